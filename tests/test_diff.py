"""Diffs parsed and applied again."""

import difflib
import random

from loomwork.functions import diff


def test_round_trip(spark):
    rng = random.Random(12)
    say = lambda: rng.choice(["", "-- a", "++ b", "@ c", "x y", "--- q", "same"]) + str(rng.randint(0, 3))
    pairs = {}
    for k in range(25):
        old = [say() for _ in range(rng.randint(0, 40))]
        new = [x for x in old if rng.random() > 0.2]
        for _ in range(rng.randint(0, 5)):
            new.insert(rng.randint(0, len(new)), say())
        pairs[k] = (old, new)
    text = lambda old, new, name: list(difflib.unified_diff(old, new, f"a/{name}", f"b/{name}", lineterm="", n=2))
    # two files in each diff
    rows = [(k, "\n".join(["diff --git x y", *text(*pairs[k], f"f{k}"), *text(*reversed(pairs[k]), f"g{k}")])) for k in pairs] + [(99, None), (98, "")]
    got = {}
    for r in diff.hunk_lines(spark.createDataFrame(rows, "id int, d string"), "id", "d").collect():
        got.setdefault((r.id, r.file), []).append(r)
    for k, (old, new) in pairs.items():
        for name, a, b in ((f"f{k}", old, new), (f"g{k}", new, old)):
            seen = got.pop((k, name), [])
            assert all(a[r.old_line - 1] == r.text for r in seen if r.kind != "+") and all(b[r.new_line - 1] == r.text for r in seen if r.kind != "-")
            gone, come = {r.old_line for r in seen if r.kind == "-"}, {r.new_line: r.text for r in seen if r.kind == "+"}
            kept, out = iter(x for i, x in enumerate(a, 1) if i not in gone), []
            for i in range(1, len(a) - len(gone) + len(come) + 1):
                out.append(come[i] if i in come else next(kept))
            assert out == b
    assert not got


def test_counts_and_names(spark):
    text = "--- a/old.py\t2024\n+++ /dev/null\n@@ -3,2 +2,0 @@ def f\n-one\n--- a/trap\n\\ No newline at end of file\n--- a/n.py\n+++ b/n.py\n@@ -0,0 +1 @@\n+only"
    got = [tuple(r) for r in diff.hunk_lines(spark.createDataFrame([(1, text)], "id int, d string"), "id", "d").orderBy("hunk", "old_line").collect()]
    assert got == [(1, "old.py", 1, "-", 3, None, "one"), (1, "old.py", 1, "-", 4, None, "-- a/trap"), (1, "n.py", 2, "+", None, 1, "only")]
