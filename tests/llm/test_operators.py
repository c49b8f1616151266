"""The operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwork.llm import bpe, components, fingerprints, jaccard, language, mixing, sharding, substrings, suffixes, text, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, name string, id string, size long"


def corpus(seed=1, n=60):
    """Copies, near copies, shared passages, repeated lines, nulls, empties, one long text, a repeated row and a null id."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéñü") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, line = say(40), say(22)
    texts = []
    for i in range(n):
        t = say(rng.randint(0, 60))
        if i % 5 == 0:
            t = f"{t} {passage}\n{say(8)}"
        if i % 7 == 0:
            t = f"{line}\n{t}\n{line}"
        if i % 6 == 1 and texts:
            t = texts[-1]
        if i % 6 == 2 and texts:
            w = texts[-1].split(" ")
            w[rng.randrange(len(w))] = "edit"
            t = " ".join(w)
        texts.append(t)
    texts += [None, "", "   \n ", "one two", "ONE two", "a", "a", say(6000), "<|endoftext|> it's  'll \t\n x", "123 !!! \U0001f600 中文"]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("big", "big", "small", None)[i % 4], len(t or ""), 1, "x", "y", 2) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[3], (None, "lost id text here now", "en", "big", 5, 1, "x", "y", 2)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_word_and_window_hashes():
    buf, off = text.utf8(pa.array(["a b c", None, "", "b c", " a  b"], pa.string()))
    starts, ends, at = text.words(buf, off)
    assert [buf[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == ["a", "b", "c", "b", "c", "a", "b"]
    h, o = text.window_hashes(text.range_hashes(buf, starts, ends), at, 2)
    assert o.tolist() == [0, 2, 2, 2, 3, 4] and h[0] == h[3] and h[1] == h[2] and h[0] != h[1]


def test_language(spark, empty):
    rng = random.Random(2)
    kinds = {"en": "the ing tion and er ed".split(), "fr": "eau oir que les ai ent".split()}
    make = lambda lang, k: " ".join("".join(rng.choice(kinds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(k))
    data = [(i, make(("en", "fr")[i % 2], rng.randint(5, 80)), ("en", "fr")[i % 2]) for i in range(300)] + [(900, None, "en"), (901, "123 !!", "fr"), (902, "", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    out = language.held_out(4, 2)
    got = {r.doc_id: r for r in language.identify(df, usable=~out).select("doc_id", out.alias("h"), "lang_pred", "score").collect()}
    held = [i for i, r in got.items() if r.h and i < 300]
    assert held and np.mean([got[i].lang_pred == ("en", "fr")[i % 2] for i in held]) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(empty).count() == 0
    assert language.identify(df.where("false").union(df.where("doc_id = 3").withColumn("lang", F.lit(None)))).first().lang_pred == "und"


def test_language_learns_from_short_texts(spark):
    """Labelled texts all under a segment, two of the languages in one unspaced word; and a short language among long ones."""
    rng = random.Random(3)
    kinds = {"en": "the ing tion and er ed".split(), "fr": "eau oir que les ai ent".split(), "de": "sch ung ich der ein ver".split(), "zh": list("的一是不了人我在有他"), "th": list("กขคงจชซญดต")}
    langs = list(kinds)

    def make(lang, words):
        if lang in ("zh", "th"):
            return "".join(rng.choice(kinds[lang]) for _ in range(5 * words))
        return " ".join("".join(rng.choice(kinds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))

    for longest in (20, 300):  # the second time en, fr and de are long
        texts = [(lang, make(lang, rng.randint(3, longest if lang in ("en", "fr", "de") else 20))) for lang in langs * 120]
        data = [(i, text, lang if i < 400 else None) for i, (lang, text) in enumerate(texts)]
        df = spark.createDataFrame(data, "doc_id long, text string, lang string")
        got = {r.doc_id: r for r in language.identify(df).collect()}
        for k, lang in enumerate(langs):
            new = [got[i] for i in range(400, 600) if i % 5 == k]
            assert np.mean([r.lang_pred == lang for r in new]) > 0.9, (longest, lang)
            assert np.mean([r.score for r in new]) > 0.4, (longest, lang)


def test_language_learns_every_language(spark):
    """More than a hundred languages, and one that only has long texts."""
    rng = random.Random(6)
    langs = [f"l{i:03d}" for i in range(119)] + ["long"]
    kinds = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(6)] for x in langs}
    make = lambda x, k: " ".join(rng.choice(kinds[x]) for _ in range(k))
    data = [(i, make(x, 1500 if x == "long" else 12), x) for i, x in enumerate(langs * 6)]
    data += [(10_000 + i, make(x, 12), None) for i, x in enumerate(langs)]
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    right = [got[10_000 + i] == x for i, x in enumerate(langs)]
    assert np.mean(right) > 0.95 and right[-1], right


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    e, a, at = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), np.array([0, 4, 4, 7])
    got = language.forward_backward(e.copy(), at, a)
    for r in range(3):
        x, want = e[at[r] : at[r + 1]], np.zeros(3)
        n, total = len(x), 0.0
        for path in np.ndindex(*[3] * n) if n else []:
            p = np.exp(sum(x[t, k] for t, k in enumerate(path)) + sum(a[i, j] for i, j in zip(path, path[1:])))  # noqa: B905
            total += p
            for k in path:
                want[k] += p
        assert got[r] == pytest.approx(want / total if n else want, abs=1e-6)


def test_poisson(spark, docs, rows, empty):
    got = mixing.poisson_mix(docs.select("doc_id", "text", "source"), epochs=1.5).collect()
    again = mixing.poisson_mix(docs.repartition(1).select("doc_id", "text", "source"), epochs=1.5)
    assert Counter(map(str, got)) == Counter(map(str, again.collect()))
    for r in got:
        assert 0 <= r.lw_copy < r.lw_copies
    wide = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    n = {r.source: r["count"] for r in mixing.poisson_mix(wide, weights={"a": 0.5, "b": 0.5}).groupBy("source").count().collect()}
    assert n["a"] == pytest.approx(10_000, rel=0.03) and n["b"] == pytest.approx(10_000, rel=0.03)
    assert mixing.poisson_mix(empty).count() == 0
    assert mixing.poisson_mix(wide, weights={}).count() == 0


def brute_components(rows):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for r in rows:
        w = words((r[1] or "").translate(fold))
        s = frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])  # noqa: B905
        sets.setdefault(-1 if r[0] is None else r[0], set()).add(s)
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if label[i] > label[j] and any(s and 100 * len(s & t) >= 75 * len(s | t) for s in sets[i] for t in sets[j]):
                    label[i], changed = label[j], True
    return sets, label


@pytest.mark.parametrize(("frequent", "small"), [(64, 4), (2, 1)])
def test_jaccard(spark, docs, rows, empty, monkeypatch, frequent, small):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "SMALL_GROUP", small)
    sets, label = brute_components(rows)
    got = jaccard.similarity_components(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        i = -1 if r.doc_id is None else r.doc_id
        assert r.n_shingles in {len(s) for s in sets[i]}
        assert (-1 if r.component_id is None else r.component_id) == label[i]
    if frequent == 64:
        assert jaccard.similarity_components(empty).count() == 0


@pytest.mark.parametrize("frequent", [400, 360, 250, 60])
def test_pair_signatures_lose_no_pair(frequent):
    """Sets of frequent tokens alone, and with rare ones: whoever is similar enough shares a signature in roles that meet."""
    rng = random.Random(4)
    pool = [rng.getrandbits(60) for _ in range(400)]
    common = np.unique(jaccard.classes(np.array(pool[:frequent], np.uint64), 64))
    for _ in range(150):
        n = rng.randint(2, 120)
        x = rng.sample(pool, n)
        y = x[: max(1, int(n * rng.uniform(0.7, 1)))] + rng.sample(pool, rng.randint(0, n // 5))
        x, y = sorted(set(x)), sorted(set(y))
        both = len(set(x) & set(y))
        if 4 * both < 3 * (len(x) + len(y) - both) or x == y:
            continue
        h = np.array(x + y, np.uint64)
        name, row, place, role, rare = jaccard.signatures(h, np.array([0, len(x), len(x) + len(y)]), common, np.ones(len(common), np.int64), 64)
        size = np.array([len(x), len(y)])
        hit = False
        for i in np.flatnonzero(row == 0):
            for j in np.flatnonzero((row == 1) & (name == name[i])):
                a, b = (i, j) if size[0] <= size[1] else (j, i)
                ok = jaccard.can_link(*[np.array([v]) for v in (size[row[a]], rare[row[a]], place[a], role[a], size[row[b]], rare[row[b]], place[b], role[b])])[0]
                if size[0] == size[1]:
                    ok |= jaccard.can_link(*[np.array([v]) for v in (size[row[b]], rare[row[b]], place[b], role[b], size[row[a]], rare[row[a]], place[a], role[a])])[0]
                hit |= bool(ok)
        assert hit, (len(x), len(y), both)


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 9), (3, 1), (2, 2)], "a long, b long")
    assert {tuple(r) for r in components.components(links).collect()} == {(5, 1), (4, 1), (3, 1), (1, 1), (9, 7), (8, 7), (7, 7)}
    assert components.components(links.where("false")).count() == 0


def test_bpe(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_tokenizer())
    got = bpe.encode_decode(docs, bpe.default_tokenizer(), ("n_tokens", "ids", "ids_sha256", "decoded"), keep=("doc_id", "size"))
    assert got.columns == ["doc_id", "size", "n_tokens", "ids", "ids_sha256", "decoded"]
    want = {r[0]: (t.encode(r[1] or "", add_special_tokens=False).ids, r[1] or "") for r in rows}
    for r in got.collect():
        ids, back = want[r.doc_id]
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == back
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode_decode(empty, bpe.default_tokenizer()).count() == 0


def test_bpe_on_odd_strings():
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(bpe.default_tokenizer()), bpe.Codec(bpe.load_spec(bpe.default_tokenizer()))
    rng = random.Random(5)
    alphabet = list("ab  \n\t'sretvmdlé中\U0001f600.,!12  ") + ["<|endoftext|>", "the", "tion", "<|", "'ll"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for text_, want in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert c.encode_one(text_.encode()) == want.ids


def test_topk(spark):
    rng = np.random.default_rng(3)
    vecs = [(i, [float(x) for x in rng.normal(size=6)], "q") for i in range(120)] + [(200 + i, [0.5] * 6, "q") for i in range(30)]
    bad = [(900, None, "q"), (901, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], "q"), (902, [None, 1.0, 0.0, 0.0, 0.0, 0.0], "q"), (None, [1.0] * 6, "q"), (903, [1.0, 2.0], "q"), (904, [], "q")]
    df = spark.createDataFrame([*vecs, *bad], "vec_id long, embedding array<double>, q string")
    got = {}
    for r in topk.exact_topk(df, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ints = {i: np.floor(256 * np.array(v)).astype(int) for i, v, _ in vecs}
    for q in [i for i in ints if i % 10 == 0]:
        best = sorted(((-int(ints[q] @ v), i) for i, v in ints.items() if i != q))[:5]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert 900 not in got
    assert topk.exact_topk(df.where("false"), F.lit(True)).count() == 0


def test_toxicity(spark, empty):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(200)]
    bad = ["grubling", "snarfed", "blorpish"]
    data, labels = [], []
    for i in range(900):
        w = [rng.choice(vocab) for _ in range(rng.randint(10, 60))]
        if i % 5 == 0:
            w[1:1] = [rng.choice(bad).capitalize() + ",", "you", rng.choice(bad)]
        data.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    data += [(5000, None), (5001, "")]
    d, y = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = language.held_out(3, 1)
    m = toxicity.train(d, y, ~out)
    got = {r.doc_id: r for r in toxicity.score(d, m).select("doc_id", out.alias("h"), "score").collect()}
    held = [i for i, r in got.items() if r.h and i < 900]
    assert held and np.mean([(got[i].score >= 0.7) == (i % 5 == 0) for i in held]) > 0.98
    assert len(got) == 902 and all(0 <= r.score <= 1 for r in got.values()) and got[5001].score < 0.7
    assert toxicity.score(empty, toxicity.train(empty, y.where("false"), F.lit(True))).count() == 0


def test_isotonic_is_monotone():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 0]))
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all()


def brute_spans(rows, window):
    by, seen = {}, {}
    for r in rows:
        by.setdefault(-1 if r[0] is None else r[0], set()).add(r[1])
    for i, ts in by.items():
        for t in ts:
            w = words(t)
            for p in range(len(w) - window + 1):
                seen.setdefault(tuple(w[p : p + window]), set()).add((i, p))
    return seen


@pytest.mark.parametrize("window", [20, 8, 5])
def test_substrings(docs, rows, empty, window):
    seen = brute_spans(rows, window)
    for r in substrings.remove_repeats(docs, window, ("kept", "kept_sha256")).collect():
        w, i = words(r.text), -1 if r.doc_id is None else r.doc_id
        gone = {k for p in range(len(w) - window + 1) if min(seen[tuple(w[p : p + window])]) < (i, p) for k in range(p, p + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (r.lw_n_words, r.lw_n_removed) == (len(w), len(gone))
        assert r.lw_kept == (None if r.text is None else kept) and r.lw_kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        assert r.bucket == 1 and r["name"] == "x"
    assert substrings.remove_repeats(empty, window).count() == 0


def test_suffix_array():
    rng = random.Random(7)
    for k in range(1500):
        t = [rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(0, 50))]
        t = (t[:4] * 12 if k % 3 == 0 else t) + [0]
        assert suffixes.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_suffixes(docs, rows, empty):
    texts = {}
    for r in rows:
        texts.setdefault(-1 if r[0] is None else r[0], set()).add((r[1] or "").encode())
    first = {}
    for i, ts in texts.items():
        for b in ts:
            for s in range(len(b) - 49):
                first[b[s : s + 50]] = min(first.get(b[s : s + 50], i), i)
    by = {}
    for r in suffixes.remove_shared(docs, ("kept", "kept_sha256")).collect():
        by.setdefault(r.doc_id, []).append(r)
    for r in rows:
        i, b = -1 if r[0] is None else r[0], (r[1] or "").encode()
        g = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                g[s : s + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1]))
        kept = bytes(x for x, y in zip(b, g, strict=True) if not y)
        assert any((x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) == (len(b), sum(g), spans, kept) for x in by[r[0]])
    assert suffixes.remove_shared(empty).count() == 0


def test_sharding(spark, docs, rows, empty):
    hot = spark.createDataFrame([(i, "same hot text" if i % 3 == 0 else f"text {i} " * (i % 9)) for i in range(3000)], "doc_id long, text string")
    got = sharding.vector_shards(hot).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r["size"]
    assert max(size.values()) < 1.03 * min(size.values())
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    cold = Counter((r.text_crc32, r.shard) for r in got if r["size"] != 14)
    assert max(Counter(c for c, _ in cold).values()) == 1  # equal texts stay together
    assert sharding.vector_shards(docs).count() == len(rows) and sharding.vector_shards(empty).count() == 0


def test_fingerprints(spark, docs, rows, empty):
    got = {}
    for r in fingerprints.fingerprint(docs).collect():
        got.setdefault(r.doc_id, set()).add(r.fingerprint)
    same = {}
    for r in rows:
        same.setdefault(r[1] or "", set()).update(got[r[0]])
    assert all(len(v) == 1 for v in same.values())
    assert got[next(r[0] for r in rows if r[1] == "")] == {""}
    a = [f"w{i}" for i in range(400)]
    pair = spark.createDataFrame([(" ".join(a), " ".join(a[:300] + [f"x{i}" for i in range(100)]))], "a string, b string")
    f = fingerprints.with_likeness(fingerprints.with_fingerprint(fingerprints.with_fingerprint(pair, "a", "fa"), "b", "fb"), "fa", "fb", "near")
    assert f.first().near == pytest.approx(296 / 496, abs=0.12)
    nxt = fingerprints.with_next(docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["text"])
    order = sorted({r[0]: r[1] or "" for r in rows if r[0] is not None}.items(), reverse=True)
    want = {a[0]: b[1] for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert {r.doc_id: r.next_text for r in nxt.collect()} == want
    assert fingerprints.fingerprint(empty).count() == 0
