"""The pipeline's stages on a small corpus, each judged on its own input."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline as P
from loomwork.llm import mixing
from tests.llm.test_operators import brute_components, brute_spans, corpus, words

COLUMNS = list(P.COLUMNS)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rows = [(r[0], r[1], "en" if r[2] is None else r[2], r[3], r[4]) for r in corpus(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = [docs]
    for name, f in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, out[-1], "").write.parquet(path)
        out.append(spark.read.parquet(path))
    return [[tuple(r) for r in d.collect()] for d in out], out


def test_columns(stages):
    _, dfs = stages
    assert all(d.columns == COLUMNS for d in dfs[1:-1])
    assert {"doc_id", "n_tokens", "ids", "text"} <= set(dfs[-1].columns)


def test_language_keeps_what_has_letters(stages):
    rows, _ = stages
    assert {r[0] for r in rows[1]} == {r[0] for r in rows[0] if r[1] and any(c.isalpha() for c in r[1])}


def test_one_of_each_group_stays(stages):
    rows, _ = stages
    _, label = brute_components(rows[1])
    named = sorted(r[0] for r in rows[2] if r[0] is not None)
    assert named == sorted({label[r[0]] for r in rows[1] if r[0] is not None and label[r[0]] >= 0})


def test_repeated_passages_go(stages):
    rows, _ = stages
    seen, after = brute_spans(rows[2], 20), {r[0]: r[1] for r in rows[3]}
    for r in rows[2]:
        w, i = words(r[1]), -1 if r[0] is None else r[0]
        gone = {k for p in range(len(w) - 19) if min(seen[tuple(w[p : p + 20])]) < (i, p) for k in range(p, p + 20)}
        if not gone:
            assert after[r[0]] == r[1]
        elif len(gone) < len(w):
            assert after[r[0]] == " ".join(x for k, x in enumerate(w) if k not in gone)
        else:
            assert r[0] not in after


def test_tokens_decode_to_the_text(stages):
    rows, dfs = stages
    assert {r.doc_id for r in dfs[-1].collect()} <= {r[0] for r in rows[3]}
    texts = {r[0]: r[1] for r in rows[3]}
    for r in dfs[-1].collect():
        assert r.text == texts[r.doc_id] and r.n_tokens == len(r.ids)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="the driver's tables aren't here")
def test_run(spark):
    assert P.run(spark, "/root/testdata/sf0.001").count() > 0


def test_near_duplicates_judge_rows_not_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, a), (None, c), (None, c), (None, b), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, lw_key int")
    got = P.near_duplicates(spark, docs, "")
    assert got.columns == COLUMNS
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in got.collect())) == [(False, 1, a), (False, 1, b), (False, 3, ""), (True, 0, c)]
    for name, stage in P.STAGES:
        assert stage(spark, docs.where("false"), "").count() == 0, name


def test_source_mixing_copies(spark):
    """Each row as often as the SQL of mixing says, and nothing else changed."""
    rows = [(i, None if i == 3 else f"text {i} " * (i % 7), "en", ("big", "big", "small", None)[i % 4], i) for i in range(200)] + [(None, "no id", "en", "small", 5), (7, "text 7 ", "fr", "big", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = Counter(map(tuple, P.source_mixing(spark, docs, "").collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE docs (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO docs VALUES (?, ?, ?, ?, ?)", rows)
    want = Counter(con.execute(mixing.MIX_SQL.format(docs="docs") + "SELECT doc_id, text, lang, source, n_chars FROM mixed").fetchall())
    assert got == want and len(got) < len(rows) and max(got.values()) > 1
    assert P.source_mixing(spark, docs.limit(0), "").count() == 0
