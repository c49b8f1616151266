"""Source divergence against Python integers, with small blocks, chunks and stripes."""

import random
import re
from collections import Counter, defaultdict

import pytest

from loomwork.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def plain(rows, least, top):
    docs = [(lang or "", source or "", TERM.findall((t or "").translate(LOWER))) for t, lang, source in rows]
    in_docs, count, lang_count, groups = Counter(), defaultdict(Counter), defaultdict(Counter), {(a, b) for a, b, _ in docs}
    for lang, _, ts in docs:
        in_docs.update((lang, t) for t in set(ts))
    keep = {k for k, n in in_docs.items() if n >= least}
    for lang, source, ts in docs:
        ts = [t for t in ts if (lang, t) in keep]
        count[lang, source].update(ts)
        lang_count[lang].update(ts)
    share = lambda c, terms: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(terms)) for t in terms}
    out = set()
    for lang, source in groups:
        terms = [t for lg, t in keep if lg == lang]
        p, q = share(count[lang, source], terms), share(lang_count[lang], terms)
        pairs = []
        for lg, other in groups:
            if lg == lang and other != source:
                r = share(count[lg, other], terms)
                pairs.append((-sum(abs(p[t] - r[t]) for t in terms), other.encode(), other))
        out |= {(lang, source, "pair", s, -v, k) for k, (v, _, s) in enumerate(sorted(pairs), 1)}
        more = sorted((q[t] - p[t], t.encode(), t) for t in terms if count[lang, source][t] and p[t] > q[t])
        out |= {(lang, source, "term", t, -v, k) for k, (v, _, t) in enumerate(more[:top], 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abCéß中x") for _ in range(rng.randint(1, 4))) for _ in range(120)]
    say = lambda k: rng.choice([" ", "-", "1", "\n"]).join(rng.choice(vocab[: rng.randint(1, 120)]) for _ in range(k))
    sources = [*"abcdefghij", "é", "", None]
    out = [(say(rng.randint(1, 60)), ("en", "en", "fr", None)[i % 4], rng.choice(sources[:3] + sources)) for i in range(400)]
    out += [(None, "en", "only null"), ("", "xx", "a"), ("12 !!", "xx", "b"), ("rare", "xx", "c"), (say(20_000), "en", "a"), out[5], out[5]]
    return out


@pytest.mark.parametrize(("block", "chunk", "stripe", "at_once"), [(48, 1 << 16, 64, 16 << 20), (3, 40, 2, 500)])
def test_divergence(spark, rows, monkeypatch, block, chunk, stripe, at_once):
    for name, v in (("BLOCK", block), ("CHUNK", chunk), ("STRIPE", stripe), ("TEXT_AT_ONCE", at_once)):
        monkeypatch.setattr(divergence, name, v)
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "text string, lang string, source string, gid int, term string, value double").repartition(3)
    got = divergence.source_divergence(df, least_docs=12, top=7)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, 12, 7))


def test_nothing_kept_and_empty(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    got = divergence.source_divergence(df, least_docs=10**6).collect()
    assert {(r.part, r.value) for r in got} == {("pair", 0)} and sorted(map(tuple, got)) == sorted(plain(rows, 10**6, 50))
    assert divergence.source_divergence(df.limit(0)).count() == 0


def test_shares_of_large_counts():
    import numpy as np

    counts = [0, 7, 10**12, 8 * 10**14]
    assert divergence.shares(np.array(counts), 8 * 10**14, 10**6).tolist() == [1 + 10**9 * (c + 5) // (8 * 10**14 + 5 * 10**6) for c in counts]
