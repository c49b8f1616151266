"""Positive-unlabelled quality against risks, moments and priors worked out row by row."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomwork.llm import quality, text

GOOD = "the river ran by the old mill and of all towns it was near to the sea".split()


def say(rng, good, n=None):
    n = n or rng.randint(15, 120)
    if good:
        return " ".join(rng.choice(GOOD) + rng.choice(["", "", "s", "ly", "."]) for _ in range(n))
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(rng.choice(GOOD).upper() + "!!!" for _ in range(n))
    if kind == 1:
        return " ".join([rng.choice(GOOD)] * n)
    return " | ".join(rng.choice(GOOD) + "&&&" for _ in range(n))


def test_features_of_odd_texts():
    buf, off = text.utf8(pa.array([None, "", "  \n", "A b. a", "x" * 5000, "l1 a\nl1 a\nl2"], pa.string()))
    x = quality.dense_features(buf, off)
    assert x.shape == (6, len(quality.FEATURES)) and np.isfinite(x).all()
    assert (x[0] == x[1]).all()
    at = quality.FEATURES.index
    assert np.isclose(x[3, at("words")], np.log(4)) and np.isclose(x[3, at("top_word")], 2 / 3) and np.isclose(x[3, at("capitals")], 1 / 3)
    assert np.isclose(x[5, at("repeated_lines")], 1 / 3) and np.isclose(x[5, at("repeated_words")], np.log(5 / 3))


def test_moments_and_risk(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, len(quality.FEATURES))).astype(np.float32)
    half, trusted = rng.integers(0, 2, 200), rng.integers(0, 2, 200)
    df = spark.createDataFrame([(i, *map(float, r), int(h), int(t)) for i, (r, h, t) in enumerate(zip(x, half, trusted, strict=True))], ", ".join(["doc_id long", *[f"{c} float" for c in quality.FEATURES], "half int", "trusted int"])).repartition(3)
    cuts = [np.array([-0.5, 0.7], np.float32) for _ in quality.FEATURES]
    got = quality.moments(df, cuts)
    phi = np.zeros((200, quality.width(cuts)))
    phi[:, 0] = 1
    for j in range(x.shape[1]):
        phi[np.arange(200), 1 + 3 * j + (x[:, j] > -0.5) + (x[:, j] > np.float32(0.7))] = 1
    for h in (0, 1):
        for t in (0, 1):
            mine = phi[(half == h) & (trusted >= t)]
            assert got[h, t][1] == len(mine) and np.allclose(got[h, t][0], mine.T @ mine / len(mine))
    w, p, u = rng.normal(size=phi.shape[1]), phi[trusted == 1], phi
    plus, minus = quality.risk(w, p.T @ p / len(p), u.T @ u / len(u), 0.6)
    loss = lambda m, y: ((1 - y * (m @ w)) ** 2 / 4).mean()
    assert np.isclose(plus, 0.6 * loss(p, 1)) and np.isclose(minus, loss(u, -1) - 0.6 * loss(p, -1))


def test_negative_risk_is_brought_back():
    rng = np.random.default_rng(5)
    p = np.c_[np.ones(12), rng.integers(0, 2, (12, 15))]  # few rows: the unbiased risk overfits
    u = np.c_[np.ones(40), rng.integers(0, 2, (40, 15))]
    mp, mu = p.T @ p / 12, u.T @ u / 40
    free = np.linalg.solve(mu + quality.ridge(mp, 10**9), 2 * 0.9 * mp[0] - mu[0])
    w = quality.minimise(mp, mu, 0.9, 10**9)
    free_minus, minus = quality.risk(free, mp, mu, 0.9)[1], quality.risk(w, mp, mu, 0.9)[1]
    assert free_minus < 0 and minus > free_minus and abs(minus) < 0.05
    total = lambda v: (lambda a, b: a + max(0.0, b))(*quality.risk(v, mp, mu, 0.9))
    assert total(w) <= total(np.zeros(16))


def test_prior_of_a_mixture():
    rng = np.random.default_rng(7)
    for prior in (0.3, 0.8):
        draw = lambda n, good: quality.score_bin(rng.normal(0.8 if good else -0.8, 0.5, n))
        p = np.bincount(draw(20_000, True), minlength=quality.SCORE_BINS)
        n = int(50_000 * prior)
        u = np.bincount(np.concatenate([draw(n, True), draw(50_000 - n, False)]), minlength=quality.SCORE_BINS)
        assert abs(quality.class_prior(p.astype(float), u.astype(float)) - prior) < 0.04


def test_quality(spark):
    rng = random.Random(11)
    data = [(i, say(rng, i % 4 != 0)) for i in range(1600)]
    data += [(5000, None), (5001, ""), (5002, say(rng, True, 20_000)), (None, say(rng, True, 50)), (None, None), data[1], (7, "again " + say(rng, True, 40))]
    docs = spark.createDataFrame([(i, t, "x", 1.0, 3) for i, t in data], "doc_id long, text string, trusted string, score double, half int").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 1600, 2)] + [(i, 1, 0) for i in range(1, 1600, 6)] + [(None, 1, 0), (2, 1, 0)], "doc_id long, quality int, trusted int")
    out = quality.held_out(4, 2)
    got = quality.score_quality(docs, labels, ~out).select("*", out.alias("h")).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.h and r.doc_id is not None and r.doc_id < 1600]
    assert len(held) > 200 and np.mean([(r.score >= quality.THRESHOLD) == (r.doc_id % 4 != 0) for r in held]) > 0.97
    assert 0.6 < got[0].prior < 0.9
    flipped = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))  # held-out labels play no part
    again = quality.score_quality(docs, flipped, ~out).collect()
    key = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in rows)
    assert key(again) == key(got)


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score_quality(docs, labels).collect()] == [0.5, 0.5]
    assert quality.score_quality(docs.limit(0), labels).count() == 0
