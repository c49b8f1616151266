"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import text as T
from loomwork.llm.language import _fold, held_out

#: Labelled rows in the training sample; entries of the learned lexicon; trees, their depth and bins.
SAMPLE, LEXICON, TREES, DEPTH, BINS = 8000, 600, 80, 3, 48
THRESHOLD = 0.7
# Second-person words.
SECOND_PERSON = ["you", "your", "yours", "yourself", "youre", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "usted", "ustedes", "ti", "tus", "su", "vosotros"]
# Signs that stand for letters.
LOOKS_LIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
STEMS = (4, 5, 6)
FEATURES = ["words", "word_density", "stem_density", "hits", "strongest", "share_of_weight", "near_second_person", "second_person", "capitals", "shouted", "punctuation", "exclamation", "question", "obfuscated", "obfuscated_hits"]

_LEET = T.LOWER.copy()
for _k, _v in LOOKS_LIKE.items():
    _LEET[ord(_k)] = ord(_v)
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LETTER = _ALNUM.copy()
_LETTER[48:58] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = ~_ALNUM & ~T.SPACE


def _counts(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends] - total[starts]


def _cores(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words without the marks around them (words of marks only go), and the row offsets."""
    starts, ends, rows = T.words(buf, off)
    at = np.flatnonzero(_ALNUM[buf])
    if not len(at) or not len(starts):
        return starts[:0], ends[:0], np.zeros(len(off), np.int64)
    lo, hi = np.searchsorted(at, starts), np.searchsorted(at, ends)
    some = hi > lo
    kept = np.concatenate([[0], np.cumsum(some)])
    return at[lo[some]], at[hi[some] - 1] + 1, kept[rows]


def word_keys(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys (words x (whole word and each stem; 0 where the word is no longer than the stem)), starts, ends, row offsets."""
    starts, ends, rows = _cores(buf, off)
    low = _LEET[_fold(buf)]
    keys = np.zeros((len(starts), 1 + len(STEMS)), np.uint64)
    if len(starts):
        keys[:, 0] = T.range_hashes(low, starts, ends)
        for k, n in enumerate(STEMS, 1):
            longer = np.flatnonzero(ends - starts > n)
            keys[longer, k] = T.mix(T.range_hashes(low, starts[longer], starts[longer] + n) + np.uint64(k))
    return keys, starts, ends, rows


def _key_of(words: list[str]) -> np.ndarray:
    buf, off = T.utf8(pa.array(words, pa.large_string()))
    return np.sort(T.range_hashes(_LEET[_fold(buf)], off[:-1], off[1:]))


_SECOND = _key_of(SECOND_PERSON)


def _member(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where each x stands in sorted_keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == x, at, -1)


def dense_features(buf: np.ndarray, off: np.ndarray, lexicon: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; ``lexicon`` is sorted."""
    keys, starts, ends, rows = word_keys(buf, off)
    n, chars = np.diff(rows), np.diff(off)
    words, size = np.maximum(n, 1), np.maximum(chars, 1)
    by_row = lambda v: (lambda c: c[rows[1:]] - c[rows[:-1]])(np.concatenate([[0.0], np.cumsum(v, dtype=np.float64)]))
    whole = _member(lexicon, keys[:, 0])
    w_word = np.where(whole >= 0, weights[whole] if len(weights) else 0.0, 0.0)
    w_stem = np.zeros(len(keys))
    for k in range(1, keys.shape[1]):
        at = _member(lexicon, keys[:, k])
        w_stem = np.maximum(w_stem, np.where(at >= 0, weights[at] if len(weights) else 0.0, 0.0))
    hit = np.maximum(w_word, w_stem)
    row_of = np.repeat(np.arange(len(n)), n)
    strongest = np.zeros(len(n))
    some = np.flatnonzero(hit)
    np.maximum.at(strongest, row_of[some], hit[some])
    second = _member(_SECOND, keys[:, 0]) >= 0
    near = np.zeros(len(keys))
    for d in range(-3, 4):
        if d and len(keys) > abs(d):
            a, b = (slice(d, None), slice(None, -d)) if d > 0 else (slice(None, d), slice(-d, None))
            near[b] = np.maximum(near[b], second[a] & (row_of[a] == row_of[b]))
    total = ends - starts
    inner = _counts(~_LETTER[buf], starts, ends)
    odd = (inner > 0) & (inner < total)
    caps = _counts(_UPPER[buf], starts, ends)
    shout = (caps == total) & (total > 1)
    lead, end = off[:-1], off[1:]
    return np.stack(
        [
            np.log1p(n), by_row(w_word) / words, by_row(w_stem) / words, np.log1p(by_row(hit > 0)), strongest, by_row(hit) / np.sqrt(words), by_row((near > 0) * hit) / words, by_row(second) / words,
            _counts(_UPPER[buf], lead, end) / size, by_row(shout) / words, _counts(_MARK[buf], lead, end) / size, _counts(buf == ord("!"), lead, end) / size, _counts(buf == ord("?"), lead, end) / size, by_row(odd) / words, by_row(odd * hit) / words,
        ],
        axis=1,
    )


@dataclass
class Trees:
    """Boosted trees of fixed depth as arrays: node k has children 2k+1 and 2k+2."""

    base: float
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, *, rate: float = 0.15, smooth: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss over binned features."""
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(prior / (1 - prior))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin = np.full(len(x), model.base)
    inner = (1 << DEPTH) - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(x), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, width = (1 << level) - 1, 1 << level
            local = node - first
            best = np.full(width, 1e-9)
            chosen = np.full(width, -1)
            for j in range(x.shape[1]):
                m = len(cuts[j]) + 1
                if m < 2:
                    continue
                at = local * m + binned[:, j]
                gs = np.cumsum(np.bincount(at, g, width * m).reshape(width, m), axis=1)
                hs = np.cumsum(np.bincount(at, h, width * m).reshape(width, m), axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gl, hl = gs[:, :-1], hs[:, :-1]
                gain = gl**2 / (hl + smooth) + (ga - gl) ** 2 / (ha - hl + smooth) - ga**2 / (ha + smooth)
                gain[(hl < 0.5) | (ha - hl < 0.5)] = 0
                top = gain.argmax(axis=1)
                better = np.flatnonzero(gain[np.arange(width), top] > best)
                best[better] = gain[better, top[better]]
                feature[first + better], cut[first + better], chosen[better] = j, cuts[j][top[better]], top[better]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + smooth)
        model.feature.append(feature)
        model.cut.append(cut)
        model.value.append(value)
        margin += value[leaf]
    return model


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: margins and the nondecreasing rates at them."""
    order = np.argsort(margin, kind="stable")
    weight = np.ones(len(y)) if weight is None else weight
    blocks: list[list[float]] = []  # sum, weight, first margin, last margin
    for m, v, n in zip(margin[order], y[order], weight[order], strict=True):
        blocks.append([float(v * n), float(n), float(m), float(m)])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            s, c, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += c
            blocks[-1][3] = last
    xs = np.array([m for b in blocks for m in (b[2], b[3])])
    return xs, np.repeat(np.array([b[0] / b[1] for b in blocks]), 2)


@dataclass
class Model:
    lexicon: np.ndarray
    weights: np.ndarray
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    rate: float

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The calibrated rate, and the trees' own margin, by which texts of equal rates can be told apart."""
        if self.trees is None:
            return np.full((2, len(off) - 1), [[self.rate], [0.0]])
        m = self.trees.margin(dense_features(buf, off, self.lexicon, self.weights))
        return np.stack([np.clip(np.interp(m, *self.knots), 0, 1), m])


def _feature_rows(sample: DataFrame, lexicon: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shared = sample.sparkSession.sparkContext.broadcast((lexicon, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = T.utf8(b.column(0))
            for at, to, part, part_off in T.pieces(buf, off):
                x = dense_features(part, part_off, *shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1).slice(at, to - at)], ["x", "toxic"])

    got = sample.select("text", "toxic").mapInArrow(run, "x array<double>, toxic int").collect()
    got = sorted((tuple(r["x"]), r["toxic"]) for r in got)
    return np.array([x for x, _ in got]).reshape(-1, len(FEATURES)), np.array([y for _, y in got], dtype=np.float64)


def _learn_lexicon(sample: DataFrame, positives: int, negatives: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and stems whose presence speaks for the label beyond chance, with their log-odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = T.utf8(b.column(0))
            label = np.asarray(b.column(1), dtype=np.int64)
            for at, to, part, part_off in T.pieces(buf, off):
                keys, _, _, rows = word_keys(part, part_off)
                row = np.repeat(np.arange(to - at), np.diff(rows))
                flat, of = keys.ravel(), np.repeat(row, keys.shape[1])
                flat, of = flat[flat != 0], of[flat != 0]
                order = np.lexsort((of, flat))
                flat, of = flat[order], of[order]
                fresh = np.ones(len(flat), bool)
                fresh[1:] = (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])
                flat, of = flat[fresh], of[fresh]
                uniq, first = np.unique(flat, return_index=True)
                pos = np.add.reduceat(label[at:to][of], first) if len(first) else np.zeros(0, np.int64)
                size = np.diff(np.append(first, len(flat)))
                yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(pos), pa.array(size - pos)], ["key", "pos", "neg"])

    seen = sample.select("text", "toxic").mapInArrow(run, "key long, pos long, neg long").groupBy("key").agg(F.sum("pos").cast("double").alias("pos"), F.sum("neg").cast("double").alias("neg"))
    seen = seen.where(F.col("pos") >= 3)
    p, q = (F.col("pos") + 0.5) / (positives + 1), (F.col("neg") + 0.5) / (negatives + 1)
    prior = positives / (positives + negatives)
    n = F.col("pos") + F.col("neg")
    g = 2 * (F.col("pos") * F.ln(F.col("pos") / (n * prior)) + F.when(F.col("neg") > 0, F.col("neg") * F.ln(F.col("neg") / (n * (1 - prior)))).otherwise(0.0))
    top = seen.withColumn("w", F.ln(p / q)).withColumn("g", g).where((F.col("w") > 1.5) & (F.col("g") > 15)).orderBy(F.desc("g"), "key").limit(LEXICON).collect()
    keys = np.array([r["key"] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r["w"] for r in top], dtype=np.float64)[order]


def train(docs: DataFrame, labels: DataFrame, usable: F.Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from a bounded sample of the labelled rows that ``usable`` marks; texts stay on the executors.

    Half of the sample learns the lexicon and the trees that score the other half, and the other way round; these held
    scores set the calibration. Without both labels in each half, the score is the rate of label 1.
    """
    picked = labels.where(usable & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("lw_id"), F.col(label_col).cast("int").alias("toxic"), F.xxhash64(F.lit(23), id_col).alias("o"))
    picked = picked.orderBy("o", "lw_id").limit(SAMPLE)
    rows = docs.select(F.col(id_col).alias("lw_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "lw_id")  # at most SAMPLE rows
    from loomwork.llm import scratch

    # of texts that share an id one counts, so the sample is bounded whatever docs holds
    rows = rows.groupBy("lw_id", "toxic", "o").agg(F.min("text").alias("text"))
    rows = scratch.table(rows.withColumn("half", F.pmod("o", F.lit(2)).cast("int")).select("text", "toxic", "half"), "toxicity")
    counts = {(r["half"], r["toxic"]): r["n"] for r in rows.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    rate = sum(n for (_, y), n in counts.items() if y) / total if total else 0.0
    empty = np.zeros(0, np.uint64), np.zeros(0)
    if any(counts.get((h, y), 0) < 2 for h in (0, 1) for y in (0, 1)):
        return Model(*empty, None, None, float(rate))
    margins, truth = [], []
    for h in (0, 1):
        mine, other = rows.where(F.col("half") == h), rows.where(F.col("half") == 1 - h)
        lexicon = _learn_lexicon(mine, counts[h, 1], counts[h, 0])
        trees = boost(*_feature_rows(mine, *lexicon))
        x, y = _feature_rows(other, *lexicon)
        margins.append(trees.margin(x))
        truth.append(y)
    lexicon = _learn_lexicon(rows, counts[0, 1] + counts[1, 1], counts[0, 0] + counts[1, 0])
    trees = boost(*_feature_rows(rows, *lexicon))
    return Model(*lexicon, trees, isotonic(np.concatenate(margins), np.concatenate(truth)), float(rate))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The calibrated score of each whole text, and the margin that it comes from. Null and empty texts are scored as texts without words; rows aren't
    moved or joined, so repeated rows, null ids and empty tables need no care."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = T.utf8(b.column(1))
            out = [shared.value.score(part, part_off) for _, _, part, part_off in T.pieces(buf, off)]
            got = np.concatenate([*out, np.zeros((2, 0))], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got[0]), pa.array(got[1])], ["doc_id", "score", "margin"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, margin double")


def op6_gbt_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = held_out(3, 1)
    model = train(docs, labels, ~out)
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "margin")


QUERIES = {"op6_gbt_toxicity": op6_gbt_toxicity}
