"""Quality by positive-unlabelled learning: trusted positives, all texts as unlabelled ones, an estimated class prior.

A model is linear over the bins of dense features, so with the squared loss every risk is a quadratic form of second moments.
These are added up over all documents once; the non-negative risk is then minimised on them alone, without a sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import scratch
from loomwork.llm import text as T
from loomwork.llm.language import _fold, held_out
from loomwork.llm.toxicity import _ALNUM, _LETTER, _MARK, _UPPER, _counts, _key_of, _member, isotonic

THRESHOLD = 0.7
#: Quantiles (over all documents) that cut a feature into bins; closer at the ends, where odd texts stand out.
QUANTILES = [0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5, 0.7, 0.8, 0.88, 0.92, 0.95, 0.97, 0.98, 0.99, 0.995]
#: Ridge, what the reciprocal of the number of trusted rows adds to it times, steps and step width of the risk's minimisation; bins of the scores' histograms, over scores from -SPAN to SPAN.
RIDGE, FEW, STEPS, RATE, SCORE_BINS, SPAN = 1e-3, 5.0, 200, 0.5, 1024, 3.0
FEATURES = ["words", "word_length", "word_spread", "marks", "marked_words", "mark_words", "capitals", "shouted", "digits", "repeated_words", "top_word", "repeated_pairs", "repeated_lines", "line_words", "sentence_words", "function_words", "single", "entropy", "vowels"]
# Function words.
FUNCTION_WORDS = ["the", "of", "and", "to", "a", "in", "is", "that", "it", "was", "for", "on", "with", "as", "at", "by", "from", "this", "are", "der", "die", "das", "und", "den", "von", "zu", "mit", "ein", "eine", "nicht", "im", "für", "le", "la", "les", "des", "du", "et", "un", "une", "que", "qui", "dans", "pour", "par", "sur", "est", "pas", "de", "en", "el", "los", "las", "del", "y", "se", "con", "una", "su", "al", "no", "lo"]
_FUNCTION = _key_of(FUNCTION_WORDS)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_VOWEL = np.zeros(256, bool)
_VOWEL[[ord(c) for c in "aeiouyAEIOUY"]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True
_LINE = np.zeros(256, bool)
_LINE[[10, 13]] = True


def _repeats(units: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: its distinct units, and how often the most frequent one stands in it."""
    n = len(rows) - 1
    row = np.repeat(np.arange(n), np.diff(rows))
    _, first, times = np.unique(T.mix(units) ^ T.mix(row.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, row[first], times)
    return np.bincount(row[first], minlength=n), top


def dense_features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each whole text."""
    n_rows = len(off) - 1
    starts, ends, rows = T.words(buf, off)
    n, size = np.diff(rows), np.diff(off)
    words, chars = np.maximum(n, 1), np.maximum(size, 1)
    by_row = lambda v: (lambda c: c[rows[1:]] - c[rows[:-1]])(np.concatenate([[0.0], np.cumsum(v, dtype=np.float64)]))
    share = lambda flags: _counts(flags, off[:-1], off[1:]) / chars
    low = _fold(buf)
    units = T.range_hashes(low, starts, ends)
    length = ends - starts
    mean = by_row(length) / words
    spread = np.sqrt(np.maximum(by_row(length.astype(np.float64) ** 2) / words - mean**2, 0))
    marks, alnum, upper = (_counts(x[buf], starts, ends) for x in (_MARK, _ALNUM, _UPPER))
    letters = np.maximum(_counts(_LETTER[buf], off[:-1], off[1:]), 1)
    distinct, top = _repeats(units, rows)
    pairs, pair_rows = T.window_hashes(units, rows, 2)
    distinct_pairs, _ = _repeats(pairs, pair_rows)
    n_pairs = np.maximum(np.diff(pair_rows), 1)
    line_starts, line_ends, line_rows = T.words(buf, off, _LINE)
    lines = np.maximum(np.diff(line_rows), 1)
    distinct_lines, _ = _repeats(T.range_hashes(buf, line_starts, line_ends), line_rows)
    stops = by_row(_END[buf[ends - 1]]) if len(ends) else np.zeros(n_rows)
    plain_ends = ends - (_MARK[buf[ends - 1]] if len(ends) else 0)
    function = _member(_FUNCTION, T.range_hashes(low, starts, np.maximum(plain_ends, starts))) >= 0
    held = np.bincount(np.repeat(np.arange(n_rows), size) * 256 + low, minlength=n_rows * 256).reshape(n_rows, 256) / chars[:, None]
    entropy = -(held * np.log(np.maximum(held, 1e-12))).sum(axis=1)
    return np.stack(
        [
            np.log1p(n), mean, spread, share(_MARK[buf]), by_row(marks > 1) / words, by_row(alnum == 0) / words,
            _counts(_UPPER[buf], off[:-1], off[1:]) / letters, by_row((upper > 1) & (upper * 2 > alnum)) / words, share(_DIGIT[buf]),
            np.log(words / np.maximum(distinct, 1)), top / words, 1 - np.where(np.diff(pair_rows) > 0, distinct_pairs, n_pairs) / n_pairs,
            1 - np.where(np.diff(line_rows) > 0, distinct_lines, lines) / lines, np.log(words / lines), np.log(words / np.maximum(stops, 1)),
            by_row(function) / words, by_row(length == 1) / words, entropy, _counts(_VOWEL[buf], off[:-1], off[1:]) / letters,
        ],
        axis=1,
    )


def feature_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the FEATURES of each whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = T.utf8(b.column(1))
            for at, to, part, part_off in T.pieces(buf, off):
                x = dense_features(part, part_off).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), *[pa.array(np.ascontiguousarray(c)) for c in x.T]], ["doc_id", *FEATURES])

    fields = ", ".join([f"doc_id {kind}", *[f"{c} float" for c in FEATURES]])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, fields)


def codes(batch: pa.RecordBatch, cuts: list[np.ndarray]) -> np.ndarray:
    """The bin of every feature of every row, counted on over all features; column 0 is the constant."""
    first, out = 1, [np.zeros(len(batch), np.int64)]
    for name, c in zip(FEATURES, cuts, strict=True):
        out.append(first + np.searchsorted(c, np.asarray(batch.column(batch.schema.get_field_index(name))), side="left"))
        first += len(c) + 1
    return np.stack(out, axis=1)


def width(cuts: list[np.ndarray]) -> int:
    return 1 + sum(len(c) + 1 for c in cuts)


def moments(table: DataFrame, cuts: list[np.ndarray]) -> dict[tuple[int, int], tuple[np.ndarray, int]]:
    """For each (half, trusted): the mean of the outer products of the indicator vectors, and the number of rows. Unlabelled is every row: trusted 0 holds all."""
    shared = table.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = width(shared.value)
        total = np.zeros((2, 2, d, d))
        for b in batches:
            at = codes(b, shared.value)
            half, trusted = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("half", "trusted"))
            for h in (0, 1):
                for t in (0, 1):
                    mine = at[(half == h) & (trusted >= t)]
                    for i in range(mine.shape[1]):
                        for j in range(i, mine.shape[1]):
                            lo_i, lo_j = (int(mine[:, k].min(initial=d)) for k in (i, j))
                            if not len(mine):
                                continue
                            wide = int(mine[:, j].max()) - lo_j + 1
                            got = np.bincount((mine[:, i] - lo_i) * wide + mine[:, j] - lo_j)
                            some = np.flatnonzero(got)
                            total[h, t, lo_i + some // wide, lo_j + some % wide] += got[some]
        h, t, i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)) for v in (h, t, i, j)] + [pa.array(total[h, t, i, j])], ["half", "trusted", "i", "j", "v"])

    # no more rows than four times the square of the number of bins
    got = table.mapInArrow(run, "half int, trusted int, i int, j int, v double").groupBy("half", "trusted", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    half, trusted, i, j, v = (np.asarray(got[c].combine_chunks()) for c in ("half", "trusted", "i", "j", "v"))
    d, out = width(cuts), {}
    for h in (0, 1):
        for t in (0, 1):
            m = np.zeros((d, d))
            mine = (half == h) & (trusted == t)
            m[i[mine], j[mine]] = v[mine]
            m = np.triu(m) + np.triu(m, 1).T
            out[h, t] = m / max(m[0, 0], 1), int(m[0, 0])
    return out


def pooled(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int]) -> np.ndarray:
    return (a[0] * a[1] + b[0] * b[1]) / max(a[1] + b[1], 1)


def ridge(p: np.ndarray, trusted: int) -> np.ndarray:
    return (RIDGE + FEW / trusted) * np.eye(len(p))


def times(m: np.ndarray, w: np.ndarray) -> np.ndarray:
    """m @ w without a threaded library, whose threads can block one another in a driver that shares its machine."""
    return np.einsum("ij,j->i", m, w)


def solve(m: np.ndarray, b: np.ndarray) -> np.ndarray:
    """m^-1 b by conjugate gradients; m is symmetric and, by its ridge, well above singular."""
    x, r = np.zeros(len(b)), b.copy()
    d, size = r.copy(), float((r * r).sum())
    for _ in range(4 * len(b)):
        if size <= 1e-24 * max(1.0, float((b * b).sum())):
            break
        md = times(m, d)
        a = size / float((d * md).sum())
        x, r = x + a * d, r - a * md
        before, size = size, float((r * r).sum())
        d = r + size / before * d
    return x


def contrast(p: np.ndarray, u: np.ndarray, trusted: int) -> np.ndarray:
    """The weights that tell trusted from unlabelled rows best (squared loss, both weigh the same)."""
    return solve(p + u + ridge(p, trusted), p[0] - u[0])


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """prior * R+ of positives, and what the unlabelled and the positive rows leave for the risk of negatives (may be below 0), for the loss (1 - y g)^2 / 4."""
    quad, line = lambda m: float((w * times(m, w)).sum()), lambda m: float((w * m[0]).sum())
    plus = (quad(p) - 2 * line(p) + 1) / 4
    minus = (quad(u) + 2 * line(u) + 1) / 4 - prior * (quad(p) + 2 * line(p) + 1) / 4
    return prior * plus, minus


def minimise(p: np.ndarray, u: np.ndarray, prior: float, trusted: int) -> np.ndarray:
    """Weights of least prior * R+ + max(0, R-), R- being the unbiased estimate of the negatives' risk.

    Where R- >= 0, steps go down the whole risk; where it is below 0, they only bring it back up. The first step
    from 0 is the minimum of the unbiased risk, which stays if its R- is not negative.
    """
    more = ridge(p, trusted)
    w = solve(u + more, 2 * prior * p[0] - u[0])
    if risk(w, p, u, prior)[1] >= 0:
        return w
    scale = u + prior * p + more
    held, kept = np.zeros(len(w)), 0
    for step in range(STEPS):
        up = (times(u, w) + u[0] - prior * (times(p, w) + p[0])) / 2 + times(more, w)
        g = up + prior * (times(p, w) - p[0]) / 2 if risk(w, p, u, prior)[1] >= 0 else -up
        w = w - RATE * solve(scale, g)
        if 2 * step >= STEPS:
            held, kept = held + w, kept + 1
    return held / kept


def histograms(table: DataFrame, cuts: list[np.ndarray], by_half: list[np.ndarray]) -> np.ndarray:
    """(half, trusted, bin): rows by the score that the other half's weights give them; trusted 0 holds all rows."""
    shared = table.sparkSession.sparkContext.broadcast((cuts, by_half))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, by_half = shared.value
        total = np.zeros((2, 2, SCORE_BINS), np.int64)
        for b in batches:
            at = codes(b, cuts)
            half, trusted = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("half", "trusted"))
            for h in (0, 1):
                score = score_bin(by_half[1 - h][at].sum(axis=1))
                for t in (0, 1):
                    total[h, t] += np.bincount(score[(half == h) & (trusted >= t)], minlength=SCORE_BINS)
        h, t, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)) for v in (h, t, k)] + [pa.array(total[h, t, k])], ["half", "trusted", "k", "n"])

    out = np.zeros((2, 2, SCORE_BINS))
    for r in table.mapInArrow(run, "half int, trusted int, k int, n long").groupBy("half", "trusted", "k").agg(F.sum("n").alias("n")).collect():  # 4 * SCORE_BINS rows at most
        out[r["half"], r["trusted"], r["k"]] = r["n"]
    return out


def score_bin(g: np.ndarray) -> np.ndarray:
    return np.clip((g + SPAN) / (2 * SPAN) * SCORE_BINS, 0, SCORE_BINS - 1).astype(np.int64)


def class_prior(p: np.ndarray, u: np.ndarray, sure: float = 0.1) -> float:
    """The share of positives among the unlabelled: the least ratio of the unlabelled and the trusted rows above a score.

    Above a good score there are hardly any negatives, so the ratio is the prior; of all scores the one counts whose ratio,
    with its sampling error (Dvoretzky-Kiefer-Wolfowitz) added, is lowest.
    """
    n_p, n_u = p.sum(), u.sum()
    above_p, above_u = np.cumsum(p[::-1]) / n_p, np.cumsum(u[::-1]) / n_u
    some = above_p > 0
    ratio, above_p = above_u[some] / above_p[some], above_p[some]
    error = (np.sqrt(np.log(4 / sure) / (2 * n_u)) + 1.01 * np.sqrt(np.log(4 / sure) / (2 * n_p))) / above_p
    return float(np.clip(ratio[np.argmin(ratio + error)], 0.01, 0.99))


@dataclass
class Model:
    cuts: list[np.ndarray]
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]
    prior: float

    def score(self, batch: pa.RecordBatch) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(batch), 0.5)
        g = self.weights[codes(batch, self.cuts)].sum(axis=1)
        # a thousandth is the margin itself, which orders rows of one calibrated step
        return np.clip(0.999 * np.interp(g, *self.knots) + 0.001 / (1 + np.exp(-g)), 0, 1)


def train(table: DataFrame) -> Model:
    """Learn from a table of FEATURES, half and trusted. Without trusted rows in both halves every score is 0.5."""
    cuts_at = table.agg(*[F.percentile_approx(c, QUANTILES, 2000).alias(c) for c in FEATURES]).first()
    nothing = Model([], np.zeros(0), (np.zeros(1), np.zeros(1)), 0.5)
    if cuts_at[FEATURES[0]] is None:
        return nothing
    cuts = [np.unique(np.array(cuts_at[c], np.float32)) for c in FEATURES]
    m = moments(table, cuts)
    if not (m[0, 1][1] and m[1, 1][1]):
        return nothing
    seen = histograms(table, cuts, [contrast(m[h, 1][0], m[h, 0][0], m[h, 1][1]) for h in (0, 1)])
    prior = float(np.mean([class_prior(seen[h, 1], seen[h, 0]) for h in (0, 1)]))
    seen = histograms(table, cuts, [minimise(m[h, 1][0], m[h, 0][0], prior, m[h, 1][1]) for h in (0, 1)]).sum(axis=0)
    # a score's chance of being positive is prior * (density of positives / density of all), made monotone
    some = np.flatnonzero(seen[0])
    chance = prior * seen[1, some] / seen[1].sum() / (seen[0, some] / seen[0].sum())  # above 1 by chance: cut after pooling only
    g = (some + 0.5) / SCORE_BINS * 2 * SPAN - SPAN
    at, rate = isotonic(g, chance, seen[0, some])
    return Model(cuts, minimise(pooled(m[0, 1], m[1, 1]), pooled(m[0, 0], m[1, 0]), prior, m[0, 1][1] + m[1, 1][1]), (at, np.clip(rate, 0, 1)), prior)


def score_quality(docs: DataFrame, labels: DataFrame, usable: F.Column | None = None, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, score and prior: the chance that each whole text is of good quality, and the estimated share of good ones.

    Trusted positives are the rows whose id has labels that ``usable`` (over labels) marks and that are all 1; labels of 0
    are not read as negatives. Every row is unlabelled text, its copies too. Null and empty texts are scored as texts without
    words; rows with a null id are never trusted; rows that share an id are each scored by their own text. Without
    trusted rows all scores are 0.5; an empty table gives an empty one. Other columns aren't read and may have any name.
    """
    made = feature_table(docs, id_col=id_col, text_col=text_col)
    good = labels if usable is None else labels.where(usable)
    good = good.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("least"), F.max(label_col).alias("most")).where("least = 1 and most = 1").select("doc_id", F.lit(1).alias("trusted"))
    table = made.join(good, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(0))).withColumn("half", F.pmod(F.xxhash64(F.lit(29), "doc_id", *FEATURES[:3]), F.lit(2)).cast("int"))
    table = scratch.table(table, "quality")
    model = train(table)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(b)), pa.array(np.full(len(b), shared.value.prior))], ["doc_id", "score", "prior"])

    return table.select("doc_id", *FEATURES).mapInArrow(run, f"doc_id {table.schema['doc_id'].dataType.simpleString()}, score double, prior double")


def op13_nonnegative_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = held_out(4, 2)
    return score_quality(docs, labels, ~out).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op13_nonnegative_pu_quality": op13_nonnegative_pu_quality}
