"""Language ID: a linear-chain conditional random field labels each word, and the words' posteriors decide.

Words have affix, character n-gram, whole-word and lexicon features; labels have learned transitions.
Forward-backward gives every word's posterior, also in text that switches between languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import text as T

#: Labelled texts in the training sample, over all languages (20 of each at least), and characters taken of each.
SAMPLE, SAMPLE_CHARS = 2000, 8000
#: Rows of the hashed weight table, words of a training segment, words of a forward-backward group.
TABLE, SEGMENT, GROUP = 1 << 16, 32, 1 << 20
#: Share of the training segments that go on in another text, so that transitions see languages switch.
SWITCHED = 0.25
#: n-grams times languages that a training step holds at once; unspaced words have very many n-grams.
STEP_GRAMS = 1 << 23
#: Words of the sample that name a language by themselves: at least so often, and in so large a share.
LEXICON_COUNT, LEXICON_SHARE, LEXICON_SIZE = 8, 0.9, 4096
UNKNOWN = "und"


def _fold(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin-1 letters, on UTF-8 bytes."""
    out = T.LOWER[buf]
    if len(out) > 1:
        upper = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)) + 1
        out[upper] += 0x20
    return out


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of the rows: fixed features (words x kinds), n-gram features with their counts, word hashes, row offsets."""
    low = _fold(buf)
    starts, ends, rows = T.words(low, off)
    n = ends - starts
    slots = np.uint64(TABLE - 1)
    if not len(starts):
        return np.zeros((0, 6), np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64), rows
    wide = np.concatenate([low, np.zeros(4, np.uint8)]).astype(np.uint64)
    head = [np.where(n > k, wide[starts + k], 0) for k in range(4)]
    tail = [np.where(n > k, wide[np.maximum(ends - 1 - k, 0)], 0) for k in range(4)]
    h = T.range_hashes(low, starts, ends)
    pack = lambda xs, salt: sum(x << np.uint64(8 * k) for k, x in enumerate(xs)) + (np.uint64(salt) << np.uint64(40))
    kinds = [pack(head[:2], 1), pack(head[:3], 2), pack(head, 3), pack(tail[:2], 4), pack(tail[:3], 5)]
    fixed = np.stack([*[(T.mix(x) & slots).astype(np.int32) for x in kinds], ((h >> np.uint64(7)) & slots).astype(np.int32)], axis=1)
    grams = np.maximum(n - 2, 0)
    at = T.take_ranges(starts, grams)
    gram = wide[at] | wide[at + 1] << np.uint64(8) | wide[at + 2] << np.uint64(16)
    return fixed, (((gram + np.uint64(6 << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int32), grams, h, rows


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # TABLE x languages
    transitions: np.ndarray  # languages x languages
    lexicon: np.ndarray  # sorted word hashes
    lexicon_lang: np.ndarray
    lexicon_weights: np.ndarray  # languages of the lexicon x languages

    def emissions(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fixed, gram, grams, h, rows = features(buf, off)
        return self.score(fixed, gram, grams, h), rows

    def in_lexicon(self, h: np.ndarray) -> np.ndarray:
        """The language that the lexicon has for each word, or -1."""
        if not len(self.lexicon):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == h, self.lexicon_lang[at], -1)

    def score(self, fixed: np.ndarray, gram: np.ndarray, grams: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = self.weights[fixed[:, 0]].copy()
        for k in range(1, fixed.shape[1]):
            out += self.weights[fixed[:, k]]
        if len(gram):
            some = np.flatnonzero(grams)
            first = np.cumsum(grams)[some] - grams[some]
            out[some] += np.add.reduceat(self.weights[gram], first, axis=0)
        lex = self.in_lexicon(h)
        hit = np.flatnonzero(lex >= 0)
        out[hit] += self.lexicon_weights[lex[hit]]
        return out


def forward_backward(e: np.ndarray, rows: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Sum of the words' posteriors for each row; all rows step together, the longest first in line."""
    n = np.diff(rows)
    out = np.zeros((len(n), e.shape[1]))
    if not n.sum():
        return out
    line = np.argsort(-n, kind="stable")
    n, base = n[line], rows[:-1][line]
    e = np.exp(e - e.max(axis=1, keepdims=True))
    a = np.exp(transitions - transitions.max()).astype(e.dtype)
    back = np.ascontiguousarray(a.T)
    steps = int(n[0])
    active = np.searchsorted(-n, -np.arange(steps), side="left")  # rows that have a word at each step
    alpha = np.empty_like(e)
    now = e[base[: active[0]]]
    now /= now.sum(axis=1, keepdims=True)
    alpha[base[: active[0]]] = now
    for t in range(1, steps):
        at = base[: active[t]] + t
        now = (now[: len(at)] @ a) * e[at]
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = now
    total = np.zeros((len(n), e.shape[1]))
    beta = np.ones((0, e.shape[1]), e.dtype)
    for t in range(steps - 1, -1, -1):
        at = base[: active[t]] + t
        if len(at) > len(beta):  # rows whose last word this is
            beta = np.concatenate([beta, np.ones((len(at) - len(beta), e.shape[1]), e.dtype)])
        post = alpha[at] * beta
        total[: len(at)] += post / post.sum(axis=1, keepdims=True)
        beta = (e[at] * beta) @ back
        beta /= beta.sum(axis=1, keepdims=True)
    out[line] = total
    return out


def train(texts: list[str], labels: list[str], *, epochs: int = 4, rate: float = 0.3, seed: int = 5) -> Model:
    """Maximum likelihood by AdaGrad over segments of the texts; a text's language labels all its words.

    Every word is in a segment: the last one of a text is as long as what is left of it. In each step some segments go on
    with the words of another from a random place on, as code-switched text does.
    """
    langs = sorted(set(labels))
    k = len(langs)
    buf, off = T.utf8(pa.array(texts, pa.large_string()))
    fixed, gram, grams, h, rows = features(buf, off)
    y = np.repeat(np.array([langs.index(x) for x in labels], dtype=np.int64), np.diff(rows))
    words, which = np.unique(h, return_inverse=True)
    seen = np.zeros((len(words), k))
    np.add.at(seen, (which, y), 1)
    count = seen.sum(axis=1)
    named = np.flatnonzero((count >= LEXICON_COUNT) & (seen.max(axis=1) >= LEXICON_SHARE * count))
    named = np.sort(named[np.argsort(-count[named], kind="stable")[:LEXICON_SIZE]])
    m = Model(langs, np.zeros((TABLE, k), np.float32), np.eye(k, dtype=np.float32), words[named], seen[named].argmax(axis=1), np.zeros((k, k), np.float32))
    lex = m.in_lexicon(h)
    begin = np.concatenate([[0], np.cumsum(grams)])
    per_row = -(-np.diff(rows) // SEGMENT)
    segments = np.repeat(rows[:-1], per_row) + SEGMENT * T.take_ranges(np.zeros(len(per_row), np.int64), per_row)
    lengths = np.minimum(SEGMENT, np.repeat(rows[1:], per_row) - segments)
    load = begin[segments + lengths] - begin[segments]
    if not len(segments):
        return m
    g_w, g_t, g_l = np.full_like(m.weights, 1e-3), np.full_like(m.transitions, 1e-3), np.full_like(m.lexicon_weights, 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        parts = np.array_split(rng.permutation(len(segments)), max(1, len(segments) // 512))
        for part in (q for p in parts for q in np.array_split(p, min(len(p), 1 + int(load[p].sum()) * k // STEP_GRAMS))):
            places = np.arange(SEGMENT)
            live, word = places < lengths[part][:, None], segments[part][:, None] + places
            other = rng.permutation(len(part))
            cut = np.where(rng.random(len(part)) < SWITCHED, rng.integers(1, SEGMENT, len(part)), SEGMENT)
            swap = (places >= cut[:, None]) & ((cut <= lengths[part]) & (cut < lengths[part][other]))[:, None]
            live, word = np.where(swap, live[other], live), np.where(swap, word[other], word)
            at = word[live]
            mine = gram[T.take_ranges(begin[at], grams[at])]
            e = np.zeros((len(part), SEGMENT, k))
            e[live] = m.score(fixed[at], mine, grams[at], h[at])
            e = np.exp(e - e.max(axis=2, keepdims=True))
            a = np.exp(m.transitions.astype(np.float64))
            alpha, beta = np.empty_like(e), np.ones_like(e)
            alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
            for t in range(1, SEGMENT):
                x = (alpha[:, t - 1] @ a) * e[:, t]
                alpha[:, t] = x / x.sum(axis=1, keepdims=True)
            for t in range(SEGMENT - 2, -1, -1):
                x = (e[:, t + 1] * beta[:, t + 1]) @ a.T
                beta[:, t] = np.where(live[:, t + 1, None], x / x.sum(axis=1, keepdims=True), 1)  # 1 at a segment's last word
            post = alpha * beta
            post /= post.sum(axis=2, keepdims=True)
            x = e[:, 1:] * beta[:, 1:]
            z = ((alpha[:, :-1] @ a) * x).sum(axis=2)
            pair = a * ((alpha[:, :-1] * (live[:, 1:] / z)[:, :, None]).reshape(-1, k).T @ x.reshape(-1, k))
            truth = np.zeros((len(at), k))
            truth[np.arange(len(at)), y[at]] = 1
            grad = truth - post[live]
            moved = np.zeros((k, k))
            label = y[np.where(live, word, 0)]
            np.add.at(moved, (label[:, :-1][live[:, 1:]], label[:, 1:][live[:, 1:]]), 1)
            d_t = (moved - pair) / len(at)
            d_w = np.zeros((TABLE, k))
            of_gram = np.repeat(grad, grams[at], axis=0)
            for c in range(k):
                d_w[:, c] = np.bincount(mine, of_gram[:, c], TABLE)
                for f in range(fixed.shape[1]):
                    d_w[:, c] += np.bincount(fixed[at, f], grad[:, c], TABLE)
            d_w = d_w / len(at) - 1e-6 * m.weights
            d_l = np.zeros((k, k))
            hit = np.flatnonzero(lex[at] >= 0)
            np.add.at(d_l, lex[at][hit], grad[hit])
            d_l /= len(at)
            for w, g, d in ((m.weights, g_w, d_w), (m.transitions, g_t, d_t), (m.lexicon_weights, g_l, d_l)):
                g += d * d
                w += rate * d / np.sqrt(g)
    return m


def sample_texts(docs: DataFrame, usable: F.Column, *, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], list[str]]:
    """A sample of labelled texts, about as many of each language, picked by a hash of the id; of a long text a stretch from a hashed place.

    Every language counts, so the sample and the model grow with their number.
    """
    rows = docs.where(usable & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    sizes = {r[0]: r["n"] for r in rows.groupBy(lang_col).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], []
    each = max(20, SAMPLE // len(sizes))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, each / n))])
    o = F.xxhash64(F.lit(11), F.col(id_col), F.col(text_col))
    u = F.pmod(o, F.lit(1_000_003)) / 1_000_003
    # of a long text a stretch from a hashed place, so that what is said late is learned too
    from_ = F.pmod(F.shiftright(o, 21), F.greatest(F.length(text_col) - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    picked = rows.where(u < F.try_element_at(share, F.col(lang_col))).select(F.substr(F.col(text_col), from_.cast("int"), F.lit(SAMPLE_CHARS)), lang_col, o.alias("lw_o"))
    # about half as many are expected; the limit holds where rows repeat
    got = picked.orderBy("lw_o", lang_col).limit(2 * max(SAMPLE, each * len(sizes)) + 2000).collect()
    got = sorted((r[1], r[0]) for r in got)
    return [t for _, t in got], [lang for lang, _ in got]


def predict(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns in ``keep``, then lang_pred and score (the mean posterior of that language over the words) of each whole text.

    A text that is null or has no letter is ``und`` with score 0, as is every text if nothing was learned.
    Rows are neither moved nor joined, so repeated rows, null ids and empty tables need no care. A column to keep that has a
    name of the result raises ValueError; others aren't read. A very long text is labelled whole; its words take a step each.
    """
    if clash := {*keep} & {"lang_pred", "score"}:
        raise ValueError(f"columns to keep have names of the result: {sorted(clash)}")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array([*m.langs, UNKNOWN])
        for batch in batches:
            buf, off = T.utf8(batch.column(len(keep)))
            letters = np.asarray(batch.column(len(keep) + 1).fill_null(False), dtype=bool) if len(m.langs) else np.zeros(len(batch), bool)
            sums = np.zeros((len(batch), max(1, len(m.langs))))
            held, first, size = [], 0, 0
            for at, to, part, part_off in T.pieces(buf, off):
                if not len(m.langs):
                    break
                e, rows = m.emissions(part, part_off)
                held.append((e, np.diff(rows)))
                size += len(e)
                if size >= GROUP or to == len(batch):
                    counts = np.concatenate([c for _, c in held])
                    sums[first:to] = forward_backward(np.concatenate([x for x, _ in held]), np.concatenate([[0], np.cumsum(counts)]), m.transitions)
                    held, first, size = [], to, 0
                del at
            total = sums.sum(axis=1)
            best = np.where(letters & (total > 0), sums.argmax(axis=1), len(m.langs))
            score = np.where(best < len(m.langs), sums.max(axis=1) / np.maximum(total, 1e-9), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], names.take(pa.array(best)), pa.array(np.clip(score, 0, 1))], [*keep, "lang_pred", "score"])
            del batch, buf, off, held
            T.give_back()

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    seen = docs.select(*keep, F.col(text_col).alias("__lw_text"), F.col(text_col).rlike(r"\p{L}").alias("__lw_letters"))
    return seen.mapInArrow(run, f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame, *, usable: F.Column | None = None, keep: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that ``usable`` marks (all, if None), then label every row; see predict()."""
    texts, labels = sample_texts(docs, F.lit(True) if usable is None else usable, id_col=id_col, text_col=text_col, lang_col=lang_col)
    none = np.zeros((0, 0), np.float32)
    model = train(texts, labels) if texts else Model([], none, none, np.zeros(0, np.uint64), np.zeros(0, np.int64), none)
    return predict(docs, model, keep=keep, text_col=text_col)


def held_out(mod: int, rest: int, id_col: str = "doc_id") -> F.Column:
    """The rows that must not be learned from: crc32 of the id as text leaves this rest."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(False))


def op1_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = held_out(4, 2)
    return identify(docs, usable=~out).select("doc_id", out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_crf_language": op1_crf_language}
