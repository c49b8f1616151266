"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

The ends of both token sequences, merged, cut a text into elementary intervals. The owner of an interval in a sequence is
its first token that ends there or later, so each interval is one overlapping pair of tokens. An end that both share closes
a group: no token reaches across it.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm import bpe, scratch
from loomwork.llm import text as T

#: Bytes of text that are aligned at a time, and distinct words that a worker remembers between them.
TEXT_AT_ONCE, REMEMBERED = 2 << 20, 200_000
#: Pairs of ids whose counts are sent to the workers at a time (13 bytes each). More take more rounds, with equal results.
PAIRS_AT_ONCE = 4_000_000
#: Distinct pairs that a task adds up before it hands them on.
PAIRS_HELD = 1 << 20
SPACE = 32


class Vocabulary:
    """The bytes of every id, and its decimal digits."""

    def __init__(self, bytes_of: dict[int, bytes]) -> None:
        size = max(bytes_of) + 1
        every = [bytes_of.get(i, b"") for i in range(size)]
        self.length = np.array([len(b) for b in every], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(every), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.data[T.take_ranges(self.start[ids], self.length[ids])]


class Words:
    """Ids of texts by way of their distinct words, each of which a library encodes once and a table remembers."""

    vocabulary: Vocabulary

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.table: dict[bytes, tuple[int, ...]] = {}

    def bounds(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the words of all rows (then the end), and the row offsets into them."""
        raise NotImplementedError

    def spelled(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each word."""
        raise NotImplementedError

    def encode_one(self, text: bytes) -> list[int]:
        """The ids of a whole text."""
        raise NotImplementedError

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and the row offsets into them."""
        bounds, rows = self.bounds(buf, off)
        if len(bounds) < 2:
            return np.zeros(0, np.int64), rows
        _, first, which = np.unique(T.range_hashes(buf, bounds[:-1], bounds[1:]), return_index=True, return_inverse=True)
        raw = buf.tobytes()
        distinct = [raw[a:b] for a, b in zip(bounds[first].tolist(), bounds[first + 1].tolist(), strict=True)]
        if len(self.table) > REMEMBERED:
            self.forget()
        new = [w for w in distinct if w not in self.table]
        self.table.update(zip(new, self.spelled(new), strict=True))
        return _spread([self.table[w] for w in distinct], which, rows)


class ByteWords(Words):
    """A byte-level BPE file: its words are what its regular expression splits a text into."""

    def __init__(self, spec: bytes, file: bytes) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine
        super().__init__()
        self.codec = bpe.Codec(spec)
        self.vocabulary = Vocabulary(self.codec.bytes_of)
        self.model = Tokenizer.from_buffer(file)
        self.model.no_truncation()
        self.model.no_padding()
        self.model.encode_special_tokens = True

    def bounds(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.codec.split(buf, off)

    def spelled(self, words: list[bytes]) -> list[tuple[int, ...]]:
        return [tuple(e.ids) for e in self.model.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def encode_one(self, text: bytes) -> list[int]:
        return self.model.encode(text.decode(), add_special_tokens=False).ids


class PieceWords(Words):
    """A sentencepiece BPE model that puts a space before a text and whose pieces hold none but at their start.

    So no merge crosses the border before a space that follows another character, and words lie between such borders.
    """

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        if any("▁" in p.lstrip("▁") for p in pieces) or [self.model.id_to_piece(i) for i in self.model.encode("a  b ")][-1] != "▁":
            raise ValueError("a model is needed that keeps all spaces and has them at the start of pieces only")
        plain = lambda i, p: bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
        self.vocabulary = Vocabulary({i: plain(i, p) for i, p in enumerate(pieces)})
        self.alone = (self.model.piece_to_id("▁"),)

    def bounds(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blank = buf == SPACE
        begin = blank.copy()
        begin[1:] &= ~blank[:-1]
        begin[off[:-1][np.diff(off) > 0]] = True  # each row starts with a space
        starts = np.flatnonzero(begin)
        return np.append(starts, len(buf)), np.searchsorted(starts, off)

    def spelled(self, words: list[bytes]) -> list[tuple[int, ...]]:
        found = self.model.encode([w[1:].decode() for w in words], num_threads=1)
        return [tuple(ids) if len(w) > 1 else self.alone for w, ids in zip(words, found, strict=True)]

    def encode_one(self, text: bytes) -> list[int]:
        return self.model.encode(text[1:].decode())


def _spread(words: list[tuple[int, ...]], which: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words[which[0]], words[which[1]], ... one after another, and row offsets into them in place of those into the words."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter(chain.from_iterable(words), np.int64, int(size.sum()))
    n = size[which]
    return flat[T.take_ranges((np.cumsum(size) - size)[which], n)], np.concatenate([[0], np.cumsum(n)])[rows]


def encoded(words: Words, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, row offsets, and whether the bytes of a row's tokens are the row's. Rows where they aren't are encoded again as a whole, as two words may share a hash."""
    ids, rows = words.encode(buf, off)
    length = words.vocabulary.length

    def fits(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(length[ids])])[rows]
        if (total == off).all():
            wrong = np.concatenate([[0], np.cumsum(words.vocabulary.spell(ids) != buf)])
            return wrong[off[1:]] == wrong[off[:-1]]
        return np.array([b - a == d - c and bool((words.vocabulary.spell(ids[e:f]) == buf[a:b]).all()) for a, b, c, d, e, f in zip(off[:-1], off[1:], total[:-1], total[1:], rows[:-1], rows[1:], strict=True)], dtype=bool)

    ok = fits(ids, rows)
    if not ok.all():
        raw = buf.tobytes()
        parts = [ids[a:b] if good else np.array(words.encode_one(raw[c:d]), np.int64) for a, b, c, d, good in zip(rows[:-1], rows[1:], off[:-1], off[1:], ok, strict=True)]
        ids, rows = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        ok = fits(ids, rows)
    return ids, rows, ok


@dataclass
class Aligned:
    """Of some rows: ids and their rows on both sides, and of each interval its owners, its row and whether it closes a group."""

    a: np.ndarray
    b: np.ndarray
    row_a: np.ndarray
    row_b: np.ndarray
    owner_a: np.ndarray
    owner_b: np.ndarray
    row: np.ndarray
    closes: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray


def union1d(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """numpy.union1d of two ascending arrays, by a merge (a stable sort of two runs) instead of a hash table."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return both[np.append(True, both[1:] != both[:-1])] if len(both) else both


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each elementary interval its owner on either side, and whether both end there; the last ends must be equal."""
    ends = union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return a, b, (ends_a[a] == ends) & (ends_b[b] == ends)


def align_rows(one: Words, two: Words, buf: np.ndarray, off: np.ndarray) -> Aligned:
    """The rows end to end: where texts join, both sides have an end, so no interval and no group crosses."""
    a, rows_a, ok_a = encoded(one, buf, off)
    b, rows_b, ok_b = encoded(two, buf, off)
    n = len(off) - 1
    row_a, row_b = np.repeat(np.arange(n), np.diff(rows_a)), np.repeat(np.arange(n), np.diff(rows_b))
    ok = ok_a & ok_b
    if not ok.all():
        keep_a, keep_b = ok[row_a], ok[row_b]
        a, row_a, b, row_b = a[keep_a], row_a[keep_a], b[keep_b], row_b[keep_b]
    kind = np.int32 if len(buf) < 1 << 31 else np.int64
    ends_a, ends_b = np.cumsum(one.vocabulary.length[a]).astype(kind), np.cumsum(two.vocabulary.length[b]).astype(kind)
    owner_a, owner_b, closes = intervals(ends_a, ends_b)
    return Aligned(a, b, row_a, row_b, owner_a, owner_b, row_a[owner_a], closes, ends_a, ends_b)


_DIGITS = np.array([list(str(i).ljust(6, "\0").encode()) for i in range(10_000)], np.uint8)


def digits(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits from the left (rows x 6, room for one more), and their number; ids have up to five."""
    out = _DIGITS[np.minimum(ids, 9999)]
    long = np.flatnonzero(ids > 9999)
    out[long, 0] = ids[long] // 10_000 + 48
    for k, p in enumerate((1000, 100, 10, 1), 1):
        out[long, k] = ids[long] // p % 10 + 48
    return out, 1 + (ids > 9).astype(np.int64) + (ids > 99) + (ids > 999) + (ids > 9999)


def spelled_groups(x: Aligned, n: int) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` of all rows end to end, and the row offsets into it."""
    group = np.cumsum(x.closes) - x.closes
    last_a = np.append(x.owner_a[1:] != x.owner_a[:-1], True) if len(group) else x.closes
    last_b = np.append(x.owner_b[1:] != x.owner_b[:-1], True) if len(group) else x.closes
    ga, gb, groups = group[last_a], group[last_b], int(x.closes.sum())
    ends_a, ends_b = np.cumsum(np.bincount(ga, minlength=groups)), np.cumsum(np.bincount(gb, minlength=groups))
    at_a = np.arange(len(ga)) + np.concatenate([[0], ends_b])[ga]  # after the B tokens of all earlier groups
    at_b = np.arange(len(gb)) + ends_a[gb]  # after the A tokens of this group too
    ids, mark, row = (np.zeros(len(ga) + len(gb), t) for t in (np.int64, np.uint8, np.int64))
    ids[at_a], ids[at_b], row[at_a], row[at_b] = x.a, x.b, x.row_a, x.row_b
    mark[:] = ord(",")
    mark[at_a[ends_a - 1]] = ord("|")
    mark[at_b[ends_b - 1]] = ord(";")
    out, size = digits(ids)
    out[np.arange(len(ids)), size] = mark
    flat = out[np.arange(6) <= size[:, None]].tobytes()
    return flat, np.concatenate([[0], np.cumsum(np.bincount(row, size + 1, n).astype(np.int64))])


_WORDS: dict[bytes, tuple[ByteWords, PieceWords]] = {}


def _words(spec: bytes, file: bytes, model: bytes) -> tuple[ByteWords, PieceWords]:
    key = hashlib.sha256(spec + model).digest()
    if key not in _WORDS:
        _WORDS.clear()
        _WORDS[key] = ByteWords(spec, file), PieceWords(model)
    return _WORDS[key]


_SHOWN = {"groups": "string", "groups_sha256": "string"}


def _aligned(docs: DataFrame, a_file: str, b_file: str, outputs: tuple[str, ...], keep: tuple[str, ...], text_col: str) -> DataFrame:
    """The columns in ``keep``, n_a, n_b, n_groups, n_links, ``outputs``, and the distinct linked pairs of each row (b * 65536 + a) with how often each is."""
    with open(a_file, "rb") as f, open(b_file, "rb") as g:
        files = bpe.load_spec(a_file, special=False), f.read(), g.read()
    if any(len(w.vocabulary.length) > 1 << 16 for w in _words(*files)):
        raise ValueError("vocabularies of up to 65,536 ids are supported")
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _words(*shared.value)
        for batch in batches:
            buf, off = T.utf8(batch.column(len(keep)))
            for at, to, part, part_off in T.pieces(buf, off, TEXT_AT_ONCE):
                n = to - at
                x = align_rows(one, two, part, part_off)
                count = lambda rows: pa.array(np.bincount(rows, minlength=n))  # noqa: E731, B023
                cols = [*[c.slice(at, n) for c in batch.columns[: len(keep)]], count(x.row_a), count(x.row_b), count(x.row[x.closes]), count(x.row)]
                if outputs:
                    flat, ends = spelled_groups(x, n)
                    lines = [flat[a : b - 1] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    cols += [pa.array([line.decode() for line in lines] if k == "groups" else [hashlib.sha256(line).hexdigest() if line else "" for line in lines]) for k in outputs]
                pairs, times = np.unique(x.row << 32 | x.b[x.owner_b] << 16 | x.a[x.owner_a], return_counts=True)
                ends = np.searchsorted(pairs >> 32, np.arange(n + 1))
                width = 1 if times.max(initial=0) < 256 else 4
                blob = lambda v, size: pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(v))])  # noqa: E731, B023
                cols += [blob(pairs.astype(np.uint32), 4), blob(times.astype(f"<u{width}"), width)]
                yield pa.RecordBatch.from_arrays(cols, [*keep, "n_a", "n_b", "n_groups", "n_links", *outputs, "lw_pairs", "lw_times"])
        one.forget()  # the worker process outlives the task
        two.forget()
        T.give_back()

    text = F.when(F.length(text_col) > 0, F.concat(F.lit(" "), F.col(text_col)))
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    fields += ["n_a long, n_b long, n_groups long, n_links long", *[f"{k} {_SHOWN[k]}" for k in outputs], "lw_pairs binary, lw_times binary"]
    return docs.select(*keep, text.alias("__lw_text")).mapInArrow(run, ", ".join(fields))


def _pairs_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of all rows, how often each is, and the row offsets into them."""
    p, t = batch.column(batch.schema.get_field_index("lw_pairs")), batch.column(batch.schema.get_field_index("lw_times"))
    blobs, times = p.to_pylist(), t.to_pylist()
    n = np.array([len(b) // 4 for b in blobs], dtype=np.int64)
    many = [np.frombuffer(t, "<u1" if len(t) * 4 == len(b) else "<u4").astype(np.int64) for b, t in zip(blobs, times, strict=True) if b]
    return np.frombuffer(b"".join(blobs), np.uint32), np.concatenate([np.zeros(0, np.int64), *many]), np.concatenate([[0], np.cumsum(n)])


def pair_counts(held: DataFrame) -> DataFrame:
    """b, pair, n and best (no pair of this b has more links) of every linked pair of ids of the whole corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        give = lambda: pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(total)], ["pair", "n"])
        for batch in batches:
            pairs, times, _ = _pairs_of(batch)
            key, which = np.unique(np.concatenate([key, pairs]), return_inverse=True)
            total = np.bincount(which, np.concatenate([total, times]), len(key)).astype(np.int64)
            if len(key) > PAIRS_HELD:
                yield give()
                key, total = key[:0], total[:0]
        yield give()

    found = held.select("lw_pairs", "lw_times").mapInArrow(add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    of_b = Window.partitionBy("b")  # no more rows than A has ids
    return found.withColumn("b", F.shiftright("pair", 16)).select("b", "pair", "n", (F.col("n") == F.max("n").over(of_b)).alias("best"))


def _ranges(counts: DataFrame) -> list[tuple[int, int]]:
    """Ranges of b (both ends in) with up to PAIRS_AT_ONCE pairs each, or of one b."""
    sizes = sorted((r["b"], r["n"]) for r in counts.groupBy("b").agg(F.count("*").alias("n")).collect())  # no more rows than B has ids
    out, held = [], 0
    for b, n in sizes:
        if out and held + n <= PAIRS_AT_ONCE:
            out[-1], held = (out[-1][0], b), held + n
        else:
            out.append((b, b))
            held = n
    return out


def _add_counts(held: DataFrame, counts: DataFrame, low: int, high: int) -> DataFrame:
    """n_best and count_sum grow by the pairs whose b is in the range."""
    got = counts.where(F.col("b").between(low, high)).select("pair", "n", "best").toArrow()
    pair = np.asarray(got["pair"].combine_chunks()).astype(np.uint32)
    order = np.argsort(pair)
    shared = held.sparkSession.sparkContext.broadcast((pair[order], np.asarray(got["n"].combine_chunks())[order], np.asarray(got["best"].combine_chunks().cast(pa.int8()))[order]))
    names = held.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, best = shared.value
        for batch in batches:
            pairs, times, ends = _pairs_of(batch)
            at = np.minimum(np.searchsorted(key, pairs), len(key) - 1)
            times = times * (key[at] == pairs)
            by_row = lambda v: (lambda c: c[ends[1:]] - c[ends[:-1]])(np.concatenate([[0], np.cumsum(v)]))  # noqa: E731, B023
            more = {"n_best": by_row(times * best[at]), "count_sum": by_row(times * n[at])}
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c) + more[k]) if k in more else c for k, c in zip(names, batch.columns, strict=True)], names)

    return held.mapInArrow(run, held.schema)


def align(docs: DataFrame, a_file: str, b_file: str, outputs: tuple[str, ...] = ("groups",), *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Align the tokens of a byte-level BPE file (A, on a space and the text) with those of a sentencepiece BPE model (B, on the text).

    Returns the columns in ``keep``, then n_a, n_b, n_groups, n_links (overlapping token pairs), n_best (links whose count is
    the highest that their B id has in the corpus), count_sum (the counts of all links; a pair of ids counts once for each
    link of it in all rows), and ``outputs``: groups (``a1,a2|b1;a3|b2,b3``) or groups_sha256.

    Texts that are null or empty, or whose tokens spell something else on either side, have no tokens: zeros and ''.
    Special tokens' strings are plain text. Rows are neither moved nor joined: repeated rows and null ids give rows like any
    other and count in the corpus, an empty table gives an empty one. Columns of docs are read only if in ``keep``,
    where a name that the result has too raises ValueError. Each text is aligned whole; one of 100 MB takes some 5 GB of a task.
    """
    made = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", *outputs)
    if clash := {*keep} & {*made, "lw_pairs", "lw_times"}:
        raise ValueError(f"columns to keep have names of the result: {sorted(clash)}")
    held = scratch.table(_aligned(docs, a_file, b_file, tuple(outputs), keep, text_col), "alignment")
    counts = scratch.table(pair_counts(held), "alignment-pairs")
    held = held.withColumn("n_best", F.lit(0).cast("long")).withColumn("count_sum", F.lit(0).cast("long"))
    ranges = _ranges(counts)
    for k, (low, high) in enumerate(ranges):
        held = _add_counts(held, counts, low, high)
        if k + 1 < len(ranges):
            held = scratch.table(held, "alignment")
    return held.select(*keep, *made)


def op11_elementary_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), ("groups_sha256",))


QUERIES = {"op11_elementary_intervals": op11_elementary_intervals}
