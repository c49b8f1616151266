"""Substring dedup by level-wise doubling.

Names of windows of about five words are compared first; only windows that repeat are extended to twice the length, by
joining the names of two neighbours, and so on up to the wanted length or until none survives. At the wanted length
all but the first occurrence go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import exchange as X
from loomwork.llm import scratch
from loomwork.llm import text as T

WINDOW = 20
#: The first level has windows of so many words at least (the wanted length halved as often as that allows).
SHORTEST = 5
_C1, _C2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)

# kind 0: places whose names the bucket compares; 1: places known to repeat already; 2: the ids, text hashes and word offsets of a piece
_SENT = pa.schema([("bucket", pa.int32()), ("piece", pa.int64()), ("kind", pa.int32()), ("at", pa.binary()), ("name", pa.binary()), ("doc", pa.binary())])
_BACK = pa.schema([("piece", pa.int64()), ("kind", pa.int32()), ("at", pa.binary()), ("name", pa.binary()), ("doc", pa.binary())])
_SENT_SQL, _BACK_SQL = "bucket int, piece long, kind int, at binary, name binary, doc binary", "piece long, kind int, at binary, name binary, doc binary"


def _runs(names: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal names (and equal extra bits) start, and their lengths."""
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (extra[1:] != extra[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(names)))


def _send(piece: int, at: np.ndarray, names: np.ndarray, doc: np.ndarray, pos: np.ndarray, buckets: int, last: bool, extra: np.ndarray | None = None) -> list[tuple]:
    """Rows for the buckets. Of a name that the piece has often only the first place is sent; the others are known to repeat.

    At the last level names get 64 more bits (extra), first means lowest (doc, pos), and places with the same doc and pos (rows of one id) are one occurrence.
    """
    extra = names if extra is None else extra
    order = np.lexsort((pos, doc, extra, names)) if last else np.argsort(names, kind="stable")
    first, size = _runs(names[order], extra[order]) if last else X.runs(names[order])
    lead, again = np.zeros(len(names), bool), np.zeros(len(names), bool)
    if last:
        head = np.repeat(order[first], size)
        lead[order] = (doc[order] == doc[head]) & (pos[order] == pos[head])
    else:
        lead[order[first]] = True
        again[order] = np.repeat(size > 1, size)
    bucket, low = X.split_name(names, buckets)
    rows = []
    sent = np.flatnonzero(lead)
    for b, mine in X.parts(bucket[sent]):
        mine = sent[mine]
        # a bit a name tells whether it repeats within the piece
        rows.append((b, piece, 0, X.pack(at[mine]), X.pack48(low[mine]) + (extra[mine].tobytes() if last else np.packbits(again[mine]).tobytes()), doc[mine].tobytes() + pos[mine].tobytes() if last else None))
    rest = np.flatnonzero(~lead)
    for b, mine in X.parts(bucket[rest]) if not last else [(int(piece % buckets), np.arange(len(rest)))]:
        mine = rest[mine]
        if len(mine):
            rows.append((b, piece, 1, X.pack(at[mine]), None if last else X.pack48(low[mine]), None))
    return rows


def _compare(buckets: int, last: bool) -> X.Reduce:
    """In a bucket: at a level below the last, keep places whose name repeats; at the last, all but the first occurrence."""

    def run(t: pa.Table) -> pa.Table:
        piece, kind = np.asarray(t.column("piece")), np.asarray(t.column("kind"))
        at, name, doc = t.column("at").to_pylist(), t.column("name").to_pylist(), t.column("doc").to_pylist()
        bucket = t.column("bucket")[0].as_py()
        out = [(int(piece[i]), int(kind[i]), at[i], name[i] if last or kind[i] == 2 else _whole(X.unpack48(name[i]), bucket).tobytes(), doc[i]) for i in np.flatnonzero(kind > 0)]
        rows = np.flatnonzero(kind == 0)
        if not len(rows):
            return X.table_of(out, _BACK)
        places = [X.unpack(at[i]) for i in rows]
        sizes = np.array([len(p) for p in places])
        names = np.concatenate([X.unpack48(name[i][: 6 * n]) for i, n in zip(rows, sizes, strict=True)])
        if last:
            extra = np.concatenate([np.frombuffer(name[i], np.uint64, offset=6 * int(n)) for i, n in zip(rows, sizes, strict=True)])
            docs = np.concatenate([np.frombuffer(doc[i], np.int64, int(n)) for i, n in zip(rows, sizes, strict=True)])
            pos = np.concatenate([np.frombuffer(doc[i], np.int64, offset=8 * int(n)) for i, n in zip(rows, sizes, strict=True)])
            order = np.lexsort((pos, docs, extra, names))
            first, size = _runs(names[order], extra[order])
            head = np.repeat(order[first], size)
            keep = np.empty(len(names), bool)
            keep[order] = (docs[order] != docs[head]) | (pos[order] != pos[head])
        else:
            order = np.argsort(names, kind="stable")
            first, size = X.runs(names[order])
            keep = np.concatenate([np.unpackbits(np.frombuffer(name[i], np.uint8, offset=6 * int(n)), count=int(n)) for i, n in zip(rows, sizes, strict=True)]).astype(bool)
            keep[order] |= np.repeat(size > 1, size)
        begin = np.cumsum(sizes) - sizes
        for i, p, a in zip(rows, places, begin, strict=True):
            k = keep[a : a + len(p)]
            if k.any():
                out.append((int(piece[i]), 0, X.pack(p[k]), None if last else _whole(names[a : a + len(p)][k], bucket).tobytes(), None))
        return X.table_of(out, _BACK)

    return run


def _whole(low: np.ndarray, bucket: int) -> np.ndarray:
    """A name again as 64 bits; the bucket stands for the bits that chose it."""
    return T.mix(low + np.uint64((bucket + 1) * int(_C1) % (1 << 64)))


def _gather(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a piece: ids and text hashes of its rows (two lines), their unit offsets, and the kept places in order, with their names."""
    kind = np.asarray(t.column("kind"))
    at, name, doc = t.column("at").to_pylist(), t.column("name").to_pylist(), t.column("doc").to_pylist()
    info = int(np.flatnonzero(kind == 2)[0])
    own, offsets = np.frombuffer(doc[info], np.int64).reshape(2, -1), np.frombuffer(name[info], np.int64)
    rows = [i for i in range(len(kind)) if kind[i] != 2]
    places = np.concatenate([np.zeros(0, np.int64), *[X.unpack(at[i]) for i in rows]])
    names = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(name[i] or b"", np.uint64) for i in rows]])
    order = np.argsort(places, kind="stable")
    return own, offsets, places[order], names[order] if len(names) == len(places) else names


def _extend(length: int, window: int, buckets: int) -> X.Reduce:
    """In a piece: two windows of `length` words that repeat give a candidate of twice the length, or of the wanted one (then they overlap)."""
    longer = min(2 * length, window)

    def run(t: pa.Table) -> pa.Table:
        piece = t.column("piece")[0].as_py()
        own, offsets, at, names = _gather(t)
        row = np.searchsorted(offsets, at, side="right") - 1
        step = longer - length
        after = np.searchsorted(at, at + step)
        ok = after < len(at)
        ok[ok] = (at[after[ok]] == at[ok] + step) & (row[after[ok]] == row[ok])
        here = np.flatnonzero(ok)
        joined = T.mix(names[here] * _C1 + names[after[here]] * _C2)
        rows = _send(piece, at[here], joined, own[0][row[here]], at[here] - offsets[row[here]], buckets, longer == window, T.mix(names[here] * _C2 ^ names[after[here]] * _C1))
        return X.table_of([*rows, (int(piece % buckets), piece, 2, None, offsets.tobytes(), own.tobytes())], _SENT)

    return run


def _spans(window: int) -> X.Reduce:
    """In a piece: the word spans that the repeated windows of each row cover."""
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("start", pa.list_(pa.int64())), ("end", pa.list_(pa.int64()))])

    def run(t: pa.Table) -> pa.Table:
        own, offsets, at, _ = _gather(t)
        row = np.searchsorted(offsets, at, side="right") - 1
        out = []
        for r in np.unique(row):
            a = at[slice(*np.searchsorted(row, [r, r + 1]))] - offsets[r]
            new = np.concatenate([[True], a[1:] > a[:-1] + window])
            starts = a[new]
            ends = np.append(a[np.flatnonzero(new)[1:] - 1], a[-1]) + window
            out.append((int(own[0][r]), int(own[1][r]), starts.tolist(), ends.tolist()))
        return X.table_of(out, schema)

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, th, starts and ends of the word spans covered by windows that also start earlier; docs has id, th (a hash of the text) and text.

    Each level sends the names of its candidates to buckets and gets back those that repeat; the next one has
    twice as many words, the last one ``window``.
    """
    buckets = X.bucket_count(docs, "text")
    length = window
    while length >= 2 * SHORTEST:
        length = -(-length // 2)
    only = length == window

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, ids, buf, off, th in X.each_piece(batches, with_column=2):
            starts, ends, rows = T.words(buf, off)
            names, offsets = T.window_hashes(T.range_hashes(buf, starts, ends), rows, length)
            row = np.repeat(np.arange(len(ids)), np.diff(offsets))
            at = np.arange(len(names))
            sent = _send(piece, at, names, ids[row], at - offsets[row], buckets, only) if len(names) else []
            yield from X.batches_of([*sent, (int(piece % buckets), piece, 2, None, offsets.tobytes(), ids.tobytes() + th.tobytes())], _SENT)

    sent, held = docs.select("id", "text", "th").mapInArrow(first, _SENT_SQL), []
    while True:
        last = length == window
        back = scratch.table(sent.groupBy("bucket").applyInArrow(X.lean(_compare(buckets, last)), _BACK_SQL), "substrings")
        X.release(back)
        scratch.drop(*held)
        held = [back]
        if last or back.where("kind <> 2").limit(1).count() == 0:
            break
        sent = back.groupBy("piece").applyInArrow(X.lean(_extend(length, window, buckets)), _SENT_SQL)
        length = min(2 * length, window)
    spans = back.where(F.lit(length == window)).groupBy("piece").applyInArrow(X.lean(_spans(window)), "id long, th long, start array<long>, end array<long>")
    one = spans.groupBy("id", "th").agg(F.min(F.struct("start", "end")).alias("s"))  # rows of one id and text fare alike
    done = scratch.table(one.select("id", "th", "s.start", "s.end"), "spans")
    X.release(done)
    scratch.drop(*held)
    return done


def _kept(text: bytes, starts: np.ndarray, ends: np.ndarray, span_start: list, span_end: list) -> tuple[bytes, int]:
    """The kept words joined by one space, and how many words go."""
    gone = np.zeros(len(starts) + 1, np.int64)
    for a, b in zip(span_start, span_end, strict=True):
        gone[min(a, len(starts))] += 1
        gone[min(b, len(starts))] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return b" ".join([text[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]), int((~keep).sum())


def remove_repeats(docs: DataFrame, window: int = WINDOW, outputs: tuple[str, ...] = ("kept",), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of docs with lw_n_words, lw_n_removed and, as asked, lw_kept and lw_kept_sha256.

    A word goes if it is in a run of ``window`` words that also starts earlier: in a document with a smaller id, or
    earlier in the same one. Kept words are joined by one space. A null text has no words (its kept text is ''
    only in the hash; lw_kept stays null). Rows with one id count as one document: of equal windows in them the
    earlier start stays, and those with the same start all stay, so a repeated row changes nothing. Each row loses words
    of its own repeated windows alone, whatever other rows have its id. Rows with a null id are such a document, before
    all others. An empty table gives an empty table. Other columns are kept; one with a name that is used here raises ValueError.
    """
    if clash := {"lw_n_words", "lw_n_removed", "lw_kept", "lw_kept_sha256"} & {*docs.columns}:
        raise ValueError(f"docs have columns that are used here: {sorted(clash)}")
    own, th = F.coalesce(F.col(id_col).cast("long"), F.lit(X.NO_ID)), F.xxhash64(text_col)
    spans = repeated_spans(docs.select(own.alias("id"), F.col(text_col).alias("text"), th.alias("th")), window)
    names = [f.name for f in docs.schema]
    kinds = {"kept": ("lw_kept string", pa.string()), "kept_sha256": ("lw_kept_sha256 string", pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, begin, stop = batch.column("__lw_text"), batch.column("__lw_start"), batch.column("__lw_end")
            buf, off = T.utf8(col)
            for a, b, part, part_off in T.pieces(buf, off):
                starts, ends, rows = T.words(part, part_off)
                raw, n_removed, kept = part.tobytes(), [], []
                for r in range(b - a):
                    mine = slice(rows[r], rows[r + 1])
                    text, gone = _kept(raw, starts[mine], ends[mine], begin[a + r].as_py() or [], stop[a + r].as_py() or [])
                    n_removed.append(gone)
                    kept.append(text)
                valid = np.asarray(col.slice(a, b - a).is_valid())
                made = {"kept": lambda: pa.array([k.decode("utf-8", "replace") if v else None for k, v in zip(kept, valid, strict=True)], pa.string()), "kept_sha256": lambda: pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}  # noqa: B023
                own = [batch.column(n).slice(a, b - a) for n in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(rows)), pa.array(n_removed, pa.int64()), *[made[k]() for k in outputs]], [*names, "lw_n_words", "lw_n_removed", *[kinds[k][0].split()[0] for k in outputs]])

    held = docs.withColumns({"__lw_id": own, "__lw_th": th, "__lw_text": F.col(text_col)})
    # a merge join at any size: both sides grow with the input
    spans = spans.select(F.col("id").alias("__lw_id"), F.col("th").alias("__lw_th"), F.col("start").alias("__lw_start"), F.col("end").alias("__lw_end"))
    both = held.join(spans.hint("merge"), ["__lw_id", "__lw_th"], "left").drop("__lw_id", "__lw_th")
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], "lw_n_words long, lw_n_removed long", *[kinds[k][0] for k in outputs]])
    return both.mapInArrow(run, fields)


def op7_substring_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, outputs=("kept_sha256",)).select("doc_id", F.col("lw_n_words").alias("n_words"), F.col("lw_n_removed").alias("n_removed"), F.col("lw_kept_sha256").alias("kept_sha256"))


SQL = {
    "op7_substring_doubling": r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS p, ws FROM w WHERE len(ws) >= 20),
seq AS (SELECT doc_id, p, array_to_string(ws[p : p + 19], ' ') AS s FROM win),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM seq) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM dup),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
}

QUERIES = {"op7_substring_doubling": op7_substring_doubling}
