"""Shuffles of many small numbers as a few large rows.

A piece is a run of rows that one task works on at a time; what is found at a place of a piece is sent to
the bucket of its 64-bit name, and the answer goes back to the piece. Numbers travel packed: a row holds all
that one piece has for one bucket, so a shuffle costs about eight bytes a name and no work a name in the JVM.
A name that a piece holds often is sent once or a few times, so no bucket gets a hot name from more
than the number of pieces.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import text as T

#: Bytes of text for each bucket, at every size of the input: what a task holds at a time doesn't grow with it.
BUCKET_TEXT = 4 << 20
#: Stands for a null id; sorts first.
NO_ID = -(1 << 63)
Reduce = Callable[[pa.Table], pa.Table]


def bucket_count(docs: DataFrame, text_col: str) -> int:
    """Buckets in proportion to the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-size // BUCKET_TEXT))


def release(df: DataFrame) -> None:
    """Let Spark drop the shuffle files of finished steps now, and not when the driver next happens to collect garbage.

    A hint only: without a JVM of its own (Spark Connect) the session drops them when it does.
    """
    import gc
    import time

    jvm = getattr(getattr(df.sparkSession, "sparkContext", None), "_jvm", None)
    for _ in range(2 if jvm is not None else 0):  # what Python let go must reach the JVM first
        gc.collect()
        jvm.System.gc()
        time.sleep(0.3)


def lean(reduce: Reduce) -> Reduce:
    """The reducer, which afterwards returns the memory that it worked in: workers stay, and several share an executor."""

    def run(t: pa.Table) -> pa.Table:
        try:
            return reduce(t)
        finally:
            T.give_back()

    return run


def split_name(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each name by its upper 32 bits, scaled; the lower 48 bits tell names of a bucket apart."""
    return ((names >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), names & np.uint64((1 << 48) - 1)


def pack(at: np.ndarray) -> bytes:
    """Ascending places as a first place and differences, in as few bytes each as they need."""
    if not len(at):
        return b""
    steps = np.diff(at)
    most = int(steps.max(initial=0))
    width = 1 if most < 256 else 2 if most < 65536 else 4
    return struct.pack("<BI", width, int(at[0])) + steps.astype(f"<u{width}").tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.int64)
    width, first = struct.unpack_from("<BI", blob)
    return first + np.concatenate([[0], np.cumsum(np.frombuffer(blob, f"<u{width}", offset=5), dtype=np.int64)])


def pack_counts(n: np.ndarray) -> bytes:
    """Small numbers in any order, in as few bytes each as the largest needs."""
    if not len(n):
        return b""
    most = int(n.max())
    width = 1 if most < 256 else 2 if most < 65536 else 4
    return struct.pack("<B", width) + n.astype(f"<u{width}").tobytes()


def unpack_counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64) if blob else np.zeros(0, np.int64)


def pack48(names: np.ndarray) -> bytes:
    """48-bit numbers in six bytes each: the lower 32 bits of all, then the upper 16."""
    return (names & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (names >> np.uint64(32)).astype("<u2").tobytes()


def unpack48(blob: bytes) -> np.ndarray:
    n = len(blob) // 6
    return np.frombuffer(blob, "<u4", n).astype(np.uint64) | np.frombuffer(blob, "<u2", n, offset=4 * n).astype(np.uint64) << np.uint64(32)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal neighbours: where each run starts, and its length."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return first, np.diff(np.append(first, len(keys)))


def parts(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places in it in ascending order)."""
    order = np.argsort(buckets.astype(np.uint16) if len(buckets) and buckets.max() < 65536 else buckets, kind="stable")
    first, size = runs(buckets[order])
    for a, n in zip(first.tolist(), size.tolist(), strict=True):
        yield int(buckets[order[a]]), order[a : a + n]


def each_piece(batches: Iterator[pa.RecordBatch], id_at: int = 0, text_at: int = 1, with_column: int | None = None) -> Iterator[tuple]:
    """(number of the piece, ids, bytes, offsets and, if asked for, another column of numbers); a task that is run again numbers its pieces as before."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids = np.asarray(batch.column(id_at).cast(pa.int64()).fill_null(NO_ID))
        more = None if with_column is None else np.asarray(batch.column(with_column))
        buf, off = T.utf8(batch.column(text_at))
        for a, b, part, part_off in T.pieces(buf, off):
            yield (number, ids[a:b], part, part_off, *(() if more is None else (more[a:b],)))
            number += 1


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def batches_of(rows: list[tuple], schema: pa.Schema) -> list[pa.RecordBatch]:
    return table_of(rows, schema).to_batches()
