"""Words, shingles and hashes of many texts at once, on their UTF-8 bytes.

A batch of texts is one byte array and an array of offsets. Everything here is vectorised over a piece of a
batch; ``pieces`` bounds how large a piece is, so memory doesn't follow the size of a batch.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; a longer single text makes a piece of its own.
PIECE = 1 << 20

#: glibc's call that returns freed memory; other C libraries have none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_RNG = np.random.Generator(np.random.PCG64(0x10053))
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACES = _RNG.integers(0, 1 << 64, 4096, dtype=np.uint64) | np.uint64(1)
#: The bits of the first n bytes of eight, and the longest range that is hashed eight bytes at a time.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG = 64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and of its inverse."""
    if len(_POWERS["up"]) < n:
        n2 = max(n, PIECE + 1)
        for k, base in (("up", _BASE), ("down", _UNBASE)):
            x = np.full(n2, base, dtype=np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (two xor-shift-multiply rounds)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is empty."""
    col = col.cast(pa.large_binary())
    n = len(col)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    if col.null_count:
        size = np.diff(off) * np.asarray(col.is_valid())
        if size.sum() != off[-1] - off[0]:
            return utf8(col.fill_null(b""))
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(buf: np.ndarray, off: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of at most so many bytes, or of one row."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield at, to, buf[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to
    give_back()


def give_back() -> None:
    """Return freed memory to the system: worker processes are reused, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def words(buf: np.ndarray, off: np.ndarray, marks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs that are free of ``marks`` (ASCII white space), and the row offsets into them."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    ink = ~marks[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[off] = True
    begin = ink.copy()
    begin[1:] &= ~ink[:-1] | edge[1:-1]
    end = ink
    end[:-1] &= ~ink[1:] | edge[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range.

    Blocks of eight bytes go one after another through a bijection that spreads every bit, so ranges of equal length
    and up to eight bytes never share a hash. Ranges beyond LONG bytes get 64 bits of BLAKE2b.
    """
    n = ends - starts
    wide = np.concatenate([buf, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(buf) + 1,), "<u8", buffer=wide, strides=(1,))  # the eight bytes from every place on
    h = mix(n.astype(np.uint64) + _BASE)
    h = mix(h ^ (blocks[starts] & _FIRST[np.minimum(n, 8)]))
    for done in range(8, min(LONG, int(n.max(initial=0))), 8):
        more = np.flatnonzero((n > done) & (n <= LONG))
        h[more] = mix(h[more] ^ (blocks[starts[more] + done] & _FIRST[np.minimum(n[more] - done, 8)]))
    for i in np.flatnonzero(n > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def window_hashes(units: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` consecutive units within a row, and the row offsets into them."""
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    out = np.concatenate([[0], np.cumsum(counts)])
    n = len(units) - size + 1
    if n <= 0 or not out[-1]:
        return np.zeros(0, np.uint64), out
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total += units[k : k + n] * _PLACES[k]
    return mix(total)[take_ranges(offsets[:-1], counts)], out


def take_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] numbers), then those of the next range, and so on."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def joined(t: pa.Table, name: str, dtype) -> np.ndarray:  # noqa: ANN001
    """The blobs of a binary column one after another, as numbers."""
    return np.frombuffer(b"".join(t.column(name).to_pylist()), dtype=dtype)
