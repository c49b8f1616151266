"""Suffix-array dedup of byte strings.

Strings of 50 bytes that two documents share have an anchor in common, a place that their bytes alone choose. Only
anchors that occur again go further, with the bytes that strings around them can cover. Equal surroundings are
decided by the lowest document that has them. Surroundings that differ are sorted by a suffix array, which is
constructed by linear grouping: groups of suffixes with a common Lyndon prefix are refined from the highest down by
their previous-smaller pointers, then each group's order is emitted, without recursive renaming. Surroundings of one
anchor that are too many for one suffix array are compared string by string.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import exchange as X
from loomwork.llm import scratch
from loomwork.llm import text as T

LENGTH = 50
#: Bytes of an anchor. Every string of LENGTH bytes has REACH + 1 places for one, and holds the lowest of these.
ANCHOR = 24
REACH = LENGTH - ANCHOR
#: Symbols of the texts that are sorted at a time.
CHUNK = 120_000


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of a text whose last symbol is the lowest and occurs once.

    First part: suffixes are grouped by their first symbol, and groups are taken from the highest down. Of each
    suffix in the group the pointer to the previous suffix in a lower group is set. A suffix that k pointers of the group
    reach has a Lyndon prefix that goes on with k repeats of the group's; such suffixes leave their own group for
    one just above it, those with the most repeats highest. Second part: suffixes come out in ascending order;
    each puts those before it whose prefix ends at it into the next free place of their groups.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for i, s in enumerate(order):
        if i and text[s] != text[order[i - 1]]:
            start = i
        place[s], group[s] = i, start
        size[start] += 1
    before = [-1] * n
    end = n
    while end > 0:
        start = group[order[end - 1]]
        if end - start == 1:
            p = order[start] - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[order[start]] = p
            if p >= 0:
                g = group[p]
                m = size[g]
                if m > 1:
                    last, at = g + m - 1, place[p]
                    other = order[last]
                    order[at], place[other] = other, at
                    order[last], place[p] = p, last
                    group[p], size[last], size[g] = last, 1, m - 1
            end = start
            continue
        reached: dict[int, int] = {}
        for s in sorted(order[start:end]):
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[s] = p
            if p >= 0:
                reached[p] = reached.get(p, 0) + 1
        by_count: dict[int, dict[int, list[int]]] = {}
        for p, k in reached.items():
            by_count.setdefault(k, {}).setdefault(group[p], []).append(p)
        for k in sorted(by_count, reverse=True):
            for g, moved in by_count[k].items():
                m = size[g]
                if len(moved) == m:
                    continue
                last = g + m
                for p in moved:
                    last -= 1
                    at, other = place[p], order[last]
                    order[at], place[other] = other, at
                    order[last], place[p] = p, last
                for p in moved:
                    group[p] = last
                size[last], size[g] = len(moved), last - g
        end = start
    out, placed, free = [0] * n, [False] * n, list(range(n))
    out[0], placed[n - 1] = n - 1, True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = before[j]
    return out


def _slide(x: np.ndarray, size: int, f: np.ufunc) -> np.ndarray:
    """f over each run of `size` values, by runs of doubling length."""
    done, out = 1, x
    while done * 2 <= size:
        out = f(out[: len(out) - done], out[done:])
        done *= 2
    rest = size - done
    return f(out[: len(out) - rest], out[rest:]) if rest else out


def _anchor_names(total: np.ndarray, at: np.ndarray, down: np.ndarray) -> np.ndarray:
    return T.mix((total[at + ANCHOR] - total[at]) * down[at]) | np.uint64(1)


def anchors(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose ANCHOR bytes hash lowest in some string of LENGTH bytes of a row, and these hashes.

    Whether a place is one depends on the bytes of such a string alone, so equal strings have equal anchors.
    """
    n = len(buf)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = T.powers(n + 1)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(T._BYTE[buf] * up[:-1], out=total[1:])
    h = _anchor_names(total, np.arange(n - ANCHOR + 1), down)
    low = _slide(h, REACH + 1, np.minimum)
    inside = np.zeros(n + 1, np.int8)  # strings that start here end in the same row
    long = np.diff(off) >= LENGTH
    np.add.at(inside, off[:-1][long], 1)
    np.add.at(inside, off[1:][long] - LENGTH + 1, -1)
    low = np.where(np.cumsum(inside[: len(low)], dtype=np.int8) > 0, low, np.uint64(0))
    padded = np.concatenate([np.zeros(REACH, np.uint64), low, np.zeros(REACH, np.uint64)])
    at = np.flatnonzero(_slide(padded, REACH + 1, np.maximum) == h)
    return at, h[at]


def _by_string(left: list[bytes], right: list[bytes], doc: np.ndarray) -> np.ndarray:
    """As shared_windows() for one group, a string's distance to the anchor at a time."""
    masks = np.zeros(len(left), np.int64)
    n_left, n_right = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    sides = [np.frombuffer(b"".join(side), np.uint8).reshape(-1, REACH) for side in ([x.rjust(REACH, b"\0") for x in left], [x.ljust(REACH, b"\0") for x in right])]
    for o in range(REACH + 1):
        fits = np.flatnonzero((n_left >= o) & (n_right >= REACH - o))
        if len(fits):
            strings = np.ascontiguousarray(np.concatenate([sides[0][fits, REACH - o :], sides[1][fits, : REACH - o]], axis=1)).view(f"V{REACH}").ravel()
            _, kind = np.unique(strings, return_inverse=True)
            low = np.full(kind.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, kind, doc[fits])
            masks[fits[doc[fits] > low[kind]]] |= 1 << o
    return masks


def shared_windows(left: list[bytes], right: list[bytes], group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each surrounding (bytes before and after its group's anchor) a mask of the strings that a lower document has.

    Bit o stands for the string with o bytes before the anchor. Groups are sorted together in chunks; in a text the anchor
    is one symbol of its group, so a string has REACH + 1 symbols. ``group`` ascends.
    """
    masks = np.zeros(len(left), np.int64)
    i = 0
    end_of = np.searchsorted(group, group, side="right")  # groups stand together
    while i < len(left):
        if (end_of[i] - i) * (2 * REACH + 2) > CHUNK:
            whole = slice(i, int(end_of[i]))
            masks[whole] = _by_string(left[whole], right[whole], doc[whole])
            i = whole.stop
            continue
        text: list[int] = []
        base, first = [], i
        while i < len(left) and (not text or len(text) + (end_of[i] - i) * (2 * REACH + 2) <= CHUNK or group[i] == group[i - 1]):
            base.append(len(text))
            text += [b + 2 for b in left[i]]
            text.append(258 + int(group[i] - group[first]))
            text += [b + 2 for b in right[i]]
            text.append(1)
            i += 1
        text.append(0)
        sa = np.array(suffix_array(text))
        n_left = np.array([len(x) for x in left[first:i]])
        n_right = np.array([len(x) for x in right[first:i]])
        owner, used = np.full(len(text), -1), np.zeros(len(text), np.int64)
        starts = np.array(base)
        for o in range(REACH + 1):
            fits = np.flatnonzero((n_left >= o) & (n_right >= REACH - o))
            at = starts[fits] + n_left[fits] - o
            owner[at], used[at] = fits, o
        sa = sa[owner[sa] >= 0]
        if not len(sa):
            continue
        symbols = np.array(text + [0] * REACH)
        new = np.ones(len(sa), bool)
        a, b = sa[:-1], sa[1:]
        same = np.ones(len(a), bool)
        for k in range(REACH + 1):
            same &= symbols[a + k] == symbols[b + k]
        new[1:] = ~same
        docs = doc[first:i][owner[sa]]
        begin = np.flatnonzero(new)
        low = np.repeat(np.minimum.reduceat(docs, begin), np.diff(np.append(begin, len(sa))))
        hit = docs > low
        np.bitwise_or.at(masks, first + owner[sa[hit]], np.int64(1) << used[sa[hit]])
    return masks


def _common(group: np.ndarray, side: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each side (its bytes from the anchor outwards, zeros after them): the most bytes in common with another of its group."""
    words = np.zeros((len(side), 32), np.uint8)
    words[:, :REACH] = side
    keys = words.view(">u8").astype(np.uint64)
    order = np.lexsort((size, *[keys[:, k] for k in range(3, -1, -1)], group))
    a, b = order[:-1], order[1:]  # neighbours in this order have the most in common
    same = np.cumprod(side[a] == side[b], axis=1).sum(axis=1)
    same = np.where(group[a] == group[b], np.minimum(same, np.minimum(size[a], size[b])), 0)
    out = np.zeros(len(side), np.int64)
    np.maximum.at(out, a, same)
    np.maximum.at(out, b, same)
    return out


def shared_masks(group: np.ndarray, doc: np.ndarray, left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """shared_windows() of many surroundings (bytes from the anchor outwards, zeros after them).

    Bytes that no other surrounding of the group has in common can't be in a shared string and are cut off; what is
    then equal within a group is sorted once, for its lowest document.
    """
    if not len(group):
        return np.zeros(0, np.int64)
    ll, rr = _common(group, left, n_left), _common(group, right, n_right)
    some = np.flatnonzero(ll + rr >= REACH)
    outside = np.arange(REACH)
    forms = np.concatenate([group[some, None].view(np.uint8).reshape(-1, 8), ll[some, None].astype(np.uint8), rr[some, None].astype(np.uint8), np.where(outside < ll[some, None], left[some], 0).astype(np.uint8), np.where(outside < rr[some, None], right[some], 0).astype(np.uint8)], axis=1)
    forms = np.ascontiguousarray(forms).view(f"V{10 + 2 * REACH}").ravel()
    _, lead, which = np.unique(forms, return_index=True, return_inverse=True)  # equal groups stand together
    lead = some[lead]
    low = np.full(len(lead), np.iinfo(np.int64).max)
    np.minimum.at(low, which, doc[some])
    first, size = X.runs(group[lead])
    several = np.repeat(size > 1, size)  # a form that is alone in its group shares strings with none
    rank = np.repeat(np.arange(len(first)), size)
    found = np.zeros(len(lead), np.int64)
    found[several] = shared_windows([left[k, : ll[k]][::-1].tobytes() for k in lead[several]], [right[k, : rr[k]].tobytes() for k in lead[several]], rank[several], low[several])
    every = (np.int64(2) << ll[some]) - (np.int64(1) << (REACH - rr[some]))  # strings with REACH - rr to ll bytes before the anchor
    mask = np.zeros(len(group), np.int64)
    mask[some] = np.where(doc[some] > low[which], every, 0) | found[which]
    return mask


_DOCS = pa.schema([("part", pa.int32()), ("id", pa.binary()), ("th", pa.binary()), ("pos", pa.binary()), ("mask", pa.binary()), ("name", pa.binary())])
_DOCS_SQL = "part int, id binary, th binary, pos binary, mask binary, name binary"


def _to_parts(parts: int, i: np.ndarray, th: np.ndarray, pos: np.ndarray, mask: np.ndarray | None, name: np.ndarray | None) -> list[tuple]:
    """Rows for the parts of documents: what is known of places goes back to their texts."""
    of = (T.mix(i.view(np.uint64) ^ T.mix(th.view(np.uint64))) % np.uint64(parts)).astype(np.int64)
    return [(p, i[k].tobytes(), th[k].tobytes(), pos[k].astype("<u4").tobytes(), None if mask is None else mask[k].astype("<u4").tobytes(), None if name is None else name[k].tobytes()) for p, k in X.parts(of)]


def _by_document(t: pa.Table) -> tuple[np.ndarray, ...]:
    """ids, text hashes, places, masks and names of a part, ordered by document and place, and where documents start."""
    i, th = T.joined(t, "id", np.int64), T.joined(t, "th", np.int64)
    pos = T.joined(t, "pos", "<u4").astype(np.int64)
    mask = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(m, "<u4").astype(np.int64) if m is not None else np.full(len(p) // 4, (1 << (REACH + 1)) - 1) for m, p in zip(t.column("mask").to_pylist(), t.column("pos").to_pylist(), strict=True)]])
    name = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(m, np.uint64) if m is not None else np.zeros(len(p) // 4, np.uint64) for m, p in zip(t.column("name").to_pylist(), t.column("pos").to_pylist(), strict=True)]])
    order = np.lexsort((pos, th, i))
    i, th, pos, mask, name = i[order], th[order], pos[order], mask[order], name[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (th[1:] != th[:-1])
    return i, th, pos, mask, name, np.flatnonzero(new)


def _per_document(t: pa.Table) -> pa.Table:
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("pos", pa.binary()), ("name", pa.binary())])
    i, th, pos, _, name, first = _by_document(t)
    last = np.append(first[1:], len(i))
    return X.table_of([(int(i[a]), int(th[a]), pos[a:b].astype("<u4").tobytes(), name[a:b].tobytes()) for a, b in zip(first, last, strict=True)], schema)


def _ranges(t: pa.Table) -> pa.Table:
    """Per document: merged ranges of places where strings that go start (they may reach over the ends of the text)."""
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("lo", pa.list_(pa.int64())), ("hi", pa.list_(pa.int64()))])
    i, th, pos, mask, _, first = _by_document(t)
    last = np.append(first[1:], len(i))
    bits = np.arange(REACH + 1)
    out = []
    for a, b in zip(first, last, strict=True):
        at = np.unique((pos[a:b, None] - bits)[(mask[a:b, None] >> bits) & 1 > 0])
        if len(at):
            cut = np.flatnonzero(np.diff(at) > 1) + 1
            out.append((int(i[a]), int(th[a]), at[np.concatenate([[0], cut])].tolist(), at[np.append(cut, len(at)) - 1].tolist()))
    return X.table_of(out, schema)


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """id, th and the ranges lo..hi of places where strings start that also start in a document with a lower id."""
    buckets = X.bucket_count(rows, "text")
    sent = pa.schema([("bucket", pa.int32()), ("piece", pa.int64()), ("kind", pa.int32()), ("name", pa.binary()), ("at", pa.binary()), ("th", pa.binary())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, th = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            for a, b, buf, off in T.pieces(*T.utf8(batch.column(1))):
                at, h = anchors(buf, off)
                order = np.argsort(h, kind="stable")
                begin, count = X.runs(h[order])
                lead, twice = order[begin], count > 1  # of a name only the first place is sent; the others are known to occur again
                later = np.ones(len(at), bool)
                later[lead] = False
                bucket, low = X.split_name(h[lead], buckets)
                out = [(p, piece, 0, X.pack48(low[k]), at[lead[k]].astype("<u4").tobytes(), np.packbits(twice[k]).tobytes()) for p, k in X.parts(bucket)]
                out.append((int(piece % buckets), piece, 1, None, at[later].astype("<u4").tobytes(), None))
                out.append((int(piece % buckets), piece, 2, ids[a:b].tobytes(), off.astype(np.int64).tobytes(), th[a:b].tobytes()))
                yield from X.batches_of(out, sent)
                piece += 1

    def again(t: pa.Table) -> pa.Table:
        """In a bucket: anchors that occur again."""
        kind = np.asarray(t.column("kind"))
        col = {c: t.column(c).to_pylist() for c in ("piece", "name", "at", "th")}
        bucket = t.column("bucket")[0].as_py()
        out = [(bucket, col["piece"][i], int(kind[i]), col["name"][i], col["at"][i], col["th"][i]) for i in np.flatnonzero(kind > 0)]
        at_rows = np.flatnonzero(kind == 0)
        if len(at_rows):
            names = [X.unpack48(col["name"][i]) for i in at_rows]
            size = np.array([len(x) for x in names])
            every = np.concatenate(names)
            order = np.argsort(every, kind="stable")
            _, count = X.runs(every[order])
            keep = np.concatenate([np.unpackbits(np.frombuffer(col["th"][i], np.uint8), count=int(n)) for i, n in zip(at_rows, size, strict=True)]).astype(bool)
            keep[order] |= np.repeat(count > 1, count)
            begin = np.cumsum(size) - size
            for i, a, k in zip(at_rows, begin, size, strict=True):
                m = keep[a : a + k]
                if m.any():
                    out.append((bucket, col["piece"][i], 0, None, np.frombuffer(col["at"][i], "<u4")[m].tobytes(), None))
        return X.table_of(out, sent)

    def to_documents(t: pa.Table) -> pa.Table:
        """In a piece: the kept anchors of each document."""
        schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("pos", pa.binary())])
        kind = np.asarray(t.column("kind"))
        col = {c: t.column(c).to_pylist() for c in ("name", "at", "th")}
        info = int(np.flatnonzero(kind == 2)[0])
        ids, off, th = (np.frombuffer(col[c][info], np.int64) for c in ("name", "at", "th"))
        at = np.sort(np.concatenate([np.zeros(0, "<u4"), *[np.frombuffer(col["at"][i], "<u4") for i in np.flatnonzero(kind < 2)]])).astype(np.int64)
        cut = np.searchsorted(at, off)
        return X.table_of([(int(ids[r]), int(th[r]), (at[cut[r] : cut[r + 1]] - off[r]).astype("<u4").tobytes()) for r in np.flatnonzero(np.diff(cut))], schema)

    sent_sql = "bucket int, piece long, kind int, name binary, at binary, th binary"
    kept = scratch.table(rows.select("id", "text", "th").mapInArrow(find, sent_sql).groupBy("bucket").applyInArrow(X.lean(again), sent_sql), "anchors")
    X.release(kept)
    places = kept.groupBy("piece").applyInArrow(X.lean(to_documents), "id long, th long, pos binary").dropDuplicates(["id", "th"])

    # kind 0: anchors with their surroundings; 1: places whose surroundings a lower document of the piece has
    around = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("name", pa.binary()), ("ctx", pa.binary()), ("tags", pa.binary()), ("id", pa.binary()), ("th", pa.binary()), ("pos", pa.binary())])

    def prepared(batch: pa.RecordBatch) -> Iterator[tuple]:
        """(first row, row after the last, bytes, offsets, prefix sums, places in the bytes, their rows) of each piece."""
        buf, off = T.utf8(batch.column(2))
        for a, b, part, part_off in T.pieces(buf, off):
            pos = [np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in batch.column(3).slice(a, b - a)]
            row = np.repeat(np.arange(b - a), [len(p) for p in pos])
            yield a, b, part, part_off, np.concatenate([np.zeros(0, np.int64), *pos]) + part_off[row], row

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for a, b, buf, off, at, row in prepared(batch):
                if not len(at):
                    continue
                up, down = T.powers(len(buf) + 1)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T._BYTE[buf] * up[:-1], dtype=np.uint64)])
                name = _anchor_names(total, at, down)
                lo, hi = np.maximum(at - REACH, off[row]), np.minimum(at + LENGTH, off[row + 1])
                of = lambda x, y: T.mix((total[y] - total[x]) * down[x] + (y - x).astype(np.uint64))  # noqa: B023, E731
                ctx = T.mix(of(lo, hi) + (at - lo).astype(np.uint64))
                half = REACH // 2
                l_ok, r_ok = at - half >= off[row], at + ANCHOR + half <= off[row + 1]
                left = of(np.where(l_ok, at - half, at), at) | np.uint64(1)
                right = of(at + ANCHOR, np.where(r_ok, at + ANCHOR + half, at + ANCHOR)) | np.uint64(1)
                tags = np.stack([np.where(l_ok, left, 0), np.where(r_ok, right, 0)]).astype(np.uint64) & np.uint64(0xFFFFFFFF)
                order = np.lexsort((ids[a:b][row], ctx, name))
                new = np.ones(len(order), bool)
                new[1:] = (name[order][1:] != name[order][:-1]) | (ctx[order][1:] != ctx[order][:-1])
                mine = ids[a:b][row[order]]
                later = np.zeros(len(order), bool)
                later[order] = mine > mine[np.flatnonzero(new)][np.cumsum(new) - 1]
                done, left_over = np.flatnonzero(later), np.flatnonzero(~later)
                if len(done):
                    yield from X.batches_of([(int(TaskContext.get().partitionId() % buckets), 1, None, None, None, ids[a:b][row[done]].tobytes(), th[a:b][row[done]].tobytes(), (at - off[row])[done].astype("<u4").tobytes())], around)
                bucket, low = X.split_name(name, buckets)
                yield from X.batches_of([(p, 0, X.pack48(low[k]), ctx[k].tobytes(), tags[:, k].astype("<u4").tobytes(), ids[a:b][row[k]].tobytes(), th[a:b][row[k]].tobytes(), (at - off[row])[k].astype("<u4").tobytes()) for p, k in ((p, left_over[k]) for p, k in X.parts(bucket[left_over]))], around)

    def decide(t: pa.Table) -> pa.Table:
        """In a bucket: all but the lowest document with equal surroundings lose them; others that may share a string are to be sorted."""
        known = t.filter(pc.equal(t.column("kind"), 1))
        t = t.filter(pc.equal(t.column("kind"), 0))
        out = _to_parts(buckets, T.joined(known, "id", np.int64), T.joined(known, "th", np.int64), T.joined(known, "pos", "<u4").astype(np.int64), None, None)
        if not len(t):
            return X.table_of(out, _DOCS)
        name = np.concatenate([X.unpack48(x) for x in t.column("name").to_pylist()])
        ctx, i, th = T.joined(t, "ctx", np.uint64), T.joined(t, "id", np.int64), T.joined(t, "th", np.int64)
        pos = T.joined(t, "pos", "<u4").astype(np.int64)
        tags = np.concatenate([np.frombuffer(x, "<u4").reshape(2, -1) for x in t.column("tags").to_pylist()], axis=1).astype(np.uint64)
        order = np.lexsort((i, ctx, name))
        name, ctx, i, th, pos, tags = name[order], ctx[order], i[order], th[order], pos[order], tags[:, order]
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (ctx[1:] != ctx[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(name)))
        low = i[first]
        gone = i > np.repeat(low, size)
        out += _to_parts(buckets, i[gone], th[gone], pos[gone], None, None)

        def meets(tag: np.ndarray) -> np.ndarray:
            key = T.mix(name[first] ^ T.mix(tag[first] + np.uint64(99)))
            by = np.lexsort((low, key))
            begin, count = X.runs(key[by])
            differ = low[by][begin] < low[by][begin + count - 1]
            ok = np.zeros(len(first), bool)
            ok[by] = np.repeat(differ, count)
            return ok & (tag[first] != 0)

        open_ = np.repeat(meets(tags[0]) | meets(tags[1]), size) & ~gone
        bucket = t.column("bucket")[0].as_py()
        ask = _to_parts(buckets, i[open_], th[open_], pos[open_], None, T.mix(name[open_] ^ np.uint64(bucket << 48)))
        return X.table_of([*out, *ask], _DOCS)

    decided = places.hint("merge").join(rows, ["id", "th"]).select("id", "th", "text", "pos").mapInArrow(surround, "bucket int, kind int, name binary, ctx binary, tags binary, id binary, th binary, pos binary")
    decided = scratch.table(decided.groupBy("bucket").applyInArrow(X.lean(decide), _DOCS_SQL), "decided")
    X.release(decided)
    scratch.drop(kept)
    ask = decided.where("name is not null").groupBy("part").applyInArrow(X.lean(_per_document), "id long, th long, pos binary, name binary")
    fetched_sql = "bucket int, name binary, id binary, th binary, pos binary, many binary, left binary, right binary"
    fetched = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("name", "id", "th", "pos", "many", "left", "right")]])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes around anchors, once for equal ones of a document."""
        for batch in batches:
            ids, th = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for a, b, buf, off, at, row in prepared(batch):
                raw = buf.tobytes()
                name = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(4).slice(a, b - a)]])
                same: dict[tuple, list[int]] = defaultdict(list)
                for p, r, g in zip(at.tolist(), row.tolist(), name.tolist(), strict=True):
                    s, e = int(off[r]), int(off[r + 1])
                    same[g, r, raw[max(p - REACH, s) : p][::-1], raw[p + ANCHOR : min(p + LENGTH, e)]].append(p - s)
                by: dict[int, list] = defaultdict(list)
                for (g, r, left, right), pos in same.items():
                    by[g % buckets].append((g, ids[a + r], th[a + r], pos, left, right))
                out = []
                for k, es in by.items():
                    lr = [b"".join([bytes([len(e[c])]) + e[c].ljust(REACH, b"\0") for e in es]) for c in (4, 5)]  # both from the anchor outwards
                    out.append((k, np.array([e[0] for e in es], np.uint64).tobytes(), np.array([e[1] for e in es], np.int64).tobytes(), np.array([e[2] for e in es], np.int64).tobytes(), np.array([p for e in es for p in e[3]], "<u4").tobytes(), np.array([len(e[3]) for e in es], "<u4").tobytes(), *lr))
                yield from X.batches_of(out, fetched)

    def sort(t: pa.Table) -> pa.Table:
        """In a bucket: the suffix array of the surroundings tells which strings a lower document has."""
        name, i, th = T.joined(t, "name", np.uint64), T.joined(t, "id", np.int64), T.joined(t, "th", np.int64)
        many, pos = T.joined(t, "many", "<u4").astype(np.int64), T.joined(t, "pos", "<u4").astype(np.int64)
        left, right = T.joined(t, "left", np.uint8).reshape(-1, REACH + 1), T.joined(t, "right", np.uint8).reshape(-1, REACH + 1)
        mask = shared_masks(name, i, left[:, 1:], left[:, 0].astype(np.int64), right[:, 1:], right[:, 0].astype(np.int64))
        hit = np.repeat(mask > 0, many)
        of = np.repeat(np.arange(len(many)), many)[hit]
        return X.table_of(_to_parts(buckets, i[of], th[of], pos[hit], mask[of], None), _DOCS)

    text_of = ask.hint("merge").join(rows, ["id", "th"]).select("id", "th", "text", "pos", "name").mapInArrow(fetch, fetched_sql)
    sorted_ = scratch.table(text_of.groupBy("bucket").applyInArrow(X.lean(sort), _DOCS_SQL), "sorted")
    X.release(sorted_)
    every = decided.where("name is null").unionByName(sorted_)
    ranges = scratch.table(every.groupBy("part").applyInArrow(X.lean(_ranges), "id long, th long, lo array<long>, hi array<long>"), "ranges")
    X.release(ranges)
    scratch.drop(decided, sorted_)
    return ranges


def remove_shared(docs: DataFrame, outputs: tuple[str, ...] = ("kept",), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and, as asked, kept (bytes) and kept_sha256 of every row.

    A byte of the UTF-8 text goes if a string of 50 bytes around it also starts in a row with a lower id. Rows
    with one id never take bytes from each other, so repeated rows fare alike; a null id is below all others. Null
    texts count as empty. An empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("own"), F.coalesce(F.col(id_col).cast("long"), F.lit(X.NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    ranges = repeated_ranges(rows.select("id", "th", "text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            los, his, got = batch.column(2), batch.column(3), {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")}
            buf, off = T.utf8(batch.column(1))
            for r in range(len(batch)):
                text = buf[off[r] : off[r + 1]].tobytes()
                n, at, kept, spans = len(text), 0, [], 0
                for lo, hi in zip(los[r].as_py() or [], his[r].as_py() or [], strict=True):
                    lo, hi = max(lo, 0), min(hi, n - LENGTH) + LENGTH
                    if lo > at or not spans:
                        kept.append(text[at:lo])
                        spans += 1
                    at = hi
                kept.append(text[at:])
                whole = b"".join(kept)
                for k, v in (("n_bytes", n), ("n_removed", n - len(whole)), ("n_spans", spans), ("kept", whole), ("kept_sha256", hashlib.sha256(whole).hexdigest())):
                    got[k].append(v)
            kinds = {"kept": pa.binary(), "kept_sha256": pa.string()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(got[k], kinds.get(k, pa.int64())) for k in ("n_bytes", "n_removed", "n_spans", *outputs)]], ["doc_id", "n_bytes", "n_removed", "n_spans", *outputs])

    kind = docs.schema[id_col].dataType.simpleString()
    sql = {"kept": "kept binary", "kept_sha256": "kept_sha256 string"}
    both = rows.join(ranges.hint("merge"), ["id", "th"], "left").select("own", "text", "lo", "hi")
    return both.mapInArrow(cut, ", ".join([f"doc_id {kind}, n_bytes long, n_removed long, n_spans long", *[sql[k] for k in outputs]]))


def op8_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_shared(docs, ("kept_sha256",))


QUERIES = {"op8_linear_grouping": op8_linear_grouping}
