"""N-gram Jaccard join by token-combination prefixes.

A token is the hash of a shingle. Tokens are put in one global order, rare ones first, frequent ones by rising count. Sets that are
similar enough share something in short prefixes of that order. A rare token in the prefix is a signature by itself;
tokens of frequent classes count in pairs only, and the prefix is extended until any allowed loss of tokens still leaves a
common signature. Candidates that share a signature are verified exactly; those that are connected by verified links already
need no more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import components as C
from loomwork.llm import exchange as X
from loomwork.llm import scratch
from loomwork.llm import text as T

WORDS = 5
#: Similarity of at least NUM / DEN links two sets.
NUM, DEN = 3, 4
#: Token classes in at least so many sets count as frequent, but no more than the most frequent MOST_CLASSES of them,
#: which are sent to all workers (16 bytes each). The choice moves work only: results don't depend on it.
FREQUENT, MOST_CLASSES = 64, 1 << 16
#: Groups of a signature up to this size give all their pairs at once; larger ones first link to one of their members.
SMALL_GROUP = 4
#: Members of a larger group that all others are compared with at first.
LEADS = 6
#: Tokens of a frequent class that share a part of the universe are paired; a prefix has about so many in a part.
PART = 6
#: Groups of a member that its list names, so that pairs which share many groups are taken up once.
LISTED = 32
#: Bits for each id of the bitmap that leaves rows out before they are shuffled, and the most it has (8 MB, sent to all workers).
ID_BITS, MOST_ID_BITS = 16, 1 << 26
#: 64-bit words of the bitmap by which members of a large group are compared before their token sets are.
SKETCH = 16
BITMAP = [f"s{k}" for k in range(SKETCH)]


def token_sets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens of each row, ascending, and the row offsets into them."""
    low = T.LOWER[buf]
    starts, ends, rows = T.words(low, off)
    units = T.range_hashes(low, starts, ends)
    h, offsets = T.window_hashes(units, rows, WORDS)
    n = np.diff(rows)
    short = np.flatnonzero((n > 0) & (n < WORDS))
    row = np.repeat(np.arange(len(n)), np.diff(offsets))
    if len(short):
        whole = np.array([T.mix(np.array([int(np.bitwise_xor.reduce(T.mix(units[rows[r] : rows[r + 1]] + np.arange(1, n[r] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))) ^ int(n[r])], np.uint64))[0] for r in short], np.uint64)
        h, row = np.concatenate([h, whole]), np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[fresh], row[fresh]
    return h, np.searchsorted(row, np.arange(len(n) + 1))


def digests(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set: two sums of differently mixed tokens."""
    out = []
    for salt in (0x1234567, 0x89ABCDE):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(h ^ np.uint64(salt)), dtype=np.uint64)])
        out.append(T.mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def classes(h: np.ndarray, buckets: int) -> np.ndarray:
    """The class of each token: its bucket and 32 more bits."""
    return X.split_name(h, buckets)[0].astype(np.uint64) << np.uint64(32) | (h >> np.uint64(8)) & np.uint64(0xFFFFFFFF)


def frequent_classes(docs: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent token classes (ascending) and the number of sets that have them, counted over all documents."""
    schema = pa.schema([("bucket", pa.int32()), ("cls", pa.binary()), ("n", pa.binary())])
    counted = pa.schema([("cls", pa.int64()), ("n", pa.int64())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, buf, off in X.each_piece(batches):
            h, offsets = token_sets(buf, off)
            _, lead = np.unique(digests(h, offsets)[0], return_index=True)
            cls, n = np.unique(classes(h[T.take_ranges(offsets[lead], np.diff(offsets)[lead])], buckets), return_counts=True)
            first, size = X.runs(cls >> np.uint64(32))
            yield from X.batches_of([(int(cls[a] >> np.uint64(32)), cls[a : a + k].astype("<u4").tobytes(), _counts(n[a : a + k])) for a, k in zip(first.tolist(), size.tolist(), strict=True)], schema)

    def add(t: pa.Table) -> pa.Table:
        cls, n = t.column("cls").to_pylist(), t.column("n").to_pylist()
        every = np.concatenate([np.frombuffer(c, "<u4") for c in cls])
        many = np.concatenate([_uncount(b, len(c) // 4) for b, c in zip(n, cls, strict=True)])
        order = np.argsort(every, kind="stable")
        first, _ = X.runs(every[order])
        total = np.add.reduceat(many[order], first)
        keep = total >= FREQUENT
        bucket = t.column("bucket")[0].as_py()
        return pa.Table.from_arrays([pa.array((np.int64(bucket) << 32) | every[order][first][keep].astype(np.int64)), pa.array(total[keep])], schema=counted)

    found = docs.mapInArrow(send, "bucket int, cls binary, n binary").groupBy("bucket").applyInArrow(X.lean(add), "cls long, n long")
    top = found.orderBy(F.desc("n"), "cls").limit(MOST_CLASSES).collect()  # at most MOST_CLASSES rows
    X.release(docs)
    cls, n = np.array([r["cls"] for r in top], np.uint64), np.array([r["n"] for r in top], np.int64)
    order = np.argsort(cls)
    return cls[order], n[order]


def _counts(n: np.ndarray) -> bytes:
    """Nothing if all counts are 1."""
    return b"" if (n == 1).all() else n.astype("<u4").tobytes()


def _uncount(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<u4").astype(np.int64) if blob else np.ones(n, np.int64)


def tolerances(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of a set may be missing: against smaller partners, and against partners at least as large.

    With overlap >= NUM / (NUM + DEN) * (|x| + |y|) and partners of at least NUM / DEN the size, these are the least overlaps.
    """
    return n - -(-NUM * n // DEN), n - -(-2 * NUM * n // (NUM + DEN))


def level(n: int) -> int:
    """Sets that may be similar have levels that differ by one at most."""
    return int(math.log(n) / math.log(DEN / NUM) + 1e-9)


def pair_signatures(freq: np.ndarray, rare: int, loss: int, lv: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of pairs of frequent tokens (in global order) for sets compared at a level, and the place of the first of each.

    A part of the universe with c tokens of the prefix still has a pair after c - 2 losses, so the prefix grows until
    the sum of c - 1 over the parts, and the rare tokens, exceed the loss.
    """
    m = max(1, round((DEN / NUM) ** lv * (1 - NUM / DEN) / PART))
    part = (freq >> np.uint64(3)) % np.uint64(m)
    seen: dict[int, list[int]] = {}
    strength, names, place = rare, [], []
    for i, p in enumerate(part.tolist()):
        if strength > loss:
            break
        mine = seen.setdefault(p, [])
        for j in mine:
            names.append((int(freq[j]), int(freq[i])))
            place.append(j)
        strength += bool(mine)
        mine.append(i)
    if not names:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ab = np.array(names, np.uint64)
    ab.sort(axis=1)
    return T.mix(ab[:, 0] * np.uint64(0xD6E8FEB86659FD93) + T.mix(ab[:, 1] + np.uint64(lv + 1))), np.array(place)


def signatures(h: np.ndarray, offsets: np.ndarray, common: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """name, row, place (of its first token in the set's order) and role of every signature, and the number of rare tokens of every row.

    Role bits: 1 meets partners at least as large, 2 meets partners at most as large, 4 is a pair, 8 is a rare token.
    """
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    cls = classes(h, buckets)
    at = np.minimum(np.searchsorted(common, cls), max(len(common) - 1, 0))
    often = np.where(common[at] == cls, counts[at], 0) if len(common) else np.zeros(len(h), np.int64)
    rare = often == 0
    small, large = tolerances(n)
    before = np.concatenate([[0], np.cumsum(rare)])
    n_rare = before[offsets[1:]] - before[offsets[:-1]]
    place = before[:-1] - before[offsets[:-1]][row]
    take = rare & (place <= small[row]) & (n[row] > 1)
    names, rows, places = [h[take]], [row[take]], [place[take]]
    roles = [np.where(place[take] <= large[row[take]], 3 | 8, 2 | 8).astype(np.uint8)]
    for r in np.flatnonzero((n_rare <= small) & (n > 1)):  # too few rare tokens: pairs of frequent ones
        mine = slice(offsets[r], offsets[r + 1])
        f = ~rare[mine]
        freq, c = h[mine][f], often[mine][f]
        freq = freq[np.lexsort((freq, c))]
        lv, c1 = level(int(n[r])), int(n_rare[r])
        for at_level, loss, role in ((lv, int(large[r]), 1), (lv, int(small[r]), 2), (lv - 1, int(small[r]), 2)):
            if c1 > loss:
                continue
            name, first = pair_signatures(freq, c1, loss, at_level)
            names.append(name)
            rows.append(np.full(len(name), r))
            places.append(first + c1)
            roles.append(np.full(len(name), role | 4, np.uint8))
    return np.concatenate(names), np.concatenate(rows), np.concatenate(places), np.concatenate(roles), n_rare


_SENT = pa.schema([("bucket", pa.int32()), ("piece", pa.int64()), ("kind", pa.int32()), ("name", pa.binary()), ("row", pa.binary()), ("place", pa.binary()), ("role", pa.binary())])
_SENT_SQL = "bucket int, piece long, kind int, name binary, row binary, place binary, role binary"
_FULL = pa.schema([("bucket", pa.int32()), ("name", pa.binary()), ("id", pa.binary()), ("digest", pa.binary()), ("n", pa.binary()), ("rare", pa.binary()), ("place", pa.binary()), ("role", pa.binary())])
_FULL_SQL = "bucket int, name binary, id binary, digest binary, n binary, rare binary, place binary, role binary"
# kind 0: a candidate pair a, b; 1: members of a large group: group a, node b, n, rare, place, role
_CAND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("rare", pa.int32()), ("place", pa.int32()), ("role", pa.int32())])
_CAND_SQL = "kind int, a long, b long, n int, rare int, place int, role int"


def _send_signatures(docs: DataFrame, buckets: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(frequent_classes(docs, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shared.value
        for piece, ids, buf, off, named in X.each_piece(batches, with_column=2):
            h, offsets = token_sets(buf, off)
            d1, d2 = digests(h, offsets)
            order = np.lexsort((ids, d2, d1))
            lead = np.sort(order[X.runs(d1[order])[0]])  # of equal sets the lowest id speaks
            n = np.diff(offsets)
            mine = h[T.take_ranges(offsets[lead], n[lead])]
            name, row, place, role, n_rare = signatures(mine, np.concatenate([[0], np.cumsum(n[lead])]), common, counts, buckets)
            order = np.argsort(row, kind="stable")
            name, row, place, role = name[order], row[order], place[order], role[order]
            bucket, low = X.split_name(name, buckets)
            out = [(b, piece, 0, X.pack48(low[p]), X.pack(row[p]), X.pack_counts(place[p]), role[p].tobytes()) for b, p in X.parts(bucket)]
            info = np.stack([ids, n, d1, d2, named]).astype(np.int64)
            out.append((int(piece % buckets), piece, 2, info.tobytes(), lead.astype(np.int64).tobytes(), X.pack_counts(n_rare), None))
            yield from X.batches_of(out, _SENT)

    return docs.mapInArrow(run, _SENT_SQL)


def _shared_only(t: pa.Table) -> pa.Table:
    """In a bucket: what is left are signatures that two sets at least have, in roles that can meet."""
    kind = np.asarray(t.column("kind"))
    cols = {c: t.column(c).to_pylist() for c in ("piece", "name", "row", "place", "role")}
    bucket = t.column("bucket")[0].as_py()
    out = [(bucket, *[cols["piece"][i], 2], *[cols[c][i] for c in ("name", "row", "place", "role")]) for i in np.flatnonzero(kind == 2)]
    rows = np.flatnonzero(kind == 0)
    if len(rows):
        name = np.concatenate([X.unpack48(cols["name"][i]) for i in rows])
        size = np.array([len(cols["role"][i]) for i in rows])
        role = np.concatenate([np.frombuffer(cols["role"][i], np.uint8) for i in rows])
        order = np.argsort(name, kind="stable")
        first, count = X.runs(name[order])
        meets = (count > 1) & (np.bitwise_or.reduceat(role[order], first) & 3 == 3)
        keep = np.zeros(len(name), bool)
        keep[order] = np.repeat(meets, count)
        begin = np.cumsum(size) - size
        for i, a, k in zip(rows, begin, size, strict=True):
            m = keep[a : a + k]
            if m.any():
                out.append((bucket, cols["piece"][i], 0, X.pack48(name[a : a + k][m]), X.pack(X.unpack(cols["row"][i])[m]), X.pack_counts(X.unpack_counts(cols["place"][i])[m]), role[a : a + k][m].tobytes()))
    return X.table_of(out, _SENT)


def _attach(t: pa.Table) -> pa.Table:
    """In a piece: signatures get the id, digest and size of their sets, and go back to their buckets."""
    kind = np.asarray(t.column("kind"))
    cols = {c: t.column(c).to_pylist() for c in ("bucket", "name", "row", "place", "role")}
    at = int(np.flatnonzero(kind == 2)[0])
    ids, n, d1, _, _ = np.frombuffer(cols["name"][at], np.int64).reshape(5, -1)
    lead, rare = np.frombuffer(cols["row"][at], np.int64), X.unpack_counts(cols["place"][at])
    out = []
    for i in np.flatnonzero(kind == 0):
        mine = X.unpack(cols["row"][i])
        row = lead[mine]
        out.append((cols["bucket"][i], cols["name"][i], ids[row].tobytes(), d1[row].tobytes(), X.pack_counts(n[row]), X.pack_counts(rare[mine]), cols["place"][i], cols["role"][i]))
    return X.table_of(out, _FULL)


def can_link(na: np.ndarray, ca: np.ndarray, pa_: np.ndarray, ra: np.ndarray, nb: np.ndarray, cb: np.ndarray, pb: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """Whether a (no larger than b) may be similar to b, given the places of a shared signature in both and their numbers of rare tokens.

    A shared rare token may be taken for the first one. Sets that meet by a pair may be taken to share no rare token: a set
    has pairs in a role only if all its rare tokens are signatures in that role, so such sets meet by one of those. Then
    only frequent tokens count, those before the first token of the pair and those from it on.
    """
    pair = (ra & rb & 4 > 0) & ((ra | rb) & 8 == 0)
    most = np.where(pair, np.minimum(pa_ - ca, pb - cb), 0) + np.minimum(na - pa_, nb - pb)
    mixed = (ra & rb & 4 > 0) & ~pair  # two kinds of signature with one name: no bound but the sizes
    return (ra & 1 > 0) & (rb & 2 > 0) & (DEN * na >= NUM * nb) & (mixed | ((NUM + DEN) * most >= NUM * (na + nb)))


def _candidates(t: pa.Table) -> pa.Table:
    """In a bucket: all pairs of small groups, one link a member of larger ones, and the members of these."""
    col = lambda c, kind: T.joined(t, c, kind)
    name = np.concatenate([X.unpack48(b) for b in t.column("name").to_pylist()])
    ids, digest, role = col("id", np.int64), col("digest", np.int64), col("role", np.uint8)
    n, rare, place = (np.concatenate([X.unpack_counts(b) for b in t.column(c).to_pylist()]) for c in ("n", "rare", "place"))
    order = np.lexsort((ids, digest, name))  # equal sets of several pieces: the lowest id stays
    name, ids, digest, n, rare, place, role = (x[order] for x in (name, ids, digest, n, rare, place, role))
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (digest[1:] != digest[:-1])
    begin = np.flatnonzero(new)
    role = np.bitwise_or.reduceat(role, begin) if len(begin) else role
    place = np.minimum.reduceat(place, begin) if len(begin) else place
    name, ids, n, rare = name[begin], ids[begin], n[begin], rare[begin]
    order = np.lexsort((ids, n, name))
    name, ids, n, rare, place, role = (x[order] for x in (name, ids, n, rare, place, role))
    first, size = X.runs(name)
    # a set with too many rare tokens of its own even for the smallest of its group meets nobody by this pair
    meets = (role & 12 != 4) | ((NUM + DEN) * (n - rare) >= NUM * (n + np.repeat(n[first], size)))
    name, ids, n, rare, place, role = (x[meets] for x in (name, ids, n, rare, place, role))
    first, size = X.runs(name)
    pairs_a, pairs_b = [], []

    def test(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = can_link(n[a], rare[a], place[a], role[a], n[b], rare[b], place[b], role[b])
        same = n[a] == n[b]
        ok |= same & can_link(n[b], rare[b], place[b], role[b], n[a], rare[a], place[a], role[a])
        pairs_a.append(ids[a[ok]])
        pairs_b.append(ids[b[ok]])
        return ok

    few = (size > 1) & (size <= SMALL_GROUP)
    for gap in range(1, SMALL_GROUP):
        f = first[few & (size > gap)]
        s = size[few & (size > gap)]
        a = T.take_ranges(f, s - gap)
        test(a, a + gap)
    groups = []
    known: set[bytes] = set()
    for f, s in zip(first[size > SMALL_GROUP].tolist(), size[size > SMALL_GROUP].tolist(), strict=True):
        g = np.arange(f, f + s)
        key = np.stack([ids[g], place[g], role[g]]).tobytes()
        if key in known:
            continue
        known.add(key)
        # each member meets the ones whose ids hash lowest, by a few hashes: groups that share members mostly agree on them
        for salt in range(LEADS):
            lead = f + int(np.argmin(T.mix(ids[g].view(np.uint64) + np.uint64(salt << 40))))
            rest = g[g != lead]
            test(np.minimum(lead, rest), np.maximum(lead, rest))
        tag = int(T.mix(name[f : f + 1] + np.uint64(t.column("bucket")[0].as_py() << 48))[0] >> np.uint64(1))
        groups.append((tag, g))
    a, b = np.concatenate([*pairs_a, np.zeros(0, np.int64)]), np.concatenate([*pairs_b, np.zeros(0, np.int64)])
    a, b = np.minimum(a, b), np.maximum(a, b)
    pair = np.unique(np.stack([a, b]), axis=1)
    zero = np.zeros(pair.shape[1], np.int32)
    parts = [pa.RecordBatch.from_arrays([pa.array(zero), pa.array(pair[0]), pa.array(pair[1]), pa.array(zero), pa.array(zero), pa.array(zero), pa.array(zero)], schema=_CAND)]
    for tag, g in groups:
        parts.append(pa.RecordBatch.from_arrays([pa.array(np.ones(len(g), np.int32)), pa.array(np.full(len(g), tag)), pa.array(ids[g]), *[pa.array(v[g].astype(np.int32)) for v in (n, rare, place, role)]], schema=_CAND))
    return pa.Table.from_batches(parts, schema=_CAND)


def _id_bit(bits: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(bits)).alias("bit")


def _bitmap(ids: DataFrame) -> Broadcast:
    """A bit for each hash of the ids that occur; what has no bit is none of them, so rows can be left out where they lie."""
    bits = min(MOST_ID_BITS, max(1 << 15, 1 << (ids.count() * ID_BITS).bit_length()))
    parts = ids.select(_id_bit(bits)).groupBy(F.shiftright("bit", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit((1 << 15) - 1))).alias("held"))
    out = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for r in parts.collect():  # MOST_ID_BITS bits at most
        out[r["part"]] = np.frombuffer(r["held"], np.uint8)
    return ids.sparkSession.sparkContext.broadcast(out.reshape(-1))


def _marked(rows: DataFrame, bitmap: Broadcast) -> DataFrame:
    return rows.withColumn("bit", _id_bit(8 * len(bitmap.value)))


def _held(batches: Iterator[pa.RecordBatch], bitmap: Broadcast) -> Iterator[pa.RecordBatch]:
    """Of marked rows those that have their bit, in a task."""
    for batch in batches:
        at = np.asarray(batch.column("bit"))
        yield batch.filter(pa.array((bitmap.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))


def _may_link(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that 16 bits of each token don't rule out: tokens that are equal have equal bits, so no link is lost."""
    return _compared(pairs, sets, np.uint16)


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose sets have the wanted similarity, by their whole token sets."""
    return _compared(pairs, sets, np.uint64)


def _compared(pairs: DataFrame, sets: DataFrame, kind: type) -> DataFrame:
    bitmap = _bitmap(pairs.select(F.explode(F.array("a", "b")).alias("id")))

    def upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _held(batches, bitmap):
            tokens = batch.column("tokens")
            if kind is not np.uint64:  # the upper bits, in the same order
                tokens = pa.array([(np.frombuffer(t.as_buffer(), np.uint64) >> np.uint64(48)).astype(kind).tobytes() for t in tokens], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), tokens], ["id", "s"])
            del batch, tokens
            T.give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), kind), np.frombuffer(y.as_buffer(), kind)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
                keep.append(both > 0 and DEN * both >= NUM * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])
            del batch
            T.give_back()

    # only sets that take part in a pair are shuffled
    mine = _marked(sets.select("id", "tokens"), bitmap).mapInArrow(upper, "id long, s binary")
    a, b = (mine.select(F.col("id").alias(k), F.col("s").alias(f"s{k}")) for k in "ab")
    return pairs.join(b.hint("merge"), "b").join(a.hint("merge"), "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def sketches(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A bitmap of SKETCH words for each set, with the bit of each of its tokens (rows x words).

    Bits that differ belong to tokens that differ, so two sets differ in at least as many tokens as their bitmaps in bits.
    """
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    bit = (T.mix(h) % np.uint64(64 * SKETCH)).astype(np.int64)
    out = np.zeros((len(offsets) - 1) * SKETCH, np.uint64)
    np.bitwise_or.at(out, row * SKETCH + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out.reshape(-1, SKETCH).view(np.int64)


def _token_table(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The token sets of the documents that have candidates (and of few others, whose ids share a bit with theirs), and their bitmaps. Texts stay where they lie."""
    schema = pa.schema([("id", pa.int64()), ("tokens", pa.binary()), *[(c, pa.int64()) for c in BITMAP]])
    bitmap = _bitmap(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, buf, off in X.each_piece(_held(batches, bitmap)):
            h, offsets = token_sets(buf, off)
            seen = sketches(h, offsets).tolist()
            yield from X.batches_of([(int(i), h[a:b].tobytes(), *s) for i, a, b, s in zip(ids, offsets[:-1], offsets[1:], seen, strict=True)], schema)

    return _marked(docs.select("id", "text"), bitmap).mapInArrow(run, ", ".join(["id long, tokens binary", *[f"{c} long" for c in BITMAP]]))


def similarity_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the lowest id that links reach, its own included) of every row.

    A row's tokens are its distinct shingles of five words (the whole sequence, if shorter) in lower-cased text; sets link
    at a Jaccard similarity of 3/4 or more. Null texts and texts without words have no tokens and link with
    nothing. Rows with one id are one document: it links with what any of its texts links with, and all its texts
    with words have one component. A row with a null id is a document of its own; its component_id is the lowest id
    that it reaches, or null. Tokens are 64-bit hashes, compared exactly. Empty in, empty out.
    """
    own = F.col(id_col).cast("long")
    # documents without an id get a hash of their text for one inside, which no result shows
    rows = docs.select(F.coalesce(own, F.xxhash64(F.lit("no id"), text_col)).alias("id"), F.col(text_col).alias("text"), own.isNotNull().cast("long").alias("named"))
    buckets = X.bucket_count(rows, "text")
    sent = scratch.table(_send_signatures(rows, buckets).groupBy("bucket").applyInArrow(X.lean(_shared_only), _SENT_SQL), "signatures")
    X.release(sent)
    found = scratch.table(sent.groupBy("piece").applyInArrow(X.lean(_attach), _FULL_SQL).groupBy("bucket").applyInArrow(X.lean(_candidates), _CAND_SQL), "candidates")
    X.release(found)

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.frombuffer(blob.as_buffer(), np.int64).reshape(5, -1)], ["id", "n", "d1", "d2", "named"])

    each = scratch.table(sent.where("kind = 2").select("name").mapInArrow(flat, "id long, n long, d1 long, d2 long, named long"), "rows")
    reps = each.groupBy("d1", "d2").agg(F.min("id").alias("node"))
    each_node = scratch.table(each.join(reps, ["d1", "d2"]).select("id", "n", "named", "node"), "nodes")
    X.release(each_node)
    scratch.drop(sent, each)

    pairs = scratch.table(found.where("kind = 0").groupBy("a", "b").agg(F.count("*").alias("shared")), "pairs")
    members = found.where("kind = 1").select(F.col("a").alias("g"), F.col("b").alias("id"), "n", "rare", "place", "role")
    nodes = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(members.select("id")).distinct()
    sets = scratch.table(_token_table(rows, nodes), "sets")
    X.release(sets)

    # texts of one id; then all pairs of small groups, and each member of a large group with a few of its others
    several = each_node.where("n > 0").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("id", "a")
    same_id = each_node.where("n > 0").join(several, "id").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    likely = scratch.table(_may_link(pairs.select("a", "b"), sets), "likely")
    X.release(likely)
    links = scratch.table(_verify(likely, sets).unionByName(same_id), "links")
    X.release(links)
    scratch.drop(pairs, likely)
    label = scratch.table(C.components(links), "labels")
    X.release(label)

    # then all candidates that aren't connected yet
    def labelled(df: DataFrame, label: DataFrame, key: str, out: str) -> DataFrame:
        known = label.select(F.col("node").alias(key), F.col("label").alias(out))
        return df.join(known, key, "left").withColumn(out, F.coalesce(out, key))

    grouped = scratch.table(labelled(members, label, "id", "label"), "members")
    mixed = scratch.table(grouped.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("g"), "mixed")
    open_ = scratch.table(grouped.join(mixed, "g").select("g", "id", "n", "label"), "open")
    scratch.drop(found, grouped, mixed)
    # a pair is taken up in the lowest group that the lists of both name, by what doesn't depend on the group; without such a group, in each
    lists = open_.groupBy("id").agg(F.slice(F.sort_array(F.collect_list("g")), 1, LISTED).alias("gs"))
    # a bitmap of several texts of one id tells nothing
    bitmap = sets.groupBy("id").agg(*[F.expr(f"bit_or({c})").alias(c) for c in BITMAP], F.count("*").alias("texts"))
    member = open_.join(lists.join(bitmap.hint("merge"), "id").hint("merge"), "id")
    x, y = (member.select("g", *[F.col(c).alias(f"{c}_{k}") for c in ("id", "n", "label", "texts", "gs", *BITMAP)]) for k in "xy")
    # overlap >= NUM / (NUM + DEN) * (n_x + n_y) leaves so many tokens that may differ
    differ = " + ".join(f"bit_count({c}_x ^ {c}_y)" for c in BITMAP)
    near = f"texts_x > 1 or texts_y > 1 or {NUM + DEN} * ({differ}) <= {DEN - NUM} * (n_x + n_y)"
    first = "coalesce(array_min(array_intersect(gs_x, gs_y)), g) >= g"
    fits = F.expr(f"(n_x < n_y or n_x = n_y and id_x < id_y) and label_x <> label_y and {DEN} * n_x >= {NUM} * n_y and ({near}) and {first}")
    more = x.join(y, "g").where(fits).select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"))
    rest = scratch.table(more.distinct(), "apart")
    likely = scratch.table(_may_link(rest, sets), "likely")
    X.release(likely)
    scratch.drop(open_, rest)

    # one of the likely partners of each first, then those that this leaves apart
    one = scratch.table(likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "best")
    first_links, links = links, scratch.table(links.unionByName(_verify(one, sets)), "links")
    X.release(links)
    scratch.drop(first_links, label)
    label = scratch.table(C.components(links), "labels")
    apart = labelled(labelled(likely.join(one, ["a", "b"], "left_anti"), label, "a", "la"), label, "b", "lb").where("la <> lb").select("a", "b")
    apart = scratch.table(apart, "apart")
    late = scratch.table(_verify(apart, sets), "links")
    X.release(late)
    scratch.drop(likely, one, apart, sets)
    if late.limit(1).count():
        scratch.drop(label)
        label = scratch.table(C.components(links.unionByName(late)), "labels")
    scratch.drop(links, late)

    known = each_node.join(label.select("node", "label"), "node", "left")
    known = known.withColumn("c", F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("label", "node")))
    lowest = known.where("named = 1").groupBy("c").agg(F.min("id").alias("component_id"))
    return known.join(lowest, "c", "left").select(F.when(F.col("named") == 1, F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def op3_token_combination_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_token_combination_join": op3_token_combination_join}
