"""How far the sources of each language diverge: L1 distances of smoothed term shares, by two-dimensional tiling.

Groups of a language fall into blocks, its kept terms into chunks. A packed count vector (one group, one chunk) is
replicated to the tiles that its block takes part in, one for each other block; a tile reads its vectors chunk by chunk
and adds up the submatrix of all pairs of its two blocks. No task holds more than two blocks of one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm import scratch
from loomwork.llm import text as T

#: Documents of its language that a kept term occurs in; what is added to each count; ranks of the part `term`.
LEAST_DOCS, SMOOTH, TOP = 30, 5, 50
#: Groups of a block; counts of a chunk (about so many over all groups of a language); successive chunks of a tile.
BLOCK, CHUNK, STRIPE = 48, 1 << 16, 64
#: Bytes of text whose terms are counted together before they are shuffled.
TEXT_AT_ONCE = 16 << 20
#: All bytes that no term holds: ASCII without its letters.
NO_LETTER = np.zeros(256, bool)
NO_LETTER[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def _share(count: str, total: str, terms: str) -> F.Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)) by long division in steps of 1000, exact up to 9 * 10^15 words; null without terms."""
    m, rest, digits = f"nullif({total} + {SMOOTH} * {terms}, 0)", f"({count} + {SMOOTH})", []
    for _ in range(3):
        digits.append(f"({rest} * 1000 div {m})")
        rest = f"({rest} * 1000 % {m})"
    return F.expr(f"1 + {digits[0]} * 1000000 + {digits[1]} * 1000 + {digits[2]}")


def shares(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """The same on arrays."""
    m, rest, out = total + SMOOTH * terms, count.astype(np.int64) + SMOOTH, np.zeros(len(count), np.int64)
    for _ in range(3):
        part, rest = np.divmod(rest * 1000, m)
        out = out * 1000 + part
    return out + 1


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, group, text) to (language, group, term, its occurrences, documents with it), added up over stretches of rows."""
    for batch in batches:
        lang, group = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        buf, off = T.utf8(batch.column(2))
        for at, to, part, part_off in T.pieces(buf, off, TEXT_AT_ONCE):
            low = T.LOWER[part]
            starts, ends, rows = T.words(low, part_off, NO_LETTER)
            if not len(starts):
                continue
            bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
            terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(low[~NO_LETTER[low]])).dictionary_encode()
            code, size = np.asarray(terms.indices).astype(np.int64), len(terms.dictionary)
            found, n = np.unique(np.repeat(np.arange(to - at), np.diff(rows)) * size + code, return_counts=True)
            row, code = np.divmod(found, size)
            names, mine = np.unique(group[at:to], return_inverse=True)
            found, which = np.unique(mine[row] * size + code, return_inverse=True)
            of, code = np.divmod(found, size)
            lang_of = np.zeros(len(names), np.int64)
            lang_of[mine] = lang[at:to]
            total, docs = np.bincount(which, n).astype(np.int64), np.bincount(which)
            yield pa.RecordBatch.from_arrays([pa.array(lang_of[of]), pa.array(names[of]), terms.dictionary.take(pa.array(code)).cast(pa.string()), pa.array(total), pa.array(docs)], ["lang_id", "gid", "term", "n", "d"])


class Tile:
    """The pairs of two blocks of groups (or of one with itself) over some chunks of the vocabulary."""

    def __init__(self, same: bool, first: int) -> None:
        self.same, self.first = same, first
        self.gids: list[int] = []
        self.side: list[bool] = []  # in the first block
        self.size: list[tuple[int, int]] = []  # kept words of the group, kept terms of its language
        self.chunk: int | None = None
        self.held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def group(self, gid: int, block: int, total: int, terms: int) -> None:
        self.gids.append(gid)
        self.side.append(block == self.first)
        self.size.append((total, terms))

    def start(self) -> None:
        k = len(self.gids)
        self.place = {g: i for i, g in enumerate(self.gids)}
        self.absent = np.array([shares(np.zeros(1, np.int64), *s)[0] if s[1] else 0 for s in self.size], dtype=np.int64)
        self.over = np.zeros((k, k), np.int64)
        side = np.array(self.side)
        self.right = np.arange(k) if self.same else np.flatnonzero(~side)
        self.left = range(k) if self.same else np.flatnonzero(side).tolist()
        self.apart = np.abs(self.absent[:, None] - self.absent[None, :])

    def vector(self, chunk: int, gid: int, at: np.ndarray, n: np.ndarray) -> None:
        if chunk != self.chunk:
            self.close()
            self.chunk = chunk
        self.held.append((self.place[gid], at, n))

    def close(self) -> None:
        """Add the chunk: for each pair what its terms differ by beyond what absent terms would."""
        if not self.held:
            return
        some, where = np.unique(np.concatenate([at for _, at, _ in self.held]), return_inverse=True)
        p, first = np.repeat(self.absent[:, None], len(some), axis=1), 0
        for g, at, n in self.held:
            p[g, where[first : first + len(at)]] = shares(n, *self.size[g])
            first += len(at)
        for i in self.left:
            right = self.right[self.right > i] if self.same else self.right
            self.over[i, right] += np.abs(p[right] - p[i]).sum(axis=1) - len(some) * self.apart[i, right]
        self.held = []

    def rows(self) -> pa.RecordBatch:
        self.close()
        a, b = [], []
        for i in self.left:
            right = self.right[self.right > i] if self.same else self.right
            a.append(np.full(len(right), i))
            b.append(right)
        a, b = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
        gids, terms = np.array(self.gids, dtype=np.int64), np.array([v for _, v in self.size], dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(gids[a]), pa.array(gids[b]), pa.array(self.apart[a, b] * terms[a]), pa.array(self.over[a, b])], ["a", "b", "apart", "over"])


def tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile, stripe and chunk to pairs of groups; the rows of chunk -1 name the groups of a tile."""
    now, tile, ready = None, None, False
    for batch in batches:
        keys = list(zip(*[batch.column(k).to_pylist() for k in range(9)], strict=True))
        lists = []
        for k in (9, 10):
            c = batch.column(k)
            lists.append((np.asarray(c.offsets), np.asarray(c.values)))
        (at_off, at), (n_off, n) = lists
        for i, (lang, bi, bj, stripe, chunk, gid, block, total, terms) in enumerate(keys):
            if (lang, bi, bj, stripe) != now:
                if tile is not None:
                    tile.start() if not ready else None
                    yield tile.rows()
                now, tile, ready = (lang, bi, bj, stripe), Tile(bi == bj, bi), False
            if chunk < 0:
                tile.group(gid, block, total, terms)
                continue
            if not ready:
                tile.start()
                ready = True
            # copied: the batch goes, and a chunk may go on in the next one
            tile.vector(chunk, gid, at[at_off[i] : at_off[i + 1]].copy(), n[n_off[i] : n_off[i + 1]].copy())
    if tile is not None:
        tile.start() if not ready else None
        yield tile.rows()


def _groups(named: DataFrame) -> tuple[DataFrame, int]:
    """Every (lang, source) with 64-bit names of its own, and the seed of the names: another one is taken until no two share one."""
    found = scratch.table(named.select("lang", "source").distinct(), "divergence-groups")
    seed = 0
    while True:
        ids = found.select("lang", "source", *_ids(seed))
        all_, gids, langs, lang_ids = ids.agg(F.count("*"), F.count_distinct("gid"), F.count_distinct("lang"), F.count_distinct("lang_id")).first()
        if all_ == gids and langs == lang_ids:
            return ids, seed
        seed += 1


def _ids(seed: int) -> list[F.Column]:
    return [F.xxhash64(F.lit(seed), "lang").alias("lang_id"), F.xxhash64(F.lit(seed + 1), "lang", F.octet_length("lang"), "source").alias("gid")]


def source_divergence(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each (lang, source) group is from the others and from its language.

    Terms are runs of ASCII letters (lower-cased) and of all characters beyond ASCII; a language keeps those in at
    least ``least_docs`` of its rows. A term's share in a group is 1 + floor(10^9 * (count + 5) / (N + 5 * V)), N being
    the group's kept words and V the language's kept terms. Part ``pair`` ranks the other sources of the language by the
    sum of share differences over all kept terms; part ``term`` the ``top`` kept terms of a group whose share exceeds
    the language's by most. Ties go to the smaller item in UTF-8.

    Null text, lang and source count as ''. Every row is a document: repeated rows count as often as they occur, ids
    aren't read. A group without terms, as all groups of a language without kept ones, has pairs (of value 0 if V is 0)
    and no terms; an empty table gives an empty result. Only the three named columns are read, so others may have any name.
    """
    blank = F.lit("")
    named = docs.select(F.coalesce(F.col(lang_col), blank).alias("lang"), F.coalesce(F.col(source_col), blank).alias("source"), F.coalesce(F.col(text_col), blank).alias("text"))
    groups, seed = _groups(named)
    counts = named.select(*_ids(seed), "text").mapInArrow(count_terms, "lang_id long, gid long, term string, n long, d long")
    # a frequent term is spread over its groups here; the window below meets one row of each of them
    counts = counts.groupBy("lang_id", "gid", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    of_term = Window.partitionBy("lang_id", "term")
    kept = counts.withColumn("in_docs", F.sum("d").over(of_term)).withColumn("all_n", F.sum("n").over(of_term)).where(F.col("in_docs") >= least_docs)
    kept = scratch.table(kept.select("lang_id", "gid", "term", "n", "all_n"), "divergence-kept")

    langs = kept.groupBy("lang_id", "term").agg(F.max("all_n").alias("all_n"), F.count("*").alias("rows"))
    langs = langs.groupBy("lang_id").agg(F.count("*").alias("terms"), F.sum("all_n").alias("lang_total"), F.sum("rows").alias("rows"))
    blocks = groups.groupBy("lang_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    totals = kept.groupBy("gid").agg(F.sum("n").alias("total"))
    sizes = groups.join(totals, "gid", "left").join(langs, "lang_id", "left").join(blocks, "lang_id").na.fill(0, ["total", "terms", "lang_total", "rows"])
    sizes = scratch.table(sizes.withColumn("block", F.pmod("gid", "blocks").cast("int")), "divergence-sizes")
    chunks = max(1, -(-(sizes.agg(F.max("rows")).first()[0] or 0) // CHUNK))
    stripes = -(-chunks // STRIPE)

    chunk = F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int")
    place = Window.partitionBy("lang_id", "chunk").orderBy("term")
    vectors = kept.withColumn("chunk", chunk).withColumn("at", F.dense_rank().over(place))
    vectors = vectors.groupBy("gid", "chunk").agg(F.collect_list(F.struct("at", "n")).alias("v"))
    vectors = vectors.select("gid", "chunk", F.col("v.at").alias("at"), F.col("v.n").alias("n"))
    heads = sizes.select("gid", F.lit(-1).alias("chunk"), F.expr("cast(array() as array<int>)").alias("at"), F.expr("cast(array() as array<bigint>)").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"))
    vectors = vectors.withColumn("stripe", F.floor(F.col("chunk") / STRIPE).cast("int")).unionByName(heads)
    sent = vectors.join(sizes.select("lang_id", "gid", "block", "blocks", "total", "terms"), "gid")
    sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = [F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj")]
    sent = sent.select("lang_id", *tile, "stripe", "chunk", "gid", "block", "total", "terms", "at", "n")
    sent = sent.repartition("lang_id", "bi", "bj", "stripe").sortWithinPartitions("lang_id", "bi", "bj", "stripe", "chunk", "gid")
    pairs = sent.mapInArrow(tile_pairs, "a long, b long, apart long, over long")
    pairs = pairs.groupBy("a", "b").agg((F.max("apart") + F.sum("over")).alias("value"))
    pairs = pairs.select("value", F.explode(F.array(F.struct(F.col("a").alias("gid"), F.col("b").alias("other")), F.struct(F.col("b").alias("gid"), F.col("a").alias("other")))).alias("p")).select("value", "p.*")
    pairs = pairs.join(groups.select("gid", "lang", "source"), "gid").join(groups.select(F.col("gid").alias("other"), F.col("source").alias("item")), "other")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))

    found = kept.join(sizes.select("gid", "lang", "source", "total", "terms", "lang_total"), "gid")
    value = _share("n", "total", "terms") - _share("all_n", "lang_total", "terms")
    found = found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value")).where("value > 0")
    found = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.unionByName(found)


def op12_tiled_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_tiled_divergence": op12_tiled_divergence}
SQL = {
    "op12_tiled_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT i, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v, sum(total) AS nl FROM kept GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS ng FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (ng + 5 * v) AS p, 1 + (1000000000 * (total + 5)) // (nl + 5 * v) AS q
      FROM gn JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM k WHERE part = 'pair' OR rank <= 50"""
}
