"""Exact top-k search by pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm import scratch

#: Pivots are chosen among so many vectors at most (those whose ids hash lowest); bounds hold for any choice.
PIVOT_SAMPLE = 1024
PIVOTS = 32
#: Vectors in a block of queries and of candidates; a task holds one block of each.
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192
#: Candidates that are evaluated between two looks at the stopping rule.
STEP = 128


def _matrix(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten(), dtype=np.int64).reshape(-1, dim)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the vector whose nearest pivot so far is farthest."""
    if not len(sample):
        return sample
    sample = sample.astype(np.float64)
    chosen = [0]
    near = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(n, len(sample)):
        at = int(np.argmax(near))
        if near[at] == 0:
            break
        chosen.append(at)
        near = np.minimum(near, np.linalg.norm(sample - sample[at], axis=1))
    return sample[chosen]


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.stack([np.linalg.norm(x - p, axis=1) for p in pivots], axis=1)


def search(queries: np.ndarray, q_rows: np.ndarray, q_table: np.ndarray, q_least: np.ndarray, cands: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, c_table: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The k best candidates of each query, as far as they reach its least score: (row of the query, id of the candidate, inner product), exact.

    |d(q, p) - d(c, p)| bounds d(q, c) from below for each pivot p, and q.c = (|q|^2 + |c|^2 - d(q, c)^2) / 2, so
    the largest of these bounds caps the score. Candidates are evaluated from the highest cap down; a query
    is done when the next cap is below its k-th score, or below ``q_least``, which k candidates are known to reach.
    Caps get a margin for rounding, and equal caps are evaluated, so ties are never lost. A row is never its own candidate.
    """
    q_sq, c_sq = (queries.astype(np.float64) ** 2).sum(axis=1), (cands.astype(np.float64) ** 2).sum(axis=1)
    top = max(np.abs(queries).max(initial=0), np.abs(cands).max(initial=0))
    exact = float(top) * float(top) * queries.shape[1] < 2**52
    cf = cands.astype(np.float64) if exact else cands
    out = []
    for i in range(len(queries)):
        low = np.zeros(len(cands))
        for p in range(q_table.shape[1]):
            np.maximum(low, np.abs(c_table[:, p] - q_table[i, p]), out=low)
        cap = (q_sq[i] + c_sq - low * low) / 2
        cap += 1 + 1e-9 * (q_sq[i] + c_sq)
        cap[c_rows == q_rows[i]] = -np.inf
        open_ = np.flatnonzero((cap >= q_least[i]) & (cap > -np.inf))
        order = open_[np.argsort(-cap[open_], kind="stable")]
        best_s, best_v = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        q = queries[i].astype(cf.dtype)
        at, step = 0, STEP
        while at < len(order) and (len(best_s) < k or cap[order[at]] >= best_s[-1]):
            take = order[at : at + step]
            s = (cf[take] @ q).astype(np.int64)
            best_s, best_v = np.concatenate([best_s, s]), np.concatenate([best_v, c_ids[take]])
            keep = np.lexsort((best_v, -best_s))[:k]
            best_s, best_v = best_s[keep], best_v[keep]
            at, step = at + step, step * 2
        out += [(int(q_rows[i]), int(v), int(s)) for v, s in zip(best_v, best_s, strict=True)]
    return out


def exact_topk(vectors: DataFrame, is_query: F.Column, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """For each row that is_query marks, the k other rows of highest integer inner product, exactly.

    Components become floor(scale * x). Returns query_id, rank (from 1), vec_id, score; ties go to the smaller
    id. Vectors that are null, empty or hold null or non-finite components take no part, nor do those with components so
    large that scores could leave 64 bits (floor(scale * x) squared, times the length, above 2^62), nor null ids. Vectors are
    compared with those of equal length only. Rows that repeat an id are rows of their own: each is a query with its own
    ranks, and a candidate of the others. An empty table gives an empty table. Other columns are not read.

    Pivots come from a bounded sample; their distances are computed once for every row. Each query also meets the
    sample at once: its k-th score there bounds the caps in all blocks. Queries and candidates meet in blocks of
    fixed size, each pair of blocks in one task.
    """
    x = F.col(vector_col)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.pow(F.abs(F.floor(v.cast("double") * scale).cast("double")), F.lit(2)) * F.size(x) <= float(1 << 62)))
    rows = scratch.table(
        vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & whole)
        .select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.size(x).alias("dim"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")),
        "topk",
    )
    pivots = {}
    for (dim,) in sorted(tuple(r) for r in rows.select("dim").distinct().limit(64).collect()):
        sample = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id", "row").limit(PIVOT_SAMPLE).select("row", "v").collect()
        v = np.array([r["v"] for r in sample], dtype=np.int64)
        pivots[dim] = choose_pivots(v, PIVOTS), v, np.array([r["row"] for r in sample], dtype=np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    n = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    nq, nc = -(-max(n["q"], 1) // QUERY_BLOCK), -(-max(n["n"], 1) // CANDIDATE_BLOCK)

    def table_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            tables: list = [None] * len(dims)
            least = np.full(len(dims), np.iinfo(np.int64).min)
            asks, own = np.asarray(b.column("q").fill_null(False)), np.asarray(b.column("row"))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                p = shared.value.get(int(dim))
                if p is None:  # beyond the lengths that got pivots: no bound, every candidate is evaluated
                    for i in at:
                        tables[i] = [0.0]
                    continue
                p, sample, sampled = p
                mine = _matrix(b.column("v").take(pa.array(at)), int(dim))
                for i, line in zip(at, pivot_distances(mine, p), strict=True):
                    tables[i] = line
                for i in np.flatnonzero(asks[at]):
                    s = np.sort((sample @ mine[i])[sampled != own[at[i]]])
                    if len(s) >= k:
                        least[at[i]] = s[-k]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), b.column("dim"), b.column("v"), b.column("q"), pa.array(tables, pa.list_(pa.float64())), pa.array(least)], ["row", "id", "dim", "v", "q", "table", "least"])

    tabled = rows.mapInArrow(table_of, "row long, id long, dim int, v array<long>, q boolean, table array<double>, least long")
    tabled = scratch.table(tabled, "topk-table")
    cand = tabled.withColumn("cb", F.pmod(F.xxhash64("row"), F.lit(nc))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).withColumn("q", F.lit(False))
    quer = tabled.where("q").withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(nq))).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    cols = ["qb", "cb", "dim", "row", "id", "v", "table", "least", "q"]
    both = cand.select(*[F.col(c).cast("int") if c in ("qb", "cb") else F.col(c) for c in cols]).unionByName(quer.select(*[F.col(c).cast("int") if c in ("qb", "cb") else F.col(c) for c in cols]))

    def block(t: pa.Table) -> pa.Table:
        found: list = []
        is_q = np.asarray(t.column("q"))
        if is_q.any() and not is_q.all():
            dim = t.column("dim")[0].as_py()
            own, ids, least = (np.asarray(t.column(c), dtype=np.int64) for c in ("row", "id", "least"))
            v = _matrix(t.column("v"), dim)
            flat = np.asarray(t.column("table").combine_chunks().flatten(), dtype=np.float64).reshape(len(ids), -1)
            found = search(v[is_q], own[is_q], flat[is_q], least[is_q], v[~is_q], own[~is_q], ids[~is_q], flat[~is_q], k)
        cols = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["row", "vec_id", "score"])

    parts = both.groupBy("qb", "cb", "dim").applyInArrow(block, "row long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    best = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    asked = rows.where("q").select("row", F.col("id").alias("query_id"))
    return best.join(asked, "row").select("query_id", "rank", "vec_id", "score")


def op5_pivot_table_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_topk(vectors, F.col("vec_id") % 50 == 0)


SQL = {
    "op5_pivot_table_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
}

QUERIES = {"op5_pivot_table_topk": op5_pivot_table_topk}
