"""Vocabularies, packing, BPE merges and quantisation codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.search import tokens
from loomwork.sources.sinks import shared_dir

# The 4-bit NormalFloat codes.
NF4 = [-1.0, -0.6962, -0.5251, -0.3949, -0.2844, -0.1848, -0.0911, 0.0, 0.0796, 0.1609, 0.2461, 0.3379, 0.4407, 0.5626, 0.7230, 1.0]
SPECIAL = ["<pad>", "<unk>"]


def nearest_code(x: Column) -> Column:
    codes = F.array(*[F.lit(c) for c in NF4])
    return F.array_min(F.transform(codes, lambda c, i: F.struct(F.abs(x - c).alias("d"), i.alias("i"))))["i"]


def vocabulary(docs: DataFrame, text: str, size: int) -> DataFrame:
    """id and piece: special ids first, then the most frequent words (ties by word)."""
    words = docs.select(F.explode(tokens(F.col(text))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    top = words.orderBy(F.desc("n"), "piece").limit(size - len(SPECIAL))  # the rows of the vocabulary only
    ranked = top.select((F.row_number().over(Window.orderBy(F.desc("n"), "piece")) + len(SPECIAL) - 1).cast("long").alias("id"), "piece")
    return ranked.unionByName(docs.sparkSession.createDataFrame(list(enumerate(SPECIAL)), "id long, piece string"))


#: Pieces that are sent to every task (some 100 bytes each); a larger vocabulary is joined by a shuffle.
MOST_SENT = 1_000_000


def encode(docs: DataFrame, keys: list[str], text: str, vocab: DataFrame) -> DataFrame:
    """The ids of each row's words, in order; words that the vocabulary lacks are <unk>, a text without words has no ids.

    A task looks each of its distinct words up once, in a hash table: the cost doesn't grow with the vocabulary, and no row of docs
    moves. Beyond MOST_SENT pieces distinct words are joined with the vocabulary, and the words of a row gathered again.
    """
    spark, unknown = docs.sparkSession, SPECIAL.index("<unk>")
    split = docs.select(*keys, tokens(F.col(text)).alias("w"))
    known = vocab.select("piece", F.col("id").cast("long")).limit(MOST_SENT + 1).toArrow()
    if known.num_rows > MOST_SENT:
        each = split.withColumn("__row", F.monotonically_increasing_id()).select("__row", *keys, F.posexplode_outer("w").alias("pos", "piece"))
        found = each.join(vocab.select("piece", F.col("id").cast("long").alias("id")), "piece", "left")
        held = found.groupBy("__row", *keys).agg(F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(unknown).cast("long")).alias("id"))))).alias("r"))
        return held.select(*keys, F.col("r.id").alias("ids"))
    shared = spark.sparkContext.broadcast((known.column("piece").to_pylist(), np.asarray(known.column("id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, ids = shared.value
        table = dict(zip(pieces, ids.tolist(), strict=True))
        for batch in batches:
            words = batch.column(len(keys))
            coded = words.flatten().dictionary_encode()
            of = np.array([table.get(w, unknown) for w in coded.dictionary.to_pylist()], dtype=np.int64)
            flat = of[np.asarray(coded.indices)] if len(coded) else of
            size = np.asarray(pc.list_value_length(words))
            ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.ListArray.from_arrays(ends, pa.array(flat))], [*keys, "ids"])

    fields = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys]
    return split.mapInArrow(run, ", ".join([*fields, "ids array<long>"]))


def pack(docs: DataFrame, key: str, ids: str, length: int) -> DataFrame:
    """block and ids: all ids in the order of key, cut into blocks; an incomplete last block is dropped.

    Only the lengths of documents are summed in order: first over ranges of documents, then within each, so no task
    sees the whole stream.
    """
    sized = docs.select(key, ids, F.size(ids).alias("n"), F.floor(F.col(key) / 4096).alias("part"))
    parts = sized.groupBy("part").agg(F.sum("n").alias("n"))
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    whole = parts.agg(F.sum("n").alias("total"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy(key)) - F.col("n")
    placed = sized.withColumn("within", within).join(starts, "part").join(F.broadcast(whole))  # whole is one row
    each = placed.select(F.posexplode(ids).alias("pos", "id"), (F.col("start") + F.col("within")).alias("at"), "total").withColumn("at", F.col("at") + F.col("pos"))
    kept = each.where(F.col("at") < F.floor(F.col("total") / length) * length)
    rows = F.sort_array(F.collect_list(F.struct("at", "id")))
    return kept.groupBy(F.floor(F.col("at") / length).alias("block")).agg(rows.alias("r")).select("block", F.col("r.id").alias("ids"))


def bpe_merges(docs: DataFrame, text: str, n: int) -> DataFrame:
    """rank, left, right and count of the first n merges, learned from the counts of all words (ties by the pair).

    The distinct words stay distributed, as symbols with spaces between them (a word has none of its own); only the best pair
    of each round reaches the driver.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    words = docs.select(F.explode(tokens(F.col(text))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    held = words.select(F.array_join(F.split("w", ""), " ").alias("w"), "n").checkpoint()
    rows = []
    for rank in range(n):
        symbols = held.select(F.split("w", " ").alias("s"), "n")
        pairs = symbols.select("n", F.inline(F.arrays_zip(F.slice("s", 1, F.size("s") - 1).alias("a"), F.slice("s", 2, F.size("s")).alias("b"))))
        best = pairs.groupBy("a", "b").agg(F.sum("n").alias("k")).orderBy(F.desc("k"), "a", "b").first()
        if best is None:
            break
        a, b, k = best
        rows.append((rank, a, b, k))
        held = held.withColumn("w", F.regexp_replace("w", f"(?<![^ ]){a} {b}(?![^ ])", a + b))
        if rank % 16 == 15:
            held = held.checkpoint()  # so the plan doesn't grow
    return spark.createDataFrame(rows, "rank int, left string, right string, count long")
