"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

A shingle is hashed once: the top byte of its hash picks one of 256 bins, which keeps its lowest hash. Empty bins copy
another bin by optimal densification; of each bin the low 8 bits are stored, two hex digits.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm import scratch

BINS, BITS, WORDS = 256, 8, 5
#: Bins that an empty bin tries, each picked by a hash of the bin and the attempt, before the general rule picks.
ATTEMPTS = 6
#: Key ranges for each shuffle partition, and sampled keys for each range.
RANGES, SAMPLED = 2, 16

_LOW = (1 << 56) - 1
#: The value above all hashes of a bin; in the order of signed numbers, as hashes are sorted.
_LAST = [(b << 56) | _LOW for b in range(-BINS // 2, BINS // 2)]
_rng = random.Random(20)
#: Places with several equal rows that are broadcast, and copies of a row that one task writes.
MOST_REPEATED, COPIES_A_TASK = 50_000, 2000
_TRIES = [[_rng.randrange(BINS) for _ in range(BINS)] for _ in range(ATTEMPTS)]
_HEX = [f"{b:02x}" for b in range(256)]


def _literal(values: list, kind: str) -> Column:
    return F.expr("array(" + ",".join(f"'{v}'" if kind == "string" else f"{v}L" if kind == "bigint" else str(v) for v in values) + ")")


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column whose value is computed once a row, however often later expressions name it."""
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the fingerprint of a text column: 512 hex digits, or '' for a text without words.

    Words are what stands between ASCII white space, in lower case; fewer than five words are one shingle.
    """
    kept = df.columns
    df = _held(df, "__lw_w", F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    df = _held(df, "__lw_h", F.transform("__lw_w", lambda w: F.xxhash64(w))).drop("__lw_w")
    h = F.col("__lw_h")
    shingles = F.when(F.size(h) >= WORDS, F.transform(F.sequence(F.lit(0), F.size(h) - WORDS), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WORDS)]))).otherwise(F.array(F.xxhash64(h)))
    df = _held(df, "__lw_s", F.sort_array(F.concat(shingles, _literal(_LAST, "bigint"))))
    s = F.col("__lw_s")
    lowest = F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(s, i - 1), 56)))
    df = _held(df.withColumn("__lw_n", F.size("__lw_h")), "__lw_m", lowest).drop("__lw_s", "__lw_h")
    m = F.col("__lw_m")
    full = lambda x: x.bitwiseAND(F.lit(_LOW)) != _LOW
    df = _held(df, "__lw_f", F.filter(m, full))
    filled = F.col("__lw_f")

    def bin_value(x: Column, i: Column) -> Column:
        tries = [F.get(m, F.get(_literal(t, "int"), i)) for t in _TRIES]
        # each filled bin draws a number by a hash of both bins; the lowest wins, so any two texts pick alike
        general = F.array_min(F.transform(filled, lambda e: F.struct(F.xxhash64(i, F.shiftright(e, 56)).alias("draw"), e.alias("e"))))["e"]
        return F.coalesce(F.when(full(x), x), *[F.when(full(t), t) for t in tries], general)

    digits = F.transform(m, lambda x, i: F.get(_literal(_HEX, "string"), bin_value(x, i).bitwiseAND(F.lit(255)).cast("int")))
    return df.select(*kept, F.when(F.col("__lw_n") > 0, F.array_join(digits, "")).otherwise("").alias(out))


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add the estimated Jaccard similarity of two fingerprints: the share of equal bins, less what 8 bits agree on by chance.

    Two texts without words are alike (1), one without words is like no other (0).
    """
    kept = df.columns
    df = _held(_held(df, "__lw_a", F.unhex(a)), "__lw_b", F.unhex(b))
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substr("__lw_a", i, F.lit(1)) == F.substr("__lw_b", i, F.lit(1))))
    chance = 1.0 / (1 << BITS)
    value = F.when(F.col(a) == F.col(b), 1.0).when((F.col(a) == "") | (F.col(b) == ""), 0.0).otherwise(F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance)))
    return df.select(*kept, value.alias(out))


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row; nothing is moved."""
    return with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "fingerprint").select("doc_id", "fingerprint")


def _ranges(places: DataFrame) -> DataFrame:
    """One row: the lowest places of the ranges, in blocks of equal length, and the lowest place of each block.

    Ranges hold about as many places each, whatever the keys are: their bounds come from a sample of the distinct places that is
    picked by hash. Their number follows the shuffle partitions, so a range is what a task is meant to hold.
    """
    n = RANGES * int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = math.isqrt(n) + 1
    share = min(1.0, SAMPLED * n / max(1, places.count()))
    sample = places.where(F.pmod(F.xxhash64(F.lit(31), "__lw_o"), F.lit(1 << 20)) < share * (1 << 20))
    a = F.col("a")
    bounds = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(a, F.floor(i.cast("long") * F.size(a) / n).cast("int")))
    blocks = F.transform(F.sequence(F.lit(0), F.lit(-(-n // block) - 1)), lambda i: F.slice("b", i * block + 1, F.lit(block)))
    row = sample.agg(F.sort_array(F.collect_list("__lw_o")).alias("a")).select(bounds.alias("b")).select(blocks.alias("__lw_blocks"))
    return scratch.table(row.select("__lw_blocks", F.transform("__lw_blocks", lambda x: F.get(x, 0)).alias("__lw_lows")), "ranges")


def _once(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Rows that are equal in every column as one, with their number __lw_times; they are put together before anything moves."""
    repeated = places.where("__lw_times > 1")
    n = repeated.limit(MOST_REPEATED + 1).count()
    if not n:
        return rows.withColumn("__lw_times", F.lit(1).cast("long"))
    kept = [F.first(f"`{c}`").alias(c) for c in rows.columns if c != "__lw_o"]
    names = [f"`{c}`" for c in rows.columns]
    if n > MOST_REPEATED:
        return rows.groupBy("__lw_o").agg(*kept, F.count("*").alias("__lw_times")).select(*names, "__lw_times")
    few = F.broadcast(repeated)  # MOST_REPEATED rows at most
    single = rows.join(few, "__lw_o", "left_anti").withColumn("__lw_times", F.lit(1).cast("long"))
    several = rows.join(few.select("__lw_o"), "__lw_o", "left_semi").groupBy("__lw_o").agg(*kept, F.count("*").alias("__lw_times"))
    return single.unionByName(several.select(*single.columns))


def _each(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Every row __lw_times times: each is followed by an equal one, the last by what follows them all. Many copies spread over tasks."""
    final = F.col("__lw_copy") == F.col("__lw_times")
    shown = [F.when(final, F.col(f"next_{c}")).otherwise(F.col(f"`{c}`")).alias(f"next_{c}") for c in cols]
    kept = [f"`{c}`" for c in rows.columns if c != "__lw_times" and c not in {f"next_{x}" for x in cols}]
    few = rows.where(F.col("__lw_times") <= COPIES_A_TASK).withColumn("__lw_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__lw_times"))))
    many = rows.where(F.col("__lw_times") > COPIES_A_TASK).withColumn("__lw_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__lw_times") - 1) / COPIES_A_TASK))))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of their own: what grows afterwards isn't put together
    many = many.repartition(tasks, "__lw_part", *[f"`{c}`" for c in cols])
    first = F.col("__lw_part") * COPIES_A_TASK
    many = many.withColumn("__lw_copy", F.explode(F.sequence(first + 1, F.least(first + COPIES_A_TASK, F.col("__lw_times"))))).drop("__lw_part")
    return few.unionByName(many).select(*kept, *shown)


def with_next(rows: DataFrame, cols: list[str], *, key: str = "doc_id", derive: list | None = None) -> DataFrame:
    """Each row with next_<c> for c in cols: the values of the row with the next lower key; after the last, the first.

    Rows that share a key are ordered by the hash of the columns in rows; null keys come last. ``derive`` are functions from
    a DataFrame to one with more columns, which may be in cols too; they run once a row. Rows are cut into key
    ranges, and the top row of a range is also put at the end of the range above, so each range is ordered by itself. Rows that
    are equal in every column go through this as one and follow one another, so a million of them are no hot range.
    Other columns are kept, whatever their names, but a column next_<c> would be given twice and raises ValueError; an empty
    table gives an empty table.
    """
    if clash := {f"next_{c}" for c in cols} & {*rows.columns}:
        raise ValueError(f"rows have columns that the result adds: {sorted(clash)}")
    names = [f"`{c}`" for c in rows.columns]
    place = F.struct(F.col(key).isNotNull().alias("named"), F.coalesce(F.col(key), F.lit(0).cast(rows.schema[key].dataType)).alias("key"), F.xxhash64(*names).alias("h"))
    rows = rows.withColumn("__lw_o", place)
    places = scratch.table(rows.groupBy("__lw_o").agg(F.count("*").alias("__lw_times")), "places")
    bounds, o = F.broadcast(_ranges(places)), F.col("__lw_o")  # one row
    at = F.greatest(F.size(F.filter("__lw_lows", lambda x: x <= o)) - 1, F.lit(0))
    r = at * F.size(F.get("__lw_blocks", 0)) + F.size(F.filter(F.get("__lw_blocks", at), lambda x: x <= o))
    ranged = lambda df: df.join(bounds, how="cross").withColumn("__lw_r", r).drop("__lw_blocks", "__lw_lows")
    tops = ranged(places.select("__lw_o")).groupBy("__lw_r").agg(F.max("__lw_o").alias("__lw_top"))
    whole = Window.orderBy("__lw_r")
    above = F.coalesce(F.lead("__lw_r").over(whole), F.min("__lw_r").over(Window.partitionBy()))
    plan = scratch.table(tops.withColumn("__lw_above", above), "tops")  # one row a range
    rows = _once(rows, places)
    for f in derive or []:
        rows = f(rows)
    kept = [c for c in rows.columns if c != "__lw_o"]
    held = ranged(rows).join(F.broadcast(plan), "__lw_r")
    here = F.struct(F.col("__lw_r").alias("__lw_at"), F.lit(False).alias("__lw_ghost"))
    ghost = F.struct(F.col("__lw_above").alias("__lw_at"), F.lit(True).alias("__lw_ghost"))
    held = held.select(*[f"`{c}`" for c in kept], "__lw_o", F.inline(F.when(o == F.col("__lw_top"), F.array(here, ghost)).otherwise(F.array(here))))
    order = Window.partitionBy("__lw_at").orderBy("__lw_ghost", F.desc("__lw_o"))
    found = held.select(*[f"`{c}`" for c in kept], "__lw_ghost", *[F.lead(c).over(order).alias(f"next_{c}") for c in cols])
    found = found.where(~F.col("__lw_ghost")).drop("__lw_ghost")
    return _each(found, cols) if places.where("__lw_times > 1").limit(1).count() else found.drop("__lw_times")


def op10_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = with_next(docs, ["text", "fingerprint"], derive=[lambda df: with_fingerprint(df, "text", "fingerprint")])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.substr("next_text", F.lit(1), half))
    both = _held(own.withColumn("n_chars", F.length("text").cast("long")), "edited", edited).drop("text", "next_text")
    done = with_fingerprint(both, "edited", "edited_fingerprint")
    done = with_likeness(with_likeness(done, "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "next_fingerprint", "near_next")
    return done.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


QUERIES = {"op10_one_permutation_minhash": op10_one_permutation_minhash}
