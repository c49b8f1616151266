"""A corpus from raw documents to tokens: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm import bpe, jaccard, language, mixing, scratch, substrings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose words belong to no language with at least this mean posterior is rejected.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without letters (null ones too) and texts of no clear language; a missing lang is filled in.

    Rows with null or repeated ids are judged like any other; an empty table stays empty.
    """
    found = language.identify(docs.select(*COLUMNS), keep=COLUMNS)
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts the row with the lowest id stays (a null id comes last); equal rows are one.

    Rows are told apart by id and text, so different texts that share an id, or have none, are judged each by itself.
    """
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    named = docs.select(*COLUMNS).withColumn("lw_key", key)
    found = jaccard.similarity_components(named, id_col="lw_key").select(F.col("doc_id").alias("lw_key"), "component_id")
    # the least (no id, id, key) of each component, added up before anything moves
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("lw_key").alias("key"))
    order = named.select("lw_key", rank.alias("o")).distinct().join(found.distinct(), "lw_key")
    lead = order.groupBy("component_id").agg(F.min("o").alias("o")).select(F.col("o.key").alias("lw_key"))
    one = Window.partitionBy("lw_key").orderBy(F.xxhash64("source", "lang", "n_chars"))
    kept = named.join(lead.hint("merge"), "lw_key", "left_semi").withColumn("lw_r", F.row_number().over(one))
    return kept.where("lw_r = 1").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that also start earlier go; texts without such passages stay as they are, emptied ones go.

    Null ids come before all others; each row loses words of its own passages only.
    """
    done = substrings.remove_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("lw_n_removed") > 0, F.col("lw_kept")).otherwise(F.col("text"))
    done = done.where((F.col("lw_n_removed") == 0) | (F.col("lw_n_removed") < F.col("lw_n_words"))).withColumn("text", text)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks, in a global random order. A null source is one of its own."""
    return mixing.poisson_mix(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, their number, and the text that they decode to; a null text has none."""
    done = bpe.encode_decode(docs, bpe.default_tokenizer(), ("n_tokens", "ids", "decoded"), keep=("doc_id", "lang", "source"))
    return done.withColumnRenamed("decoded", "text")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mixing", source_mixing),
    ("tokens", tokens),
]

#: The language stage is a learned model, which SQL can't express; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
