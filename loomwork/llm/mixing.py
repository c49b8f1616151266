"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rates are broadcast up to so many sources, and joined by a shuffle beyond.
MOST_BROADCAST = 10_000


def source_rates(docs: DataFrame, *, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each source: its bytes, its mean repetition rate and the Poisson distribution function.

    The rate of a source is what brings its bytes to its weight of ``epochs`` times the corpus. Without
    ``weights`` a source weighs its bytes to the power ``alpha``. A source that weights doesn't name has rate 0;
    a null source is the source ''. A source without bytes has rate 0.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("src")).agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0))).cast("double").alias("size"))
    if weights is None:
        raw = F.pow("size", F.lit(alpha))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else F.lit(None).cast("map<string,double>")
        raw = F.coalesce(F.try_element_at(given, F.col("src")), F.lit(0.0)) * F.when(F.col("size") > 0, 1.0).otherwise(0.0)
    sizes = sizes.withColumn("raw", raw)
    whole = sizes.agg(F.sum("size").alias("all_size"), F.sum("raw").alias("all_raw"))
    rate = F.when((F.col("size") > 0) & (F.col("all_raw") > 0), F.col("raw") / F.col("all_raw") * F.col("all_size") * epochs / F.col("size")).otherwise(0.0)
    rates = sizes.join(F.broadcast(whole), how="cross").select("src", "size", rate.alias("rate"))  # whole is one row
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    step = lambda acc, k: F.struct(  # noqa: E731  log of k! and the distribution function so far
        (acc["log_fact"] + F.when(k > 0, F.ln(k.cast("double"))).otherwise(0.0)).alias("log_fact"),
        F.concat(acc["cdf"], F.array(F.coalesce(F.element_at(acc["cdf"], -1), F.lit(0.0)) + F.exp(-F.col("rate") + k * F.ln("rate") - acc["log_fact"] - F.when(k > 0, F.ln(k.cast("double"))).otherwise(0.0)))).alias("cdf"),
    )
    cdf = F.aggregate(F.sequence(F.lit(0), last), F.struct(F.lit(0.0).alias("log_fact"), F.array(F.lit(0.0)).alias("cdf")), step, lambda acc: acc["cdf"])
    return rates.withColumn("cdf", F.when(F.col("rate") > 0, F.slice(cdf, 2, 1 << 30)).otherwise(F.array(F.lit(2.0))))


def uniform(*parts) -> F.Column:
    """52 bits of an md5 as a number from 0 up to 1."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_mix(docs: DataFrame, *, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Repeat each row by a Poisson count with the mean of its source, then shuffle globally.

    The count is the inverse of the Poisson distribution function at a number hashed from seed, id and text, so a
    rerun gives the same counts. Rows get the columns of docs plus lw_rate, lw_copies, lw_copy (from 0) and
    lw_key, a hash of id, text and copy: rows are dealt out and sorted by it. Rows with count 0 go.
    A null id counts as the id '', a null text as ''; different texts with one id, or none, are drawn each by itself,
    rows equal in both get the same count. Null and empty texts weigh nothing but are repeated as others of their
    source; an empty table gives an empty table. Other columns are kept; one with a name that is used here raises ValueError.
    """
    if clash := {"lw_src", "lw_row", "lw_rate", "lw_cdf", "lw_copies", "lw_copy", "lw_key"} & {*docs.columns}:
        raise ValueError(f"docs have columns that are used here: {sorted(clash)}")
    rates = source_rates(docs, weights=weights, alpha=alpha, epochs=epochs, text_col=text_col, source_col=source_col).select(F.col("src").alias("lw_src"), F.col("rate").alias("lw_rate"), F.col("cdf").alias("lw_cdf"))
    few = rates.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    named = docs.withColumn("lw_src", F.coalesce(F.col(source_col), F.lit(""))).withColumn("lw_row", key)
    counted = named.join(F.broadcast(rates) if few else rates, "lw_src")
    # the array of one number binds it: written straight into the filter it would be hashed again for each step of the distribution
    below = F.transform(F.array(uniform(F.lit(str(seed)), F.col("lw_row"))), lambda u: F.size(F.filter("lw_cdf", lambda c: c <= u)))
    counted = counted.withColumn("lw_copies", F.element_at(below, 1)).drop("lw_cdf", "lw_src")
    copies = counted.where(F.col("lw_copies") > 0).withColumn("lw_copy", F.explode(F.sequence(F.lit(0), F.col("lw_copies") - 1)))
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("lw_row"), F.col("lw_copy"))), 1, 15), 16, 10).cast("long")
    return copies.withColumn("lw_key", order).drop("lw_row").repartition("lw_key").sortWithinPartitions("lw_key")


def op2_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return poisson_mix(docs).select("doc_id", "source", F.col("lw_copy").alias("copy"), F.col("lw_copies").alias("n_copies"), F.round("lw_rate", 9).alias("rate"), F.col("lw_key").alias("shuffle_key"), "text")


#: The rows of documents after mixing, as DuckDB tables for the relation {docs}.
MIX_SQL = """
WITH sizes AS (SELECT coalesce(source, '') AS src, sum(coalesce(strlen(text), 0))::DOUBLE AS size FROM {docs} GROUP BY 1),
rates AS (SELECT src, CASE WHEN size > 0 THEN (sqrt(size) / (SELECT sum(sqrt(size)) FROM sizes)) * (SELECT sum(size) FROM sizes) / size ELSE 0 END AS rate FROM sizes),
cdf AS (SELECT src, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY src ORDER BY k) AS c
  FROM rates, range(0, 400) t(k) WHERE rate > 0 AND k <= ceil(rate + 12 * sqrt(rate) + 30)),
steps AS (SELECT src, rate, list(c ORDER BY k) AS cs FROM cdf GROUP BY 1, 2),
counted AS (SELECT d.*, rate, len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, '') || ':' || md5(coalesce(d.text, ''))), 1, 13))::BIGINT / 4503599627370496.0)) AS n_copies
  FROM {docs} d JOIN steps s ON coalesce(d.source, '') = s.src),
mixed AS (SELECT c.*, unnest(range(0, n_copies))::INT AS copy FROM counted c WHERE n_copies > 0)
"""

SQL = {
    "op2_poisson_mixing": MIX_SQL.format(docs="documents")
    + """SELECT doc_id, source, copy, n_copies::INT AS n_copies, round(rate, 9) AS rate,
  ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':' || copy), 1, 15))::BIGINT AS shuffle_key, text FROM mixed"""
}

QUERIES = {"op2_poisson_mixing": op2_poisson_mixing}
