"""The tables that queries read, and tables derived from them that stand for the reference's own data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Expressions that Spark and DuckDB read alike.
MEMORY = {
    "id": "doc_id + 1",
    "kind": "CASE WHEN doc_id % 3 = 0 THEN 'entity' ELSE 'note' END",
    "key": "concat('k', doc_id)",
    "entity_type": "CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END",
    "attributes": """concat('{"src":"', source, '","n":"', n_chars, '"}')""",
    "content": "text",
    "tags": "concat(source, ',', lang)",
    "created_at": "concat('2024-01-01T00:', lpad(cast(cast(floor((doc_id % 500) / 60.0) as int) as varchar(9)), 2, '0'), ':', lpad(cast((doc_id % 500) % 60 as varchar(9)), 2, '0'))",
}
FILE = {
    "path": "concat(source, '/', lang, CASE WHEN doc_id % 10 = 0 THEN '/node_modules' WHEN doc_id % 7 = 0 THEN '/src/Lib' ELSE '' END, '/', CASE WHEN doc_id % 25 = 1 THEN 'package.json' WHEN doc_id % 25 = 2 THEN 'Dockerfile' ELSE concat('f', doc_id, CASE doc_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.kt' WHEN 3 THEN '.md' WHEN 4 THEN '.TXT' ELSE '.tsx' END) END)",
    "size": "octet_length(text)",
    "doc_id": "doc_id",
    "text": "text",
}
#: A typed call graph of suppliers (units of code) over parts that they share with the next supplier.
EDGE = {"src": "l_suppkey", "dst": "l_partkey % 97", "edge_type": "CASE l_linenumber % 3 WHEN 0 THEN 'call' WHEN 1 THEN 'data' ELSE 'event' END"}


def _sql(exprs: dict[str, str], frm: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in exprs.items()) + f" FROM {frm}"


MEMORIES_SQL = _sql(MEMORY, "documents")
FILES_SQL = _sql(FILE | {"size": "strlen(text)"}, "documents")
EDGES_SQL = _sql(EDGE, "lineitem")


def _select(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in exprs.items()])


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory store: one row for each document; timestamps have whole seconds and tie."""
    return _select(table(spark, sf_dir, "documents"), MEMORY)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of files, one for each document, under a few folders."""
    return _select(table(spark, sf_dir, "documents"), FILE)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed, typed edges between units."""
    return _select(table(spark, sf_dir, "lineitem"), EDGE)
