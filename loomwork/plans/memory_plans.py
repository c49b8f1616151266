"""Full-text search, the memory store's reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import index as I
from loomwork.operators import memory as M
from loomwork.operators import search as S
from loomwork.registry import query
from loomwork.sources import sinks
from loomwork.sources.tables import MEMORIES_SQL, memories, table

WORDS = r"""regexp_extract_all(lower(coalesce({t}, '')), '([\p{{L}}\p{{N}}_]+)', 1)"""


def bm25_sql(frm: str, id_expr: str, text: str, terms: list[list[str]], limit: str = "LIMIT 20") -> str:
    """BM25 as DuckDB SQL; a term of several words is a phrase."""
    tf = []
    for i, t in enumerate(terms):
        if len(t) == 1:
            tf.append(f"len(list_filter(w, lambda x: x = '{t[0]}')) AS tf{i}")
        else:
            same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(t))
            tf.append(f"len(list_filter(range(1, len(w) - {len(t) - 2}), lambda i: {same})) AS tf{i}")
    n = range(len(terms))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avg_len))" for i in n)
    return f"""WITH b AS (SELECT {id_expr} AS id, {WORDS.format(t=text)} AS w FROM {frm}),
tf AS (SELECT id, len(w) AS len, {', '.join(tf)} FROM b),
st AS (SELECT count(*) AS n, avg(len) AS avg_len, {', '.join(f'count(*) FILTER (tf{i} > 0) AS df{i}' for i in n)} FROM tf)
SELECT id, round({score}, 6) AS score FROM tf, st WHERE {' OR '.join(f'tf{i} > 0' for i in n)} ORDER BY score DESC, id {limit}"""


@query("fts_search", bm25_sql("documents", "doc_id", "text", [["the"], ["worthless"], ["license"], ["por"]]))
def fts_search(spark: SparkSession, sf: str) -> DataFrame:
    return S.bm25(table(spark, sf, "documents"), "the worthless License por")


_M = f"(WITH m AS ({MEMORIES_SQL}) SELECT * FROM m)"
_TEXT = "concat_ws(' ', key, entity_type, attributes, content, tags)"


@query("fts_phrase_hyphen", bm25_sql("documents", "doc_id", "text", [["of", "the"], ["mit", "license"]], ""))
def fts_phrase_hyphen(spark: SparkSession, sf: str) -> DataFrame:
    return S.bm25(table(spark, sf, "documents"), "of-the MIT-License", limit=None)


@query("ord_rank", bm25_sql(_M, "id", _TEXT, [["src3"], ["and"]], "LIMIT 10"))
def ord_rank(spark: SparkSession, sf: str) -> DataFrame:
    return S.bm25(memories(spark, sf), "src3 and", id_col="id", text_cols=("key", "entity_type", "attributes", "content", "tags"), limit=10)


_LIKE = " OR ".join(f"{c} ILIKE '%{t}%'" for t in ("idiot", "k12") for c in ("key", "entity_type", "attributes", "content", "tags"))


@query("fts_fallback", f"SELECT id, key, created_at FROM {_M} WHERE {_LIKE} ORDER BY created_at DESC, id LIMIT 20")
def fts_fallback(spark: SparkSession, sf: str) -> DataFrame:
    found = S.like_any(memories(spark, sf), "idiot k12", ["key", "entity_type", "attributes", "content", "tags"])
    return found.select("id", "key", "created_at").orderBy(F.desc("created_at"), "id").limit(20)


@query("flt_like_any", f"SELECT id, kind, key FROM {_M} WHERE {_LIKE}")
def flt_like_any(spark: SparkSession, sf: str) -> DataFrame:
    return S.like_any(memories(spark, sf), "idiot k12", ["key", "entity_type", "attributes", "content", "tags"]).select("id", "kind", "key")


_KEPT = "(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN concat(text, ' revised') ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0)"


@query("fts_maintain", f"""WITH b AS MATERIALIZED (SELECT doc_id AS id, {WORDS.format(t='text')} AS w FROM {_KEPT}), p AS (SELECT id, unnest(w) AS term, len(w)::INT AS doc_len FROM b)
SELECT term, id, doc_len, count(*) AS tf FROM p GROUP BY ALL""")
def fts_maintain(spark: SparkSession, sf: str) -> DataFrame:
    """The postings of an index that took three batches: all documents, new texts of every seventh, the end of every fifth."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    index = I.TextIndex(spark, sinks.scratch_path(spark, "index"))
    change = lambda d, op: d.withColumn("op", F.lit(op)).withColumn("seq", F.lit(0))
    index.apply(change(docs, "I"), 0)
    index.apply(change(docs.where("id % 7 = 0").withColumn("text", F.concat("text", F.lit(" revised"))), "U"), 1)
    index.apply(change(docs.where("id % 5 = 0"), "D"), 2)
    return index.postings().select("term", "id", "doc_len", "tf")


@query("join_rowid", f"WITH m AS ({MEMORIES_SQL}), f AS (SELECT doc_id + 1 AS id, strlen(text) AS n FROM documents WHERE text ILIKE '%tion%') SELECT m.id, m.key, f.n FROM m JOIN f USING (id)")
def join_rowid(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "documents").where(F.col("text").ilike("%tion%")).select((F.col("doc_id") + 1).alias("id"), F.octet_length("text").cast("long").alias("n"))
    return memories(spark, sf).select("id", "key").join(hits, "id")


@query("prj_star_decode", f"""SELECT id, kind, key, entity_type, attributes->>'src' AS src, attributes->>'n' AS n, coalesce(content, '') AS content, string_split(tags, ',')[1] AS tag1, len(string_split(tags, ',')) AS n_tags, created_at FROM {_M}""")
def prj_star_decode(spark: SparkSession, sf: str) -> DataFrame:
    m = M.decode(memories(spark, sf))
    return m.select("id", "kind", "key", "entity_type", F.col("attributes")["src"].alias("src"), F.col("attributes")["n"].alias("n"), "content", F.col("tags")[0].alias("tag1"), F.size("tags").cast("long").alias("n_tags"), "created_at")


@query("prj_cols", f"SELECT id, content, created_at FROM {_M}")
def prj_cols(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).select("id", "content", "created_at")


@query("flt_eq", f"SELECT id, key, entity_type FROM {_M} WHERE kind = 'entity' AND key = 'k42'")
def flt_eq(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).where("kind = 'entity' AND key = 'k42'").select("id", "key", "entity_type")


def optional_kind(m: DataFrame, kind: str | None) -> DataFrame:
    """Narrow to a kind if one is given."""
    M.validate(kind=kind)
    return m if kind is None else m.where(F.col("kind") == kind)


@query("flt_optional", f"SELECT 'all' AS asked, count(*) AS n FROM {_M} UNION ALL SELECT 'note', count(*) FROM {_M} WHERE kind = 'note'")
def flt_optional(spark: SparkSession, sf: str) -> DataFrame:
    m = memories(spark, sf)
    count = lambda kind: optional_kind(m, kind).agg(F.lit(kind or "all").alias("asked"), F.count("*").alias("n"))
    return count(None).unionByName(count("note"))


@query("flt_tag_contains", f"SELECT id, tags FROM {_M} WHERE list_contains(string_split(lower(tags), ','), 'src1')")
def flt_tag_contains(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).where(F.array_contains(M.tag_list(F.lower("tags")), "src1")).select("id", "tags")


@query("ord_recent", f"SELECT id, kind, created_at FROM {_M} ORDER BY created_at DESC, id LIMIT 100")
def ord_recent(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).select("id", "kind", "created_at").orderBy(F.desc("created_at"), "id").limit(100)


@query("ord_oldest", "SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id, turn LIMIT 50")
def ord_oldest(spark: SparkSession, sf: str) -> DataFrame:
    """The oldest 50 notes, not the latest."""
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").orderBy("conv_id", "turn").limit(50)


@query("stm_session_append", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, role) AS replay, count(*) AS n FROM (SELECT * FROM conversations UNION ALL SELECT conv_id, 1000 + turn, 'note', 'again' FROM conversations WHERE turn = 0) GROUP BY conv_id")
def stm_session_append(spark: SparkSession, sf: str) -> DataFrame:
    """Notes appended to each session, replayed oldest first."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    more = c.where("turn = 0").select("conv_id", (F.col("turn") + 1000).alias("turn"), F.lit("note").alias("role"), F.lit("again").alias("text"))
    notes = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return c.unionByName(more).groupBy("conv_id").agg(notes.alias("notes"), F.count("*").alias("n")).select("conv_id", F.array_join(F.col("notes.text"), "\n").alias("replay"), "n")


_NOW = "2024-06-01T12:00:00"


@query("dml_upsert_entity", f"""WITH s AS (SELECT key, entity_type, source AS src, text AS content, tags FROM (WITH m AS ({MEMORIES_SQL}) SELECT m.*, d.source, d.text FROM m JOIN documents d ON d.doc_id + 1 = m.id) WHERE kind = 'entity'),
i AS (SELECT 'k' || doc_id AS key, 'upd' AS entity_type, 'n' || doc_id AS extra, CASE WHEN doc_id % 4 = 0 THEN 'more' ELSE '' END AS notes FROM documents WHERE doc_id % 2 = 0)
SELECT coalesce(s.key, i.key) AS key, coalesce(i.entity_type, s.entity_type) AS entity_type, s.src, i.extra,
  CASE WHEN i.key IS NULL OR (s.key IS NOT NULL AND i.notes = '') THEN s.content WHEN s.key IS NULL THEN i.notes ELSE trim(s.content || chr(10) || chr(10) || '---[{_NOW}]---' || chr(10) || i.notes) END AS content,
  CASE WHEN s.key IS NULL THEN 'en,new' WHEN i.key IS NULL THEN s.tags WHEN split_part(s.tags, ',', 2) = 'en' THEN s.tags || ',new' ELSE s.tags || ',en,new' END AS tags,
  CASE WHEN i.key IS NULL THEN 'old' ELSE '{_NOW}' END AS updated_at FROM s FULL JOIN i ON s.key = i.key""")
def dml_upsert_entity(spark: SparkSession, sf: str) -> DataFrame:
    store = M.decode(memories(spark, sf).where("kind = 'entity'")).select("key", "entity_type", "attributes", "content", "tags", F.lit("old").alias("updated_at"))
    incoming = table(spark, sf, "documents").where("doc_id % 2 = 0").select(
        F.lit(1).alias("seq"), F.concat(F.lit("k"), "doc_id").alias("key"), F.lit("upd").alias("entity_type"), F.create_map(F.lit("extra"), F.concat(F.lit("n"), "doc_id")).alias("attributes"),
        F.when(F.expr("doc_id % 4 = 0"), "more").otherwise("").alias("notes"), F.array(F.lit("en"), F.lit("new")).alias("tags"),
    )
    done = M.upsert_entities(store, incoming, _NOW)
    return done.select("key", "entity_type", F.col("attributes")["src"].alias("src"), F.col("attributes")["extra"].alias("extra"), "content", F.array_join("tags", ",").alias("tags"), "updated_at")


@query("dml_append_note", f"SELECT id, key, content FROM {_M} UNION ALL SELECT conv_id + 1000000, role, text FROM conversations WHERE length(trim(text)) > 0 AND length(trim(role)) > 0")
def dml_append_note(spark: SparkSession, sf: str) -> DataFrame:
    notes = table(spark, sf, "conversations").select((F.col("conv_id") + 1000000).alias("id"), F.col("role").alias("key"), F.col("text").alias("content"))
    return M.append_notes(memories(spark, sf).select("id", "key", "content"), notes)


@query("dml_delete", f"SELECT id, kind, key FROM {_M} WHERE NOT (id IN (5, 9) OR (kind = 'entity' AND key = 'k42'))")
def dml_delete(spark: SparkSession, sf: str) -> DataFrame:
    return M.forget(memories(spark, sf), ["5", "9", "k42"]).select("id", "kind", "key")


@query("dml_validate", "SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant', 'system') THEN 'bad role' WHEN length(trim(text)) = 0 THEN 'empty text' ELSE 'ok' END AS verdict FROM conversations")
def dml_validate(spark: SparkSession, sf: str) -> DataFrame:
    verdict = F.when(~F.col("role").isin("user", "assistant", "system"), "bad role").when(F.length(F.trim("text")) == 0, "empty text").otherwise("ok")
    return table(spark, sf, "conversations").select("conv_id", "turn", verdict.alias("verdict"))


@query("src_sql_table", "SELECT kind, count(*) AS n FROM (WITH m AS (" + MEMORIES_SQL + ") SELECT * FROM m) GROUP BY kind")
def src_sql_table(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("SELECT kind, count(*) AS n FROM {m} GROUP BY kind", m=memories(spark, sf))


@query("set_tag_union", f"SELECT id, list_distinct(string_split(tags, ',') || ['en', 'new']).list_sort().array_to_string(',') AS tags FROM {_M}")
def set_tag_union(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).select("id", F.array_join(F.array_sort(F.array_union(M.tag_list(F.col("tags")), F.array(F.lit("en"), F.lit("new")))), ",").alias("tags"))


@query("map_merge", """SELECT event_id, (props->>'k')::VARCHAR AS k, user_id::VARCHAR AS "user", 'new' AS state FROM events""")
def map_merge(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>").alias("old"), F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("state"), F.lit("new")).alias("new"))
    both = e.select("event_id", F.inline(F.array(F.struct(M.merge_attributes(F.col("old"), F.col("new")).alias("m")))))
    return both.select("event_id", *[F.col("m")[k].alias(k) for k in ("k", "user", "state")])


@query("agg_count_result", f"SELECT count(*) AS count, min(id) AS lowest, max(id) AS highest FROM {_M}")
def agg_count_result(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).agg(F.count("*").alias("count"), F.min("id").alias("lowest"), F.max("id").alias("highest"))
