"""Workspace listing, line search, symbols, LLM output, logs, and sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import diff as D
from loomwork.functions import text as X
from loomwork.registry import query
from loomwork.sources import sinks
from loomwork.sources.tables import FILES_SQL, files, table

_IGN = "[" + ", ".join(f"'{d}'" for d in X.IGNORED_DIRS) + "]"
_OK = f"len(list_intersect(string_split(path, '/'), {_IGN})) = 0"


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).where(~X.ignored(F.col("path")))


_DIRS = f"(SELECT DISTINCT array_to_string(s[1:k], '/') AS path, k AS depth FROM (SELECT s, unnest(range(1, len(s))) AS k FROM (SELECT string_split(path, '/') AS s FROM f WHERE {_OK})))"


@query("src_list_files", """SELECT concat('source=', source, '/lang=', lang) AS path, 'files' AS type, sum(strlen(text) + 1)::BIGINT AS size, true AS timed FROM documents GROUP BY source, lang
UNION ALL SELECT DISTINCT concat('source=', source), 'dir', 0, false FROM documents UNION ALL SELECT DISTINCT concat('source=', source, '/lang=', lang), 'dir', 0, false FROM documents""")
def src_list_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as files below folders, and listed by the reader of files: bytes of each folder's files, whether all have a time, and the folders."""
    tree = sinks.scratch_path(spark, "tree")
    table(spark, sf, "documents").select("source", "lang", "text").write.partitionBy("source", "lang").option("lineSep", "\u0000").text(tree)
    found = sinks.list_files(spark, tree)
    held = found.where("type = 'file'").groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("path")).agg(F.lit("files").alias("type"), F.sum("size").alias("size"), (F.count("modificationTime") == F.count("*")).alias("timed"))
    return held.unionByName(found.where("type = 'dir'").select("path", "type", F.lit(0).cast("long").alias("size"), F.lit(False).alias("timed")))


@query("src_ignore_dirs", f"WITH f AS ({FILES_SQL}) SELECT path FROM f WHERE NOT {_OK}")
def src_ignore_dirs(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).where(X.ignored(F.col("path"))).select("path")


@query("src_tree", f"WITH f AS ({FILES_SQL}), e AS (SELECT path, depth, 0 AS is_file FROM {_DIRS} WHERE depth <= 4 UNION ALL SELECT DISTINCT path, len(string_split(path, '/')), 1 FROM f WHERE {_OK} AND len(string_split(path, '/')) <= 4) SELECT path, depth::INT AS depth, is_file FROM e ORDER BY is_file, lower(path), path LIMIT 2000")
def src_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Folders before files, names without regard to case, four levels, at most 2000 entries (the tool's own cap)."""
    f = _listed(spark, sf).select("path")
    both = X.folders(f).withColumn("is_file", F.lit(0)).unionByName(f.distinct().select("path", F.size(F.split("path", "/")).alias("depth"), F.lit(1).alias("is_file")))
    return both.where("depth <= 4").orderBy("is_file", F.lower("path"), "path").limit(2000)


@query("src_find_files", f"WITH f AS ({FILES_SQL}) SELECT DISTINCT path FROM f WHERE {_OK} AND regexp_matches(path, '^(?:.*/)?f[^/]*\\.py$')")
def src_find_files(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(spark, sf).where(F.col("path").rlike(X.glob_regex("**/f*.py"))).select("path").distinct()


@query("src_read_text", "SELECT doc_id, text FROM documents WHERE strlen(text) <= 5242880")
def src_read_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.octet_length("text") <= sinks.MOST_BYTES).select("doc_id", "text")


@query("src_read_range", "SELECT doc_id, i::INT AS line, string_split(text, chr(10))[i] AS line_text FROM (SELECT doc_id, text, unnest(range(2, 5)) AS i FROM documents) WHERE i <= len(string_split(text, chr(10)))")
def src_read_range(spark: SparkSession, sf: str) -> DataFrame:
    return X.lines(table(spark, sf, "documents").select("doc_id", "text")).where(F.col("line").between(2, 4))


@query("src_file_info", f"WITH f AS ({FILES_SQL}) SELECT doc_id, path, string_split(path, '/')[-1] AS name, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS suffix, size::BIGINT AS size FROM f")
def src_file_info(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).select("doc_id", "path", X.basename(F.col("path")).alias("name"), X.suffix(F.col("path")).alias("suffix"), F.col("size").cast("long").alias("size"))


@query("src_git_status", f"WITH f AS ({FILES_SQL}) SELECT CASE doc_id % 4 WHEN 0 THEN ' M' WHEN 1 THEN '??' WHEN 2 THEN 'A ' ELSE 'D ' END AS code, path FROM f")
def src_git_status(spark: SparkSession, sf: str) -> DataFrame:
    """Porcelain lines: two characters of code, a space, the path."""
    line = F.concat(F.expr("CASE doc_id % 4 WHEN 0 THEN ' M' WHEN 1 THEN '??' WHEN 2 THEN 'A ' ELSE 'D ' END"), F.lit(" "), "path")
    return files(spark, sf).select(line.alias("l")).select(F.substring("l", 1, 2).alias("code"), F.expr("substring(l, 4)").alias("path"))


_SIDES = "SELECT a.doc_id, string_split(a.text, chr(10)) AS o, string_split(b.text, chr(10)) AS n FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1"


@query("src_git_diff", f"""WITH s AS MATERIALIZED ({_SIDES}), e AS (SELECT doc_id, '-' AS kind, unnest(o) AS text, unnest(range(1, len(o) + 1))::INT AS old_line, 0 AS new_line FROM s
UNION ALL SELECT doc_id, '+', unnest(n), 0, unnest(range(1, len(n) + 1))::INT FROM s) SELECT doc_id, concat('src/', doc_id, '.md') AS file, CASE WHEN old_line + new_line = 1 THEN 1 ELSE 2 END::BIGINT AS hunk, kind, old_line, new_line, md5(text) AS line FROM e""")
def src_git_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of raw diffs, with its file, hunk and line numbers. A diff turns a document into the next one: its first line in one hunk, the rest in another."""
    d = table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("o"))
    pair = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("o").alias("n")), "doc_id")
    signed = lambda c, sign, a, n: F.transform(F.slice(c, a, n), lambda x: F.concat(F.lit(sign), x))
    rest = lambda c: F.size(c) - 1
    span = lambda c: F.concat(F.when(rest(c) > 0, F.lit("2,")).otherwise(F.lit("1,")), rest(c).cast("string"))
    name = F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".md"))
    head = F.array(F.concat(F.lit("--- a/"), name), F.concat(F.lit("+++ b/"), name), F.lit("@@ -1 +1 @@ first"))
    one, two = F.concat(signed("o", "-", 1, 1), signed("n", "+", 1, 1)), F.concat(signed("o", "-", 2, F.size("o")), signed("n", "+", 2, F.size("n")))
    second = F.array(F.concat(F.lit("@@ -"), span("o"), F.lit(" +"), span("n"), F.lit(" @@")))
    diffs = pair.select("doc_id", F.array_join(F.concat(head, one, second, two), "\n").alias("diff"))
    return D.hunk_lines(diffs, "doc_id", "diff").select("doc_id", "file", "hunk", "kind", F.coalesce("old_line", F.lit(0)).alias("old_line"), F.coalesce("new_line", F.lit(0)).alias("new_line"), F.md5(F.col("text").cast("binary")).alias("line"))


@query("src_git_log", "SELECT md5(event_id::VARCHAR) AS hash, 'u' || user_id AS author, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date, event_type AS message FROM events WHERE event_id % 9 <> 0")
def src_git_log(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of four parts between unit separators; others are dropped."""
    short = F.when(F.col("event_id") % 9 == 0, F.lit("x"))
    line = F.concat_ws("\u001f", F.md5(F.col("event_id").cast("string")), F.concat(F.lit("u"), "user_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "event_type", short)
    part = table(spark, sf, "events").select(F.split(line, "\u001f").alias("p")).where(F.size("p") == 4)
    return part.select(*[F.col("p")[i].alias(n) for i, n in enumerate(("hash", "author", "date", "message"))])


@query("src_http_html", "SELECT page_id, coalesce(nullif(regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1), ''), nullif(regexp_extract(html, '(?is)<body\\b[^>]*>(.*)</body>', 1), ''), html) AS part FROM pages")
def src_http_html(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.html_element(F.col("html"), tag="article").alias("part"))


@query("src_read_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src_read_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.scratch_path(spark, "csv")
    sinks.write_csv(table(spark, sf, "nation"), path)
    return sinks.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("src_inline", "SELECT * FROM (VALUES ('foo', 1::BIGINT), ('bar', 2)) t(a, b)")
def src_inline(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([("foo", 1), ("bar", 2)], "a string, b long")


@query("src_dataset", "SELECT conv_id, turn, CASE WHEN conv_id % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM conversations")
def src_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.with_split(table(spark, sf, "conversations").select("conv_id", "turn"), F.col("conv_id") % 10 == 0)


@query("src_battery", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE (props->>'k')::INT END AS percent FROM events")
def src_battery(spark: SparkSession, sf: str) -> DataFrame:
    """The percentage in a tab-separated line, -1 if there is none."""
    line = F.when(F.col("event_id") % 5 == 0, F.lit("no battery")).otherwise(F.concat(F.lit(" -InternalBattery-0 (id=1)\t"), F.get_json_object("props", "$.k"), F.lit("%; charging")))
    return table(spark, sf, "events").select("event_id", F.coalesce(F.regexp_extract(line, r"\t(\d+)%", 1).try_cast("int"), F.lit(-1)).alias("percent"))


@query("src_generate", "SELECT i::BIGINT AS arange, round(i * 10 / 49.0, 6) AS linspace, 1.0::DOUBLE AS one, 0.0::DOUBLE AS zero FROM range(0, 50) t(i)")
def src_generate(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(50).select(F.col("id").alias("arange"), F.round(F.col("id") * 10 / 49.0, 6).alias("linspace"), F.lit(1.0).alias("one"), F.lit(0.0).alias("zero"))


@query("src_mvn_sim")
def src_mvn_sim(spark: SparkSession, sf: str) -> DataFrame:
    """200 seeded normal rows of three features; the first is shifted by 1.5 from row 180 on."""
    z = [F.randn(s) for s in (1, 2, 3)]
    base = spark.range(0, 200, 1, 1).select(F.col("id").alias("i"), *[x.alias(f"z{k}") for k, x in enumerate(z)])
    return base.select("i", (F.col("z0") + F.when(F.col("i") >= 180, 1.5).otherwise(0.0)).alias("x0"), (0.5 * F.col("z0") + 0.866 * F.col("z1")).alias("x1"), F.col("z2").alias("x2"))


@query("snk_write_file", "SELECT text FROM benchmark")
def snk_write_file(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.scratch_path(spark, "text")
    sinks.write_text(table(spark, sf, "benchmark"), path)
    return spark.read.option("lineSep", "\u0000").text(path).select(F.col("value").alias("text"))


@query("snk_save_md", "SELECT replace(p_brand || ' x', '#', '#') AS name, count(*) AS n FROM part GROUP BY 1")
def snk_save_md(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.scratch_path(spark, "md")
    named = table(spark, sf, "part").select(F.concat("p_brand", F.lit("/x")).alias("title"), F.col("p_name").alias("text"))
    sinks.save_markdown(named, path, "title")
    return spark.read.option("lineSep", "\u0000").text(path).groupBy("name").agg(F.count("*").alias("n"))


@query("snk_audit_jsonl", "SELECT l_suppkey AS component, count(*) AS n, 'move' AS decision FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey, count(*), 'keep' FROM lineitem GROUP BY 1")
def snk_audit_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.scratch_path(spark, "audit")
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("component")).agg(F.count("*").alias("n"))
    for decision in ("move", "keep"):
        sinks.append_jsonl(rows.withColumn("decision", F.lit(decision)), path)
    return spark.read.schema("component long, n long, decision string").json(path)


@query("snk_csv_tables", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def snk_csv_tables(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.scratch_path(spark, "scores")
    sinks.write_csv(table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")), path)
    return sinks.read_csv(spark, path, "event_type string, n long, total double")


# lines, symbols, names
_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS line FROM documents)"


@query("str_grep", f"SELECT doc_id, line, line_text FROM {_LINES} WHERE regexp_matches(line_text, '(?i)\\bthe [a-z]+ion\\b')")
def str_grep(spark: SparkSession, sf: str) -> DataFrame:
    return X.grep(table(spark, sf, "documents").select("doc_id", "text"), r"\bthe [a-z]+ion\b", ignore_case=True)


@query("str_filename", f"WITH f AS ({FILES_SQL}) SELECT doc_id, path FROM f WHERE regexp_matches(lower(string_split(path, '/')[-1]), '^f1[^/]*\\.py$') OR contains(lower(string_split(path, '/')[-1]), 'dock')")
def str_filename(spark: SparkSession, sf: str) -> DataFrame:
    name = F.lower(X.basename(F.col("path")))
    return files(spark, sf).where(name.rlike(X.glob_regex("f1*.py")) | name.contains("dock")).select("doc_id", "path")


@query("str_symbols", f"""WITH f AS ({FILES_SQL}), l AS (SELECT path, CASE WHEN size % 3 = 0 THEN 'class ' WHEN size % 3 = 1 THEN '  async def ' ELSE 'export const ' END || regexp_extract(text, '([A-Za-z]+)', 1) || ' = (1)' AS t FROM f)
SELECT path, 1 AS line, kind, name FROM (
SELECT path, 'class' AS kind, regexp_extract(t, '^\\s*class\\s+(\\w+)', 1) AS name FROM l WHERE path LIKE '%.py'
UNION ALL SELECT path, 'function', regexp_extract(t, '^\\s*(?:async\\s+)?def\\s+(\\w+)', 1) FROM l WHERE path LIKE '%.py'
UNION ALL SELECT path, 'class', regexp_extract(t, '^\\s*(?:data\\s+|sealed\\s+|abstract\\s+)*class\\s+(\\w+)', 1) FROM l WHERE path LIKE '%.kt'
UNION ALL SELECT path, 'class', regexp_extract(t, '^\\s*(?:export\\s+)?class\\s+(\\w+)', 1) FROM l WHERE path LIKE '%.js' OR path LIKE '%.tsx'
UNION ALL SELECT path, 'const', regexp_extract(t, '^\\s*(?:export\\s+)?const\\s+(\\w+)\\s*=\\s*(?:async\\s*)?\\(', 1) FROM l WHERE path LIKE '%.js' OR path LIKE '%.tsx') WHERE name <> ''""")
def str_symbols(spark: SparkSession, sf: str) -> DataFrame:
    head = F.expr("CASE WHEN size % 3 = 0 THEN 'class ' WHEN size % 3 = 1 THEN '  async def ' ELSE 'export const ' END")
    code = files(spark, sf).select("path", F.concat(head, F.regexp_extract("text", "([A-Za-z]+)", 1), F.lit(" = (1)")).alias("text"))
    return X.symbols(code)


@query("str_replace_n", "SELECT doc_id, replace(text, 'the', 'THE') AS every, regexp_replace(text, 'the', 'THE') AS first FROM documents WHERE contains(text, 'the')")
def str_replace_n(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without the literal are an error in the tool; here they are left out."""
    d = table(spark, sf, "documents").where(F.col("text").contains("the"))
    return d.select("doc_id", X.replace_n(F.col("text"), "the", "THE").alias("every"), X.replace_n(F.col("text"), "the", "THE", 1).alias("first"))


@query("str_tokens", "SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(text, '([\\p{L}\\p{N}_\\-]+)', 1), lambda t: '\"' || t || '\"'), ' OR ') AS match FROM conversations")
def str_tokens(spark: SparkSession, sf: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_\-]+)"), F.lit(1))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.transform(words, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ").alias("match"))


_NUM = "'1. ' || replace(text, '. ', chr(10) || '2) ')"


@query("str_numbered_list", f"SELECT doc_id, list_transform(list_filter(list_transform(string_split({_NUM}, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^\\d+[.)]')), lambda x: regexp_extract(x, '^\\d+[.)]\\s*(.*)', 1)) AS items FROM documents")
def str_numbered_list(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("1. "), F.replace("text", F.lit(". "), F.lit("\n2) ")))
    return table(spark, sf, "documents").select("doc_id", X.numbered_list(text).alias("items"))


_EXT = "CASE lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.LANGUAGES.items()) + " END"


def _language(path) -> F.Column:  # noqa: ANN001
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in X.LANGUAGES.items() for x in kv]), X.suffix(path))


@query("str_ext_lang", f"WITH f AS ({FILES_SQL}) SELECT doc_id, path, {_EXT} AS language FROM f")
def str_ext_lang(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).select("doc_id", "path", _language(F.col("path")).alias("language"))


@query("agg_lang_counts", f"WITH f AS ({FILES_SQL}) SELECT {_EXT} AS language, count(*) AS n FROM f WHERE {_EXT} IS NOT NULL GROUP BY 1")
def agg_lang_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = files(spark, sf).select(_language(F.col("path")).alias("language")).where("language is not null")
    return found.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language")


@query("agg_frameworks", f"WITH f AS ({FILES_SQL}), m AS (SELECT unnest([{', '.join(repr(k) for k in X.FRAMEWORKS)}]) AS marker, unnest([{', '.join(repr(v) for v in X.FRAMEWORKS.values())}]) AS framework) SELECT DISTINCT framework FROM f, m WHERE ends_with(string_split(path, '/')[-1], marker)")
def agg_frameworks(spark: SparkSession, sf: str) -> DataFrame:
    markers = F.array(*[F.struct(F.lit(k).alias("marker"), F.lit(v).alias("framework")) for k, v in X.FRAMEWORKS.items()])
    hit = files(spark, sf).select(F.inline(F.filter(markers, lambda m: F.endswith(X.basename(F.col("path")), m["marker"]))))
    return hit.select("framework").distinct()


@query("str_latex_fix")
def str_latex_fix(spark: SparkSession, sf: str) -> DataFrame:
    """Lookbehind keeps this out of the SQL twin; tests hold it against worked lines."""
    line = F.concat(F.lit("\\[ a^"), F.col("doc_id"), F.lit(" \\] and \\( b \\) "), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", X.fix_latex(line).alias("fixed"))


_TOPIC = "p_partkey AS number, p_name AS topic, p_type AS description, [p_brand, 'size ' || p_size] AS subtopics"


@query("str_topic_fmt", f"SELECT number, topic || ': ' || description || ' [' || array_to_string(subtopics, ', ') || ']' AS line, '## ' || number || '- ' || topic || chr(10) || chr(10) || description || chr(10) || chr(10) || '### Subtopics' || chr(10) || '- ' || array_to_string(subtopics, chr(10) || '- ') || chr(10) || chr(10) AS md FROM (SELECT {_TOPIC} FROM part)")
def str_topic_fmt(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("number"), F.col("p_name").alias("topic"), F.col("p_type").alias("description"), F.array("p_brand", F.concat(F.lit("size "), "p_size")).alias("subtopics"))
    md = F.concat(F.lit("## "), "number", F.lit("- "), "topic", F.lit("\n\n"), "description", F.lit("\n\n### Subtopics\n- "), F.array_join("subtopics", "\n- "), F.lit("\n\n"))
    return t.select("number", F.concat("topic", F.lit(": "), "description", F.lit(" ["), F.array_join("subtopics", ", "), F.lit("]")).alias("line"), md.alias("md"))


@query("str_topic_by_number", "SELECT p_size, coalesce(min_by(p_name, p_partkey) FILTER (p_partkey % 5 = 3), '') AS topic FROM part GROUP BY 1")
def str_topic_by_number(spark: SparkSession, sf: str) -> DataFrame:
    """Of each list the first topic with number 3, or ''."""
    item = F.struct(F.col("p_partkey").alias("at"), F.expr("p_partkey % 5").alias("number"), F.col("p_name").alias("topic"))
    lists = table(spark, sf, "part").groupBy("p_size").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return lists.select("p_size", F.coalesce(F.get(F.filter("items", lambda x: x["number"] == 3), 0)["topic"], F.lit("")).alias("topic"))


@query("str_truncate", "SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END AS shown, left(text, 15000) AS page FROM documents")
def str_truncate(spark: SparkSession, sf: str) -> DataFrame:
    """The tool's display cuts: 300 characters with dots, 15000 for a page."""
    cut = F.when(F.length("text") > 300, F.concat(F.left("text", F.lit(300)), F.lit("..."))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", cut.alias("shown"), F.left("text", F.lit(15000)).alias("page"))


@query("str_safe_name", "SELECT page_id, regexp_replace(url, '[/:*?\"<>|]', ' ', 'g') AS name FROM pages")
def str_safe_name(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.safe_name(F.col("url")).alias("name"))


_LOG = "strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || upper(event_type) || ' [' || CASE WHEN event_id % 13 = 0 THEN 'Auth' ELSE 'AuthService] -' END || ' user ' || user_id"


def _log(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.upper("event_type"), F.lit(" ["), F.when(F.expr("event_id % 13 = 0"), "Auth").otherwise("AuthService] -"), F.lit(" user "), "user_id")
    return table(spark, sf, "events").select("event_id", line.alias("line"))


_RX = "'^(.*?) (.*?) (.*?) \\[(.*?)\\] - (.*?)$'"


@query("str_dissect", f"WITH l AS (SELECT event_id, {_LOG} AS line FROM events) SELECT event_id, CASE WHEN regexp_matches(line, {_RX}) THEN regexp_extract(line, {_RX}, 1) || ' ' || regexp_extract(line, {_RX}, 2) END AS timestamp, CASE WHEN regexp_matches(line, {_RX}) THEN regexp_extract(line, {_RX}, 3) END AS level, CASE WHEN regexp_matches(line, {_RX}) THEN regexp_extract(line, {_RX}, 4) END AS logger, CASE WHEN regexp_matches(line, {_RX}) THEN regexp_extract(line, {_RX}, 5) END AS message FROM l")
def str_dissect(spark: SparkSession, sf: str) -> DataFrame:
    parts = X.dissect(F.col("line"), "%{timestamp} %{+timestamp} %{level} [%{logger}] - %{message}")
    return _log(spark, sf).select("event_id", *[c.alias(k) for k, c in parts.items()])


@query("dt_parse_layout", "SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN date_trunc('second', ts) END AS ts FROM events")
def dt_parse_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Timestamps of the layout 2006-01-02 15:04:05; others are null."""
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    bad = F.when(F.expr("event_id % 13 = 0"), F.concat(F.lit("x"), text)).otherwise(text)
    return table(spark, sf, "events").select("event_id", F.try_to_timestamp(bad, F.lit("yyyy-MM-dd HH:mm:ss")).cast(table(spark, sf, "events").schema["ts"].dataType).alias("ts"))


@query("dt_fmt", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders")
def dt_fmt(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("dt_now")
def dt_now(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("now"))


@query("dt_diff", "SELECT user_id, date_diff('microsecond', min(ts), max(ts)) AS micros FROM events GROUP BY 1")
def dt_diff(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")).alias("micros"))


@query("dt_news_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS date FROM orders")
def dt_news_date(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.expr("o_orderkey % 7 = 0"), "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", text.try_cast("date").alias("date"))


@query("str_chat_template", "SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn, role) || chr(10) || '<|assistant|>' || chr(10) AS prompt FROM conversations GROUP BY 1")
def str_chat_template(spark: SparkSession, sf: str) -> DataFrame:
    said = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(said.alias("m"))
    body = F.array_join(F.transform("m", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"])), "\n")
    return c.select("conv_id", F.concat(body, F.lit("\n<|assistant|>\n")).alias("prompt"))


@query("str_bpe_pretok", "SELECT doc_id, regexp_extract_all(text, '([\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]+)', 1) AS pieces FROM documents")
def str_bpe_pretok(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+)"), F.lit(1)).alias("pieces"))


@query("str_heuristic_record", "SELECT p_partkey, lower(string_split(p_name, ' ')[1]) AS verb, lower(string_split(p_name, ' ')[2]) AS object, CASE WHEN p_size > 25 THEN 'trading' ELSE 'account' END AS l1 FROM part")
def str_heuristic_record(spark: SparkSession, sf: str) -> DataFrame:
    """A camel-case name split into verb and object, with a first-level tag."""
    camel = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    words = F.split(F.regexp_replace(camel, "([a-z0-9])([A-Z])", "$1 $2"), " ")
    return table(spark, sf, "part").select("p_partkey", F.lower(words[0]).alias("verb"), F.lower(words[1]).alias("object"), F.when(F.col("p_size") > 25, "trading").otherwise("account").alias("l1"))


# JSON
@query("jsn_array_greedy", "SELECT event_id, nullif(regexp_extract('text [1] ' || props || ' [2, 3] end', '(?s)\\[.*\\]', 0), '') AS found FROM events")
def jsn_array_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", X.json_array_text(F.concat(F.lit("text [1] "), "props", F.lit(" [2, 3] end"))).alias("found"))


@query("jsn_recover", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE (props->>'k')::BIGINT END AS k FROM events")
def jsn_recover(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('Sure:\n```json\n', props, '\n```\nDone') WHEN 2 THEN concat('It is ', props, ' indeed') ELSE 'nothing {' END")
    return table(spark, sf, "events").select("event_id", F.try_variant_get(X.recover_json(text), "$.k", "long").alias("k"))


@query("jsn_root_keys", "SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN (props->>'k')::BIGINT END AS k, CASE WHEN event_id % 11 = 0 THEN 'x' || props END AS error FROM events")
def jsn_root_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys become columns; text that doesn't parse goes to an error column."""
    text = F.when(F.expr("event_id % 11 = 0"), F.concat(F.lit("x"), "props")).otherwise(F.col("props"))
    parsed = F.from_json(text, "k long, error string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "error"})
    return table(spark, sf, "events").select("event_id", parsed.alias("j")).select("event_id", "j.k", "j.error")


@query("stm_multiline", """WITH l AS (SELECT doc_id, line, line_text, sum(CASE WHEN line = 1 OR regexp_matches(line_text, '^[A-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS e FROM """ + _LINES + """)
SELECT doc_id, e::BIGINT AS event, string_agg(line_text, chr(10) ORDER BY line) AS text FROM l GROUP BY doc_id, e""")
def stm_multiline(spark: SparkSession, sf: str) -> DataFrame:
    """A line that starts with a capital opens an event, others append to it."""
    from loomwork.streaming import logs

    return logs.multiline(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", r"^[A-Z]")
