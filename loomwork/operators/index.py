"""An inverted index that takes inserts, updates and deletes: segments of postings, versions in place of deletions, merges.

Every batch of changes adds one segment; nothing that is there is rewritten. A posting carries the version (the number of the
batch) that wrote it, and a small log of (id, version, doc_len) names the last version of each document, without a length
if it is gone. A posting counts if its version is the document's last one; merges drop the others. Searches read the
buckets of their terms and the log, never texts.

Texts stay where they lie: a batch shuffles its words once, a row for each document and bucket, and postings are read
without a shuffle, as the versions that don't count are sent to them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwork.operators import search as S

_POSTINGS = "term string, id {kind}, version long, tf long, positions array<int>, doc_len int, bucket int"
#: Words or postings of a task that sorts and writes them (some 200 MB in memory).
PIECE = 2_000_000
#: Rows that are sent to all workers at most (some 30 MB); they are counted first, and more of them are joined by a shuffle.
MOST_SENT = 500_000


def _less(k: int) -> Callable[[Column], Column]:
    return lambda x: x - k


class TextIndex:
    """An index in a folder that all machines share.

    Changes have the columns op ('I', 'U' or 'D'), id, seq (the last change of an id in a batch counts) and text.
    Inserting an id that is there replaces its text, updating one that isn't inserts it, deleting one that isn't does nothing.
    A null text has no words; changes of a null id are left out. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, *, id_type: str = "long", buckets: int = 32, most_segments: int = 8) -> None:
        self.spark, self.path, self.buckets, self.most_segments = spark, path.rstrip("/"), buckets, most_segments
        self.schema = _POSTINGS.format(kind=id_type)
        self.log_schema = f"id {id_type}, version long, doc_len int, batch long"
        self.state_schema = "generation long, segments array<string>, versions long"

    def _exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at)

    def state(self) -> tuple[int, list[str], int]:
        """The last generation: its number, its segments, and the highest version that they hold (-1 if none)."""
        if not self._exists("state"):
            return -1, [], -1
        last = self.spark.read.schema(self.state_schema).json(f"{self.path}/state/*").orderBy(F.desc("generation")).first()
        return (last["generation"], list(last["segments"]), last["versions"]) if last else (-1, [], -1)

    def _commit(self, generation: int, segments: list[str], version: int) -> None:
        """A generation counts once its one row is there, which is written last."""
        row = self.spark.createDataFrame([(generation, segments, version)], self.state_schema)
        row.coalesce(1).write.mode("overwrite").json(f"{self.path}/state/{generation:012d}")

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Add a batch as one segment. A batch that was added before (a stream that restarts sends its last one again) changes nothing."""
        generation, segments, version = self.state()
        if batch <= version:
            return
        last = self._last(changes)
        doc_len = F.when(F.col("op") != "D", F.size(S.tokens(F.col("text")))).alias("doc_len")
        last.select("id", F.lit(batch).cast("long").alias("version"), doc_len).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")
        n = self._log(batch).where(F.col("batch") == batch).agg(F.sum("doc_len")).first()[0] or 0
        rows = self._postings(last.where("op <> 'D'"), self._slices(n)).withColumn("version", F.lit(batch).cast("long"))
        self._write(rows, f"segments/{batch:012d}")
        self._commit(generation + 1, [*segments, f"segments/{batch:012d}"], batch)
        if len(segments) + 1 > self.most_segments:
            self.merge()

    def stream(self, changes: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        """Apply every micro-batch of a stream of changes."""
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def _last(self, changes: DataFrame) -> DataFrame:
        """id, op and text of each id's last change. Only texts of ids that come more than once are shuffled."""
        rows = changes.where("id is not null").select("id", "op", "seq", "text")
        often = rows.groupBy("id").count().where("count > 1").select("id")
        n = often.limit(MOST_SENT + 1).count()
        if not n:
            return rows.drop("seq")
        pick = lambda r: r.groupBy("id").agg(F.max(F.struct("seq", "op", "text")).alias("c")).select("id", "c.op", "c.text")
        if n > MOST_SENT:
            return pick(rows)
        return rows.join(F.broadcast(often), "id", "left_anti").drop("seq").unionByName(pick(rows.join(F.broadcast(often), "id", "left_semi")))

    def _slices(self, n: int) -> int:
        """Tasks that share a bucket when n words or postings are written."""
        return max(1, -(-n // (self.buckets * PIECE)))

    def _dealt(self, rows: DataFrame, slices: int) -> DataFrame:
        """A bucket's rows in as many partitions as it has slices, by their ids."""
        return rows.repartitionById(self.buckets * slices, (F.col("bucket") * slices + F.pmod(F.xxhash64("id"), F.lit(slices))).cast("int"))

    def _postings(self, docs: DataFrame, slices: int) -> DataFrame:
        """The postings of documents, dealt out by bucket. The shuffle carries a document's words of a bucket as one row: the words and their places."""
        each = F.sort_array(F.transform("w", lambda t, i: F.struct(self._bucket(t).alias("bucket"), i.alias("pos"), t.alias("term"))))
        held = S.runs(S.words(docs, "id", "text"), each, "bucket", ["id", "doc_len"])
        packed = held.select("id", "doc_len", "bucket", F.array_join(F.col("run")["term"], " ").alias("words"), F.col("run")["pos"].alias("places"))
        again = F.sort_array(F.transform(F.split("words", " "), lambda t, i: F.struct(t.alias("term"), F.get("places", i).alias("pos"))))
        found = S.runs(self._dealt(packed, slices), again, "term", ["id", "doc_len", "bucket"])
        return found.select("term", "id", "doc_len", "bucket", F.size("run").cast("long").alias("tf"), F.col("run")["pos"].alias("positions"))

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, name: str) -> None:
        """Write postings that are dealt out by bucket."""
        rows = rows.select("term", "id", "version", "tf", "positions", F.col("doc_len").cast("int").alias("doc_len"), "bucket")
        rows.sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def _read(self, segments: list[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.path}/{s}") for s in segments]
        return reduce(DataFrame.unionByName, parts)

    def _log(self, version: int) -> DataFrame:
        """The log up to a version; a batch that broke off isn't in yet."""
        if version < 0:
            return self.spark.createDataFrame([], self.log_schema)
        return self.spark.read.schema(self.log_schema).parquet(f"{self.path}/log").where(F.col("batch") <= version)

    def documents(self) -> DataFrame:
        """id, version and doc_len of the documents that are there."""
        last = self._log(self.state()[2]).groupBy("id").agg(F.max_by(F.struct("version", "doc_len"), "version").alias("v"))
        return last.select("id", "v.version", "v.doc_len").where("doc_len is not null")

    def _live(self, rows: DataFrame, version: int) -> DataFrame:
        """Postings whose version is their document's last one. Versions that aren't are sent to them, of whole-number ids 64 in a row."""
        old = self._log(version).groupBy("id").agg(F.max("version").alias("last"), F.collect_set("version").alias("v")).where(F.size("v") > 1)
        old = old.select("id", "last", F.explode("v").alias("version")).where("version < last").select("id", "version")
        whole = self.schema.split(", ")[1].split()[1].lower() in ("long", "bigint", "int", "integer")
        if whole:
            old = old.groupBy(F.shiftright("id", 6).alias("block"), "version").agg(F.bit_or(F.expr("shiftleft(1L, cast(id & 63 as int))")).alias("bits"))
        n = old.limit(MOST_SENT + 1).count()
        if not n:
            return rows
        if n > MOST_SENT:
            return rows.join(self.documents().select("id", "version"), ["id", "version"], "left_semi")
        if not whole:
            return rows.join(F.broadcast(old), ["id", "version"], "left_anti")
        held = rows.withColumn("block", F.shiftright("id", 6)).join(F.broadcast(old), ["block", "version"], "left")
        return held.where(F.expr("bits is null or shiftright(bits, cast(id & 63 as int)) & 1 = 0")).select(*rows.columns)

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """term, id, tf, positions and doc_len of the documents that are there; of some terms only, if asked for."""
        _, segments, version = self.state()
        rows = self._read(segments)
        if terms is not None:
            asked = self.spark.createDataFrame([(t,) for t in terms], "term string").select(self._bucket(F.col("term")).alias("b"))
            rows = rows.where(F.col("bucket").isin([r["b"] for r in asked.distinct().collect()]) & F.col("term").isin(terms))  # as many as the query has terms
        return self._live(rows, version).select("term", "id", "tf", "positions", "doc_len")

    def merge(self, most: int | None = None) -> None:
        """Make one segment of the smallest ones, so that ``most`` (half of most_segments) are left; the others aren't read.

        Postings of older versions go. The merged segment is written beside the others and counts with the next generation.
        """
        generation, segments, version = self.state()
        most = most or max(1, self.most_segments // 2)
        if len(segments) <= most:
            return
        sizes = [(self.spark.read.parquet(f"{self.path}/{s}").count(), s) for s in segments]  # of Parquet files' footers
        small = {s for _, s in sorted(sizes)[: len(segments) - most + 1]}
        name = f"segments/merged-{generation + 1:012d}"
        live = self._live(self._read([s for s in segments if s in small]), version)
        self._write(self._dealt(live, self._slices(sum(n for n, s in sizes if s in small))), name)
        self._commit(generation + 1, [*[s for s in segments if s not in small], name], version)

    def search(self, query: str, limit: int | None = 20) -> DataFrame:
        """id and BM25 score of the documents with any query token, best first; a hyphenated token is a phrase. The same as search.bm25 over their texts."""
        phrases = list(dict.fromkeys(tuple(re.findall(r"\w+", t.lower())) for t in S.query_tokens(query)))
        phrases = [p for p in phrases if p]
        docs = self.documents()
        if not phrases:
            return docs.select("id", F.lit(0.0).alias("score")).limit(0)
        held = self.postings(sorted({t for p in phrases for t in p}))
        found = None
        for i, p in enumerate(phrases):
            # the places of the phrase's first word from which the others follow
            at = None
            for k, t in enumerate(p):
                mine = held.where(F.col("term") == t).select("id", "doc_len", F.transform("positions", _less(k)).alias("p"))
                at = mine if at is None else at.join(mine.select("id", F.col("p").alias("q")), "id").select("id", "doc_len", F.array_intersect("p", "q").alias("p"))
            hits = at.select("id", "doc_len", F.lit(i).alias("i"), F.size("p").alias("tf")).where("tf > 0")
            found = hits if found is None else found.unionByName(hits)
        df = found.groupBy("i").agg(F.count("*").alias("df"))  # as many rows as the query has tokens
        stats = docs.agg(F.count("*").alias("n"), F.avg("doc_len").alias("avg_len"))  # one row
        part = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (S.K1 + 1) / (F.col("tf") + S.K1 * (1 - S.B + S.B * F.col("doc_len") / F.col("avg_len")))
        scored = found.join(F.broadcast(df), "i").join(F.broadcast(stats)).groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))
        return scored.orderBy(F.desc("score"), "id").limit(limit) if limit else scored
