"""Full-text search: query parsing, postings, Okapi BM25 and phrase matching."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: BM25 parameters; ours, as the store being modelled leaves ranking to its database.
K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}_]+"


def query_tokens(query: str) -> list[str]:
    """Word tokens, hyphens included, in the order of the query."""
    return re.findall(r"[\w\-]+", query)


def tokens(text: Column) -> Column:
    """Lower-cased words of a text as an array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def runs(rows: DataFrame, array: Column, key: str, keep: list[str]) -> DataFrame:
    """One row for each run of equal keys in a sorted array of structs: the columns to keep, the key, and the run's structs.

    Nothing is shuffled. The array is made once a row, and the work is linear in its length.
    """
    once = lambda c, name: F.inline(F.array(F.struct(c.alias(name))))
    made = rows.select(*keep, once(array, "all")).where(F.size("all") > 0)
    starts = F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: (i == 0) | (F.get("all", i)[key] != F.get("all", i - 1)[key]))
    run = lambda i, k: F.struct(F.get("all", i)[key].alias(key), F.slice("all", i + 1, F.coalesce(F.get("starts", k + 1), F.size("all")) - i).alias("run"))
    return made.select(*keep, "all", once(starts, "starts")).select(*keep, F.inline(F.transform("starts", run)))


def words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, words in their order and doc_len of every document."""
    return docs.select(F.col(id_col).alias("id"), F.inline(F.array(F.struct(tokens(F.col(text_col)).alias("w"))))).withColumn("doc_len", F.size("w"))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, id, tf, positions (from 0) and doc_len for every term of every document. A document's words stay in its task."""
    each = F.sort_array(F.transform("w", lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))
    found = runs(words(docs, id_col, text_col), each, "term", ["id", "doc_len"])
    return found.select("term", "id", "doc_len", F.size("run").cast("long").alias("tf"), F.col("run")["pos"].alias("positions"))


def _phrase_count(words: Column, phrase: list[str]) -> Column:
    """How often the words follow one another."""
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda w: w == phrase[0]))
    at = F.sequence(F.lit(0), F.size(words) - len(phrase))
    same = lambda i: reduce(lambda x, y: x & y, [F.get(words, i + k) == w for k, w in enumerate(phrase)])
    return F.when(F.size(words) >= len(phrase), F.size(F.filter(at, same))).otherwise(0)


def bm25(docs: DataFrame, query: str, *, id_col: str = "doc_id", text_cols: tuple[str, ...] = ("text",), limit: int | None = 20) -> DataFrame:
    """id and score of documents that hold any query token, best first; ties go to the lower id.

    A hyphenated token is a phrase of adjacent words. Corpus sums are taken in one pass over all texts without a
    shuffle; only texts that contain a term's letters are split into words again for their scores.
    """
    terms = list(dict.fromkeys(tuple(re.findall(r"\w+", t.lower())) for t in query_tokens(query)))
    terms = [t for t in terms if t]
    if not terms:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    text = F.concat_ws(" ", *[F.col(c) for c in text_cols])
    counts = [_phrase_count(F.col("w"), list(t)).alias(f"tf{i}") for i, t in enumerate(terms)]

    def counted(rows: DataFrame) -> DataFrame:
        base = rows.select(F.col(id_col).alias("id"), F.inline(F.array(F.struct(tokens(text).alias("w")))))
        return base.select("id", F.size("w").alias("len"), *counts)

    tf = counted(docs.where(reduce(lambda x, y: x | y, [F.contains(F.lower(text), F.lit(t[0])) for t in terms])))
    stats = counted(docs).agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    part = lambda i: F.ln(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    hit = reduce(lambda x, y: x | y, [F.col(f"tf{i}") > 0 for i in range(len(terms))])
    scored = tf.where(hit).join(F.broadcast(stats)).select("id", F.round(reduce(lambda x, y: x + y, [part(i) for i in range(len(terms))]), 6).alias("score"))  # stats is one row
    return scored.orderBy(F.desc("score"), "id").limit(limit) if limit else scored


def like_any(docs: DataFrame, query: str, cols: list[str]) -> DataFrame:
    """Rows where any token is in any column, ignoring case; % and _ in a token are wildcards, as in the store modelled."""
    found = [F.col(c).ilike(f"%{t}%") for t in query_tokens(query) for c in cols]
    return docs.where(reduce(lambda x, y: x | y, found)) if found else docs.limit(0)
