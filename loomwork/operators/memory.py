"""The memory store: validation, upsert-merge, append and delete over plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("entity", "note")


class InvalidMemory(ValueError):
    """An argument that the store refuses."""


def validate(kind: str | None = None, **texts: str) -> None:
    """Refuse unknown kinds and blank texts."""
    if kind is not None and kind not in KINDS:
        raise InvalidMemory(f"kind must be one of {KINDS}")
    for name, text in texts.items():
        if not text or not text.strip():
            raise InvalidMemory(f"{name} must not be empty")


def tag_list(tags: Column) -> Column:
    """Comma-joined tags as an array without empty ones."""
    return F.filter(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: t != "")


def decode(memories: DataFrame) -> DataFrame:
    """Attributes as a map, null content as '', tags as an array."""
    return memories.withColumns({"attributes": F.coalesce(F.from_json("attributes", T.MapType(T.StringType(), T.StringType())), F.create_map().cast("map<string,string>")), "content": F.coalesce("content", F.lit("")), "tags": tag_list(F.col("tags"))})


def merge_attributes(old: Column, new: Column) -> Column:
    """New keys overwrite, others stay; a key that is null in new overwrites too."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def upsert_entities(store: DataFrame, incoming: DataFrame, now: str) -> DataFrame:
    """Entities after a batch: key, entity_type, attributes (map), content, tags (array), updated_at.

    incoming has seq, key, entity_type, attributes, notes and tags. Repeated keys of a batch are folded in
    the order of seq. The type is overwritten, attributes are merged, new tags join in order, notes are appended after a
    time line; what a batch doesn't name stays as it is.
    """
    pick = F.sort_array(F.collect_list(F.struct("seq", "entity_type", F.map_entries("attributes").alias("attributes"), "notes", "tags")))
    batch = incoming.groupBy("key").agg(pick.alias("steps"))
    both = store.join(batch, "key", "full_outer")
    empty = F.create_map().cast("map<string,string>")
    old = F.struct(
        F.col("entity_type"), F.coalesce("attributes", empty).alias("attributes"), F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.col("updated_at").isNotNull().alias("old"),
    )

    def step(acc: Column, s: Column) -> Column:
        notes = F.coalesce(s["notes"], F.lit(""))
        added = F.trim(F.concat(acc["content"], F.lit(f"\n\n---[{now}]---\n"), notes))
        return F.struct(
            s["entity_type"].alias("entity_type"), merge_attributes(acc["attributes"], F.coalesce(F.map_from_entries(s["attributes"]), empty)).alias("attributes"),
            F.when(notes == "", acc["content"]).when(acc["old"], added).otherwise(notes).alias("content"),
            F.array_union(acc["tags"], F.coalesce(s["tags"], F.array().cast("array<string>"))).alias("tags"), F.lit(True).alias("old"),
        )

    merged = F.aggregate(F.coalesce("steps", F.array().cast(batch.schema["steps"].dataType)), old, step)
    done = both.select("key", F.inline(F.array(F.struct(merged.alias("m")))), F.when(F.col("steps").isNotNull(), F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"))
    return done.select("key", "m.entity_type", "m.attributes", "m.content", "m.tags", "updated_at")


def append_notes(store: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes with non-blank key and content join the store; nothing is overwritten."""
    ok = (F.length(F.trim("key")) > 0) & (F.length(F.trim("content")) > 0)
    return store.unionByName(notes.where(ok))


def forget(store: DataFrame, names: list[str]) -> DataFrame:
    """The store without what is named: digits are an id of any kind, anything else an entity's key."""
    ids, keys = [int(n) for n in names if n.isdigit()], [n for n in names if not n.isdigit()]
    gone = F.col("id").isin(ids) | ((F.col("kind") == "entity") & F.col("key").isin(keys))
    return store.where(~gone)
