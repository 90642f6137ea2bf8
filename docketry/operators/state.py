"""State tables: tasks with their logs, key-value pairs, and lookups by key. Writes are new versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_or_empty
from .merge import KEYS, delete, upsert

FINISHED, ACTIVE = ("done", "failed", "cancelled"), ("pending", "running")


def lookup(table: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows of the wanted keys; each once, however often its key is asked for."""
    return table.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def existing(table: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The wanted keys with exists: whether the table has them."""
    have = table.select(*keys).distinct().withColumn("exists", F.lit(True))
    return wanted.select(*keys).distinct().join(have, list(keys), "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def with_bodies(cases: DataFrame, bodies: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """cases with raw_text, empty where there is no body: one join in place of a read for each case."""
    return cases.join(bodies.select(*keys, "raw_text"), list(keys), "left").withColumn("raw_text", text_or_empty(F.col("raw_text")))


def set_value(table: DataFrame, keys: DataFrame, column: str, value: Column, by: tuple[str, ...] = KEYS) -> DataFrame:
    """The table with a column set for the given keys; keys that it lacks are ignored."""
    hit = keys.select(*by).distinct().withColumn("_hit", F.lit(True))
    return table.join(hit, list(by), "left").withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).drop("_hit")


def put(pairs: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """Key-value pairs with new ones written over equal keys."""
    return upsert(pairs, new, keys, rules={})


def get(pairs: DataFrame, key: str, default: str = "") -> DataFrame:
    """One row: the key's value, or the default."""
    return pairs.agg(F.coalesce(F.max(F.when(F.col("key") == key, F.col("value"))), F.lit(default)).alias("value"))


def tasks(table: DataFrame, kinds: tuple[str, ...] = (), statuses: tuple[str, ...] = (), limit: int = 0) -> DataFrame:
    """Tasks of the kinds and statuses (none: any), newest first, ties by sequence."""
    for column, chosen in (("kind", kinds), ("status", statuses)):
        table = table.filter(F.col(column).isin(*chosen)) if chosen else table
    ordered = table.orderBy(F.desc("created_at"), F.desc("seq"))
    return ordered.limit(limit) if limit > 0 else ordered


def running(table: DataFrame) -> DataFrame:
    """Active tasks by kind: kind, tasks."""
    return table.filter(F.col("status").isin(*ACTIVE)).groupBy("kind").agg(F.count("*").alias("tasks"))


def progress(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Tasks with the changes' columns (by id) where these are not null, in one join; of an id's several values the greatest counts."""
    columns = [c for c in changes.columns if c != "id"]
    if not columns:
        return table
    new = changes.groupBy("id").agg(*[F.max(c).alias(f"_new_{c}") for c in columns])
    joined = table.join(new, "id", "left")
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(*[f"_new_{c}" for c in columns])


def finish(table: DataFrame, ids: DataFrame, status: str, at: str) -> DataFrame:
    """Active tasks of the ids with a final status and time; finished ones stay as they are."""
    active = ids.join(table.filter(F.col("status").isin(*ACTIVE)).select("id"), "id", "left_semi")
    return set_value(set_value(table, active, "finished_at", F.lit(at), ("id",)), active, "status", F.lit(status), ("id",))


def remove_tasks(table: DataFrame, logs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks and logs without the ids."""
    return delete(table, ids, ("id",)), delete(logs, ids.withColumnRenamed("id", "task_id"), ("task_id",))


def log_tail(log: DataFrame, start: int) -> DataFrame:
    """Lines from a sequence number on, in order."""
    return log.filter(F.col("seq") >= start).orderBy("task_id", "seq")


def merged_results(results: DataFrame, counters: tuple[str, ...]) -> DataFrame:
    """One row: every counter summed over the datasets' results; missing ones count nothing."""
    return results.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counters])


def known_links(links: DataFrame, known: DataFrame, key: str = "case_id") -> DataFrame:
    """links with known: whether the key is already there."""
    have = known.select(key).distinct().withColumn("known", F.lit(True))
    return links.join(have, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def page_is_known(page: DataFrame, seen: DataFrame, key: str = "link_url") -> DataFrame:
    """One row: whether every key of a page was seen before."""
    return page.select(key).distinct().join(seen.select(key).distinct(), key, "left_anti").agg((F.count("*") == 0).alias("known"))
