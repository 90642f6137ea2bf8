"""Writes as new versions of tables: upserts with a status lattice, fills, deletes, retention.

There is no table format with transactions here, so a write is a DataFrame of the new version, made by one full outer join
on the keys; `versions.commit` puts versions of several tables in place under one revision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_or_empty

KEYS = ("dataset", "case_id")
#: A pending arrival never takes these back; a failed case may become pending again.
SETTLED = ("done", "skipped")


def last_by_key(source: DataFrame, keys: tuple[str, ...] = KEYS, sequence: str = "seq") -> DataFrame:
    """One row a key, the last in input order; rows without a key go."""
    filled = source.filter(" and ".join(f"`{k}` is not null and cast(`{k}` as string) <> ''" for k in keys))
    order = Window.partitionBy(*keys).orderBy(F.desc(sequence))
    return filled.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def lattice(old: Column, new: Column) -> Column:
    return F.when((new == "pending") & old.isin(*SETTLED), old).otherwise(new)


def upsert(target: DataFrame, source: DataFrame, keys: tuple[str, ...] = KEYS, rules: dict | None = None) -> DataFrame:
    """The target's new version: rows of the source (one a key) replace or join it. All columns are overwritten, blanks too,
    but for those with a rule (old, new) -> value; columns that the source lacks stay."""
    rules = {"status": lattice} if rules is None else rules
    t, s = target.alias("t"), source.withColumn("_new", F.lit(True)).alias("s")
    joined = t.withColumn("_old", F.lit(True)).alias("t").join(s, list(keys), "full")
    out: list[Column] = []
    for c in target.columns:
        if c in keys or c not in source.columns:
            out.append(F.col(c) if c in keys else F.col(f"t.{c}").alias(c))
            continue
        old, new = F.col(f"t.{c}"), F.col(f"s.{c}")
        changed = F.when(F.col("_old").isNull(), new).otherwise(rules[c](old, new)) if c in rules else new
        out.append(F.when(F.col("_new"), changed).otherwise(old).alias(c))
    return joined.select(*out)


def upsert_bodies(target: DataFrame, source: DataFrame) -> DataFrame:
    """Bodies follow their case only where they are not empty."""
    return upsert(target, source.filter(text_or_empty(F.col("raw_text")) != ""), rules={})


def fill(target: DataFrame, values: DataFrame, column: str, only_if_empty: bool = True, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """target with column set from values (keys and column), where it is blank or everywhere; of a key's several values the greatest counts."""
    new = values.groupBy(*keys).agg(F.max(column).alias("_new"))
    blank = F.trim(text_or_empty(F.col(column))) == ""
    take = F.col("_new").isNotNull() & (blank if only_if_empty else F.lit(True))
    return target.join(new, list(keys), "left").withColumn(column, F.when(take, F.col("_new")).otherwise(F.col(column))).drop("_new")


def set_body(bodies: DataFrame, new: DataFrame) -> DataFrame:
    """Bodies with those of `new` in their place, blank ones too."""
    return upsert(bodies, new, rules={})


def write_summary(summaries: DataFrame, bridge: DataFrame, cases: DataFrame, new: DataFrame, tags: Column, status: str | None = None) -> dict[str, DataFrame]:
    """New versions of summaries, bridge and cases for summaries (one or many): links of the written keys are replaced, their cases get the status."""
    links = new.select("dataset", "case_id", F.explode(tags).alias("violation"))
    out = {"summaries": upsert(summaries, new, rules={}), "case_violations": replace_bridge(bridge, new, links)}
    hit = new.select(*KEYS).distinct().withColumn("_hit", F.lit(True))
    marked = cases.join(hit, list(KEYS), "left").withColumn("status", F.when(F.col("_hit"), F.coalesce(F.lit(status), F.col("status"))).otherwise(F.col("status")))
    return out | {"cases": marked.drop("_hit")}


def rebuild_bridge(summaries: DataFrame, tags: Column) -> DataFrame:
    """The bridge from the summaries' raw text alone."""
    return summaries.select("dataset", "case_id", F.explode(tags).alias("violation")).distinct()


def replace_bridge(bridge: DataFrame, written: DataFrame, links: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Links of all written keys are dropped and the new ones come in, each once; a key whose tags went leaves no stale link."""
    kept = bridge.join(written.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(links.select(*bridge.columns)).distinct()


def delete(table: DataFrame, keys_of: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows whose key is not to be deleted; a cascade is this on each table."""
    return table.join(keys_of.select(*keys).distinct(), list(keys), "left_anti")


def retain(tasks: DataFrame, finished: tuple[str, ...], keep: int, order: tuple[str, str] = ("created_at", "seq")) -> DataFrame:
    """Tasks but for finished ones older than the newest `keep` of these."""
    done = tasks.filter(F.col("status").isin(*finished))
    newest = done.orderBy(*[F.desc(c) for c in order]).limit(keep).select("id")
    old = done.join(newest, "id", "left_anti").select("id")
    return tasks.join(old, "id", "left_anti")


def append_log(log: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines (task_id, level, message, created_at, at) numbered after each task's last one."""
    last = log.groupBy("task_id").agg(F.max("seq").alias("_last"))
    order = Window.partitionBy("task_id").orderBy("at")
    new = lines.join(last, "task_id", "left").withColumn("seq", F.coalesce("_last", F.lit(0)) + F.row_number().over(order))
    return log.unionByName(new.select(*log.columns))


def to_fetch(known: DataFrame, bodies: DataFrame, skipped: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Keys that need no fetch: those with a body, and skipped ones."""
    names = list(keys)
    return known.select(*names).join(bodies.select(*names), names, "left_semi").unionByName(skipped.select(*names)).distinct()
