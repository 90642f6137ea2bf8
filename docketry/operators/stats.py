"""Statistics over filtered cases. Ranked results break ties by value, which is the same in every run."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import percent, split_multi, text_or_empty


def ranked(counts: DataFrame, n: int = 0, value: str = "value", count: str = "cases") -> DataFrame:
    """Largest counts first, ties by value; the first n of them if n is given."""
    ordered = counts.orderBy(F.desc(count), F.asc(value))
    return ordered.limit(n) if n else ordered


def numbered(counts: DataFrame, n: int, by: tuple[str, ...] = (), value: str = "value", count: str = "cases") -> DataFrame:
    """The n largest counts of each group, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc(count), F.asc(value))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def distribution(rows: DataFrame, column: str, keep_blank: bool = True) -> DataFrame:
    """Cases by value; null and empty are one group, or left out."""
    value = text_or_empty(F.col(column).cast("string"))
    counts = rows.groupBy(value.alias("value")).agg(F.count("*").alias("cases"))
    return counts if keep_blank else counts.filter(F.col("value") != "")


def trend(rows: DataFrame, period: int, org: Column, person: Column, date: str = "date") -> DataFrame:
    """Cases by month (7) or year (4) of dated rows, with those of organisations and of persons."""
    dated = rows.filter(F.length(date) >= period)
    return dated.groupBy(F.substring(date, 1, period).alias("period")).agg(F.count("*").alias("cases"), F.count_if(F.coalesce(org, F.lit(False))).alias("orgs"), F.count_if(F.coalesce(person, F.lit(False))).alias("persons"))


def date_range(rows: DataFrame, date: str = "date") -> DataFrame:
    return rows.filter(F.col(date) != "").agg(F.min(date).alias("first"), F.max(date).alias("last"))


def totals(rows: DataFrame) -> DataFrame:
    """Counts by dataset and status and the grand total, in one pass over the rows."""
    sets = rows.groupingSets([["dataset", "status"], []], F.col("dataset"), F.col("status"))
    counted = sets.agg(F.count("*").alias("cases"), F.grouping_id().alias("_g"))
    return counted.select(F.when(F.col("_g") > 0, "total").otherwise(F.concat_ws(".", "dataset", "status")).alias("key"), "cases")


def body_totals(rows: DataFrame, bodies: DataFrame) -> DataFrame:
    """`totals` and the number of cases that have a body."""
    have = rows.join(bodies.select("dataset", "case_id"), ["dataset", "case_id"], "left_semi").agg(F.lit("bodies").alias("key"), F.count("*").alias("cases"))
    return totals(rows).unionByName(have)


def basic(rows: DataFrame) -> DataFrame:
    """One row: all cases, organisations, persons, neither, first and last date."""
    dated = F.nullif(F.col("date"), F.lit(""))
    org, person = F.count_if(F.col("entity_type") == "org"), F.count_if(F.col("entity_type") == "person")
    return rows.agg(F.count("*").alias("total"), org.alias("orgs"), person.alias("persons"), (F.count("*") - org - person).alias("unknown"), F.min(dated).alias("first"), F.max(dated).alias("last"))


def tag_counts(rows: DataFrame, tags: Column) -> DataFrame:
    """Mentions of each tag of an array; a case counts once for each of its tags."""
    return rows.select(F.explode(tags).alias("value")).groupBy("value").agg(F.count("*").alias("cases"))


def mention_totals(rows: DataFrame, tags: Column) -> DataFrame:
    return tag_counts(rows, tags).agg(F.sum("cases").alias("mentions"), F.count("*").alias("kinds"))


def tag_distribution(bridge: DataFrame, cases: DataFrame, limit: int = 0) -> DataFrame:
    """Cases by tag among the filtered cases, largest first; a case counts once for each of its tags."""
    chosen = bridge.join(cases.select("dataset", "case_id"), ["dataset", "case_id"], "left_semi")
    return ranked(chosen.groupBy(F.col("violation").alias("value")).agg(F.count("*").alias("cases")), limit)


def bridge_rows(bridge: DataFrame, cases: DataFrame, summaries: DataFrame) -> DataFrame:
    """The bridge with its cases' columns and, where there is one, the summary's."""
    return bridge.join(cases, ["dataset", "case_id"]).join(summaries, ["dataset", "case_id"], "left")


def by_kind(rows: DataFrame, values: Column, n: int, kind: str = "entity_type") -> DataFrame:
    """The n most frequent values of an array for each kind of party, ranked; blanks and rows without a kind go."""
    long = rows.filter(text_or_empty(F.col(kind)) != "").select(kind, F.explode(values).alias("value")).filter("value <> ''")
    return numbered(long.groupBy(kind, "value").agg(F.count("*").alias("cases")), n, (kind,))


def analysis(rows: DataFrame, metrics: dict[str, Column], top: dict[str, int] | None = None) -> DataFrame:
    """metric, value, cases, rank of every metric (an array of values for a row) from one scan and one aggregation.

    Metrics in `top` are cut to their most frequent values, the others are whole.
    """
    named = lambda name: lambda v: F.struct(F.lit(name).alias("metric"), v.alias("value"))
    pairs = [F.transform(values, named(name)) for name, values in metrics.items()]
    long = rows.select(F.explode(F.concat(*pairs)).alias("m")).select("m.*").filter("value is not null")
    counts = long.groupBy("metric", "value").agg(F.count("*").alias("cases"))
    counts = counts.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("cases"), F.asc("value"))))
    kept = [(F.col("metric") != name) | (F.col("rank") <= n) for name, n in (top or {}).items()]
    for test in kept:
        counts = counts.filter(test)
    return counts


def bridge(rows: DataFrame, tags: Column) -> DataFrame:
    """dataset, case_id, violation: one row for each case and different tag."""
    return rows.select("dataset", "case_id", F.explode(tags).alias("violation")).distinct()


def cited_laws(c: Column) -> Column:
    """Laws cited in a multi-value field, an array: the title in 《》, else the fragment unless it is an article alone."""

    def law(item: Column) -> Column:
        title = F.regexp_extract(item, "《([^》]+)》", 1)
        return F.when(title != "", title).when(~item.rlike("^第[一二三四五六七八九十百千零〇]+条"), item)

    return F.array_compact(F.transform(split_multi(c), law))


def citations(rows: DataFrame, c: Column) -> DataFrame:
    """Cases by cited law (`cited_laws`); a case counts once for each citation."""
    return rows.select(F.explode(cited_laws(c)).alias("value")).groupBy("value").agg(F.count("*").alias("cases"))


@dataclass(frozen=True)
class Metric:
    """One table of a bundle: the values of a row (an array), under each of its kinds if `kinds` (an array) is given, whole or the n first of each kind.

    They are ordered by cases, ties by value, or by the greatest text `by`, ties by cases and value: the longest or newest first. A value
    that comes with several texts `by` is a row for each, so `by` is for values that are one row's own.
    A row may have no values or kinds: an empty array, null, or null elements. A limit beyond 1000 is right but not applied in the tasks first.
    """

    values: Column
    kinds: Column | None = None
    n: int = 0
    by: Column | None = None


def bundle(rows: DataFrame, metrics: dict[str, Metric], org: Column, person: Column, date: str = "date") -> DataFrame:
    """All tables of an analysis from one scan: metric, kind, value, cases, orgs, persons, first, last (YYYY-MM-DD), rank.

    A row of the result is one value of a metric (and kind): how many cases, how many of them of organisations and of persons, and their first
    and last date (null where no case has a date that exists). rank is null in whole metrics. A case counts once for each element of its array; null kinds are no rows.

    The scan's rows are exploded into (metric, kind, value) and counted before and after one shuffle; that shuffle spreads a frequent value by
    its counts alone. Ranking takes the n first of each metric and kind in every task before they meet, so the second shuffle has
    at most the greatest n rows a task, metric and kind; values of whole metrics are partitions of their own there, and never sorted together.
    """
    if not any(m.n for m in metrics.values()):
        raise ValueError("no metric has a limit: count them by `analysis`")
    none = F.array().cast("array<struct<metric:string,kind:string,value:string,by:string>>")

    def long_of(name: str, m: Metric) -> Column:
        by = F.lit(None).cast("string") if m.by is None else text_or_empty(m.by)
        of_kind = lambda k: F.transform(m.values, lambda v: F.struct(F.lit(name).alias("metric"), k.alias("kind"), v.cast("string").alias("value"), by.alias("by")))
        return F.coalesce(of_kind(F.lit("")) if m.kinds is None else F.flatten(F.transform(m.kinds, of_kind)), none)

    pairs = [long_of(name, m) for name, m in metrics.items()]
    told = rows.select(F.col(date).try_cast("date").alias("_date"), F.coalesce(org, F.lit(False)).alias("_org"), F.coalesce(person, F.lit(False)).alias("_person"), F.explode(F.concat(*pairs)).alias("m"))
    long = told.select("_date", "_org", "_person", "m.*").filter("value is not null and kind is not null")
    # Every aggregate is a number or a day, so that tasks hash and don't sort.
    counts = long.groupBy("metric", "kind", "value", "by").agg(F.count("*").alias("cases"), F.count_if("_org").alias("orgs"), F.count_if("_person").alias("persons"), F.min("_date").alias("first"), F.max("_date").alias("last"))
    limits = {name: m.n for name, m in metrics.items() if m.n}
    whole = ~F.col("metric").isin(*limits)
    order = Window.partitionBy("metric", "kind", F.when(whole, F.col("value"))).orderBy(F.desc("by"), F.desc("cases"), F.asc("value"))
    first = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(limits.values()))
    cut = F.coalesce(*[F.when(F.col("metric") == name, n) for name, n in limits.items()])
    kept = first.filter(whole | (F.col("rank") <= cut))
    return kept.select("metric", "kind", "value", "cases", "orgs", "persons", *[F.col(c).cast("string").alias(c) for c in ("first", "last")], F.when(~whole, F.col("rank")).alias("rank"))


def bundle_json(bundled: DataFrame, most: int = 500) -> DataFrame:
    """metric, items, payload: the tables of a bundle as JSON arrays, by kind and rank, or by value in whole metrics.

    A payload is one value, so a metric of more than `most` rows is an error and not a cut table. No task gathers more than that: each
    hands on most + 1 rows a metric, which is enough to know. Whole metrics are meant to be calendars and fixed lists.
    """
    order = Window.partitionBy("metric").orderBy("kind", F.asc_nulls_first("rank"), "value")
    numbered = bundled.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most + 1)
    row = F.struct("_n", F.struct("kind", "rank", "value", "cases", "orgs", "persons", "first", "last").alias("row"))
    gathered = numbered.groupBy("metric").agg(F.count("*").alias("items"), F.array_sort(F.collect_list(row)).alias("rows"))
    payload = F.to_json(F.transform("rows", lambda r: r["row"]))
    return gathered.select("metric", "items", F.when(F.col("items") <= most, payload).otherwise(F.raise_error(F.concat(F.lit("too many rows for a payload: "), "metric"))).alias("payload"))


def overview(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Counts by every dimension, and of all, in one pass: dimension, value, cases."""
    plain = rows.select(*[text_or_empty(F.col(d).cast("string")).alias(d) for d in dimensions])
    sets = plain.groupingSets([[d] for d in dimensions] + [[]], *[F.col(d) for d in dimensions])
    counted = sets.agg(F.count("*").alias("cases"), *[F.grouping(d).alias(f"_{d}") for d in dimensions])
    which = F.coalesce(*[F.when(F.col(f"_{d}") == 0, d) for d in dimensions], F.lit("total"))
    value = F.coalesce(*[F.when(F.col(f"_{d}") == 0, F.col(d)) for d in dimensions], F.lit(""))
    return counted.select(which.alias("dimension"), value.alias("value"), "cases")


def pivot_months(rows: DataFrame, date: str = "date") -> DataFrame:
    """Cases by year and month 1 to 12, zeros where there are none."""
    dated = rows.filter(F.length(date) >= 7).select(F.substring(date, 1, 4).alias("year"), F.substring(date, 6, 2).cast("int").alias("month"))
    return dated.groupBy("year").pivot("month", list(range(1, 13))).count().na.fill(0)


def melt(table: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return table.unpivot(keys, values, "measure", "count")


def annualised(counts: DataFrame, year: int, elapsed: int, days: int) -> DataFrame:
    """The running year's count scaled to the whole year (halves to even), other years as they are."""
    scaled = F.bround(F.col("cases") * F.lit(days) / F.lit(elapsed)).cast("long")
    return counts.withColumn("projected", F.when(F.col("period") == str(year), scaled).otherwise(F.col("cases")))


def shares(counts: DataFrame) -> DataFrame:
    """Each count's percentage of all, with one decimal."""
    total = counts.agg(F.sum("cases").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", percent(F.col("cases"), F.col("_total"))).drop("_total")  # one row


def comparison(left: DataFrame, right: DataFrame) -> DataFrame:
    """Outer union of two count tables, by the sum of both."""
    both = left.withColumnRenamed("cases", "a").join(right.withColumnRenamed("cases", "b"), "value", "full").na.fill(0, ["a", "b"])
    return both.orderBy(F.desc(F.col("a") + F.col("b")), "value")


def representatives(rows: DataFrame, by: str, text: str, n: int = 2) -> DataFrame:
    """The n rows of each kind with the longest text, ties by newest date and largest id."""
    order = Window.partitionBy(by).orderBy(F.desc(F.length(text)), F.desc("date"), F.desc("case_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def quality_counters(rows: DataFrame, rules: dict[str, Column], key: str = "case_id", samples: int = 8) -> DataFrame:
    """rule, cases, samples: how many rows each rule finds, with the least keys among them; a rule that finds none has 0 and no samples.

    One scan and one aggregation: a task counts and keeps `samples` keys a rule, and that is all that it hands on. Keys of one value
    count as often as they occur; null keys are no samples.
    """
    kind = rows.schema[key].dataType
    names = list(rules)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, least = [0] * len(names), [[] for _ in names]
        for batch in batches:
            keys = batch.column("key")
            for i, hit in enumerate(batch.columns[1:]):
                found = keys.filter(hit)
                many[i] += len(found)
                found = found.drop_null()
                first = found.take(pc.select_k_unstable(found, samples, sort_keys=[("", "ascending")])) if len(found) > samples else found
                least[i] = sorted(least[i] + first.to_pylist())[:samples]
        yield pa.record_batch([pa.array(names), pa.array(many, pa.int64()), pa.array(least, pa.list_(to_arrow_type(kind)))], ["rule", "cases", "samples"])

    told = rows.select(F.col(key).alias("key"), *[F.coalesce(c, F.lit(False)).alias(f"_{i}") for i, c in enumerate(rules.values())])
    schema = T.StructType().add("rule", "string").add("cases", "long").add("samples", T.ArrayType(kind))
    none = rows.sparkSession.createDataFrame([(name, 0, []) for name in names], schema)  # for a table without rows
    parts = told.mapInArrow(partial, schema).unionByName(none)
    return parts.groupBy("rule").agg(F.sum("cases").alias("cases"), F.slice(F.array_sort(F.flatten(F.collect_list("samples"))), 1, samples).alias("samples"))


def options(taxonomy: DataFrame, observed: DataFrame) -> DataFrame:
    """Taxonomy names in their order, then other observed names by count; each once."""
    known = taxonomy.select("value", F.lit(0).alias("part"), F.col("position").cast("long").alias("place"))
    seen = observed.select("value", F.lit(1).alias("part"), (-F.col("cases")).alias("place"))
    return known.unionByName(seen).groupBy("value").agg(F.min(F.struct("part", "place")).alias("at")).orderBy("at", "value").select("value")
