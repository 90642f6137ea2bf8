"""The declarative case query: an immutable filter spec that compiles to DataFrame operations."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that results may be ordered by; an unknown one falls back to the date.
SORTABLE = ("date", "title", "bureau", "status", "case_type", "case_id", "dataset")
#: Columns that counts may be grouped by; an unknown one is an error.
GROUPABLE = ("dataset", "status", "case_type", "bureau", "entity_type", "category", "date", "source_type")
#: Columns of the summary side: only queries that use one need its join.
SUMMARY_COLUMNS = ("entity_type", "summary_entity", "violation_summary", "involved_fund")
#: Columns that a keyword is looked for in, where the rows have them; bodies are none.
KEYWORD_COLUMNS = ("title", "punished_entities", "punished_entity", "case_id", "document_number", "violation_summary", "involved_fund")
#: What is shown when no status is chosen.
DEFAULT_STATUSES = ("done", "pending")


@dataclass(frozen=True)
class CaseQuery:
    datasets: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    case_types: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    bureaus: tuple[str, ...] = ()
    entity_types: tuple[str, ...] = ()
    violations: tuple[str, ...] = ()
    date_from: str = ""
    date_to: str = ""
    fund_only: bool = False
    keyword: str = ""
    keyword_columns: tuple[str, ...] = KEYWORD_COLUMNS
    order_by: str = "date"
    descending: bool = True
    limit: int = 0
    offset: int = 0

    def with_(self, **changes) -> CaseQuery:
        return replace(self, **changes)

    def in_default_scope(self) -> CaseQuery:
        return self if self.statuses else self.with_(statuses=DEFAULT_STATUSES)

    def for_trend(self, floor: str) -> CaseQuery:
        """Trends ignore the chosen dates but for a floor."""
        return self.with_(date_from=floor, date_to="")

    def needs_summary(self, derived: tuple[str, ...] = ()) -> bool:
        """Whether a column of the summary side is used; `derived` names columns of the case side that the view takes from there."""
        used = {"entity_type"} if self.entity_types else set()
        used |= {"status"} if self.statuses else set()
        used |= set(self.keyword_columns) if self.keyword.strip() else set()
        return bool(used & {*SUMMARY_COLUMNS, *derived})

    def predicate(self, columns: list[str] | None = None) -> Column:
        """The conjunction of all filters; an empty one restricts nothing. Rows without a date pass the date bounds.

        A keyword is looked for in those of its columns that the rows have, if `columns` names these.
        """
        sets = {"dataset": self.datasets, "status": self.statuses, "case_type": self.case_types, "category": self.categories, "bureau": self.bureaus, "entity_type": self.entity_types}
        parts = [F.col(c).isin(*v) for c, v in sets.items() if v]
        if self.date_from:
            parts.append((F.col("date") == "") | (F.col("date") >= self.date_from))
        if self.date_to:
            parts.append((F.col("date") == "") | (F.col("date") <= self.date_to))
        if self.fund_only:
            parts.append(F.col("is_fund_related"))
        if word := self.keyword.strip().lower():
            looked_in = [c for c in self.keyword_columns if columns is None or c in columns]
            parts.append(reduce(or_, [F.coalesce(F.lower(F.col(c).cast("string")).contains(word), F.lit(False)) for c in looked_in], F.lit(False)))
        return reduce(and_, parts, F.lit(True))

    def filtered(self, rows: DataFrame, bridge: DataFrame | None = None) -> DataFrame:
        """Matching rows, unordered. Violations are any-of on the bridge (dataset, case_id, violation) by a semi-join; without a bridge they are an error."""
        rows = rows.filter(self.predicate(rows.columns))
        if self.violations:
            if bridge is None:
                raise ValueError("a filter on violations needs the bridge")
            chosen = bridge.filter(F.col("violation").isin(*self.violations))
            rows = rows.join(chosen, ["dataset", "case_id"], "left_semi")
        return rows

    def search(self, rows: DataFrame, bridge: DataFrame | None = None) -> DataFrame:
        """Matching rows in order (ties by case_id in the same direction), cut to the page."""
        column = self.order_by if self.order_by in SORTABLE else "date"
        by = [F.desc(column), F.desc("case_id")] if self.descending else [F.asc(column), F.asc("case_id")]
        found = self.filtered(rows, bridge).orderBy(*by)
        if self.limit > 0:
            found = found.offset(max(0, self.offset)).limit(self.limit)
        return found

    def count(self, rows: DataFrame, bridge: DataFrame | None = None) -> DataFrame:
        """Number of matching rows, whatever the page."""
        return self.filtered(rows, bridge).agg(F.count("*").alias("cases"))

    def aggregate(self, rows: DataFrame, dimension: str, bridge: DataFrame | None = None) -> DataFrame:
        """Cases by value of a dimension; null and empty values are one group."""
        if dimension not in GROUPABLE:
            raise ValueError(f"can't group by {dimension!r}")
        counts = self.filtered(rows, bridge).groupBy(F.coalesce(F.col(dimension), F.lit("")).alias("value")).agg(F.count("*").alias("cases"))
        return counts.orderBy(F.desc("cases"), F.asc("value"))


def page_of(page: int, total: int, size: int = 20) -> tuple[int, int]:
    """(page, offset), the page clamped to those that exist."""
    last = max(1, -(-total // size))
    page = min(max(1, page), last)
    return page, (page - 1) * size


def keyword_union(rows: DataFrame, keywords: list[str], limit: int, columns: tuple[str, ...] = KEYWORD_COLUMNS, keys: tuple[str, ...] = ("dataset", "case_id"), cut: bool = True) -> DataFrame:
    """Rows that match any keyword, the newest `limit` of each, without repeats, newest first, cut to `limit` again; one scan for all keywords.

    Without cut all of these come, in no order: at most `limit` for each keyword.
    """
    newest = [F.desc("date"), *[F.desc(k) for k in reversed(keys)]]
    words = [k for k in keywords if k.strip()]
    if not words:
        return rows.limit(0)
    said = [F.when(CaseQuery(keyword=k, keyword_columns=columns).predicate(rows.columns), F.lit(i)) for i, k in enumerate(words)]
    hits = rows.withColumn("_keyword", F.explode(F.array_compact(F.array(*said))))
    first = hits.withColumn("_n", F.row_number().over(Window.partitionBy("_keyword").orderBy(*newest))).filter(F.col("_n") <= limit)
    union = first.drop("_keyword", "_n").dropDuplicates(list(keys))
    return union.orderBy(*newest).limit(limit) if cut else union
