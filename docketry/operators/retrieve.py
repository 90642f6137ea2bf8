"""Retrieval for questions: a validated intent, the rows it finds, and the evidence text."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip, first_filled, text_or_empty
from ..plans.case_query import KEYWORD_COLUMNS, CaseQuery, keyword_union


def _strict(value) -> str:
    text = str(value or "").strip()
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        try:
            return date.fromisoformat(text).isoformat()
        except ValueError:
            pass
    return ""


@dataclass(frozen=True)
class Intent:
    mode: str = "search"
    keywords: tuple[str, ...] = ()
    violations: tuple[str, ...] = ()
    datasets: tuple[str, ...] = ()
    date_from: str = ""
    date_to: str = ""
    limit: int = 15

    @classmethod
    def of(cls, answer: dict, known_tags: set[str], known_datasets: set[str]) -> Intent:
        """From a model's answer: repeats go, unknown tags become keywords, bad dates go, inverted ones are swapped, the limit is 1 to 40."""
        listed = lambda v: list(dict.fromkeys(t for x in (v if isinstance(v, (list, tuple)) else [v]) if (t := str(x or "").strip())))
        tags = listed(answer.get("violations"))
        words = list(dict.fromkeys([*listed(answer.get("keywords")), *[t for t in tags if t not in known_tags]]))
        first, last = _strict(answer.get("date_from")), _strict(answer.get("date_to"))
        if first and last and first > last:
            first, last = last, first
        try:
            limit = max(1, min(40, int(answer.get("limit"))))
        except (TypeError, ValueError):
            limit = 15
        mode = answer.get("mode") if answer.get("mode") in ("search", "stats") else "search"
        return cls(mode, tuple(words), tuple(t for t in tags if t in known_tags), tuple(d for d in listed(answer.get("datasets")) if d in known_datasets), first, last, limit)

    @classmethod
    def fallback(cls, question: str) -> Intent:
        return cls(keywords=(question.strip()[:30],))

    def query(self) -> CaseQuery:
        """Tags only exist on finished cases; without them pending ones count too."""
        return CaseQuery(datasets=self.datasets, statuses=("done",) if self.violations else ("done", "pending"), violations=self.violations, date_from=self.date_from, date_to=self.date_to, limit=self.limit)


@dataclass
class Found:
    rows: DataFrame
    total: DataFrame  # one row: cases before the cut
    structured: bool = field(default=False)  # statistics are of all matches, not of the cut rows


def retrieve(rows: DataFrame, intent: Intent, bridge: DataFrame | None = None, columns: tuple[str, ...] = KEYWORD_COLUMNS) -> Found:
    query = intent.query()
    scope = query.with_(limit=0).filtered(rows, bridge)
    if intent.keywords:
        merged = keyword_union(scope, list(intent.keywords), intent.limit, columns)
        hit = [CaseQuery(keyword=k, keyword_columns=columns).predicate(rows.columns) for k in intent.keywords]
        any_hit = hit[0]
        for h in hit[1:]:
            any_hit = any_hit | h
        return Found(merged, scope.filter(any_hit).select("dataset", "case_id").distinct().agg(F.count("*").alias("cases")))
    return Found(query.search(rows, bridge), query.count(rows, bridge), True)


def evidence(rows: DataFrame) -> DataFrame:
    """n, text: the numbered evidence of rows, newest first. The rows are a result cut to the intent's limit."""
    order = Window.orderBy(F.desc("date"), F.desc("case_id"))
    n = F.row_number().over(order)
    head = F.concat(F.lit("### ["), n.cast("string"), F.lit("] "), F.upper("dataset"), F.lit(" | "), F.coalesce(F.nullif(F.col("date"), F.lit("")), F.lit("—")), F.lit(" | "), F.coalesce(F.nullif(clip(F.col("title"), 80), F.lit("")), F.lit("(untitled)")))
    return rows.select(n.alias("n"), F.concat_ws("\n", head, F.concat(F.lit("- id: "), text_or_empty(F.col("case_id").cast("string")))).alias("text"))


#: Labels of the evidence's lines, the column that each shows, and its most characters (0: whole); those in ALWAYS are shown empty, too.
LINES = (("id", "case_id", 0), ("party", "party", 0), ("bureau", "bureau", 0), ("kind", "case_type", 0), ("violation", "violation_type", 120), ("measure", "punishment", 120), ("basis", "legal_basis", 160), ("fine", "penalty_amount", 0), ("ban", "market_ban", 0), ("facts", "violation_summary", 400), ("source", "source_url", 0))
ALWAYS = ("id", "party", "violation", "measure", "facts")
NOTHING = "—"
#: Tags that an overview names.
TOP_TAGS = 10


def _full_evidence(row: Column, names: list[str]) -> Column:
    """The lines of one case; row is a struct of its columns."""
    filled = lambda c, n: F.coalesce(F.nullif(clip(c, n) if n else text_or_empty(c.cast("string")), F.lit("")), F.lit(None))
    lines = []
    for label, name, n in LINES:
        if name in names:
            value = filled(row[name], n)
            lines.append(F.concat(F.lit(f"- {label}: "), F.coalesce(value, F.lit(NOTHING)) if label in ALWAYS else value))
    return F.concat_ws("\n", *lines)


def answered(rows: DataFrame, intent: Intent, tags: Column, bridge: DataFrame | None = None, columns: tuple[str, ...] = KEYWORD_COLUMNS) -> DataFrame:
    """One row with all that an answer needs: total, used_keywords, date_min, date_max, violations (tag and cases, most frequent first), ids (newest first) and evidence.

    With keywords the newest `limit` rows of each are collected in one scan, each row with a bit for every keyword that it
    holds; total and used_keywords are of the collected rows, dates and violations of the newest `limit` of these, which are the evidence too. What is
    collected is at most `limit` rows a keyword, 40 by the intent's bounds. Without keywords total, dates and violations are of all matches, by sums
    that each task makes first, and a second scan finds the newest rows. tags: an array of each row's tags.
    """
    query, names = intent.query(), list(rows.columns)
    scope = query.with_(limit=0).filtered(rows, bridge).withColumn("_tags", tags)
    party = first_filled(*[F.col(c) for c in ("punished_entity", "punished_entities", "summary_entity") if c in names])
    shown = [c for _, c, _ in LINES if c in names and c != "party"]
    held = F.struct(F.coalesce("date", F.lit("")).alias("date"), F.col("case_id"), F.col("dataset"), text_or_empty(F.col("title")).alias("title"), party.alias("party"), *[F.col(c) for c in shown if c != "case_id"], F.col("_tags").alias("tags"))
    newest = lambda found: F.slice(F.sort_array(F.collect_list(found), False), 1, intent.limit)
    keywords = [k for k in intent.keywords if k.strip()]
    if keywords:
        bits = [F.when(CaseQuery(keyword=k, keyword_columns=columns).predicate(rows.columns), F.lit(1 << i)).otherwise(F.lit(0)) for i, k in enumerate(keywords)]
        collected = keyword_union(scope.withColumn("_hits", reduce(lambda a, b: a + b, bits)), keywords, intent.limit, columns, cut=False)
        one = collected.agg(F.count("*").alias("total"), F.coalesce(F.bit_or("_hits"), F.lit(0)).alias("used"), newest(held).alias("r"))
        one = one.withColumn("all_tags", F.flatten(F.transform("r", lambda x: x["tags"]))).withColumn("dates", F.filter(F.transform("r", lambda x: x["date"]), lambda d: d != ""))
        counts = F.transform(F.array_distinct("all_tags"), lambda t: F.struct((-F.size(F.filter("all_tags", lambda x: x == t))).cast("long").alias("n"), t.alias("tag")))
        one = one.withColumns({"counts": F.slice(F.array_sort(counts), 1, TOP_TAGS), "date_min": F.array_min("dates"), "date_max": F.array_max("dates")})
    else:
        # One aggregation for the whole and for each tag: a row counts for null, the whole, and for each of its tags.
        each = scope.select(F.nullif(F.col("date"), F.lit("")).alias("date"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "_tags")).alias("tag"))
        by_tag = each.groupBy("tag").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))
        top = by_tag.withColumn("k", F.row_number().over(Window.partitionBy(F.col("tag").isNull()).orderBy(F.desc("n"), "tag"))).filter(F.col("k") <= TOP_TAGS)
        whole = lambda c: F.max(F.when(F.col("tag").isNull(), F.col(c)))
        counts = F.array_sort(F.collect_list(F.when(F.col("tag").isNotNull(), F.struct((-F.col("n")).alias("n"), "tag"))))
        overview = top.agg(F.coalesce(whole("n"), F.lit(0)).alias("total"), whole("first").alias("date_min"), whole("last").alias("date_max"), counts.alias("counts"))
        latest = scope.orderBy(F.desc_nulls_last("date"), F.desc("case_id"), F.desc("dataset")).limit(intent.limit)
        one = overview.join(latest.agg(newest(held).alias("r")), F.lit(True)).withColumn("used", F.lit(0))
    head = lambda x, i: F.concat(F.lit("### ["), (i + 1).cast("string"), F.lit("] "), F.upper(x["dataset"]), F.lit(" | "), F.coalesce(F.nullif(x["date"], F.lit("")), F.lit(NOTHING)), F.lit(" | "), F.coalesce(F.nullif(clip(x["title"], 80), F.lit("")), F.lit("(untitled)")))
    cases = F.transform("r", lambda x, i: F.concat_ws("\n", head(x, i), _full_evidence(x, ["party", *shown])))
    violations = F.transform("counts", lambda c: F.struct(c["tag"].alias("tag"), (-c["n"]).alias("cases")))
    named = F.array_join(F.transform(violations, lambda v: F.concat(v["tag"], F.lit(" ("), v["cases"].cast("string"), F.lit(")"))), ", ")
    summary = F.concat_ws("\n", F.lit("## Overview"), F.concat(F.lit("- cases: "), F.col("total").cast("string")), F.concat(F.lit("- dates: "), F.coalesce("date_min", F.lit(NOTHING)), F.lit(" to "), F.coalesce("date_max", F.lit(NOTHING))), F.when(F.size("counts") > 0, F.concat(F.lit("- violations: "), named)))
    body = F.when(F.size("r") > 0, F.array_join(cases, "\n\n")).otherwise("(no case found)")
    used = F.array_compact(F.array(*[F.when(F.col("used").bitwiseAND(1 << i) != 0, F.lit(k)) for i, k in enumerate(keywords)], F.lit(None).cast("string")))
    return one.select("total", used.alias("used_keywords"), "date_min", "date_max", violations.alias("violations"), F.transform("r", lambda x: x["case_id"]).alias("ids"), F.concat_ws("\n\n", summary, F.concat(F.lit("## Cases\n"), body)).alias("evidence"))


def parse_answer(text: str) -> dict | None:
    """The JSON object in a model's answer: a fence is stripped, then the whole and each balanced object are tried, trailing commas repaired."""
    bare = re.sub(r"^```[a-zA-Z]*\s*|\s*```$", "", (text or "").strip())
    starts = [m.start() for m in re.finditer(r"\{", bare)]
    for part in [bare, *(bare[s:] for s in starts)]:
        for attempt in (part, re.sub(r",\s*([}\]])", r"\1", part)):
            try:
                found, _ = json.JSONDecoder().raw_decode(attempt)
            except ValueError:
                continue
            if isinstance(found, dict):
                return found
    return None
