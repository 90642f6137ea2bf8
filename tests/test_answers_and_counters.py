"""Answers from collected rows, and counters with samples."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docketry.operators import retrieve, state, stats

ROWS = "dataset string, case_id string, status string, date string, title string, punished_entity string, violation_type string, source_url string"


def rows(spark):
    made = [("en", str(i), "done" if i % 4 else "pending", f"2024-01-{1 + i:02d}" if i % 5 else "", f"Case {i} of {'alpha' if i % 2 else 'beta'}", "", "x、y" if i % 3 else "x", "") for i in range(20)]
    return spark.createDataFrame([*made, ("de", "99", "skipped", "2024-01-30", "alpha", "", "x", "")], ROWS)


TAGS = lambda: F.split("violation_type", "、")


def test_keywords_collect_the_newest_of_each(spark):
    got = retrieve.answered(rows(spark), retrieve.Intent(keywords=("alpha", "case 1", "absent", " "), limit=3), TAGS()).first()
    # alpha: 19, 17, 13 (15 has no date and comes last); case 1: 19, 18, 17
    assert got.ids == ["19", "18", "17"] and got.total == 4 and got.used_keywords == ["alpha", "case 1"]
    assert (got.date_min, got.date_max) == ("2024-01-18", "2024-01-20")
    assert [(v.tag, v.cases) for v in got.violations] == [("x", 3), ("y", 2)]
    assert got.evidence.startswith("## Overview\n- cases: 4\n- dates: 2024-01-18 to 2024-01-20\n- violations: x (3), y (2)\n\n## Cases\n### [1] EN | 2024-01-20 | Case 19 of alpha\n- id: 19\n- party: —")
    assert "- source" not in got.evidence


def test_structure_counts_all_matches(spark):
    got = retrieve.answered(rows(spark), retrieve.Intent(datasets=("en",), limit=2), TAGS()).first()
    assert (got.total, got.date_min, got.date_max, got.ids, got.used_keywords) == (20, "2024-01-02", "2024-01-20", ["19", "18"], [])
    assert [(v.tag, v.cases) for v in got.violations] == [("x", 20), ("y", 13)]


def test_nothing_found(spark):
    for intent in (retrieve.Intent(keywords=("absent",)), retrieve.Intent(datasets=("fr",))):
        got = retrieve.answered(rows(spark), intent, TAGS()).first()
        assert got.total == 0 and got.ids == [] and got.violations == [] and got.evidence.endswith("(no case found)")


def test_keywords_read_the_rows_once(spark, tmp_path):
    rows(spark).write.parquet(str(tmp_path / "rows"))
    df = retrieve.answered(spark.read.parquet(str(tmp_path / "rows")), retrieve.Intent(keywords=("alpha", "beta"), limit=5), TAGS())
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_counters_of_rules_without_a_hit_and_many_keys(spark):
    df = spark.range(1000).selectExpr("IF(id % 10 = 9, NULL, id) AS id", "id AS n", "CAST(id AS STRING) AS s").repartition(7)
    rules = {"all": F.lit(True), "none": F.lit(False), "null": F.lit(None).cast("boolean"), "high": F.col("n") >= 995}
    got = {r.rule: (r.cases, r.samples) for r in stats.quality_counters(df, rules, "id", 4).collect()}
    assert got == {"all": (1000, [0, 1, 2, 3]), "none": (0, []), "null": (0, []), "high": (5, [995, 996, 997, 998])}
    text = {r.rule: r.samples for r in stats.quality_counters(df, {"all": F.lit(True)}, "s", 3).collect()}
    assert text == {"all": ["0", "1", "10"]}
    assert [(r.cases, r.samples) for r in stats.quality_counters(df.limit(0), {"all": F.lit(True)}, "id").collect()] == [(0, [])]


def analysed(spark, made, limit=2):
    rows = spark.createDataFrame(made, "case_id string, kind string, tags array<string>, date string, note string")
    metrics = {
        "tag": stats.Metric(F.col("tags"), n=limit), "all_tags": stats.Metric(F.col("tags")), "by_kind": stats.Metric(F.col("tags"), F.array("kind"), n=1),
        "longest": stats.Metric(F.array("case_id"), F.col("tags"), n=1, by=F.concat(F.lpad(F.length("note"), 5, "0"), F.col("case_id"))),
    }
    return stats.bundle(rows, metrics, F.col("kind") == "org", F.col("kind") == "person")


MADE = [("1", "org", ["a", "b"], "2024-01-02", "xx"), ("2", "person", ["b"], "", "xxx"), ("3", None, ["c", None], "2023-05-06", None), ("4", "org", [], "2022-01-01", "x"), ("5", "org", None, None, "x"), ("6", "org", ["a"], "2024-02-02", "xx")]


def test_bundle_has_all_tables(spark):
    got = {(r.metric, r.kind, r["rank"], r.value): (r.cases, r.orgs, r.persons, r["first"], r["last"]) for r in analysed(spark, MADE).collect()}
    assert got == {
        ("tag", "", 1, "a"): (2, 2, 0, "2024-01-02", "2024-02-02"), ("tag", "", 2, "b"): (2, 1, 1, "2024-01-02", "2024-01-02"),
        ("all_tags", "", None, "a"): (2, 2, 0, "2024-01-02", "2024-02-02"), ("all_tags", "", None, "b"): (2, 1, 1, "2024-01-02", "2024-01-02"), ("all_tags", "", None, "c"): (1, 0, 0, "2023-05-06", "2023-05-06"),
        ("by_kind", "org", 1, "a"): (2, 2, 0, "2024-01-02", "2024-02-02"), ("by_kind", "person", 1, "b"): (1, 0, 1, None, None),
        ("longest", "a", 1, "6"): (1, 1, 0, "2024-02-02", "2024-02-02"), ("longest", "b", 1, "2"): (1, 0, 1, None, None), ("longest", "c", 1, "3"): (1, 0, 0, "2023-05-06", "2023-05-06"),
    }
    assert analysed(spark, MADE[:0]).count() == 0


def test_bundle_reads_rows_once_and_ranks_in_tasks_first(spark, tmp_path):
    spark.createDataFrame(MADE, "case_id string, kind string, tags array<string>, date string, note string").write.parquet(str(tmp_path / "m"))
    rows = spark.read.parquet(str(tmp_path / "m"))
    df = stats.bundle(rows, {"tag": stats.Metric(F.col("tags"), n=2), "all": stats.Metric(F.col("tags"))}, F.lit(True), F.lit(False))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2 and plan.count("WindowGroupLimit") >= 1 and "SortAggregate" not in plan
    assert plan.index("WindowGroupLimit") < plan.index("HashAggregate")  # printed from the result down


def test_payloads_are_whole_or_an_error(spark):
    bundled = analysed(spark, MADE)
    got = {r.metric: (r["items"], json.loads(r.payload)) for r in stats.bundle_json(bundled).collect()}
    assert {m: n for m, (n, _) in got.items()} == {"tag": 2, "all_tags": 3, "by_kind": 2, "longest": 3}
    assert [(x["value"], x["rank"], x["cases"]) for x in got["tag"][1]] == [("a", 1, 2), ("b", 2, 2)]
    with pytest.raises(Exception, match="too many rows for a payload"):
        stats.bundle_json(bundled, 2).collect()
    with pytest.raises(ValueError, match="no metric has a limit"):
        stats.bundle(spark.range(1), {"x": stats.Metric(F.array("id"))}, F.lit(True), F.lit(True))


def test_progress_is_one_join(spark):
    tasks = spark.createDataFrame([("a", 1, "running"), ("b", 2, "pending"), ("c", None, None)], "id string, processed int, status string")
    changes = spark.createDataFrame([("a", 5, None), ("a", 7, None), ("c", None, "done"), ("d", 1, "done")], "id string, processed int, status string")
    df = state.progress(tasks, changes)
    assert sorted(tuple(r) for r in df.collect()) == [("a", 7, "running"), ("b", 2, "pending"), ("c", None, "done")]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert state.progress(tasks, changes.select("id")).count() == 3
