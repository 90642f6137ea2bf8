"""Queries over the full view of cases, with the SQL that each must agree with.

What operators should find in the made-up names and titles is stated in the SQL by the row's number, not worked out again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import query, read
from .functions import entities, html, taxonomy, text
from .operators import merge, repair, state, stats
from .plans.case_query import CaseQuery
from .plans.report import typical
from .schemas import FULL_CASES_SQL, full_cases

WORDS = entities.Lexicon(
    measures=("is fined", "is warned", "was barred"),
    sentence_marks=("it was found",),
    org_suffixes=("Ltd", "Bank", "Fund", "LLC"),
    party_prefixes=("Party:",),
    title_forms=(("Removal of", "from the register"),),
    org_types=(("Bank", "bank"), ("Fund", "fund"), ("Ltd", "company")),
)
TAGS = [taxonomy.Tag("late filing", ("overdue",), {"en": "Late"}), taxonomy.Tag("unclear fees", ("fees",)), taxonomy.Tag("forgery", ("forged",)), taxonomy.Tag("other", whole=True)]
FIRST = "en"

#: For the comparison: the tags of each field, and what titles and bodies say.
TAG_ROWS = """t(raw, tag, k) AS (VALUES ('overdue report、unclear fees', 'late filing', 1), ('overdue report、unclear fees', 'unclear fees', 2), ('late filing；forged ledger', 'late filing', 1),
 ('late filing；forged ledger', 'forgery', 2), ('late filing: overdue report', 'late filing', 1), ('other', 'other', 1))"""
BRIDGE = "b AS (SELECT dataset, case_id, tag AS violation FROM f JOIN t ON violation_type = raw)"
TITLED = "CASE number % 6 WHEN 0 THEN 'Alpha Trading Ltd' WHEN 1 THEN 'John Smith' WHEN 2 THEN 'Beta Bank' WHEN 3 THEN 'Gamma Fund' WHEN 4 THEN 'Delta LLC' ELSE '' END"
IN_BODY = "CASE WHEN number % 17 IN (0, 1) THEN '' ELSE 'Epsilon Capital Ltd' END"
SIGNED = "CASE WHEN number % 17 IN (0, 1) OR number % 13 = 12 THEN '' ELSE '2021-' || lpad(CAST(1 + number % 13 AS VARCHAR), 2, '0') || '-05' END"
TRUTH = f"coalesce(nullif({TITLED}, ''), {IN_BODY})"


def on_full(name: str, sql: str) -> Callable:
    """A query over the full view; in its SQL f is the view, t the tags of each field, b the bridge."""
    whole = f"WITH f AS ({FULL_CASES_SQL.format(documents='documents')}), {TAG_ROWS}, {BRIDGE} {sql.strip()}"

    def register(work: Callable[[DataFrame], DataFrame]):
        return query(name, None if not sql else whole)(lambda spark, sf_dir: work(full_cases(spark, sf_dir)))

    return register


def bridge_of(f: DataFrame) -> DataFrame:
    return stats.bridge(f, taxonomy.canonical(F.col("violation_type"), TAGS))


KEY = ["dataset", "case_id"]
bodies = lambda f: f.filter("raw_text <> ''").select(*KEY, "raw_text")
summaries = lambda f: f.filter("has_summary").select(*KEY, "entity_type", "violation_type", "punishment")

# --- reads


@on_full("case_body_or_empty", "SELECT dataset, case_id, title, raw_text FROM f")
def _(f):
    return state.with_bodies(f.select(*KEY, "title"), bodies(f))


@on_full("id_list_ordered", "SELECT case_id, row_number() OVER (ORDER BY case_id) AS n FROM f WHERE dataset = 'en' AND status IN ('done', 'failed') ORDER BY case_id")
def _(f):
    ids = CaseQuery(datasets=("en",), statuses=("done", "failed"), order_by="case_id", descending=False).search(f).select("case_id")
    return ids.withColumn("n", F.row_number().over(Window.orderBy("case_id")).cast("long"))


@on_full("summaries_of_many", "SELECT dataset, case_id, punishment FROM f WHERE has_summary AND number % 3 = 0")
def _(f):
    return state.lookup(summaries(f), f.filter("number % 3 = 0").union(f.filter("number % 6 = 0"))).select(*KEY, "punishment")


@on_full("summary_exists", 'SELECT dataset, case_id, has_summary AS "exists" FROM f')
def _(f):
    return state.existing(summaries(f), f)


def _tasks(f: DataFrame) -> DataFrame:
    return f.select(F.col("case_id").alias("id"), F.col("source_type").alias("kind"), F.when(F.col("status") == "skipped", "running").otherwise(F.col("status")).alias("status"), F.col("date").alias("created_at"), F.col("number").alias("seq"), (F.col("number") % 50).alias("processed"), F.lit(None).cast("string").alias("finished_at"))


TASKS = "(SELECT case_id AS id, source_type AS kind, CASE WHEN status = 'skipped' THEN 'running' ELSE status END AS status, date AS created_at, number AS seq, number % 50 AS processed FROM f)"


@on_full("tasks_listed", f"SELECT id, status FROM {TASKS} WHERE kind = 'pdf' AND status IN ('done', 'failed') ORDER BY created_at DESC, seq DESC LIMIT 30")
def _(f):
    return state.tasks(_tasks(f), ("pdf",), ("done", "failed"), 30).select("id", "status")


@on_full("tasks_running", f"SELECT kind, count(*) AS tasks FROM {TASKS} WHERE status IN ('pending', 'running') GROUP BY 1")
def _(f):
    return state.running(_tasks(f))


@query("log_tail_ordered", "SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS lines FROM conversations WHERE turn >= 2 ORDER BY conv_id, turn")
def _(spark, sf):
    log = read(spark, sf, "conversations").select(F.col("conv_id").alias("task_id"), F.col("turn").alias("seq"))
    tail = state.log_tail(log, 2).withColumn("lines", F.count("*").over(Window.partitionBy("task_id")))
    return tail.select(F.col("task_id").alias("conv_id"), F.col("seq").alias("turn"), "lines")


@query("key_value", "SELECT (SELECT n_name FROM nation WHERE n_nationkey = 3) AS known, 'none' AS unknown")
def _(spark, sf):
    pairs = read(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))
    return state.get(pairs, "3").withColumnRenamed("value", "known").crossJoin(state.get(pairs, "x", "none").withColumnRenamed("value", "unknown"))  # one row each


@query("key_value_put", "SELECT CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_nationkey < 5 THEN 'new' ELSE n_name END AS value FROM nation UNION ALL SELECT 'x', 'new'")
def _(spark, sf):
    pairs = read(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))
    return state.put(pairs, spark.createDataFrame([(k, "new") for k in ("0", "1", "2", "3", "4", "x")], "key string, value string"))


for _column in ("punishment", "punishment_date", "summary_entity"):
    on_full(f"missing_{_column}", f"SELECT dataset, case_id FROM f WHERE trim(coalesce({_column}, '')) = ''")(lambda f, c=_column: repair.missing(f, c))


@on_full("entities_present", "SELECT dataset, case_id FROM f WHERE trim(coalesce(summary_entity, '')) <> ''")
def _(f):
    return repair.missing(f, "summary_entity", present=True)


# --- predicates and projections


@on_full("filter_category", "SELECT case_id FROM f WHERE category IN ('trade', 'person')")
def _(f):
    return CaseQuery(categories=("trade", "person")).filtered(f).select("case_id")


@on_full("filter_violations", "SELECT case_id FROM f WHERE case_id IN (SELECT case_id FROM b WHERE violation IN ('forgery', 'unclear fees')) AND status = 'done'")
def _(f):
    return CaseQuery(violations=("forgery", "unclear fees"), statuses=("done",)).filtered(f, bridge_of(f)).select("case_id")


@on_full("filter_keyword_everywhere", "SELECT case_id FROM f WHERE " + " OR ".join(f"contains(lower(coalesce({c}, '')), 'bank')" for c in ("title", "punished_entities", "punished_entity", "case_id", "document_number", "violation_summary", "involved_fund")))
def _(f):
    return CaseQuery(keyword="BANK").filtered(f).select("case_id")


@on_full("filter_derived", "SELECT case_id FROM f WHERE dataset IN ('de', 'es') AND (date = '' OR date >= '2018-01-01')")
def _(f):
    return CaseQuery(datasets=("fr",), date_to="2019-01-01").with_(datasets=("de", "es")).for_trend("2018-01-01").filtered(f).select("case_id")


@on_full("title_relevance_of_words", "SELECT case_id, CASE WHEN number % 6 IN (2, 3) THEN true WHEN number % 6 IN (4, 5) THEN false END AS relevant FROM f")
def _(f):
    return f.select("case_id", repair.title_relevance(F.col("title"), ("Bank", "Fund"), ("Removal", "news")).alias("relevant"))


@on_full("list_urls", "SELECT case_id, number % 7 = 5 AS is_list FROM f")
def _(f):
    return f.select("case_id", text.is_list_url(F.col("source_url")).alias("is_list"))


@on_full("attachments_alone", "SELECT case_id, number % 17 = 1 AND NOT number % 17 = 0 AS alone FROM f WHERE number % 17 IN (0, 1)")
def _(f):
    return f.filter("number % 17 in (0, 1)").select("case_id", text.attachment_only(F.col("raw_text")).alias("alone"))


@on_full("garbage_texts", "SELECT case_id, number % 2 = 0 AS garbage FROM f")
def _(f):
    bad = F.when(F.col("number") % 2 == 0, F.concat(F.repeat(F.lit("\x01\x02"), 60), F.col("title"))).otherwise(F.col("title"))
    return f.select("case_id", text.is_garbage(bad).alias("garbage"))


#: What a table of cases shows: column and its source, blanks as a dash.
SHOWN = {"day": "date", "party": "punished_entity", "office": "bureau", "kind": "case_type", "punished": "punishment", "number": "document_number"}


@on_full("display_of_seven", "SELECT case_id, " + ", ".join(f"coalesce(nullif({c}, ''), '—') AS {n}" for n, c in SHOWN.items()) + ", coalesce((SELECT string_agg(tag, '、' ORDER BY k) FROM t WHERE raw = violation_type), '—') AS violations FROM f")
def _(f):
    shown = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("—"))
    return f.select("case_id", *[shown(F.col(c)).alias(n) for n, c in SHOWN.items()], shown(F.array_join(taxonomy.canonical(F.col("violation_type"), TAGS), "、")).alias("violations"))


@on_full("labelled_row", "SELECT case_id, coalesce((SELECT string_agg(CASE WHEN tag = 'late filing' AND dataset = 'en' THEN 'Late' ELSE tag END, '、' ORDER BY k) FROM t WHERE raw = violation_type), '') AS labels FROM f")
def _(f):
    return f.select("case_id", taxonomy.tags_text(taxonomy.canonical(F.col("violation_type"), TAGS), F.col("dataset"), TAGS).alias("labels"))


@on_full("advice_given", "SELECT case_id, CASE WHEN number % 10 = 3 THEN 'ask' WHEN number % 7 IN (1, 2, 3) THEN 'file in time' WHEN number % 7 = 4 THEN 'see the text' ELSE 'ask' END AS advice FROM f")
def _(f):
    return f.select("case_id", taxonomy.advice(F.col("violation_type"), TAGS, {"late filing": "file in time", "other": "see the text"}, "ask").alias("advice"))


@on_full("raw_tags_kept", "SELECT case_id, CASE WHEN number % 10 = 3 OR number % 7 = 0 THEN 'unclassified' WHEN number % 7 IN (5, 6) THEN 'another matter' ELSE (SELECT string_agg(tag, '、' ORDER BY k) FROM t WHERE raw = violation_type) END AS tags FROM f")
def _(f):
    return f.select("case_id", F.array_join(taxonomy.normalise(F.col("violation_type"), TAGS), "、").alias("tags"))


# --- joins


@on_full("bridge_with_cases_and_summaries", "SELECT b.dataset, b.case_id, violation, title, punishment FROM b JOIN f USING (dataset, case_id)")
def _(f):
    return stats.bridge_rows(bridge_of(f), f.select(*KEY, "title"), summaries(f)).select(*KEY, "violation", "title", "punishment")


@query("customers_without_large_orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(spark, sf):
    large = read(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return merge.delete(read(spark, sf, "customer").select("c_custkey"), large, ("c_custkey",))


TYPED = "CASE number % 5 WHEN 0 THEN 'Nobody' WHEN 1 THEN 'Beta Bank' WHEN 2 THEN 'Gamma Fund' WHEN 3 THEN 'Alpha Ltd' ELSE 'Omega' END"


@on_full("organisation_types", f"SELECT case_id, CASE number % 5 WHEN 1 THEN 'lender' WHEN 2 THEN 'fund' WHEN 3 THEN 'company' WHEN 4 THEN 'answered' ELSE CASE WHEN number % 17 IN (0, 1) THEN '' ELSE 'company' END END AS org_type, CASE number % 5 WHEN 1 THEN 'cache' WHEN 2 THEN 'name' WHEN 3 THEN 'name' WHEN 4 THEN 'answer' ELSE CASE WHEN number % 17 IN (0, 1) THEN 'unresolved' ELSE 'text' END END AS source FROM f WHERE number >= 0")
def _(f):
    spark = f.sparkSession
    known = spark.createDataFrame([("Beta Bank", "lender"), ("Beta Bank", "lender")], "name string, org_type string")
    answers = spark.createDataFrame([("Omega", "answered")], "name string, org_type string")
    names = f.select("case_id", F.expr(TYPED.replace("VARCHAR", "STRING")).alias("name"), F.substring("raw_text", 1, 27).alias("text"))
    return repair.resolve_types(names, known, WORDS, answers).select("case_id", "org_type", "source")


@on_full("known_links_marked", "SELECT case_id, number % 4 = 0 AS known FROM f")
def _(f):
    return state.known_links(f.select("case_id"), f.filter("number % 4 = 0").union(f.filter("number % 8 = 0")))


@on_full("page_was_seen", "SELECT true AS known")
def _(f):
    return state.page_is_known(f.filter("number % 4 = 0").select(F.col("source_url").alias("link_url")), f.select(F.col("source_url").alias("link_url")))


# --- aggregates

for _dim in ("dataset", "status", "case_type", "bureau", "entity_type", "category", "date", "source_type"):
    on_full(f"counts_by_{_dim}", f"SELECT coalesce({_dim}, '') AS value, count(*) AS cases FROM f GROUP BY 1 ORDER BY cases DESC, value")(lambda f, d=_dim: CaseQuery().aggregate(f, d))


@on_full("totals_with_bodies", "SELECT dataset || '.' || status AS key, count(*) AS cases FROM f GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM f UNION ALL SELECT 'bodies', count(*) FROM f WHERE raw_text <> ''")
def _(f):
    return stats.body_totals(f, bodies(f))


@on_full("violation_distribution", "SELECT violation AS value, count(*) AS cases FROM b WHERE case_id IN (SELECT case_id FROM f WHERE status = 'done') GROUP BY 1 ORDER BY cases DESC, value")
def _(f):
    return stats.tag_distribution(bridge_of(f), f.filter("status = 'done'"))


@on_full("violation_options", "SELECT violation AS value, count(*) AS cases FROM b GROUP BY 1 ORDER BY cases DESC, value LIMIT 2")
def _(f):
    return stats.tag_distribution(bridge_of(f), f, 2)


@on_full("summary_counts", "SELECT dataset AS key, count(*) AS cases FROM f WHERE has_summary GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM f WHERE has_summary")
def _(f):
    return stats.overview(summaries(f), ["dataset"]).select(F.when(F.col("dimension") == "total", "total").otherwise(F.col("value")).alias("key"), "cases")


@on_full("basic_with_histogram", "SELECT 'status.' || status AS key, count(*) AS cases FROM f GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM f UNION ALL SELECT 'org', count(*) FROM f WHERE entity_type = 'org' UNION ALL SELECT 'person', count(*) FROM f WHERE entity_type = 'person'")
def _(f):
    flags = F.array(F.concat(F.lit("status."), "status"), F.lit("total"), F.when(F.col("entity_type").isin("org", "person"), F.col("entity_type")))
    return stats.analysis(f, {"all": flags}).select(F.col("value").alias("key"), "cases")


@on_full("punishment_statistics", "SELECT 'exact' AS metric, coalesce(nullif(punishment, ''), 'none') AS value, count(*) AS cases FROM f GROUP BY 2 UNION ALL SELECT 'coarse', CASE WHEN number % 10 = 3 THEN 'other' WHEN number % 6 = 1 THEN 'money' WHEN number % 6 = 2 THEN 'ban' ELSE 'other' END, count(*) FROM f GROUP BY 2")
def _(f):
    coarse = taxonomy.category(F.col("punishment"), [("money", ("fined",)), ("ban", ("barred", "ban"))])
    return stats.analysis(f, {"exact": F.array(F.coalesce(F.nullif("punishment", F.lit("")), F.lit("none"))), "coarse": F.array(coarse)}).drop("rank")


@on_full("law_citations", "SELECT value, sum(cases) AS cases FROM (SELECT 'Securities Act' AS value, count(*) AS cases FROM f WHERE has_summary AND number % 4 = 0 UNION ALL SELECT unnest(['Fund Act', 'local rules']), count(*) FROM f WHERE has_summary AND number % 4 = 1) WHERE cases > 0 GROUP BY 1 ORDER BY cases DESC, value LIMIT 20")
def _(f):
    return stats.ranked(stats.citations(f, F.col("legal_basis")), 20)


@on_full("violations_by_kind", "SELECT entity_type, value, cases, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY cases DESC, value) AS rank FROM (SELECT entity_type, violation AS value, count(*) AS cases FROM f JOIN b USING (dataset, case_id) WHERE entity_type <> '' GROUP BY 1, 2)) WHERE rank <= 10")
def _(f):
    return stats.by_kind(f, taxonomy.canonical(F.col("violation_type"), TAGS), 10)


@on_full("punishments_by_kind", "SELECT entity_type, value, cases, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY cases DESC, value) AS rank FROM (SELECT entity_type, punishment AS value, count(*) AS cases FROM f WHERE entity_type <> '' AND punishment <> '' GROUP BY 1, 2)) WHERE rank <= 5")
def _(f):
    return stats.by_kind(f, F.array("punishment"), 5)


@on_full("mentions_of_raw_tags", "SELECT value, count(*) AS cases FROM (SELECT tag AS value FROM f JOIN t ON violation_type = raw UNION ALL SELECT 'another matter' FROM f WHERE violation_type = 'another matter' UNION ALL SELECT 'unclassified' FROM f WHERE coalesce(violation_type, '') = '') GROUP BY 1")
def _(f):
    return stats.tag_counts(f, taxonomy.normalise(F.col("violation_type"), TAGS))


@on_full("parties_by_kind_of_text", "SELECT is_dirty, is_person, is_org, count(*) AS cases FROM (SELECT number % 5 IN (1, 2) AS is_dirty, number % 5 = 3 AS is_person, number % 5 = 4 AS is_org FROM f) GROUP BY 1, 2, 3")
def _(f):
    one = F.col("punished_entity")
    kinds = f.select(entities.is_dirty(one, WORDS).alias("is_dirty"), entities.is_person(one, WORDS).alias("is_person"), entities.is_organisation(one, WORDS).alias("is_org"))
    return kinds.groupBy("is_dirty", "is_person", "is_org").agg(F.count("*").alias("cases"))


_METRICS = {c: f"coalesce({c}, '')" for c in ("dataset", "status", "category", "entity_type", "case_type", "org_type", "source_type", "punishment")} | {"bureau": "nullif(bureau, '')", "year": "nullif(substr(date, 1, 4), '')", "month": "nullif(substr(date, 1, 7), '')"}
_BUNDLE = " UNION ALL ".join(f"SELECT '{m}' AS metric, {c} AS value, count(*) AS cases FROM f WHERE {c} IS NOT NULL GROUP BY 2" for m, c in _METRICS.items())


def _bundle(f: DataFrame, more: dict | None = None) -> DataFrame:
    return stats.analysis(f, {m: F.array(F.expr(c)) for m, c in _METRICS.items()} | (more or {}), {"bureau": 15})


@on_full("overview_of_eleven_metrics", f"SELECT metric, value, cases, rank FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY cases DESC, value) AS rank FROM ({_BUNDLE})) WHERE metric <> 'bureau' OR rank <= 15")
def _(f):
    return _bundle(f)


@on_full("full_analysis", f"SELECT metric, value, cases, rank FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY cases DESC, value) AS rank FROM ({_BUNDLE} UNION ALL SELECT 'violation', violation, count(*) FROM b JOIN f USING (dataset, case_id) WHERE true GROUP BY 2)) WHERE metric <> 'bureau' OR rank <= 15")
def _(f):
    return _bundle(f, {"violation": taxonomy.canonical(F.col("violation_type"), TAGS)})


#: All parts of the analysis in SQL: what a row counts for, then the counts, then the first of each.
_PARTS = """, laws(raw, law) AS (VALUES ('《Securities Act》第一条、第二条', 'Securities Act'), ('《Fund Act》；local rules', 'Fund Act'), ('《Fund Act》；local rules', 'local rules')
), long(metric, kind, value, date, entity_type, k1, k2, k3) AS (
    SELECT 'total', '', '', date, entity_type, 0, '', '' FROM f UNION ALL SELECT 'dataset', '', dataset, date, entity_type, 0, '', '' FROM f UNION ALL SELECT 'status', '', status, date, entity_type, 0, '', '' FROM f
    UNION ALL SELECT 'bureau', '', bureau, date, entity_type, 0, '', '' FROM f WHERE bureau <> '' UNION ALL SELECT 'month', '', date[1:7], date, entity_type, 0, '', '' FROM f WHERE date <> '' UNION ALL SELECT 'year', '', date[1:4], date, entity_type, 0, '', '' FROM f WHERE date <> ''
    UNION ALL SELECT 'violation', '', tag, date, entity_type, 0, '', '' FROM f JOIN t ON violation_type = raw UNION ALL SELECT 'violation_by_kind', entity_type, tag, date, entity_type, 0, '', '' FROM f JOIN t ON violation_type = raw WHERE entity_type <> ''
    UNION ALL SELECT 'punishment', '', punishment, date, entity_type, 0, '', '' FROM f WHERE punishment <> '' UNION ALL SELECT 'punishment_by_kind', entity_type, punishment, date, entity_type, 0, '', '' FROM f WHERE punishment <> '' AND entity_type <> ''
    UNION ALL SELECT 'category', '', CASE punishment WHEN 'fined 5000' THEN 'money' WHEN 'barred for a year' THEN 'ban' ELSE 'other' END, date, entity_type, 0, '', '' FROM f
    UNION ALL SELECT 'law', '', law, date, entity_type, 0, '', '' FROM f JOIN laws ON legal_basis = laws.raw UNION ALL SELECT 'typical', tag, case_id, date, entity_type, length(violation_summary), date, case_id FROM f JOIN t ON violation_type = raw
), counted AS (
    SELECT metric, kind, value, count(*) AS cases, count(*) FILTER (entity_type = 'org') AS orgs, count(*) FILTER (entity_type = 'person') AS persons, min(nullif(date, '')) AS first, max(nullif(date, '')) AS last,
        row_number() OVER (PARTITION BY metric, kind ORDER BY max(k1) DESC, max(k2) DESC, max(k3) DESC, count(*) DESC, value) AS rank FROM long GROUP BY metric, kind, value
), bundled AS (
    SELECT * REPLACE (CASE WHEN metric IN ('bureau', 'violation_by_kind', 'punishment', 'punishment_by_kind', 'law', 'typical') THEN rank END AS rank) FROM counted
    WHERE NOT (metric = 'bureau' AND rank > 3) AND NOT (metric IN ('punishment', 'punishment_by_kind', 'law', 'typical') AND rank > 2) AND NOT (metric = 'violation_by_kind' AND rank > 4))"""


def _bundled(f: DataFrame) -> DataFrame:
    tags, kind = taxonomy.canonical(F.col("violation_type"), TAGS), F.array(F.nullif(F.col("entity_type"), F.lit("")))
    filled = lambda c: F.array(F.nullif(c, F.lit("")))
    longest = F.concat(F.lpad(F.length(text.text_or_empty(F.col("violation_summary"))), 10, "0"), F.rpad("date", 10, " "), F.col("case_id"))
    metrics = {
        "total": stats.Metric(F.array(F.lit(""))), "dataset": stats.Metric(F.array("dataset")), "status": stats.Metric(F.array("status")), "bureau": stats.Metric(filled(F.col("bureau")), n=3),
        "month": stats.Metric(filled(F.substring("date", 1, 7))), "year": stats.Metric(filled(F.substring("date", 1, 4))), "violation": stats.Metric(tags), "violation_by_kind": stats.Metric(tags, kind, n=4),
        "punishment": stats.Metric(filled(F.col("punishment")), n=2), "punishment_by_kind": stats.Metric(filled(F.col("punishment")), kind, n=2), "category": stats.Metric(F.array(taxonomy.category(F.col("punishment"), [("money", ("fined",)), ("ban", ("barred", "ban"))]))),
        "law": stats.Metric(stats.cited_laws(F.col("legal_basis")), n=2), "typical": stats.Metric(F.array("case_id"), tags, n=2, by=longest),
    }
    return stats.bundle(f, metrics, F.col("entity_type") == "org", F.col("entity_type") == "person")


@on_full("analysis_in_one_scan", f"{_PARTS} SELECT * FROM bundled")
def _(f):
    return _bundled(f)


@on_full("analysis_payloads", f"{_PARTS} SELECT metric, count(*) AS items, sum(cases) AS cases, string_agg(value, ',' ORDER BY kind, rank NULLS FIRST, value) AS listed FROM bundled GROUP BY metric")
def _(f):
    rows = F.from_json("payload", "array<struct<kind:string,rank:int,value:string,cases:long>>")
    made = stats.bundle_json(_bundled(f)).withColumn("r", rows)
    return made.select("metric", "items", F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x["cases"]).alias("cases"), F.array_join(F.transform("r", lambda x: x["value"]), ",").alias("listed"))


@on_full("merged_job_results", "SELECT count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped FROM f")
def _(f):
    each = f.groupBy("dataset").agg(*[F.when(F.count_if(F.col("status") == s) > 0, F.count_if(F.col("status") == s)).alias(s) for s in ("done", "failed", "skipped")])
    return state.merged_results(each, ("done", "failed", "skipped"))


#: Rules that hold in both engines.
COUNTERS = {
    "undated": "date = ''", "no_title": "title = ''", "no_body": "raw_text = ''", "short_body": "length(raw_text) < 100", "file_only": "raw_text = 'see decision.pdf'", "no_summary": "NOT has_summary",
    "done_without_summary": "status = 'done' AND NOT has_summary", "no_party": "punished_entity = ''", "no_parties": "punished_entities = ''", "no_number": "document_number = ''", "no_type": "coalesce(entity_type, '') = ''",
    "mixed_type": "entity_type = 'person / org'", "no_punishment": "coalesce(punishment, '') = ''", "no_violation": "coalesce(violation_type, '') = ''", "no_basis": "coalesce(legal_basis, '') = ''", "bad_date": "punishment_date = '2021-02-30'", "mismatch": "status_note <> ''",
}


@on_full("seventeen_counters", " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) AS cases, coalesce((list_sort(list(number)))[1:8], []) AS samples FROM f WHERE {w}" for r, w in COUNTERS.items()))
def _(f):
    return stats.quality_counters(f, {r: F.expr(w) for r, w in COUNTERS.items()}, "number")


@on_full("typical_cases", "SELECT violation, case_id, rank FROM (SELECT violation, case_id, row_number() OVER (PARTITION BY violation ORDER BY length(violation_summary) DESC, date DESC, case_id DESC) AS rank FROM b JOIN f USING (dataset, case_id)) WHERE rank <= 2 ORDER BY violation, rank LIMIT 40")
def _(f):
    rows = bridge_of(f).join(f.select(*KEY, "date", "violation_summary"), KEY)
    return typical(stats.representatives(rows, "violation", "violation_summary")).select("violation", "case_id", "rank")


@on_full("latest_twelve", "SELECT case_id, date FROM f WHERE status IN ('done', 'pending') ORDER BY date DESC, case_id DESC LIMIT 12")
def _(f):
    return CaseQuery(limit=12).in_default_scope().search(f).select("case_id", "date")


@on_full("facts_of_known_pages", """SELECT number AS page_id, CASE WHEN number % 5 = 0 THEN '404 Not Found' ELSE 'Order 404 of page ' || number END AS title, 100 + number % 7 AS chars, 1 AS links, '2024-01-05' AS day,
 CASE number % 3 WHEN 0 THEN 'http://h/a/f' || number || '.pdf' WHEN 1 THEN 'http://h/a/g' || number || '.doc' ELSE '' END AS attachment, CASE number % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS tier, number % 5 = 0 AS soft_404 FROM f""")
def _(f):
    n = F.col("number").cast("string")
    title = F.when(F.col("number") % 5 == 0, "404 Not Found").otherwise(F.concat(F.lit("Order 404 of page "), n))
    file = F.when(F.col("number") % 3 == 0, F.concat(F.lit('<div class="attachment-down"><a href="f'), n, F.lit('.pdf">get</a></div>'))).when(F.col("number") % 3 == 1, F.concat(F.lit('<a href="g'), n, F.lit('.doc">附件</a>'))).otherwise("")
    page = F.concat(F.lit("<html><head><title>"), title, F.lit('</title><script>no</script></head><body><nav>menu</nav><div class="content"><p>'), F.repeat(F.lit("x"), (100 + F.col("number") % 7).cast("int")), F.lit('</p></div><ul><li><a href="/c'), n, F.lit('">Item</a> 2024-01-05</li></ul>'), file, F.lit("<footer>end</footer></body></html>"))
    found = html.page_facts(f.select(F.col("number").alias("page_id"), F.lit("http://h/a/").alias("url"), page.alias("html")))
    return found.select("page_id", "title", F.length("main_text").alias("chars"), F.size("items").alias("links"), F.col("items")[0]["date"].alias("day"), "attachment", F.col("attachment_tier").alias("tier"), "soft_404")


# --- names


@on_full("parties_of_titles", f"SELECT case_id, {TITLED} AS party, CASE WHEN number % 6 = 1 THEN '' ELSE {TITLED} END AS organisation FROM f")
def _(f):
    return f.select("case_id", entities.party_from_title(F.col("title"), WORDS).alias("party"), entities.organisation_from_title(F.col("title"), WORDS).alias("organisation"))


@on_full("organisations_of_bodies", f"SELECT case_id, {IN_BODY} AS organisation, {IN_BODY} AS anchored FROM f")
def _(f):
    body = F.col("raw_text")
    return f.select("case_id", entities.organisation_from_body(body, F.lit(""), WORDS).alias("organisation"), entities.organisation_from_body(body, F.lit("Epsilon"), WORDS).alias("anchored"))


@on_full("punished_parties", f"SELECT case_id, CASE number % 5 WHEN 3 THEN 'John Smith' WHEN 4 THEN 'Beta Bank' ELSE {TRUTH} END AS party, {TRUTH} AS truth FROM f")
def _(f):
    title, body = F.col("title"), F.col("raw_text")
    candidates = [entities.party_from_title(title, WORDS), entities.organisation_from_title(title, WORDS), entities.organisation_from_body(body, F.lit(""), WORDS)]
    return f.select("case_id", entities.punished_entity(F.col("punished_entity"), title, body, WORDS).alias("party"), entities.authoritative_entity(candidates, WORDS).alias("truth"))


@on_full("cleaned_parties", "SELECT case_id, CASE WHEN number % 5 = 1 THEN 'Beta Bank、Gamma Fund' ELSE punished_entities END AS parties, CASE WHEN number % 5 = 1 THEN 'Alpha Trading Ltd' ELSE punished_entity END AS party FROM f")
def _(f):
    return f.select("case_id", entities.clean_parties(F.col("punished_entities"), WORDS).alias("parties"), entities.strip_measure(F.col("punished_entity"), WORDS).alias("party"))


@on_full("lines_of_persons", "SELECT case_id, number % 2 = 0 AS persons FROM f")
def _(f):
    line = F.when(F.col("number") % 2 == 0, "John Smith、Mary Jones").otherwise("John Smith、Beta Bank")
    return f.select("case_id", entities.is_person_line(line, WORDS).alias("persons"))


@on_full("types_in_texts", "SELECT case_id, CASE WHEN number % 6 IN (0, 3) THEN CASE WHEN number % 6 = 3 THEN 'fund' ELSE 'company' END WHEN number % 6 = 2 THEN 'bank' ELSE '' END AS kind FROM f")
def _(f):
    return f.select("case_id", entities.organisation_type(F.col("title"), WORDS).alias("kind"))


@on_full("case_ids_of_all_forms", """SELECT number, CASE number % 7 WHEN 0 THEN 'P2024' || lpad(CAST(number AS VARCHAR), 18, '0') WHEN 1 THEN '20240101_' || number WHEN 2 THEN '202401_ab_' || number
 WHEN 3 THEN 'c' || (1000000 + number) WHEN 4 THEN 'c' || (1000000 + number) WHEN 5 THEN '' ELSE 'some_page_x_' || number END AS found FROM f""")
def _(f):
    return f.select("number", text.case_id_from_url(F.col("source_url")).alias("found"))


@on_full("dated_case_ids", "SELECT number, CASE WHEN date = '' THEN '' ELSE replace(date, '-', '') END || '_20240101_' || number AS found FROM f WHERE number % 7 = 1")
def _(f):
    return f.filter("number % 7 = 1").select("number", text.dated_case_id(F.col("date"), F.col("source_url")).alias("found"))


@on_full("sign_off_of_bodies", f"SELECT case_id, {SIGNED} AS signed FROM f")
def _(f):
    return f.select("case_id", text.sign_off_date(F.col("raw_text")).alias("signed"))


@on_full("dates_checked", "SELECT case_id, CASE WHEN punishment_date = '2021-03-04' THEN punishment_date END AS day FROM f")
def _(f):
    return f.select("case_id", text.strict_date(F.col("punishment_date")).alias("day"))


@on_full("small_scalars", """SELECT case_id, CASE number % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag, 'ab' || number AS file, CASE WHEN number % 2 = 0 THEN 'HTTPS://x' ELSE '' END AS address,
 repeat('*', 12) || 'wxyz' AS secret, '{"a": ' || number || '}' AS json FROM f""")
def _(f):
    n, even = F.col("number").cast("string"), F.col("number") % 2 == 0
    flag = F.when(F.col("number") % 4 == 0, " Yes").when(F.col("number") % 4 == 1, "0").otherwise("maybe")
    answer = F.concat(F.lit('```json\n{"a": '), n, F.lit(",}\n```"))
    return f.select("case_id", text.lenient_bool(flag).alias("flag"), text.file_name(F.concat(F.lit('a/b:*"'), n)).alias("file"), text.safe_url(F.when(even, "HTTPS://x").otherwise("javascript:x")).alias("address"), text.mask_secret(F.lit("abcdefghijklwxyz")).alias("secret"), text.json_object(answer).alias("json"))


@query("chinese_numerals", "SELECT n_nationkey, n_nationkey AS value, 2000 + n_nationkey % 10 AS year FROM nation WHERE n_nationkey > 0")
def _(spark, sf):
    n = F.col("n_nationkey")
    digit = lambda x: F.substring(F.lit("零一二三四五六七八九"), x + 1, F.lit(1))
    tens, ones = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    word = F.concat(F.when(tens > 1, digit(tens)).otherwise(""), F.when(tens > 0, "十").otherwise(""), F.when((ones > 0), digit(ones)).otherwise(""))
    year = F.concat(F.lit("二〇〇"), digit(ones))
    return read(spark, sf, "nation").filter("n_nationkey > 0").select("n_nationkey", text.numeral(word).alias("value"), text.numeral(year).alias("year"))


# --- writes and repair


@on_full("set_statuses", "SELECT case_id, CASE WHEN number % 11 = 0 THEN 'failed' ELSE status END AS status FROM f")
def _(f):
    return state.set_value(f.select(*KEY, "status"), f.filter("number % 11 = 0"), "status", F.lit("failed")).select("case_id", "status")


@on_full("bodies_written", "SELECT case_id, CASE WHEN number % 5 = 0 THEN 'new ' || number WHEN number % 5 = 1 THEN raw_text ELSE raw_text END AS raw_text FROM f WHERE raw_text <> '' OR number % 5 = 0")
def _(f):
    new = f.filter("number % 5 in (0, 1)").select(*KEY, F.when(F.col("number") % 5 == 0, F.concat(F.lit("new "), F.col("number").cast("string"))).otherwise("").alias("raw_text"))
    return merge.upsert_bodies(bodies(f), new).select("case_id", "raw_text")


@on_full("summary_written", "SELECT case_id, tag AS violation FROM f JOIN t ON violation_type = raw WHERE number % 5 <> 0 UNION ALL SELECT case_id, 'forgery' FROM f WHERE number % 5 = 0")
def _(f):
    new = f.filter("number % 5 = 0").select(*KEY, F.lit("org").alias("entity_type"), F.lit("forged papers").alias("violation_type"), F.lit("").alias("punishment"))
    out = merge.write_summary(summaries(f), bridge_of(f), f.select(*KEY, "status"), new, taxonomy.canonical(F.col("violation_type"), TAGS), "done")
    return out["case_violations"].select("case_id", "violation")


@on_full("summary_status", "SELECT case_id, CASE WHEN number % 5 = 0 THEN 'done' ELSE status END AS status FROM f")
def _(f):
    new = f.filter("number % 5 = 0").select(*KEY, F.lit("org").alias("entity_type"), F.lit("forged papers").alias("violation_type"), F.lit("").alias("punishment"))
    return merge.write_summary(summaries(f), bridge_of(f), f.select(*KEY, "status"), new, taxonomy.canonical(F.col("violation_type"), TAGS), "done")["cases"].select("case_id", "status")


@on_full("bridge_rebuilt", "SELECT dataset, case_id, violation FROM b")
def _(f):
    return merge.rebuild_bridge(summaries(f), taxonomy.canonical(F.col("violation_type"), TAGS))


@on_full("task_progress", f"SELECT id, CASE WHEN seq % 3 = 0 THEN 99 ELSE processed END AS processed, CASE WHEN seq % 6 = 0 THEN 'paused' ELSE status END AS status FROM {TASKS}")
def _(f):
    changes = f.filter("number % 3 = 0").select(F.col("case_id").alias("id"), F.lit(99).cast("long").alias("processed"), F.when(F.col("number") % 6 == 0, "paused").alias("status"))
    return state.progress(_tasks(f), changes).select("id", "processed", "status")


@on_full("task_finish", f"SELECT id, CASE WHEN status IN ('pending', 'running') AND seq % 2 = 0 THEN 'cancelled' ELSE status END AS status FROM {TASKS}")
def _(f):
    return state.finish(_tasks(f), f.filter("number % 2 = 0").select(F.col("case_id").alias("id")), "cancelled", "2024-01-01").select("id", "status")


@on_full("tasks_removed", f"SELECT id FROM {TASKS} WHERE seq % 3 <> 0")
def _(f):
    logs = f.select(F.col("case_id").alias("task_id"), F.lit(1).alias("seq"))
    return state.remove_tasks(_tasks(f), logs, f.filter("number % 3 = 0").select(F.col("case_id").alias("id")))[0].select("id")


_ONE = f"CASE WHEN dataset = '{FIRST}' AND ({TITLED}) <> '' AND number % 5 IN (0, 1, 2) THEN {TITLED} WHEN number % 5 IN (1, 2) AND {TRUTH} = '' THEN '' ELSE punished_entity END"
_MANY = f"CASE WHEN number % 5 = 0 AND dataset <> '{FIRST}' THEN {TRUTH} WHEN number % 5 = 1 THEN 'Beta Bank、Gamma Fund' WHEN number % 5 = 2 AND {TRUTH} <> '' THEN {TRUTH} ELSE punished_entities END"
_DATE = f"CASE WHEN status = 'done' AND coalesce(punishment_date, '') = '' AND status_note = '' AND ({SIGNED}) <> '' THEN {SIGNED} WHEN punishment_date = '2021-02-30' THEN '' ELSE coalesce(punishment_date, '') END"


@on_full("repaired", f"SELECT case_id, one, many, CASE WHEN summary_entity = 'it was found that rules were broken' OR coalesce(summary_entity, '') = '' THEN held ELSE summary_entity END AS entity, CASE WHEN entity_type = 'person / org' THEN 'person、org' ELSE coalesce(entity_type, '') END AS kind, day FROM (SELECT *, CASE WHEN dataset = '{FIRST}' THEN one ELSE many END AS held FROM (SELECT *, {_ONE} AS one, {_MANY} AS many, {_DATE} AS day FROM f))")
def _(f):
    out = repair.repair(f, WORDS, FIRST)
    return out.select("case_id", F.col("punished_entity").alias("one"), F.col("punished_entities").alias("many"), F.coalesce("summary_entity", F.lit("")).alias("entity"), F.coalesce("entity_type", F.lit("")).alias("kind"), F.coalesce("punishment_date", F.lit("")).alias("day"))


@on_full("repair_audit", f"SELECT 'fill_first_party' AS name, count(*) AS rows FROM f WHERE dataset = '{FIRST}' AND ({TITLED}) <> '' AND number % 5 IN (0, 1, 2) UNION ALL SELECT 'clean_suffix', count(*) FROM f WHERE number % 5 = 1 UNION ALL SELECT 'clear_date', count(*) FROM f WHERE punishment_date = '2021-02-30' UNION ALL SELECT 'entity_type', count(*) FROM f WHERE entity_type = 'person / org'")
def _(f):
    return repair.audit(repair.repair(f, WORDS, FIRST)).filter(F.col("name").isin("fill_first_party", "clean_suffix", "clear_date", "entity_type"))


@on_full("repair_dry_run", f"SELECT 'fill_first_party' AS name, count(*) AS candidates FROM f WHERE dataset = '{FIRST}' AND ({TITLED}) <> '' AND number % 5 IN (0, 1, 2) UNION ALL SELECT 'fill_other_party', count(*) FROM f WHERE dataset <> '{FIRST}' AND number % 5 = 0 AND {TRUTH} <> '' UNION ALL SELECT 'clear_date', count(*) FROM f WHERE punishment_date = '2021-02-30' UNION ALL SELECT 'replace_dirty_party', count(*) FROM f WHERE number % 5 IN (1, 2) AND {TRUTH} <> ''")
def _(f):
    return repair.dry_run(f, WORDS, FIRST).filter(F.col("name").isin("fill_first_party", "fill_other_party", "clear_date", "replace_dirty_party"))


#: Words of titles that tell of several actions; names of customers, suppliers and parts stand for the parties.
ACTS = entities.Lexicon(measures=("is fined",), sentence_marks=("it was found",), org_suffixes=("Bank",), separators="、;", action_marks=("against ",), actions=("a warning", "a fine", "an order"), pronouns=("the said ",), longest=80)
#: One to four parties by the order's key: two in one action, one that is dirty, one named twice, and two actions of one party each.
_ACTED = """SELECT o_orderkey, o_orderkey % 5 AS form, c_name AS a, concat('Clerk ', CAST(o_orderkey % 97 AS STRING)) AS b, concat('Customer of ', CAST(c_nationkey AS STRING), ' ', CAST(c_custkey AS STRING)) AS c, concat(c_mktsegment, ' Bank ', CAST(o_custkey AS STRING)) AS d FROM {orders} o JOIN {customer} c ON o_custkey = c_custkey"""
_ACTED_TITLES = f"""SELECT *, CASE form WHEN 0 THEN concat('Notice against ', a, ' a warning') WHEN 1 THEN concat('Notice against ', a, '、', b, ' an order and against ', d, ' a fine') WHEN 2 THEN concat('Notice against it was found that ', a, ' a fine and against the said ', d, ' a warning')
    WHEN 3 THEN concat('Notice against ', a, '、', b, ' a fine, against ', c, ' a warning, against ', a, '、', d, ' an order') ELSE concat('Notice of ', a) END AS title,
    CASE o_orderkey % 3 WHEN 0 THEN a WHEN 1 THEN '' ELSE concat(a, ' with a long name of its own、', b, ' of the second office、', c, ' and others、', d, ' of the main street') END AS held FROM ({_ACTED})"""
_PARTIES = "CASE form WHEN 0 THEN a WHEN 1 THEN concat_ws('、', a, b, d) WHEN 2 THEN d WHEN 3 THEN concat_ws('、', a, b, c, d) ELSE '' END"


@query("parties_of_compound_titles", f"SELECT o_orderkey, {_PARTIES} AS parties, form IN (1, 2, 3) AS compound FROM ({_ACTED_TITLES.format(orders='orders', customer='customer')})")
def _(spark, sf):
    titles = spark.sql(_ACTED_TITLES, orders=read(spark, sf, "orders"), customer=read(spark, sf, "customer"))
    return titles.select("o_orderkey", entities.parties_of_actions(F.col("title"), ACTS).alias("parties"), entities.is_compound(F.col("title"), ACTS).alias("compound"))


@query("repaired_compound_titles", f"""SELECT o_orderkey, CASE WHEN held = '' AND form = 4 THEN '' WHEN held = '' THEN parties WHEN form IN (1, 2, 3) AND length(parties) >= length(held) THEN parties ELSE held END AS parties
FROM (SELECT *, {_PARTIES} AS parties FROM ({_ACTED_TITLES.format(orders='orders', customer='customer')}))""")
def _(spark, sf):
    titles = spark.sql(_ACTED_TITLES, orders=read(spark, sf, "orders"), customer=read(spark, sf, "customer"))
    blanks = {c: F.lit("") for c in ("raw_text", "status", "status_note", "punished_entity", "summary_entity", "entity_type", "document_number", "punishment_date")}
    rows = titles.select("o_orderkey", "title", F.col("held").alias("punished_entities"), F.lit("other").alias("dataset")).withColumns(blanks)
    return repair.repair(rows, ACTS, FIRST).select("o_orderkey", F.col("punished_entities").alias("parties"))


#: What stands before the row's number, between it and the quoted text, and after: fenced with a comma too many, behind a brace of prose, beside brackets and quotes in a string, cut off around an object, and no object.
ANSWERS = (('```json\n{"id": ', ', "body": ', ",}\n```"), ('Not {this} but {"id": ', ', "body": ', "} as asked"), ('So: {"o": {"s": "} \\" {", "l": [1, {"x": 2}, ]}, "id": ', ', "body": ', '} and {"id": -1}'), ('{"outer": {"id": ', ', "body": ', '}, "rest'), ("no object, but ", " and ", "."))


@query("objects_in_answers", "SELECT doc_id, CASE WHEN doc_id % 6 < 4 THEN doc_id END AS id, CASE WHEN doc_id % 6 < 4 THEN coalesce(text, '') END AS body FROM documents")
def _(spark, sf):
    quoted = F.regexp_replace(F.to_json(F.struct(text.text_or_empty(F.col("text")).alias("t"))), r'(?s)^\{"t":(.*)\}$', "$1")
    docs = read(spark, sf, "documents").select("doc_id", quoted.alias("body"))
    answer = F.coalesce(*[F.when(F.col("doc_id") % 6 == i, F.concat(F.lit(a), F.col("doc_id").cast("string"), F.lit(b), "body", F.lit(c))) for i, (a, b, c) in enumerate(ANSWERS)])
    found = docs.select("doc_id", text.json_object(answer).alias("o"))
    return found.select("doc_id", F.get_json_object("o", "$.id").cast("long").alias("id"), F.get_json_object("o", "$.body").alias("body"))


@on_full("placeholder_rows", "SELECT case_id, 'skipped' AS status, CASE WHEN number % 3 = 2 THEN 'skipped_title' ELSE 'skipped_content' END AS note FROM f WHERE number % 3 = 2 OR (number % 3 = 0 AND raw_text <> '' AND NOT contains(raw_text, 'the'))")
def _(f):
    rows = repair.classify(f.withColumnRenamed("is_fund_related", "title_relevant"), ("the",))
    return repair.placeholders(rows).select("case_id", "status", F.col("status_note").alias("note"))


@on_full("model_inputs", "SELECT case_id, length(substr(raw_text, 1, CASE WHEN dataset = 'en' THEN 500 ELSE 900 END)) AS chars FROM f WHERE length(trim(raw_text)) >= 50")
def _(f):
    return repair.model_input(f, {"en": 500}, 900).select("case_id", F.length("input").alias("chars"))
