"""Queries over versions of tables, matched names and paged sources, with the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query, read
from .catalog_cases import KEY, TAGS, bridge_of, on_full, summaries
from .functions import taxonomy
from .operators import bridge, names, retrieve, versions
from .sources import paged
from .streaming import ingest, records


def _two_versions(spark, sf):
    """Orders as they are, and a newer version with deleted, changed and new rows, committed one after the other."""
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    folder = ingest.stream_folder(spark)
    versions.commit(spark, folder, {"orders": orders, "nation": read(spark, sf, "nation")})

    def change(state: versions.Snapshot):
        old = state.read(spark, "orders").filter("o_orderkey % 7 <> 0")
        added = old.filter("o_orderkey % 13 = 0").withColumn("o_orderkey", -F.col("o_orderkey"))
        status, price = F.when(F.expr("o_orderkey % 5 = 0"), "X").otherwise(F.col("o_orderstatus")), F.col("o_totalprice") + F.when(F.expr("o_orderkey % 11 = 0"), 1).otherwise(0)
        return {"orders": old.withColumns({"o_orderstatus": status, "o_totalprice": price}).unionByName(added)}

    versions.transact(spark, folder, change)
    return folder


@query("rows_changed_since", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'deleted' ELSE 'updated' END AS change,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'o_orderstatus' END, CASE WHEN o_orderkey % 11 = 0 THEN 'o_totalprice' END) END AS columns
FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 11 = 0
UNION ALL SELECT -o_orderkey, 'inserted', NULL FROM orders WHERE o_orderkey % 13 = 0 AND o_orderkey % 7 <> 0
""")
def _(spark, sf):
    folder = _two_versions(spark, sf)
    old, new = (versions.snapshot(spark, folder, r).read(spark, "orders") for r in (1, 2))
    changed = versions.row_changes(old, new, ("o_orderkey",))
    return changed.select("o_orderkey", "change", F.when(F.col("columns").isNotNull(), F.concat_ws(",", "columns")).alias("columns"))


@query("tables_changed_since", "SELECT 2 AS revision, 'orders' AS name, count(*) FILTER (o_orderkey % 7 <> 0) + count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 13 = 0) AS rows FROM orders")
def _(spark, sf):
    folder = _two_versions(spark, sf)
    rows = versions.snapshot(spark, folder).read(spark, "orders").agg(F.count("*").alias("rows"))
    return versions.changes_since(spark, folder, 1).select(F.col("revision").cast("int").alias("revision"), "name").join(rows, F.lit(True))


@query("names_matched", """WITH own AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN substr(s_name, length(s_name) - 2) WHEN 1 THEN s_name ELSE 'Messrs Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || ' and sons' END AS name FROM supplier),
known AS (SELECT c_custkey, c_name FROM customer UNION ALL SELECT 100000000 + s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0)
SELECT s_suppkey, name, first.name AS matched, first.rank AS matched_rank FROM (
    SELECT s_suppkey, name, (SELECT min({'other': c_name <> name, 'rank': c_custkey, 'name': c_name}) FROM known WHERE contains(c_name, name) OR contains(name, c_name)) AS first FROM own)
""")
def _(spark, sf):
    supplier = read(spark, sf, "supplier")
    ends = F.col("s_name").substr(F.length("s_name") - 2, F.lit(3))
    inside = F.concat(F.lit("Messrs Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit(" and sons"))
    own = supplier.select("s_suppkey", F.when(F.expr("s_suppkey % 3 = 0"), ends).when(F.expr("s_suppkey % 3 = 1"), F.col("s_name")).otherwise(inside).alias("name"))
    of_suppliers = supplier.filter("s_suppkey % 2 = 0").select((100000000 + F.col("s_suppkey")).alias("rank"), F.col("s_name").alias("known"))
    known = read(spark, sf, "customer").select(F.col("c_custkey").alias("rank"), F.col("c_name").alias("known")).unionByName(of_suppliers)
    return names.match_names(own, known, "name", "known", "rank").select("s_suppkey", "name", "matched", "matched_rank")


#: 20 urls a page; the last sources' pages are missing, empty or repeated from some page on.
_LISTED = """listed AS (
    SELECT page_id, url, 's' || page_id % 4 AS source, 1 + page_id // 80 AS page, (page_id // 4) % 20 AS spot, CAST(DATE '2024-12-31' - CAST(page_id // 8 AS INTEGER) AS VARCHAR) AS day FROM pages
), shown AS (
    SELECT *, CASE WHEN page_id % 4 = 3 AND page > 3 THEN 'same' || spot WHEN page_id % 9 = 0 THEN '' ELSE url END AS link FROM listed
    WHERE NOT (page_id % 4 = 1 AND page = 4) AND NOT (page_id % 4 = 2 AND page IN (2, 4, 5, 6))
)"""


@query("paged_links", f"""WITH {_LISTED}, first AS (
    SELECT source, link, min(page) AS page FROM shown WHERE link <> '' GROUP BY 1, 2
), old AS (
    SELECT source, page, 'old' AS reason FROM shown GROUP BY 1, 2 HAVING count(*) FILTER (link <> '' AND day >= '2024-11-20') = 0
), seen AS (
    SELECT DISTINCT source, page, 'seen' AS reason FROM shown WHERE (source, page) NOT IN (SELECT (source, page) FROM first)
), ends AS (
    SELECT source, min(page) AS page FROM (SELECT * FROM old UNION ALL SELECT * FROM seen UNION ALL SELECT DISTINCT source, 4, 'end' FROM listed WHERE source = 's1' AND page = 4 UNION ALL SELECT DISTINCT source, 6, 'failures' FROM listed WHERE source = 's2' AND page = 6
        UNION ALL SELECT DISTINCT source, 40, 'cap' FROM listed WHERE page >= 40) GROUP BY 1
)
SELECT source, link AS link_url, day AS date, page FROM (SELECT s.*, row_number() OVER (PARTITION BY s.source, link ORDER BY s.page, spot, url) AS k FROM shown s LEFT JOIN ends e ON s.source = e.source WHERE link <> '' AND (e.page IS NULL OR s.page <= e.page))
WHERE k = 1 AND day BETWEEN '2024-11-20' AND '2024-12-30'
""")
def _(spark, sf):
    folder = f"{ingest.stream_folder(spark)}/pages"
    listed = read(spark, sf, "pages").select("page_id", "url", F.concat(F.lit("s"), F.expr("page_id % 4")).alias("source"), F.expr("CAST(1 + page_id DIV 80 AS INT)").alias("page"), F.expr("page_id DIV 4 % 20").alias("at"), F.expr("CAST(date_sub(DATE '2024-12-31', CAST(page_id DIV 8 AS INT)) AS STRING)").alias("day"))
    link = F.when(F.expr("page_id % 4 = 3 AND page > 3"), F.concat(F.lit("same"), "at")).when(F.expr("page_id % 9 = 0"), "").otherwise(F.col("url"))
    item = F.struct("at", "url", F.col("url").alias("title"), link.alias("link_url"), F.col("day").alias("date"))
    bodies = listed.groupBy("source", "page").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("body"))
    gone = F.expr("source = 's2' AND page IN (2, 4, 5, 6)")
    bodies = bodies.withColumn("body", F.when(F.expr("source = 's1' AND page = 4"), "[]").when(~gone, F.col("body")))
    paged.land(bodies, folder)
    return paged.scan(paged.read_pages(spark, folder), "2024-11-20", "2024-12-30", most_pages=40).select("source", "link_url", "date", "page")


def _status_records(spark, sf):
    """The events table as a stream of records of its users."""
    status = F.expr("CASE event_id % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'skipped' ELSE 'pending' END")
    return ingest.read_events(spark, sf).select("user_id", F.expr("event_id * 7919 % 1000003").alias("seq"), status.alias("status"), "value", "ts")


@query("statuses_of_a_stream", """WITH r AS (
    SELECT user_id, event_id * 7919 % 1000003 AS seq, CASE event_id % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'skipped' ELSE 'pending' END AS status, value FROM events
), ended AS (
    SELECT user_id, max(seq) AS seq, arg_max(status, seq) AS last, arg_max(status, seq) FILTER (status <> 'pending') AS before, arg_max(value, seq) AS value FROM r GROUP BY user_id
)
SELECT user_id, seq, CASE WHEN last = 'pending' AND before IN ('done', 'skipped') THEN before ELSE last END AS status, value FROM ended
""")
def _(spark, sf):
    return records.drain_latest(records.stateful(_status_records(spark, sf), ("user_id",)), ("user_id",)).select("user_id", "seq", "status", "value")


@on_full("violation_type_set", "SELECT case_id, tag AS violation FROM f JOIN t ON violation_type = raw WHERE number % 4 <> 0 UNION ALL SELECT case_id, unnest(['forgery', 'unclear fees']) FROM f WHERE number % 4 = 0 AND has_summary")
def _(f):
    new = f.filter("number % 4 = 0").select(*KEY, F.lit("forged papers、hidden fees").alias("violation_type"))
    out = bridge.set_violation_type(summaries(f), bridge_of(f), new, taxonomy.canonical(F.col("violation_type"), TAGS))
    return out["case_violations"].select("case_id", "violation")


@on_full("bridge_after_changes", "SELECT dataset, case_id, tag AS violation FROM f JOIN t ON violation_type = raw WHERE number % 10 NOT IN (3, 4) UNION ALL SELECT dataset, case_id, 'late filing' FROM f WHERE number % 10 = 4")
def _(f):
    spark, folder = f.sparkSession, f"{ingest.stream_folder(f.sparkSession)}/bridge"
    bridge.write(bridge_of(f), folder)
    tags = taxonomy.canonical(F.col("violation_type"), TAGS)
    bridge.apply(spark, folder, f.filter("number % 10 IN (3, 4)").select(*KEY, F.when(F.col("number") % 10 == 4, "overdue again").otherwise("").alias("violation_type")), tags)
    return bridge.read(spark, folder).select("dataset", "case_id", "violation")


_IN_SCOPE = "SELECT f.*, coalesce(nullif(punished_entity, ''), nullif(punished_entities, ''), nullif(summary_entity, ''), '—') AS party FROM f WHERE status IN ('done', 'pending')"
_SHOWN = """string_agg('### [' || n || '] ' || upper(dataset) || ' | ' || coalesce(nullif(date, ''), '—') || ' | ' || title || chr(10) || concat_ws(chr(10), '- id: ' || case_id, '- party: ' || party, '- bureau: ' || nullif(bureau, ''), '- kind: ' || nullif(case_type, ''),
    '- violation: ' || coalesce(nullif(violation_type, ''), '—'), '- measure: ' || coalesce(nullif(punishment, ''), '—'), '- basis: ' || nullif(legal_basis, ''), '- facts: ' || coalesce(nullif(trim(regexp_replace(violation_summary, '\\s+', ' ', 'g')), ''), '—'), '- source: ' || nullif(source_url, '')), chr(10) || chr(10) ORDER BY n)"""
_PACK = """, tags AS (SELECT tag, count(*) AS n FROM {tagged} JOIN t ON violation_type = raw GROUP BY tag), named AS (SELECT coalesce(string_agg(tag || ' (' || n || ')', ', ' ORDER BY n DESC, tag), '') AS v FROM tags)
SELECT total, used, date_min, date_max, ids, '## Overview' || chr(10) || '- cases: ' || total || chr(10) || '- dates: ' || coalesce(date_min, '—') || ' to ' || coalesce(date_max, '—') || CASE WHEN v <> '' THEN chr(10) || '- violations: ' || v ELSE '' END
    || chr(10) || chr(10) || '## Cases' || chr(10) || cases AS evidence FROM facts, named"""


def _pack(df):
    return df.select("total", F.array_join("used_keywords", ",").alias("used"), "date_min", "date_max", F.array_join("ids", ",").alias("ids"), "evidence")


@on_full("answer_by_keywords", f""", scope AS ({_IN_SCOPE}), hit AS (
    SELECT s.*, k, row_number() OVER (PARTITION BY k ORDER BY date DESC, case_id DESC, dataset DESC) AS m FROM scope s, (VALUES ('bank'), ('trading'), ('nowhere')) AS w(k)
    WHERE contains(lower(concat_ws(chr(10), title, punished_entities, punished_entity, case_id, document_number, violation_summary, involved_fund)), k)
), collected AS (SELECT * EXCLUDE (k, m) FROM hit WHERE m <= 12 GROUP BY ALL), numbered AS (SELECT *, row_number() OVER (ORDER BY date DESC, case_id DESC, dataset DESC) AS n FROM collected
), newest AS (SELECT * FROM numbered WHERE n <= 12), facts AS (
    SELECT (SELECT count(*) FROM collected) AS total, (SELECT string_agg(DISTINCT k, ',' ORDER BY k) FROM hit) AS used, min(nullif(date, '')) AS date_min, max(nullif(date, '')) AS date_max, string_agg(case_id, ',' ORDER BY n) AS ids, {_SHOWN} AS cases FROM newest
) {_PACK.format(tagged="newest")}""")
def _(f):
    return _pack(retrieve.answered(f, retrieve.Intent(keywords=("bank", "trading", "nowhere"), limit=12), taxonomy.canonical(F.col("violation_type"), TAGS)))


@on_full("answer_by_structure", f""", scope AS ({_IN_SCOPE} AND dataset = 'en' AND (date = '' OR date >= '2018-01-01')), newest AS (
    SELECT *, row_number() OVER (ORDER BY date DESC, case_id DESC, dataset DESC) AS n FROM scope QUALIFY n <= 5
), facts AS (
    SELECT (SELECT count(*) FROM scope) AS total, '' AS used, (SELECT min(nullif(date, '')) FROM scope) AS date_min, (SELECT max(date) FROM scope) AS date_max, string_agg(case_id, ',' ORDER BY n) AS ids, {_SHOWN} AS cases FROM newest
) {_PACK.format(tagged="scope")}""")
def _(f):
    return _pack(retrieve.answered(f, retrieve.Intent(datasets=("en",), date_from="2018-01-01", limit=5), taxonomy.canonical(F.col("violation_type"), TAGS)))
