"""Schemas of the case tables, and how the test tables stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


_KEY = _strings("dataset", "case_id")
CASES = T.StructType(
    [
        *_KEY,
        *_strings("source_url", "title", "date", "status", "status_note", "fetch_time", "error", "pdf_url", "updated_at", "category", "org_type", "punished_entity", "source_type"),
        T.StructField("ocr_success", T.BooleanType()),
        *_strings("case_type", "bureau", "document_number", "punished_entities"),
        T.StructField("is_fund_related", T.BooleanType()),
        *_strings("fund_evidence", "doc_url"),
    ]
)
BODIES = T.StructType([*_KEY, *_strings("raw_text")])
SUMMARIES = T.StructType(
    [
        *_KEY,
        *_strings("entity_type", "punished_entity", "violation_type", "punishment", "punishment_date", "involved_fund", "violation_summary", "legal_basis", "penalty_amount", "market_ban"),
        T.StructField("extract_success", T.BooleanType()),
        *_strings("error", "extract_time", "llm_provider", "llm_model"),
    ]
)
VIOLATIONS = T.StructType([*_KEY, *_strings("violation")])
TASKS = T.StructType([*_strings("id", "kind", "title", "status", "created_at", "started_at", "finished_at", "params"), T.StructField("processed", T.LongType()), T.StructField("total", T.LongType()), *_strings("message", "error", "result")])
TASK_LOGS = T.StructType([T.StructField("task_id", T.StringType()), T.StructField("seq", T.LongType()), *_strings("level", "message", "created_at")])
META = T.StructType(_strings("key", "value", "updated_at"))
ORG_TYPES = T.StructType(_strings("name", "org_type", "source", "updated_at"))
FETCH_STATE = T.StructType(_strings("source", "scope", "key", "value", "updated_at"))

#: Version of the schemas; tables are read with an explicit schema, never an inferred one.
VERSION = 1


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the schema's columns: unknown ones go, missing ones are null, types are cast leniently."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def case_rows(spark: SparkSession, sf_dir: str, body: bool = False, summary: bool = True) -> DataFrame:
    """The flat view of cases with their summaries over the test tables.

    documents stand for cases (lang: dataset, source: bureau), labels for summaries. The summary join is left
    out when no column of it is asked for, as a left join on an unknown key is never removed by itself.
    """
    docs = read(spark, sf_dir, "documents")
    month = F.format_string("%04d-%02d-%02d", (2015 + F.col("doc_id") % 9).cast("int"), (1 + F.col("doc_id") % 12).cast("int"), (1 + F.col("doc_id") % 28).cast("int"))
    cases = docs.select(
        F.coalesce("lang", F.lit("")).alias("dataset"),
        F.col("doc_id").alias("case_id"),
        F.coalesce("source", F.lit("")).alias("bureau"),
        F.when(F.col("doc_id") % 10 == 0, "").otherwise(month).alias("date"),
        F.substring("text", 1, 40).alias("title"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("doc_id") % 3 == 1).cast("boolean").alias("is_fund_related"),
        F.when(F.col("doc_id") % 4 == 0, "notice").when(F.col("doc_id") % 4 == 1, "penalty").otherwise("").alias("case_type"),
        "n_chars",
        *(["text"] if body else []),
    )
    if not summary:
        return cases
    status = F.when(F.col("toxic").isNull(), "pending").when(F.col("toxic") == 1, "skipped").when(F.col("quality") == 1, "done").otherwise("failed")
    labels = read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "case_id")
    return cases.join(labels, "case_id", "left").withColumn("status", status).withColumn("entity_type", F.when(F.col("quality") == 1, "org").when(F.col("quality") == 0, "person"))


#: The same view in SQL, for the comparison.
CASE_ROWS_SQL = """
SELECT coalesce(lang, '') AS dataset, d.doc_id AS case_id, coalesce(source, '') AS bureau,
  CASE WHEN d.doc_id % 10 = 0 THEN '' ELSE printf('%04d-%02d-%02d', 2015 + d.doc_id % 9, 1 + d.doc_id % 12, 1 + d.doc_id % 28) END AS date,
  substr(text, 1, 40) AS title,
  CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE d.doc_id % 3 = 1 END AS is_fund_related,
  CASE d.doc_id % 4 WHEN 0 THEN 'notice' WHEN 1 THEN 'penalty' ELSE '' END AS case_type,
  n_chars, text, quality, toxic,
  CASE WHEN toxic IS NULL THEN 'pending' WHEN toxic = 1 THEN 'skipped' WHEN quality = 1 THEN 'done' ELSE 'failed' END AS status,
  CASE quality WHEN 1 THEN 'org' WHEN 0 THEN 'person' END AS entity_type
FROM documents d LEFT JOIN labels USING (doc_id)
"""

#: All columns of a case, its body and its summary over `documents`, in SQL that both engines read: names, titles and texts are
#: made up in the forms that the operators meet. {documents} is the table.
FULL_CASES_SQL = """
SELECT coalesce(lang, '') AS dataset, CAST(doc_id AS STRING) AS case_id, doc_id AS number,
  CASE doc_id % 7 WHEN 0 THEN concat('http://h/P2024', lpad(CAST(doc_id AS STRING), 18, '0'), '/x') WHEN 1 THEN concat('http://h/a/t20240101_', CAST(doc_id AS STRING), '.html')
    WHEN 2 THEN concat('http://h/202401/ab-', CAST(doc_id AS STRING)) WHEN 3 THEN concat('http://h/c', CAST(1000000 + doc_id AS STRING), '/content.shtml') WHEN 4 THEN concat('http://h/x/c', CAST(1000000 + doc_id AS STRING), '.htm')
    WHEN 5 THEN 'http://h/list/' ELSE concat('http://h/some page?x=', CAST(doc_id AS STRING)) END AS source_url,
  CASE doc_id % 6 WHEN 0 THEN 'Alpha Trading Ltd is fined for late filing' WHEN 1 THEN 'Notice (John Smith)' WHEN 2 THEN 'Announcement - Beta Bank' WHEN 3 THEN 'Decision (Gamma Fund'
    WHEN 4 THEN 'Removal of Delta LLC from the register' ELSE 'General news' END AS title,
  CASE WHEN doc_id % 10 = 0 THEN '' ELSE concat(CAST(2015 + doc_id % 9 AS STRING), '-', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0')) END AS date,
  CASE doc_id % 9 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'skipped' ELSE 'done' END AS status,
  CASE WHEN doc_id % 13 = 0 THEN 'body mismatch' ELSE '' END AS status_note,
  CASE doc_id % 3 WHEN 0 THEN 'trade' WHEN 1 THEN 'person' ELSE '' END AS category,
  CASE doc_id % 8 WHEN 0 THEN 'bank' WHEN 1 THEN 'fund' ELSE '' END AS org_type,
  CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Alpha Trading Ltd is fined' WHEN 2 THEN 'it was found that rules were broken' WHEN 3 THEN 'John Smith' ELSE 'Beta Bank' END AS punished_entity,
  CASE WHEN doc_id % 2 = 0 THEN 'html' ELSE 'pdf' END AS source_type,
  CASE doc_id % 4 WHEN 0 THEN 'notice' WHEN 1 THEN 'penalty' ELSE '' END AS case_type, coalesce(source, '') AS bureau,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('N', CAST(doc_id AS STRING)) END AS document_number,
  CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Beta Bank is fined、Gamma Fund' WHEN 2 THEN 'it was found that rules were broken' WHEN 3 THEN 'Mary Jones' ELSE 'Delta LLC' END AS punished_entities,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 3 = 1 END AS is_fund_related,
  CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 17 = 1 THEN 'see decision.pdf' ELSE concat('Party: Epsilon Capital Ltd. ', coalesce(text, ''), ' signed 2021-', lpad(CAST(1 + doc_id % 13 AS STRING), 2, '0'), '-05') END AS raw_text,
  doc_id % 10 <> 3 AS has_summary,
  CASE WHEN doc_id % 10 = 3 THEN NULL WHEN doc_id % 4 = 0 THEN 'org' WHEN doc_id % 4 = 1 THEN 'person' WHEN doc_id % 4 = 2 THEN 'person / org' ELSE '' END AS entity_type,
  CASE WHEN doc_id % 10 = 3 THEN NULL WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 6 = 1 THEN 'it was found that rules were broken' ELSE 'Zeta Bank' END AS summary_entity,
  CASE WHEN doc_id % 10 = 3 THEN NULL WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 = 1 THEN 'overdue report、unclear fees' WHEN doc_id % 7 = 2 THEN 'late filing；forged ledger' WHEN doc_id % 7 = 3 THEN 'late filing: overdue report' WHEN doc_id % 7 = 4 THEN 'other' ELSE 'another matter' END AS violation_type,
  CASE WHEN doc_id % 10 = 3 THEN NULL WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 6 = 1 THEN 'fined 5000' WHEN doc_id % 6 = 2 THEN 'barred for a year' ELSE 'warned' END AS punishment,
  CASE WHEN doc_id % 10 = 3 THEN NULL WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN '2021-02-30' ELSE '2021-03-04' END AS punishment_date,
  CASE WHEN doc_id % 10 = 3 THEN NULL WHEN doc_id % 3 = 0 THEN 'Growth Fund' ELSE '' END AS involved_fund,
  CASE WHEN doc_id % 10 = 3 THEN NULL ELSE substr(coalesce(text, ''), 1, 200) END AS violation_summary,
  CASE WHEN doc_id % 10 = 3 THEN NULL WHEN doc_id % 4 = 0 THEN '《Securities Act》第一条、第二条' WHEN doc_id % 4 = 1 THEN '《Fund Act》；local rules' ELSE '' END AS legal_basis
FROM {documents}
"""


def full_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full view of cases over the test tables; a query reads only the columns that it uses."""
    return spark.sql(FULL_CASES_SQL, documents=read(spark, sf_dir, "documents"))
