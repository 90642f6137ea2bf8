"""Every query that has SQL must give the rows that DuckDB gives on the same tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from docketry import catalog
from docketry.operators import repair

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(v) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, tiny, oracle):
    df = catalog.QUERIES[name](spark, tiny)
    rows = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    found = oracle.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = [tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall()]
    got = [tuple(plain(r[c]) for c in order) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert got, "a comparison of nothing proves nothing"


@pytest.mark.parametrize("odd", ["empty texts", "null texts", "repeated labels", "all"])
def test_ingest_outcomes_of_odd_rows(odd, spark, tmp_path):
    con = duckdb.connect()
    body = {"empty texts": "CASE WHEN i < 12 THEN '' ELSE 'a fund' END", "null texts": "CASE WHEN i < 12 THEN NULL ELSE 'words' END", "repeated labels": "'words'", "all": "['', NULL, 'words', 'a fund'][1 + i % 4]"}[odd]
    times = 3 if odd in ("repeated labels", "all") else 1
    con.execute(f"COPY (SELECT i AS doc_id, {body} AS text, 'en' AS lang, 's' AS source, 5::BIGINT AS n_chars FROM range(60) t(i)) TO '{tmp_path}/documents.parquet'")
    con.execute(f"COPY (SELECT 7 * i AS doc_id, 1 AS quality, 0 AS toxic FROM range(9) t(i), range({times})) TO '{tmp_path}/labels.parquet'")
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    want = dict(con.execute(catalog.ORACLE_SQL["ingest_outcome"]).fetchall())
    assert {r.outcome: r.cases for r in catalog.QUERIES["ingest_outcome"](spark, str(tmp_path)).collect()} == want


def test_an_empty_body_has_failed_unless_it_is_to_be_judged(spark):
    rows = spark.createDataFrame([(i, relevant, text) for i, (relevant, text) in enumerate((r, t) for r in (False, True, None) for t in ("", None, "x", "a fund"))], "i int, title_relevant boolean, raw_text string")
    outcomes = lambda **options: [r.outcome for r in repair.classify(rows, **options).orderBy("i").collect()]
    title, content = "skipped_title", "skipped_content"
    assert outcomes() == [title] * 4 + ["failed", "failed", "success", "success"] + ["failed", "failed", content, "success"]
    assert outcomes(empty_fails=False) == [title] * 4 + ["success"] * 4 + [content, "success", content, "success"]
