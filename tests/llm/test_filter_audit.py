"""The filter audit against a loop over all orders, and against SQL."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from docketry.llm import filter_audit, queries


def brute(rows, names):
    """rows: (part, set of failed letters, good, toxic)."""
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = Counter()
        for order in itertools.permutations(names):
            stay = own
            for step, f in enumerate(order, 1):
                gone = [r for r in stay if f in r[1]]
                stay = [r for r in stay if f not in r[1]]
                failing = [r for r in own if f in r[1]]
                out[part, "".join(order), step] = [len(stay), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                total[f] += len(gone)
        for key in [k for k in out if k[0] == part]:
            out[key].append(total[key[1][key[2] - 1]])
    return out


def found(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_masks_of_three_and_of_five_filters(spark):
    import random

    rng = random.Random(4)
    for names in ("XYZ", "ABCDE"):
        rows = [(rng.choice(["p", "p", "p", "q", ""]), rng.getrandbits(len(names)), rng.random() < 0.3, rng.random() < 0.2) for _ in range(300)]
        df = spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean")
        sets = [(p, {n for k, n in enumerate(names) if m >> k & 1}, g, t) for p, m, g, t in rows]
        assert found(filter_audit.audit(df, names)) == brute(sets, names)


def test_awkward_documents(spark, tmp_path):
    long = "Word " * 400_000  # two million characters
    docs = [(1, "a b c", "s"), (2, "a b c", "s"), (2, "a b c", "t"), (None, "a b c", "t"), (0, None, None), (5, "", ""), (6, long, "t"), (7, long, "s"), (8, "X & Y", "s"), (9, "é" * 60 + " É", "s"), (3, " ".join(f"w{i}" for i in range(60)), "s")]
    frame = spark.createDataFrame([(*d, 7, 7) for d in docs], "doc_id long, text string, source string, mask int, n_words int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (None, 1, 1), (6, 0, 1), (7, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    sets = []
    told = {1: (True, False), 2: (True, True), 6: (False, True)}
    for i, text, source in docs:
        t, words = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        fails = {x for x, bad in (("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)), ("C", 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)), ("D", re.search(r"[#$%&*|]", t))) if bad}
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs):
            fails.add("E")
        sets.append((source or "", fails, *told.get(i, (False, False))))
    assert found(filter_audit.audit_documents(frame, labels, queries.AUDITED, repeated="E")) == brute(sets, "ABCDE")


def test_empty_table(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_documents(empty, labels, queries.AUDITED, repeated="E").count() == 0


def test_query_equals_sql(spark, tiny):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    want = con.execute(queries.ORACLE_SQL["op12_filter_audit"])
    names = [d[0] for d in want.description]
    got = queries.QUERIES["op12_filter_audit"](spark, tiny).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert got.select(F.sum("removed")).first()[0] > 0
