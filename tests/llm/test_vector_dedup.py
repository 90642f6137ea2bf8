"""Near-duplicate vectors against all pairs."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from docketry.llm import queries, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, x float, links long"


def brute(rows):
    """(id, vector, label) -> (id, n_links, component_id, kept) by row."""
    fit = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and label is not None for _, v, label in rows]
    near = [[] for _ in rows]
    one = [np.array(v, "f4").astype("f8") / np.linalg.norm(np.array(v, "f4").astype("f8")) if f else None for (_, v, _), f in zip(rows, fit)]
    for i in range(len(rows)):
        for j in range(i):
            if fit[i] and fit[j] and rows[i][2] == rows[j][2] and len(one[i]) == len(one[j]) and one[i] @ one[j] >= 0.98:
                near[i].append(j)
                near[j].append(i)
    out = []
    for i, (own, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        least = min(ids) if ids else None
        out.append((own, len(near[i]), least, own == least))
    return sorted(out, key=repr)


def drawn(seed, groups=60, dim=24):
    """Chains and groups of near vectors in three labels, with exact copies."""
    rng, rows = np.random.default_rng(seed), []
    for _ in range(groups):
        v = rng.standard_normal(dim)
        for _ in range(int(rng.integers(1, 9))):
            rows.append([float(np.float32(x)) for x in v])
            v = v if rng.random() < 0.2 else v + rng.standard_normal(dim) * np.linalg.norm(v) * rng.choice([0.02, 0.035, 0.05])
    labels = rng.choice([1, 1, 1, 2, 3], len(rows))
    return [(int(i), v, int(label)) for i, v, label in zip(rng.permutation(len(rows)), rows, labels)]


def found(spark, rows, **how):
    df = spark.createDataFrame([(*r, 0.0, 0) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, vector_dedup.near_duplicates(df, **how).collect()), key=repr)


@pytest.mark.parametrize("block", [4096, 7])
def test_links_and_components_equal_all_pairs(spark, block):
    rows = drawn(block)
    assert found(spark, rows, block=block) == brute(rows)


def test_labels_that_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "CELL", 16)
    rows = drawn(5, groups=150)
    got, want = found(spark, rows), brute(rows)
    linked = sum(r[1] for r in want)
    assert linked and sum(r[1] for r in got) >= 0.99 * linked
    assert all(g[1] <= w[1] for g, w in zip(got, want))  # sorted by id first


def test_calibrated_count_and_tables():
    rng = np.random.default_rng(0)
    sample = [(rng.standard_normal(32).astype("f4"), np.zeros(32), cuts) for cuts in rng.integers(0, 12, 800)]
    tables, count = vector_dedup.calibrate(sample, 0.98)
    assert tables >= vector_dedup.TABLES and count >= vector_dedup.LEAST_COUNT
    assert vector_dedup.calibrate([], 0.98)[0] == vector_dedup.TABLES


def test_awkward_rows(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [
        (5, v, 1), (4, v, 1), (4, v, 1), (3, [2.0, 4.0, 6.0], 1), (2, v, 2), (1, v, None), (0, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 3.0], 1), (8, [1.0, math.nan, 3.0], 1),
        (9, [1.0, math.inf, 3.0], 1), (10, [], 1), (None, v, 1), (None, w, 3), (11, w, 3), (None, [9.0, 9.0, 1.0], 4), (12, [1.0, 2.0], 1), (13, [1.0, 2.0], 1), (14, [0.0, -0.0, 1.0], 5), (15, [0.0, 0.0, 1.0], 5), (16, [1e-30, 2e-30, 3e-30], 1), (17, [-1.0, -2.0, -3.0], 1), (18, [5.0], 6), (19, [2.0], 6), (20, [-2.0], 6),
    ]
    got = [r if r[2] is not None else (*r[:3], True) for r in found(spark, rows)]
    assert got == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, 1)]) == [(1, 0, 1, True)]


def test_query_equals_sql(spark, tiny):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tiny}/embeddings.parquet')")
    want = con.execute(queries.ORACLE_SQL["op13_vector_dedup"]).fetchall()
    assert want and sorted(want) == sorted(map(tuple, queries.QUERIES["op13_vector_dedup"](spark, tiny).collect()))
