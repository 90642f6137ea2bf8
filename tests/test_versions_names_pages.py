"""Commits that meet, names that contain one another, and paged sources."""

from __future__ import annotations

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from docketry.operators import names, versions
from docketry.sources import paged


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, v string")


def test_commits_are_current_together_and_a_killed_writer_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path)
    assert versions.snapshot(spark, folder).revision == 0
    assert versions.commit(spark, folder, {"a": table(spark, (1, "x")), "b": table(spark, (2, "y"))}) == 1
    table(spark, (9, "z")).write.parquet(f"{folder}/a/killed")  # written, never in the log
    (tmp_path / "_log" / ".half").write_text('{"revision": 2, "pa')
    now = versions.snapshot(spark, folder)
    assert now.revision == 1 and now.read(spark, "a").first().v == "x" and set(now.paths()) == {"a", "b"}
    assert versions.discard_unused(spark, folder, keep=5) == 1
    assert versions.snapshot(spark, folder).read(spark, "b").count() == 1


def test_a_write_from_an_old_state_is_refused(spark, tmp_path):
    folder = str(tmp_path)
    versions.commit(spark, folder, {"a": table(spark, (1, "x")), "b": table(spark, (1, "x"))})
    one, two = versions.snapshot(spark, folder), versions.snapshot(spark, folder)
    versions.commit(spark, folder, {"a": table(spark, (1, "first"))}, one)
    with pytest.raises(versions.Conflict) as e:
        versions.commit(spark, folder, {"a": table(spark, (1, "second"))}, two)
    assert e.value.tables == ["a"] and e.value.revision == 2
    with pytest.raises(versions.Conflict):  # b is untouched, but a went into it
        versions.commit(spark, folder, {"b": table(spark, (1, "second"))}, two, also_read=["a"])
    assert versions.commit(spark, folder, {"b": table(spark, (1, "second"))}, two) == 3
    assert versions.snapshot(spark, folder).read(spark, "a").first().v == "first"
    assert [(r.revision, r["name"]) for r in versions.changes_since(spark, folder, 1).collect()] == [(2, "a"), (3, "b")]
    assert versions.snapshot(spark, folder, at=1).read(spark, "a").first().v == "x"


def test_writers_at_once_lose_no_update(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "COMPACTED", 3)
    folder, failed = str(tmp_path), []
    versions.commit(spark, folder, {"a": table(spark)})

    def write(k):
        try:
            versions.transact(spark, folder, lambda s: {"a": s.read(spark, "a").unionByName(table(spark, (k, "x")))}, tries=50)
        except Exception as e:  # a thread's failure must not go unseen
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    now = versions.snapshot(spark, folder)
    assert not failed and now.revision == 6
    assert sorted(r.id for r in now.read(spark, "a").collect()) == list(range(5))
    assert any(p.suffix == ".sum" for p in (tmp_path / "_log").iterdir())
    for p in (tmp_path / "_log").glob("*.json"):  # readers start from the last sum
        if int(p.stem) <= 3:
            p.unlink()
    assert versions.snapshot(spark, folder) == now


def test_row_changes(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, None, None)], "id long, v string, n int")
    new = spark.createDataFrame([(1, "a", 5), (3, None, 7), (4, "d", 7)], "id long, v string, w int")
    got = {r.id: (r.change, r.columns) for r in versions.row_changes(old, new, ("id",)).collect()}
    assert got == {1: ("updated", ["w"]), 2: ("deleted", None), 3: ("updated", ["w"]), 4: ("inserted", None)}
    assert versions.row_changes(old, old, ("id",)).count() == 0


def brute_match(name, known):
    held = [(k != name, r, k) for r, k in known if name.strip() and k and k.strip() and (k in name or name in k)]
    return min(held)[2:0:-1] if held else (None, None)


def test_names_equal_a_nested_loop_without_one(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abc é", k=n))
    own = [(i, word(rng.randint(1, 9))) for i in range(200)] + [(900, None), (901, ""), (902, "  "), (903, "ab"), (904, "ab")]
    known = [(r, word(rng.randint(1, 7))) for r in range(150)] + [(500, "ab"), (3, "ab"), (600, ""), (601, None)]
    found = names.match_names(spark.createDataFrame(own, "id long, name string"), spark.createDataFrame(known, "rank long, known string"), "name", "known", "rank")
    got = {r.id: (r.matched, r.matched_rank) for r in found.collect()}
    assert len(got) == len(own)
    for i, name in own:
        assert got[i] == brute_match(name or "", known), name
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_grams_choose_the_rarest(spark):
    every = spark.createDataFrame([(f"common name {k}",) for k in range(300)] + [("common name zq",)], "name string")
    found = names.contained(spark.createDataFrame([("name zq",), ("nowhere",), ("e 29",)], "needle string"), every)
    assert sorted((r.needle, r.name) for r in found.collect()) == sorted([("name zq", "common name zq"), *[("e 29", f"common name {k}") for k in (29, *range(290, 300))]])


def body(*items):
    return json.dumps([{"title": t, "link_url": u, "date": d} for t, u, d in items])


def test_scans_end_by_each_rule(spark):
    fresh = lambda s, p: body(("t", f"{s}/{p}/1", "2024-05-01"), ("t", f"{s}/{p}/2", None))
    pages = [("end", 1, fresh("end", 1)), ("end", 2, "[]"), ("end", 3, fresh("end", 3))]
    pages += [("old", 1, fresh("old", 1)), ("old", 2, body(("t", "old/2", "2023-01-01"))), ("old", 3, fresh("old", 3))]
    pages += [("undated", 1, body(("t", "u/1", "2023-01-01"), ("t", "u/2", "no date"))), ("undated", 2, fresh("undated", 2))]
    pages += [("seen", 1, fresh("seen", 1)), ("seen", 2, fresh("seen", 1)), ("seen", 3, fresh("seen", 3))]
    pages += [("cap", p, fresh("cap", p)) for p in range(1, 11)]
    pages += [("failed", 1, fresh("failed", 1)), ("failed", 2, None), ("failed", 3, None), ("failed", 4, fresh("failed", 4)), ("failed", 5, None), ("failed", 6, "no json"), ("failed", 7, None), ("failed", 8, fresh("failed", 8))]
    df = spark.createDataFrame(pages, "source string, page int, body string")
    got = {r.source: (r.page, r.reason) for r in paged.stops(df, "2024-01-01", most_pages=8).collect()}
    assert got == {"end": (2, "end"), "old": (2, "old"), "seen": (2, "seen"), "cap": (8, "cap"), "failed": (7, "failures")}
    links = {(r.source, r.link_url) for r in paged.scan(df, "2024-01-01", "2024-12-31", most_pages=8).collect()}
    assert ("end", "end/3/1") not in links and ("failed", "failed/4/1") in links and ("failed", "failed/8/1") not in links and ("undated", "u/2") in links
    assert sum(s == "cap" for s, _ in links) == 16 and not any(u == "u/1" for _, u in links)


def test_a_repeated_link_counts_where_it_stands_first(spark):
    pages = [("s", 2, body(("later", "u", "2024-02-02"))), ("s", 1, body(("first", "u", "2024-03-03"), ("again", "u", "2024-01-01"), ("none", "", "2024-01-01")))]
    rows = paged.scan(spark.createDataFrame(pages, "source string, page int, body string").repartition(2), "2024-01-01", "2024-12-31").collect()
    assert [(r.title, r.date, r.page) for r in rows] == [("first", "2024-03-03", 1)]


def test_pages_are_read_in_ranges_and_each_once_by_a_resumed_stream(spark, tmp_path):
    folder, state, out = (str(tmp_path / n) for n in ("pages", "state", "out"))

    def land(pages):
        paged.land(spark.createDataFrame(pages, "source string, page int, body string"), folder)

    land([("a", p, f'[{{"link_url": "a{p}"}}]') for p in range(1, 6)] + [("b", 1, None), ("b", 3, "[]")])
    batch = paged.read_pages(spark, folder, pages_a_task=2)
    assert batch.rdd.getNumPartitions() == 5
    assert {(r.source, r.page, r.body) for r in batch.collect()} == {*[("a", p, f'[{{"link_url": "a{p}"}}]') for p in range(1, 6)], ("b", 1, None), ("b", 2, None), ("b", 3, "[]")}

    def drain():
        paged.stream_pages(spark, folder, 2).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r.source, r.page) for r in spark.read.parquet(out).collect())

    assert drain() == [*[("a", p) for p in range(1, 6)], *[("b", p) for p in range(1, 4)]]
    land([("a", 6, "[]"), ("c", 1, "[]")])
    assert drain() == [*[("a", p) for p in range(1, 7)], *[("b", p) for p in range(1, 4)], ("c", 1)]
    assert drain() == [*[("a", p) for p in range(1, 7)], *[("b", p) for p in range(1, 4)], ("c", 1)]
