"""Records with a status as state, cancelled streams, and the bridge kept up to date."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from docketry.operators import bridge, merge
from docketry.streaming import ingest, records

RECORD = "k string, seq long, status string, value double, ts timestamp"


def drawn(rng, n=120):
    return [(f"k{rng.randrange(12)}", seq, rng.choice(["pending", "pending", "done", "failed", "skipped"]), float(rng.randrange(5)), f"2024-01-{1 + seq % 28:02d} 00:00:00") for seq in rng.sample(range(1000), n)]


def one_by_one(rows):
    """Each record in the order of seq, through the lattice."""
    held = {}
    for k, seq, status, value, _ in sorted(rows, key=lambda r: r[1]):
        old = held.get(k)
        held[k] = (seq, old[1] if old and status == "pending" and old[1] in ("done", "skipped") else status, value)
    return held


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, seq long, status string, value double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_gives_what_a_batch_gives(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = drawn(rng)
    want = one_by_one(rows)
    assert {r.k: (r.seq, r.status, r.value) for r in records.folded(frame(spark, rows), ("k",)).collect()} == want
    rng.shuffle(rows)
    landed, folder = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(landed)
    for at in range(0, len(rows), 40):
        frame(spark, rows[at : at + 40]).coalesce(1).write.mode("append").parquet(landed)
        if at != 40:  # the second and third part come in one run
            got = records.drain_latest(records.stateful(stream, ("k",)), ("k",), folder)
    assert {r.k: (r.seq, r.status, r.value) for r in got.collect()} == want


def test_records_without_seq_and_ties(spark):
    rows = [("a", None, "done", 1.0, "2024-01-01 00:00:00"), ("a", 1, "pending", None, "2024-01-01 00:00:00"), ("b", 5, "done", 1.0, "2024-01-01 00:00:00"), ("b", 5, "failed", 0.0, "2024-01-01 00:00:00"), ("c", None, "pending", 2.0, "2024-01-01 00:00:00")]
    got = {r.k: (r.seq, r.status) for r in records.folded(frame(spark, rows), ("k",)).collect()}
    assert got == {"a": (1, "done"), "b": (5, "failed"), "c": (None, "pending")}


def test_a_key_is_forgotten_after_its_time(spark, tmp_path):
    landed, folder = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(landed)
    for rows in ([("old", 9, "done", 1.0, "2024-01-01 00:00:00")], [("new", 1, "pending", 1.0, "2024-03-01 00:00:00")], [("new", 2, "done", 1.0, "2024-03-01 00:00:01")]):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(landed)
        time.sleep(0.05)
        got = {r.k: (r.status, r.closed) for r in records.drain_latest(records.stateful(stream, ("k",), "10 days"), ("k",), folder).collect()}
    assert got == {"old": ("done", True), "new": ("done", False)}


def test_progress_counts_and_stops_a_query(spark, tmp_path):
    landed = str(tmp_path / "in")
    for k in range(8):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(landed)
    progress = ingest.Progress(spark, lambda: progress.batches >= 2)
    spark.streams.addListener(progress)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(landed)
        query = stream.writeStream.foreachBatch(lambda batch, n: batch.count() and time.sleep(0.7)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        assert not query.isActive and 2 <= progress.batches < 8 and progress.rows >= 20
    finally:
        spark.streams.removeListener(progress)


def links(spark, summaries):
    rows = [(d, c, t) for (d, c), tags in summaries.items() for t in tags]
    return spark.createDataFrame(rows, "dataset string, case_id string, violation string")


def test_changed_buckets_alone_are_written_and_equal_a_rebuild(spark, tmp_path):
    rng, folder = random.Random(3), str(tmp_path / "bridge")
    held = {(rng.choice("ab"), str(k)): {rng.choice("xyz") for _ in range(rng.randint(0, 3))} for k in range(200)}
    bridge.write(links(spark, held), folder, 16)
    for _ in range(4):
        edits = {rng.choice(list(held)): sorted({rng.choice("xyzuv") for _ in range(rng.randint(0, 2))}) for _ in range(3)} | {("c", str(rng.randrange(10**6))): ["w"]}
        files = lambda: {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in (tmp_path / "bridge").rglob("part-*")}
        before = files()
        changes = spark.createDataFrame([(*k, v) for k, v in edits.items()], "dataset string, case_id string, tags array<string>")
        touched = {r.b for r in changes.select(bridge.bucket_of(16).alias("b")).collect()}
        assert bridge.apply(spark, folder, changes, F.col("tags"), 16) == len(touched)
        held |= {k: set(v) for k, v in edits.items()}
        assert sorted(r[:3] for r in bridge.read(spark, folder).collect()) == sorted((d, c, t) for (d, c), ts in held.items() for t in ts)
        other = lambda found: {f: t for f, t in found.items() if int(f.split("/")[0].split("=")[1]) not in touched}
        assert other(files()) == other(before)
    assert bridge.apply(spark, folder, changes.limit(0), F.col("tags"), 16) == 0


def test_a_case_without_its_last_link_and_a_type_set(spark, tmp_path):
    folder = str(tmp_path / "bridge")
    bridge.write(links(spark, {("a", "1"): ["x"]}), folder, 4)
    gone = spark.createDataFrame([("a", "1", [])], "dataset string, case_id string, tags array<string>")
    bridge.apply(spark, folder, gone, F.col("tags"), 4)
    assert bridge.read(spark, folder).count() == 0 and not list((tmp_path / "bridge").glob("bucket=*"))
    summaries = spark.createDataFrame([("a", "1", "old", "kept"), ("a", "2", "old", "kept")], "dataset string, case_id string, violation_type string, punishment string")
    new = spark.createDataFrame([("a", "1", "p;q"), ("z", "9", "p")], "dataset string, case_id string, violation_type string")
    out = bridge.set_violation_type(summaries, links(spark, {("a", "1"): ["old"], ("a", "2"): ["old"]}), new, F.split("violation_type", ";"))
    assert sorted(map(tuple, out["summaries"].collect())) == [("a", "1", "p;q", "kept"), ("a", "2", "old", "kept")]
    assert sorted(map(tuple, out["case_violations"].collect())) == [("a", "1", "p"), ("a", "1", "q"), ("a", "2", "old")]
    assert merge.KEYS == ("dataset", "case_id")
