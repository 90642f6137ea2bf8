"""Records with a status as keyed state: arbitrary arrival order, expiry by event time, and what a batch gives for the same records.

A key's records count in the order of their `seq`: the greatest one gives the row, and its status follows the lattice, by which a pending
record takes back neither a done nor a skipped one. Both follow from two records, the one of the greatest seq and the one of the
greatest seq that isn't pending; these are the state, so the result doesn't depend on the order in which records arrive, nor on how they
are dealt into micro-batches.

Records have the columns of the key, seq (long), status, ts (time stamp) and value (double). Of records of equal seq and key the greater
(status, value) counts. A null seq is less than all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.merge import SETTLED
from .ingest import stream_folder

PENDING = "pending"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _settled(last: Column, before: Column) -> Column:
    """The status, from that of the last record and that of the last record that isn't pending."""
    return F.when((last == PENDING) & before.isin(*SETTLED), before).otherwise(last)


def folded(records: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, seq, status, value, ts after all records of a key: one aggregation whose state is two records a key."""
    order = F.struct(F.coalesce("seq", F.lit(-(1 << 63))).alias("seq"), "status", "value", "ts")
    ended = records.groupBy(*keys).agg(F.max(order).alias("last"), F.max(F.when(F.col("status") != PENDING, order)).alias("before"))
    status = _settled(F.col("last.status"), F.col("before.status"))
    return ended.select(*keys, F.nullif(F.col("last.seq"), F.lit(-(1 << 63))).alias("seq"), status.alias("status"), F.col("last.value").alias("value"), F.col("last.ts").alias("ts"))


class Lattice(StatefulProcessor):
    """The state of one key; gives its row after each micro-batch that touched it, and once more, closed, when it expires."""

    def __init__(self, keys: tuple[str, ...], expire_ms: int | None):
        self.keys, self.expire_ms = keys, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = "seq long, status string, value double, ts timestamp"
        self.last, self.before = handle.getValueState("last", schema), handle.getValueState("before", schema)

    def _row(self, key: tuple, closed: bool) -> Iterator[pd.DataFrame]:
        seq, status, value, ts = self.last.get()
        before = self.before.get() if self.before.exists() else None
        if status == PENDING and before is not None and before[1] in SETTLED:
            status = before[1]
        yield pd.DataFrame([(*key, seq, status, value, ts, closed)], columns=[*self.keys, "seq", "status", "value", "ts", "closed"]).astype({"seq": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        order = lambda r: (r[0] is not None, r[0] or 0, r[1] or "", -float("inf") if r[2] is None else r[2], r[3])
        found = [(None if pd.isna(s) else int(s), st, None if pd.isna(v) else float(v), ts.to_pydatetime()) for frame in rows for s, st, v, ts in zip(frame["seq"], frame["status"], frame["value"], frame["ts"])]
        for state, own in ((self.last, found), (self.before, [r for r in found if r[1] != PENDING])):
            held = [tuple(state.get())] if state.exists() else []
            if own and (best := max(own + held, key=order)) not in held:
                state.update(best)
        if self.expire_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            newest = max(r[3] for r in found)
            self.handle.registerTimer(max(int(newest.timestamp() * 1000) + self.expire_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield from self._row(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            yield from self._row(key, True)
            self.last.clear()
            self.before.clear()

    def close(self) -> None: ...


def stateful(records: DataFrame, keys: tuple[str, ...], expire_after: str | None = None) -> DataFrame:
    """Rows of `folded` as they change, with closed. expire_after (an interval) is both the watermark's delay and how long after its newest record's time
    a key is forgotten: its state goes, and later records begin anew."""
    kinds = {f.name: f.dataType.simpleString() for f in records.schema.fields}
    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", seq long, status string, value double, ts timestamp, closed boolean"
    mode, expire_ms = "None", None
    if expire_after is not None:
        span = records.sparkSession.sql(f"SELECT CAST(timestampdiff(MILLISECOND, TIMESTAMP '2000-01-01', TIMESTAMP '2000-01-01' + INTERVAL '{expire_after}') AS LONG) AS ms")
        mode, expire_ms, records = "EventTime", span.first().ms, records.withWatermark("ts", expire_after)
    narrow = records.select(*keys, F.col("seq").cast("long").alias("seq"), "status", F.col("value").cast("double").alias("value"), "ts")
    return narrow.groupBy(*keys).transformWithStateInPandas(Lattice(keys, expire_ms), out, "Update", mode)


def drain_latest(changes: DataFrame, keys: tuple[str, ...], folder: str | None = None) -> DataFrame:
    """Run over all that is there and give each key's latest row; called again with the same folder it goes on where it ended.

    A micro-batch is a folder of its own that a replay replaces.
    """
    spark = changes.sparkSession
    folder = folder or stream_folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # what keyed state of this kind needs
    try:
        changes.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    rows = spark.read.schema(f"{changes.schema.simpleString()[7:-1].replace(':', ' ')}, batch long".replace(",", ", ")).parquet(f"{folder}/rows")
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*changes.columns), F.struct("batch", "closed")).alias("r"))
    return newest.select("r.*")
