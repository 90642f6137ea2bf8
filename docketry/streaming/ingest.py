"""Incremental ingest as streams: a look-back window with idempotent re-reads, and upserts per micro-batch."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.merge import last_by_key, upsert

OVERLAP_DAYS = 7


def fetch_range(rows: DataFrame, first_run: date, today: date, overlap_days: int = OVERLAP_DAYS) -> DataFrame:
    """start, stop of the next fetch by dataset: some days before the last date seen, or the first run's start."""
    last = F.max(F.nullif(F.col("date"), F.lit("")).try_cast("date"))
    start = F.coalesce(F.date_sub(last, overlap_days), F.lit(first_run))
    return rows.groupBy("dataset").agg(F.least(start, F.lit(today)).alias("start"), F.lit(today).alias("stop"))


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream; time stamps without zone are taken as UTC."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, keys: tuple[str, ...] = ("event_id",), overlap: timedelta = timedelta(days=OVERLAP_DAYS)) -> DataFrame:
    """Each key once within the look-back."""
    return events.withWatermark("ts", f"{overlap.days} days").dropDuplicatesWithinWatermark(list(keys))


def daily(events: DataFrame) -> DataFrame:
    """Events and their value by day and kind; a day is given out once the watermark has passed it."""
    return events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "events", "value")


def stream_folder(spark: SparkSession) -> str:
    """A new folder for a stream's state: under the shared folder that the session names, a local one only where it names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{named.rstrip('/')}/stream-{uuid.uuid4().hex}" if named else tempfile.mkdtemp(prefix="spark-stream-")


def drain(df: DataFrame) -> DataFrame:
    """Run a stream over all that is there into Parquet files of the shared folder, and read these."""
    folder = stream_folder(df.sparkSession)
    query = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")


class Progress(StreamingQueryListener):
    """Counts what the session's streams have read, and stops a stream after a batch when `cancelled` says so."""

    def __init__(self, spark: SparkSession, cancelled: Callable[[], bool] = lambda: False):
        self.spark, self.rows, self.batches, self.cancelled, self.stopped = spark, 0, 0, cancelled, set()

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self.rows, self.batches = self.rows + event.progress.numInputRows, self.batches + 1
        own = str(event.progress.id)
        if own not in self.stopped and self.cancelled():
            self.stopped.add(own)
            # Stopping waits for the stream's thread, which may wait for this one.
            threading.Thread(target=self._stop, args=(own,), daemon=True).start()

    def _stop(self, own: str) -> None:
        for query in self.spark.streams.active:
            if str(query.id) == own:
                query.stop()

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


def upsert_stream(records: DataFrame, load: Callable[[], DataFrame], store: Callable[[DataFrame, int], None], checkpoint: str, skip: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """Merge each micro-batch into a table: of a key's records the one of the greatest `seq` (a column that the records must have) wins and the status lattice holds.

    `load` gives the current version, `store(version, batch)` puts the next one in place and must be idempotent by
    batch number, as a batch may be replayed. Keys of `skip` (already landed) are left out.
    """

    def merge(batch: DataFrame, number: int) -> None:
        if skip is not None:
            batch = batch.join(skip().select("dataset", "case_id"), ["dataset", "case_id"], "left_anti")
        store(upsert(load(), last_by_key(batch).drop("seq")), number)

    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
