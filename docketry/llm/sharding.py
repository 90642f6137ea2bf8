"""Contiguous shards of near-equal bytes, from prefix sums of sizes.

The rows are put in order once by a range shuffle of narrow rows (the texts stay where they are).
Each partition adds up its own sizes; one total per partition goes to the driver, whose running
sum gives each partition its offset, and the global running sum is cut at equal targets.

Defined cases: a null text has no bytes and the checksum of the empty text; a null id sorts first;
rows with equal ids keep the order in which they were read; an empty table gives an empty result;
other columns are ignored unless they are named in `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, shuffle_partitions


def _running(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bytes and rows before each row of the task's partition."""
    n_bytes = n_rows = 0
    for frame in frames:
        sums = frame["size"].cumsum()
        yield frame.assign(_before=n_bytes + sums - frame["size"], _row=range(n_rows, n_rows + len(frame)))
        n_bytes, n_rows = n_bytes + int(frame["size"].sum()), n_rows + len(frame)


def assign_shards(df: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, and the columns in keep (as kept_<name>).

    A row belongs to the shard in whose equal share of all bytes its middle byte falls, so shards
    are contiguous in the order of ids and differ by less than the largest row.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[F.col(c).alias(f"kept_{c}") for c in keep],
    ).withColumn("_seq", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(shuffle_partitions(spark), "doc_id", "_seq").sortWithinPartitions("doc_id", "_seq").drop("_seq").withColumn("_part", F.spark_partition_id())
    ordered = materialise(ordered.mapInPandas(_running, T.StructType([*ordered.schema, T.StructField("_before", T.LongType()), T.StructField("_row", T.LongType())])), "sharding")
    totals = sorted(ordered.groupBy("_part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect())  # one row a partition
    whole = max(1, sum(t.b for t in totals))
    offsets = spark.createDataFrame(
        list(zip([t[0] for t in totals], accumulate([0, *[t.b for t in totals]]), accumulate([0, *[t.n for t in totals]]))),
        "_part int, _bytes0 long, _row0 long",
    )
    placed = ordered.join(F.broadcast(offsets), "_part").select(
        *[c for c in ordered.columns if c[0] != "_"],
        (F.col("_row") + F.col("_row0")).alias("_rank"),
        F.expr(f"cast(least({shards - 1}, (2 * (_before + _bytes0) + size) * {shards} div (2 * {whole}L)) as int)").alias("shard"),
    )
    firsts = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row a shard
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_rank") - F.col("_first")).drop("_rank", "_first")


def write_shards(df: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write df's rows as one folder a shard, each in the order of its slots; df's own columns `shard` and `slot` become `own_shard` and `own_slot`."""
    placed = assign_shards(df, shards, id_col=id_col, text_col=text_col, keep=tuple(df.columns))
    rows = placed.select("shard", "slot", *[F.col(f"kept_{c}").alias(f"own_{c}" if c in ("shard", "slot") else c) for c in df.columns])
    rows.repartitionByRange(max(shards, shuffle_partitions(df.sparkSession)), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
