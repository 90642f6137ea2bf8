"""The bridge of cases and tags kept up to date from changes: only the buckets of changed keys are read and written.

The bridge is a Parquet table in folders by bucket, a hash of the key. A change set has the keys that were written or removed and their
raw tags; the links of these keys are replaced, as a rebuild from all summaries would, and no file of another bucket is touched. The same
changes applied twice give the same bridge, so a run that was cut off is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .merge import KEYS, replace_bridge, upsert

#: Buckets of a new bridge; their number holds as long as the table does.
BUCKETS = 64


def bucket_of(buckets: int, keys: tuple[str, ...] = KEYS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write(links: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """A new bridge from links (dataset, case_id, violation)."""
    links.distinct().withColumn("bucket", bucket_of(buckets)).repartition("bucket").write.partitionBy("bucket").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("dataset string, case_id string, violation string, bucket int").parquet(folder)


def apply(spark: SparkSession, folder: str, changes: DataFrame, tags: Column, buckets: int = BUCKETS) -> int:
    """Replace the links of the keys in changes (dataset, case_id and what tags needs); how many buckets were written.

    A key without tags, or whose summary went, loses its links. The buckets of a change set, at most `buckets`, reach the driver. New
    buckets are written beside the table first and then put in the place of the old ones, so nothing is read while it is replaced.
    """
    told = changes.withColumn("bucket", bucket_of(buckets))
    touched = [r.bucket for r in told.select("bucket").distinct().collect()]
    if not touched:
        return 0
    old = read(spark, folder).filter(F.col("bucket").isin(touched))  # prunes folders
    links = changes.select(*KEYS, F.explode(tags).alias("violation"))
    new = replace_bridge(old.drop("bucket"), changes, links).withColumn("bucket", bucket_of(buckets))
    staged = f"{folder.rstrip('/')}-staged"
    new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(staged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    spark.read.schema("dataset string, case_id string, violation string, bucket int").parquet(staged).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    for bucket in touched:  # dynamic overwrite leaves what has no new rows
        if not files.exists(path(f"{staged}/bucket={bucket}")):
            files.delete(path(f"{folder}/bucket={bucket}"), True)
    files.delete(path(staged), True)
    return len(touched)


def set_violation_type(summaries: DataFrame, bridge: DataFrame, new: DataFrame, tags: Column) -> dict[str, DataFrame]:
    """New versions of summaries and bridge where the cases of new (dataset, case_id, violation_type) get that type and its links; cases without a summary stay without.

    Both are to be committed together. Of a case's several new types the greatest counts.
    """
    one = new.groupBy(*KEYS).agg(F.max("violation_type").alias("violation_type"))
    held = one.join(summaries.select(*KEYS), list(KEYS), "left_semi")
    links = held.select(*KEYS, F.explode(tags).alias("violation"))
    return {"summaries": upsert(summaries, held, rules={}), "case_violations": replace_bridge(bridge, held, links)}
