"""Sources and sinks: Parquet tables, landed list pages and API answers, CSV and JSON exports."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.html import page_facts
from ..functions.text import first_filled
from ..schemas import conform

BOM = "\ufeff"


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table with exactly the schema's columns, whatever its files hold."""
    return conform(spark.read.option("mergeSchema", "true").parquet(path), schema)


def list_pages(pages: DataFrame, start: str, stop: str) -> DataFrame:
    """Links of landed list pages within the dates, newest first; a link without a date passes. A page that says 404 has none."""
    items = page_facts(pages).filter("not soft_404").select("page_id", F.explode("items").alias("item")).select("page_id", "item.*")
    day = F.col("date").try_cast("date")
    return items.filter(day.isNull() | day.between(F.lit(start).cast("date"), F.lit(stop).cast("date"))).dropDuplicates(["link_url"])


def api_links(answers: DataFrame, c: str = "body") -> DataFrame:
    """title, link_url, date from API answers in JSON lines, whose fields go by several names."""
    get = lambda *names: first_filled(*[F.get_json_object(c, f"$.{n}") for n in names])
    return answers.select(get("title", "name").alias("title"), get("url", "linkUrl", "href").alias("link_url"), F.substring(get("publishedTimeStr", "date", "time"), 1, 10).alias("date"))


class Fetcher(Protocol):
    def get(self, url: str) -> str | None: ...


def fetch(links: DataFrame, fetcher: Callable[[], Fetcher], url_col: str = "link_url") -> DataFrame:
    """links with body from an injected fetcher, one for each task; a failed fetch is null."""
    names = list(links.columns)

    def run(frames: Iterator) -> Iterator:
        own = fetcher()
        for frame in frames:
            yield frame.assign(body=[own.get(u) for u in frame[url_col]])

    return links.mapInPandas(run, T.StructType([*links.schema, T.StructField("body", T.StringType())])).select(*names, "body")


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header that spreadsheet programs read as UTF-8; for results, not for tables."""
    first, *rest = df.columns
    df.withColumnsRenamed({first: BOM + first}).coalesce(1).write.option("header", "true").csv(path)


def to_json(df: DataFrame) -> DataFrame:
    """Each row as JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def task_params(tasks: DataFrame, c: str = "params") -> DataFrame:
    """JSON parameters as a map; what is no object is an empty one."""
    return tasks.withColumn(c, F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>")))
