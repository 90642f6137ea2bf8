"""Paged list sources: landed pages as a batch and as a stream, and the rules by which a scan of pages ends.

A page is landed as `<folder>/source=<name>/page=<number>/` with one text file: a JSON array of items (title, link_url,
date), newest first. An empty array is a page without items; a page that couldn't be had is landed as an empty file, or is
missing. `PagedSource` reads such folders by ranges of pages, and as a stream whose offset is the next page of each source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

ITEMS = "array<struct<title: string, link_url: string, date: string>>"
#: Pages that one task reads; pages that a scan reads at most; unavailable pages in a row that end it.
PAGES_A_TASK, MOST_PAGES, MOST_FAILURES = 50, 500, 3


def land(pages: DataFrame, folder: str) -> None:
    """Write pages (source, page, body) in the form that PagedSource reads; a null body is an unavailable page."""
    pages.select("source", "page", F.coalesce("body", F.lit("")).alias("value")).repartition("source", "page").write.mode("append").partitionBy("source", "page").text(folder)


class _Pages(InputPartition):
    def __init__(self, source: str, first: int, stop: int):
        self.source, self.first, self.stop = source, first, stop


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return (pafs.LocalFileSystem(), folder) if "://" not in folder and not folder.startswith("file:") else pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def _landed(folder: str) -> dict[str, int]:
    """The greatest page of each source; one entry a folder reaches the driver."""
    files, top = _opened(folder)
    found: dict[str, int] = {}
    if files.get_file_info(top).type == pafs.FileType.NotFound:
        return found
    for source in files.get_file_info(pafs.FileSelector(top)):
        if m := re.fullmatch(r"source=(.*)", source.base_name):
            pages = [int(p.base_name[5:]) for p in files.get_file_info(pafs.FileSelector(source.path)) if re.fullmatch(r"page=\d+", p.base_name)]
            if pages:
                found[m[1]] = max(pages)
    return found


def _read(folder: str, part: _Pages) -> Iterator[tuple[str, int, str | None]]:
    files, top = _opened(folder)
    for page in range(part.first, part.stop):
        where, body = f"{top}/source={part.source}/page={page}", None
        if files.get_file_info(where).type == pafs.FileType.Directory:
            for name in sorted(f.path for f in files.get_file_info(pafs.FileSelector(where)) if f.base_name.startswith("part-")):
                with files.open_input_stream(name) as stream:
                    body = (body or "") + stream.read().decode()
        yield part.source, page, (body or "").rstrip("\n") or None


def _ranges(first: dict[str, int], stop: dict[str, int], size: int) -> list[_Pages]:
    return [_Pages(s, at, min(at + size, end)) for s, end in sorted(stop.items()) for at in range(first.get(s, 1), end, size)]


class PagedSource(DataSource):
    """Rows (source, page, body) of landed pages, numbered from 1; options: path, pagesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "source string, page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options["path"], int(self.options.get("pagesPerTask", PAGES_A_TASK)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedStreamReader(self.options["path"], int(self.options.get("pagesPerTask", PAGES_A_TASK)))


class PagedReader(DataSourceReader):
    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size

    def partitions(self) -> list[_Pages]:
        return _ranges({}, {s: p + 1 for s, p in _landed(self.folder).items()}, self.size)

    def read(self, partition: _Pages) -> Iterator[tuple]:
        return _read(self.folder, partition)


class PagedStreamReader(DataSourceStreamReader):
    """An offset holds the next page of each source, so a resumed stream reads each page once."""

    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {s: p + 1 for s, p in sorted(_landed(self.folder).items())}

    def partitions(self, start: dict, end: dict) -> list[_Pages]:
        return _ranges(start, end, self.size)

    def read(self, partition: _Pages) -> Iterator[tuple]:
        return _read(self.folder, partition)

    def commit(self, end: dict) -> None: ...


def read_pages(spark: SparkSession, folder: str, pages_a_task: int = PAGES_A_TASK) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").option("path", folder).option("pagesPerTask", pages_a_task).load()


def stream_pages(spark: SparkSession, folder: str, pages_a_task: int = PAGES_A_TASK) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.readStream.format("paged").option("path", folder).option("pagesPerTask", pages_a_task).load()


def page_items(pages: DataFrame) -> DataFrame:
    """source, page, at (place on the page), title, link_url, date of all items; items without a link go."""
    items = pages.select("source", "page", F.posexplode(F.from_json("body", ITEMS)).alias("at", "item"))
    return items.select("source", "page", "at", "item.*").filter("link_url <> ''")


def stops(pages: DataFrame, start: str, most_pages: int = MOST_PAGES, most_failures: int = MOST_FAILURES) -> DataFrame:
    """source, page, reason: where the scan of each source ends. Pages beyond are not looked at.

    end: an available page without items; old: all items have a date before start; seen: every link was on an earlier page; cap: the
    number of pages; failures: so many pages in a row were unavailable (null, or no JSON array). On one page the first of these
    counts. A source whose pages meet no rule has no row. Each rule is a sum or a minimum by page, so a source with most pages is no hot key.
    """
    listed = F.from_json("body", ITEMS)
    told = pages.select("source", "page", F.size(listed).alias("n"), listed.isNull().alias("missing"))
    items = page_items(pages)
    day = F.col("date").try_cast("date")
    current = items.filter(day.isNull() | (day >= F.lit(start).cast("date"))).groupBy("source", "page").agg(F.lit(True).alias("current"))
    fresh = items.groupBy("source", "link_url").agg(F.min("page").alias("page")).groupBy("source", "page").agg(F.lit(True).alias("fresh"))
    facts = told.join(current, ["source", "page"], "left").join(fresh, ["source", "page"], "left")
    reasons = [("end", ~F.col("missing") & (F.col("n") == 0)), ("old", (F.col("n") > 0) & F.col("current").isNull()), ("seen", (F.col("n") > 0) & F.col("fresh").isNull()), ("cap", F.col("page") >= most_pages)]
    which = F.coalesce(*[F.when(rule, F.lit(k)) for k, (_, rule) in enumerate(reasons)])
    met = facts.select("source", "page", which.alias("which")).filter("which is not null")
    # A missing page counts for itself and the next ones; where all of a row of pages count, the row ends.
    ahead = told.filter("missing").select("source", F.explode(F.array(*[F.col("page") + k for k in range(most_failures)])).alias("page"))
    failed = ahead.groupBy("source", "page").agg(F.count("*").alias("k")).filter(F.col("k") == most_failures).select("source", "page", F.lit(len(reasons)).alias("which"))
    first = met.unionByName(failed).groupBy("source").agg(F.min(F.struct("page", "which")).alias("first"))
    names = F.array(*[F.lit(r) for r, _ in reasons], F.lit("failures"))
    return first.select("source", F.col("first.page").alias("page"), F.get(names, F.col("first.which")).alias("reason"))


def scan(pages: DataFrame, start: str, stop: str, most_pages: int = MOST_PAGES, most_failures: int = MOST_FAILURES) -> DataFrame:
    """source, link_url, title, date, page of the links up to where each source's scan ends, within the dates; undated ones pass.

    A link that occurs several times counts where it stands first, by page and place.
    """
    ends = stops(pages, start, most_pages, most_failures).select("source", F.col("page").alias("_end"))
    read = page_items(pages).join(ends, "source", "left").filter("_end is null or page <= _end")
    first = read.groupBy("source", "link_url").agg(F.min(F.struct("page", "at", "title", "date")).alias("i")).select("source", "link_url", "i.title", "i.date", "i.page")
    day = F.col("date").try_cast("date")
    return first.filter(day.isNull() | day.between(F.lit(start).cast("date"), F.lit(stop).cast("date")))
