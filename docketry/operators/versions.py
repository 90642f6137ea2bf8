"""Tables in versions: writes that become current together, refused where they would undo another's, and what changed since.

A folder has the written versions of its tables and a log with one small file for each revision, which names the tables it replaced and
the paths of their new versions. A commit writes its versions first and then puts the next file of the log in place, which fails if another
writer was faster. So there is one order of revisions, a killed writer leaves nothing that is current, and a commit that names
the revision it read is refused with `Conflict` where a table that it writes or read was replaced since. Every COMPACTED revisions
the state is summed up in one file, from which readers start.

The log is metadata, a row a table and revision, and is read on the driver; rows of tables never are.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Revisions between two summed-up states.
COMPACTED = 20
LOG = "_log"


class Conflict(RuntimeError):
    """A table that a commit depends on was replaced after the revision that it read."""

    def __init__(self, tables: Iterable[str], revision: int):
        self.tables, self.revision = sorted(tables), revision
        super().__init__(f"{', '.join(self.tables)} changed up to revision {revision}")


@dataclass(frozen=True)
class Snapshot:
    """The current version of each table as of a revision; versions: name to (revision, path)."""

    folder: str
    revision: int = 0
    versions: dict[str, tuple[int, str]] = field(default_factory=dict)

    def paths(self) -> dict[str, str]:
        return {name: path for name, (_, path) in self.versions.items()}

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(self.versions[name][1])


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, folder: str) -> list[str]:
    where, files = _files(spark, f"{folder}/{LOG}")
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def _text(spark: SparkSession, path: str) -> str:
    where, files = _files(spark, path)
    stream = files.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, content: str) -> bool:
    """Put a whole file in place, or leave the one that is there and say so; no reader sees a part of it."""
    temporary = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
    where, files = _files(spark, temporary)
    stream = files.create(where, False)
    stream.write(bytearray(content.encode()))
    stream.close()
    target = _files(spark, path)[0]
    try:
        if files.getScheme() == "file":  # a local rename replaces; a link doesn't
            paths = spark._jvm.java.nio.file.Path.of
            link = spark._jvm.java.nio.file.Files.createLink
            link(paths(spark._jvm.java.net.URI(f"file://{target.toUri().getPath()}")), paths(spark._jvm.java.net.URI(f"file://{where.toUri().getPath()}")))
            return True
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
        context.rename(where, target, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception as e:
        if files.exists(target):
            return False
        raise e
    finally:
        files.delete(where, False)


def _entries(spark: SparkSession, folder: str, after: int) -> list[dict]:
    names = [n for n in _listed(spark, folder) if n.endswith(".json") and int(n[:-5]) > after]
    return [json.loads(_text(spark, f"{folder}/{LOG}/{n}")) for n in names]


def snapshot(spark: SparkSession, folder: str, at: int | None = None) -> Snapshot:
    """The state as of a revision, the newest unless one is named."""
    sums = [int(n[:-4]) for n in _listed(spark, folder) if n.endswith(".sum") and (at is None or int(n[:-4]) <= at)]
    revision, versions = 0, {}
    if sums:
        held = json.loads(_text(spark, f"{folder}/{LOG}/{max(sums):012d}.sum"))
        revision, versions = held["revision"], {k: tuple(v) for k, v in held["versions"].items()}
    for entry in _entries(spark, folder, revision):
        if at is not None and entry["revision"] > at:
            break
        revision = entry["revision"]
        versions |= {name: (revision, path) for name, path in entry["paths"].items()}
    return Snapshot(folder, revision, versions)


def commit(spark: SparkSession, folder: str, tables: dict[str, DataFrame], read: Snapshot | None = None, also_read: Iterable[str] = ()) -> int:
    """Write new versions of tables and make all of them current at once; the new revision.

    read: the snapshot that the versions were made from; without it nothing was read, and tables that exist are replaced.
    also_read: further tables whose rows went into them. Raises Conflict if one of these was replaced since.
    """
    where, files = _files(spark, f"{folder}/{LOG}")
    files.mkdirs(where)
    paths = {name: f"{folder}/{name}/{uuid.uuid4().hex}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(paths[name])
    while True:
        now = snapshot(spark, folder)
        if read is not None:
            newer = {n for n in {*tables, *also_read} if now.versions.get(n, (0, ""))[0] > read.revision}
            if newer:
                for path in paths.values():
                    old, files = _files(spark, path)
                    files.delete(old, True)
                raise Conflict(newer, now.revision)
        revision = now.revision + 1
        if _put(spark, f"{folder}/{LOG}/{revision:012d}.json", json.dumps({"revision": revision, "paths": paths})):
            break
    if revision % COMPACTED == 0:
        held = snapshot(spark, folder, revision)
        _put(spark, f"{folder}/{LOG}/{revision:012d}.sum", json.dumps({"revision": held.revision, "versions": held.versions}))
    return revision


def transact(spark: SparkSession, folder: str, make: Callable[[Snapshot], dict[str, DataFrame]], also_read: Iterable[str] = (), tries: int = 10) -> int:
    """Commit what make(snapshot) gives; after a conflict it is made again from the newer state."""
    while True:
        read = snapshot(spark, folder)
        try:
            return commit(spark, folder, make(read), read, also_read)
        except Conflict:
            tries -= 1
            if not tries:
                raise


def changes_since(spark: SparkSession, folder: str, revision: int) -> DataFrame:
    """revision, name, path of every replaced table after a revision, oldest first: what a reader of that revision has missed."""
    rows = [(e["revision"], name, path) for e in _entries(spark, folder, revision) for name, path in e["paths"].items()]
    return spark.createDataFrame(rows, "revision long, name string, path string").orderBy("revision", "name")


def row_changes(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The keys of all rows that differ between two versions, change (inserted, updated, deleted), and the columns that differ.

    Keys are unique in either version; a null equals a null. Columns that only one version has count as null in the other.
    """
    columns = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    of = lambda df, c: F.col(c) if c in df.columns else F.lit(None)
    before = old.select(*keys, F.struct(F.lit(True).alias("_in"), *[of(old, c).alias(c) for c in columns]).alias("_old"))
    after = new.select(*keys, F.struct(F.lit(True).alias("_in"), *[of(new, c).alias(c) for c in columns]).alias("_new"))
    joined = before.join(after, list(keys), "full")
    differs: list[Column] = [F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), F.lit(c)) for c in columns]
    changed = F.array_compact(F.array(*differs)) if columns else F.array().cast("array<string>")
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "deleted").when(F.size(changed) > 0, "updated")
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    return joined.select(*keys, change.alias("change"), F.when(both, changed).alias("columns")).filter("change is not null")


def discard_unused(spark: SparkSession, folder: str, keep: int) -> int:
    """Remove written versions that neither the newest state nor any of the `keep` revisions before it names; how many went.

    Versions of commits under way are not told from those of killed writers, so this is for times without writers.
    """
    newest = snapshot(spark, folder)
    used = {p for r in range(max(0, newest.revision - keep), newest.revision + 1) for p in snapshot(spark, folder, r).paths().values()}
    gone = 0
    top, files = _files(spark, folder)
    for table in files.listStatus(top):
        if table.isDirectory() and not table.getPath().getName().startswith("_"):
            for version in files.listStatus(table.getPath()):
                name = f"{folder}/{table.getPath().getName()}/{version.getPath().getName()}"
                if name not in used:
                    files.delete(version.getPath(), True)
                    gone += 1
    return gone
