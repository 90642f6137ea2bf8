"""Near-duplicate vectors found by counting collisions of one-dimensional projections.

Two unit vectors of cosine c are d = sqrt(2 - 2c) apart, so along a random direction they differ by a normal value of deviation d.
A table sorts the vectors of a label along one direction; a pair collides in it where the value of one lies in the window
of WINDOW * d around the other's. A single direction tells little apart, so a table first cuts a label into cells at the mean of
further directions, as many as the label's size asks for, and windows stay within cells. How many tables there are, and how many
collisions a pair needs, is calibrated on vectors of the data: partners at exactly the least cosine are drawn
for a bounded sample, and the largest count is taken that at least RECALL of these pairs reach.

A row of a table carries the values and cells of all tables, so a task that reads a window counts a pair's collisions in all
tables at once, and no pair is ever shuffled. The first table in which a pair collides decides on it; if the count suffices, the cosine
is computed in double precision from the vectors as given. A task hands out one count of links for each vector and a forest
of links, not pairs. A cell with more rows than a task should compare is dealt into blocks, and each pair of blocks is a task.
Equal vectors are one class and never meet each other; a class counts as many links as it has rows.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component, and rows without a label, link with
nothing; vectors of different lengths don't link; zero and minus zero are different texts of one vector, so they are
two classes, which link; rows of equal id are rows of their own; a null id is the least of a component only where there is no other; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, materialise, shuffle_partitions
from .simhash import components

#: Least cosine of a link; half width of a window in distances at that cosine.
LEAST_COSINE, WINDOW = 0.98, 2.0
#: Vectors that a cell should hold on average, and most that a task compares at once.
CELL, BLOCK = 1024, 4096
#: Share of pairs at the least cosine that must reach the count, rows that it is calibrated on, and tables to begin with.
RECALL, SAMPLE, TABLES = 0.999, 2000, 8
#: Collisions that a pair needs at least; a label's most cuts; bits of a cell's number below those of its table.
LEAST_COUNT, MOST_CUTS, CUT_BITS = 2, 40, 44
SEED = 13


def directions(dim: int, table: int) -> np.ndarray:
    """A table's directions: the one that it sorts by, and those of its cuts."""
    return np.random.default_rng([SEED, dim, table]).standard_normal((1 + MOST_CUTS, dim))


def place(centred: np.ndarray, cuts: np.ndarray, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Values (float32) and cells of vectors, one row a table; cuts: how many directions cut each vector's label."""
    values, cells = np.empty((tables, len(centred)), "<f4"), np.empty((tables, len(centred)), "<i8")
    most = int(cuts.max(initial=0))
    used = np.arange(most)[None, :] < cuts[:, None]
    for t in range(tables):
        along = centred @ directions(centred.shape[1], t)[: 1 + most].T
        values[t] = along[:, 0]
        cells[t] = ((along[:, 1:] > 0) & used) @ (1 << np.arange(most, dtype="int64"))
    return values, cells


def collide(values: np.ndarray, cells: np.ndarray, a, b, window: float) -> np.ndarray:
    """Whether the vectors at a and b collide in a table."""
    return (cells[a] == cells[b]) & (np.abs(values[a] - values[b]) <= np.float32(window))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one in double precision."""
    scaled = vectors.astype("f8")
    scaled /= np.abs(scaled).max(1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def calibrate(sample: list[tuple[np.ndarray, np.ndarray, int]], least: float) -> tuple[int, int]:
    """(tables, count): fewest tables where pairs at cosine `least` to the sampled (vector, label's mean, cuts) reach a count of
    LEAST_COUNT or more with probability RECALL, and the largest such count."""
    sums = {}
    rng = np.random.default_rng(SEED)
    for dim in {len(v) for v, _, _ in sample if len(v) > 1}:
        own = [s for s in sample if len(s[0]) == dim]
        one, means, cuts = unit(np.stack([s[0] for s in own])), np.stack([s[1] for s in own]), np.array([s[2] for s in own])
        away = rng.standard_normal(one.shape)
        away = unit(away - np.einsum("ij,ij->i", away, one)[:, None] * one)
        sums[dim] = (one - means, least * one + math.sqrt(1 - least * least) * away - means, cuts)
    window, tables = WINDOW * math.sqrt(2 - 2 * least), TABLES
    while True:
        counts = []
        for a, b, cuts in sums.values():
            values, cells = place(np.concatenate([a, b]), np.concatenate([cuts, cuts]), tables)
            n = np.arange(len(a))
            counts.append(sum(collide(v, c, n, n + len(a), window).astype("int64") for v, c in zip(values, cells)))
        counts = np.sort(np.concatenate(counts)) if counts else np.array([tables])
        count = int(counts[int((1 - RECALL) * len(counts))])
        if count >= LEAST_COUNT:
            return tables, count
        tables += 4


def vector_rows(df: DataFrame, id_col: str, label_col: str, vector_col: str, with_vectors: bool) -> DataFrame:
    """vec_id, label, dim, digest (null: links with nothing) and, if asked for, the vector's bytes."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    label_type = kinds[label_col].simpleString()
    width = "<f4" if kinds[vector_col].elementType.simpleString() == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, labels = batch.column("v"), batch.column("label")
            flat = vectors.flatten()
            sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype("int64")
            ends = np.cumsum(sizes)
            numbers = pc.fill_null(flat, math.nan).to_numpy(zero_copy_only=False).astype(width)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(numbers))))
            some = np.concatenate(([0], np.cumsum(numbers != 0)))
            fit = (bad[ends] == bad[ends - sizes]) & (some[ends] > some[ends - sizes]) & labels.is_valid().to_numpy(zero_copy_only=False)
            raw = [numbers[e - n : e].tobytes() if ok else None for e, n, ok in zip(ends.tolist(), sizes.tolist(), fit.tolist())]
            digests = pa.array([r if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary())
            arrays, names = [batch.column("vec_id"), labels, pa.array(sizes.astype("i4")), digests], ["vec_id", "label", "dim", "digest"]
            yield pa.record_batch(arrays + [pa.array(raw, pa.binary())] * with_vectors, names + ["vector"] * with_vectors)

    number = "float" if width == "<f4" else "double"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast(f"array<{number}>").alias("v"))
    return in_batches(rows).mapInArrow(run, f"vec_id long, label {label_type}, dim int, digest binary" + ", vector binary" * with_vectors)


def label_means(classes: DataFrame, width: str) -> DataFrame:
    """label, dim, cuts and the mean of the unit vectors, from partial sums that each task makes."""
    label_type = classes.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def partial() -> pa.RecordBatch:
            keys = list(sums)
            columns = [pa.array([k[0] for k in keys], kind), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k][0] for k in keys], pa.int64())]
            return pa.record_batch([*columns, pa.array([sums[k][1].tolist() for k in keys], pa.list_(pa.float64()))], ["label", "dim", "n", "sums"])

        for batch in batches:
            kind = batch.column("label").type
            for label, raw in zip(batch.column("label").to_pylist(), batch.column("vector").to_pylist()):
                vector = unit(np.frombuffer(raw, width)[None, :])[0]
                n, total = sums.get((label, len(vector)), (0, 0.0))
                sums[label, len(vector)] = (n + 1, total + vector)
            if len(sums) > 4096:  # many labels: what is summed so far goes on
                yield partial()
                sums.clear()
        if sums:
            yield partial()

    parts = in_batches(classes.select("label", "vector")).mapInArrow(run, f"label {label_type}, dim int, n long, sums array<double>")
    each = parts.select("label", "dim", "n", F.posexplode("sums").alias("at", "x")).groupBy("label", "dim", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    means = F.transform(F.array_sort(F.collect_list(F.struct("at", (F.col("x") / F.col("n")).alias("m")))), lambda s: s["m"]).alias("means")
    cuts = F.least(F.lit(MOST_CUTS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(CELL))))).cast("int").alias("cuts")
    return each.groupBy("label", "dim").agg(F.max("n").alias("n"), means).select("label", "dim", "means", cuts)


def table_rows(classes: DataFrame, width: str, tables: int) -> DataFrame:
    """A row for each class and table: label, dim, cell (with the table's number), x (the value sorted by), cls, copies, the values and cells of all tables, the vector."""
    label_type = classes.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                    vectors = np.frombuffer(b"".join(part.column("vector").to_pylist()), width).reshape(-1, dim)
                    means = part.column("means").flatten().to_numpy().reshape(-1, dim)
                    values, cells = place(unit(vectors) - means, part.column("cuts").to_numpy(), tables)
                    # Of each vector all cells, then all values.
                    signs = np.concatenate([np.ascontiguousarray(cells.T).view("u1"), np.ascontiguousarray(values.T).view("u1")], axis=1)
                    signs = pa.array([r.tobytes() for r in signs], pa.binary())
                    for t in range(tables):
                        arrays = [part.column("label"), part.column("dim"), pa.array(cells[t] | t << CUT_BITS), pa.array(values[t]), part.column("cls"), part.column("copies"), signs, part.column("vector")]
                        yield pa.record_batch(arrays, ["label", "dim", "cell", "x", "cls", "copies", "signs", "vector"])

    return in_batches(classes).mapInArrow(run, f"label {label_type}, dim int, cell long, x float, cls long, copies long, signs binary, vector binary")


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root after the links a-b: each place's least place within its component."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further


def group_links(group: pa.RecordBatch, width: str, tables: int, count: int, least: float) -> pa.RecordBatch:
    """Links among the rows of one cell of one table, sorted by x: (a, -1, links of a) and a forest (a, b, 0)."""
    dim, table = group.column("dim")[0].as_py(), group.column("cell")[0].as_py() >> CUT_BITS
    n, cls, copies = group.num_rows, group.column("cls").to_numpy(), group.column("copies").to_numpy()
    signs = np.frombuffer(b"".join(group.column("signs").to_pylist()), "u1").reshape(n, -1)
    cells = np.ascontiguousarray(np.ascontiguousarray(signs[:, : 8 * tables]).view("<i8").T)
    values = np.ascontiguousarray(np.ascontiguousarray(signs[:, 8 * tables :]).view("<f4").T)
    one = unit(np.frombuffer(b"".join(group.column("vector").to_pylist()), width).reshape(n, dim))
    window = WINDOW * math.sqrt(2 - 2 * least)
    # In a task of two blocks only rows of different blocks are compared.
    side = group.column("mine").to_numpy() if group.column("low")[0].as_py() != group.column("high")[0].as_py() else None
    x = values[table].astype("f8")
    ends = np.searchsorted(x, x + window + 1e-5, "right")
    sizes = ends - np.arange(n) - 1
    links, root = np.zeros(n, "int64"), np.arange(n)
    before, first = np.concatenate(([0], np.cumsum(sizes))), 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(before, before[first] + 200_000, "right")) - 1)
        own = sizes[first:last]
        a = np.repeat(np.arange(first, last), own)
        b = a + 1 + np.arange(len(a)) - np.repeat(before[first:last] - before[first], own)
        first = last
        if side is not None:
            keep = side[a] != side[b]
            a, b = a[keep], b[keep]
        for t in range(table):  # those that collide in a table before this are its pairs
            keep = ~collide(values[t], cells[t], a, b, window)
            a, b = a[keep], b[keep]
        met = np.zeros(len(a), "int64")
        for t in range(table, tables):
            met += collide(values[t], cells[t], a, b, window)
            if t == table:
                keep = met > 0
            else:
                keep = met + (tables - 1 - t) >= count
            if not keep.all():
                a, b, met = a[keep], b[keep], met[keep]
        for start in range(0, len(a), 1 << 15):
            p, q = a[start : start + (1 << 15)], b[start : start + (1 << 15)]
            near = np.einsum("ij,ij->i", one[p], one[q]) >= least
            p, q = p[near], q[near]
            links += np.bincount(p, copies[q], n).astype("int64") + np.bincount(q, copies[p], n).astype("int64")
            root = _joined(root, p, q)
    linked, moved = np.flatnonzero(links), np.flatnonzero(root != np.arange(n))
    a, b = np.concatenate([cls[linked], cls[moved]]), np.concatenate([np.full(len(linked), -1), cls[root[moved]]])
    return pa.record_batch([pa.array(a), pa.array(b), pa.array(np.concatenate([links[linked], np.zeros(len(moved), "int64")]))], ["a", "b", "links"])


#: Columns that make a group; the last three name its blocks.
GROUP = ("label", "dim", "cell", "low", "high")


def _groups(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """(rows, whether they belong to a group of more than `most` rows) from rows sorted by group; other groups come whole."""
    held, passing = None, False
    for batch in batches:
        rows = batch if held is None else pa.concat_batches([held, batch])
        changed = np.zeros(max(0, rows.num_rows - 1), bool)
        for name in GROUP:
            c = rows.column(name)
            changed |= pc.not_equal(c.slice(1), c.slice(0, max(0, len(c) - 1))).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(changed) + 1).tolist()]
        for s, e in zip(starts, starts[1:]):
            yield rows.slice(s, e - s), passing or bool(most and e - s > most)
            passing = False
        held = rows.slice(starts[-1])
        if most and (passing or held.num_rows > most):
            # The group goes on in the next batch: all but one row, which tells where it ends, are handed on now.
            if held.num_rows > 1:
                yield held.slice(1), True
            held, passing = held.slice(0, 1), True
    if held is not None and held.num_rows:
        yield held, passing or bool(most and held.num_rows > most)


def found_links(rows: DataFrame, width: str, tables: int, count: int, least: float, block: int) -> DataFrame:
    """a, b, links as of `group_links` for all cells of table_rows."""
    spark, of_rows = rows.sparkSession, [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields]
    schema = ", ".join(["a long", "b long", "links long", "mine int", "low int", "high int", *of_rows])

    def run(most: int | None):
        def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group, large in _groups(batches, most):
                names = group.schema.names
                if large:
                    empty = pa.nulls(group.num_rows, pa.int64())
                    yield pa.record_batch([empty, empty, empty, *group.columns], ["a", "b", "links", *names])
                elif group.num_rows > 1:
                    out = group_links(group, width, tables, count, least)
                    if out.num_rows:
                        yield pa.record_batch([*out.columns, *(pa.nulls(out.num_rows, group.schema.field(c).type) for c in names)], ["a", "b", "links", *names])

        return links

    def compared(df: DataFrame, most: int | None, name: str) -> DataFrame:
        ordered = df.repartition(shuffle_partitions(spark), *GROUP).sortWithinPartitions(*GROUP, "x")
        columns = ["mine", "low", "high", *rows.columns]
        return materialise(in_batches(ordered.select(*columns)).mapInArrow(run(most), schema), name)

    found = compared(rows.withColumns({"mine": F.lit(0), "low": F.lit(0), "high": F.lit(0)}), block, "vector-links")
    large, near = found.filter("a is null").select(*rows.columns), found.filter("a is not null").select("a", "b", "links")
    if not large.isEmpty():
        # Each row goes to the pairs of its block with every block of its cell.
        sizes = large.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
        dealt = large.join(sizes, ["label", "dim", "cell"]).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pairs = pairs.select("mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), *rows.columns)
        near = near.unionByName(compared(pairs, None, "vector-block-links").select("a", "b", "links"))
    return near


def near_duplicates(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", least: float = LEAST_COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links (rows linked directly), component_id (least id reachable), kept (it is its own) of every row.

    Rows of equal label link where their cosine is `least` or more. Every link that is given has been verified; of pairs at exactly
    that cosine at least RECALL are found by calibration, of nearer ones more.
    """
    spark, elements = df.sparkSession, df.schema[vector_col].dataType.elementType.simpleString()
    width, key = "<f4" if elements == "float" else "<f8", ["label", "dim", "digest"]
    told = vector_rows(df, id_col, label_col, vector_col, True).filter("digest is not null")
    grouped = told.groupBy(*key).agg(F.any_value("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    classes = materialise(grouped.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    means = materialise(label_means(classes, width), "vector-means")
    centred = classes.join(means, ["label", "dim"])
    sample = centred.orderBy(F.xxhash64("digest"), "cls").limit(SAMPLE).select("vector", "means", "cuts").collect()
    tables, count = calibrate([(np.frombuffer(r.vector, width), np.array(r.means), r.cuts) for r in sample], least)
    near = found_links(table_rows(centred.select("label", "dim", "cls", "copies", "vector", "means", "cuts"), width, tables), width, tables, count, least, block)
    links = near.filter("b < 0").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    roots = components(near.filter("b >= 0").select("a", "b").distinct()).withColumnsRenamed({"node": "cls"})
    rooted = classes.select(*key, "cls", "copies", "first_id").join(roots, "cls", "left").join(links, "cls", "left")
    rooted = materialise(rooted.withColumn("root", F.coalesce("root", "cls")), "vector-roots")
    least_ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_class = rooted.join(least_ids, "root").select(*key, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    every = vector_rows(df, id_col, label_col, vector_col, False).join(by_class, key, "left")
    out = every.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
