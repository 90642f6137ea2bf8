"""Best-fit packing of token sequences into few bins of one capacity.

Lengths are whole numbers up to the capacity, so how pieces combine depends only on how many there are
of each length. That histogram, with one entry a length at most, is planned on the driver: pieces above a
third of the capacity meet at most in pairs, each with the longest partner that still fits; the shorter
ones then fill the gaps, longest first, each into the smallest gap that takes it. The plan is a
list of runs (length, first rank, how many, first bin, offset), whose number depends on the capacity and
not on the data. Tasks number the pieces of each length and look their place up in the plan.

The numbering is spread out: pieces of one length are numbered within many salts, and the salts' sizes
give the start of each, so that a length that holds a third of all pieces is no single group.

Defined cases: a null text is empty and gives the end token alone; longer documents than the capacity
are cut, into pieces of full capacity and a rest; equal ids or texts are packed each for itself; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, materialise, shuffle_partitions, slices

CAPACITY, END_ID = 4096, 1
#: Most bytes of words and ids that a worker process remembers from task to task; frequent words come early, so later ones are not kept.
REMEMBERED = 128 << 20
#: Stands between words that are encoded together: a pre-token of its own, with one id. Words that hold it are encoded alone.
MARK = "\x01"
#: Words that are encoded together.
TOGETHER = 128


def word_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """From texts to packed ids, as the library gives them without the tokens it adds itself.

    The vocabulary's pre-tokens and added tokens never span an ASCII blank, so words are encoded once and remembered
    up to a bound of bytes.
    """
    import tokenizers

    model = tokenizers.Tokenizer.from_file(path)
    (mark,) = model.encode(MARK, add_special_tokens=False).ids
    known: dict[bytes, bytes] = {}
    held = 0

    def ids_of(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in model.encode_batch_fast(texts, add_special_tokens=False)]

    def of_words(words: list[bytes]) -> dict[bytes, bytes]:
        alone = [w for w in words if MARK.encode() in w]
        plain = [w for w in words if MARK.encode() not in w]
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        out = {w: ids.tobytes() for w, ids in zip(alone, ids_of([w.decode() for w in alone]))}
        for group, ids in zip(groups, ids_of([f" {MARK} ".join(w.decode() for w in g) for g in groups])):
            at = np.flatnonzero(ids == mark)
            for w, first, last in zip(group, [0, *(at + 1).tolist()], [*at.tolist(), len(ids)]):
                out[w] = ids[first:last].tobytes()
        return out

    def encode(texts: list[str]) -> list[bytes]:
        nonlocal held
        words = [t.encode().split() for t in texts]
        fresh = of_words(list(set().union(*words).difference(known)))
        size = sum(map(len, fresh)) + sum(map(len, fresh.values())) + 170 * len(fresh)  # with what objects and places take
        if held + size <= REMEMBERED:
            held += size
            known.update(fresh)
            return [b"".join(map(known.__getitem__, ws)) for ws in words]
        return [b"".join([known[w] if w in known else fresh[w] for w in ws]) for ws in words]

    return encode


@cache
def kept_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """The encoder of a worker process: its tasks run one after another and share what it remembers, which is bounded."""
    return word_encoder(path)


def pieces(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every row."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = kept_encoder(tokenizer_path)
        for batch in slices(batches, "text"):
            out: list[list] = [[], [], [], [], []]
            parts = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                ids += end
                for n, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    for column, value in zip(out, (doc_id, n, start // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
                    if with_ids:
                        parts.append(part)
            columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *[pa.array(x, pa.int64()) for x in out[2:]]]
            yield pa.record_batch([*columns, *([pa.array(parts, pa.binary())] if with_ids else [])], ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return in_batches(rows).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, how many, first bin, offset) that place counts[length] pieces of each length.

    Bins that hold the same so far are kept as runs of bins by their gap, so each step moves a whole run.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    left = {n: c for n, c in counts.items() if c}
    used: dict[int, int] = {}
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first bin, how many)
    bins = 0

    def put(length: int, many: int, first_bin: int, offset: int) -> None:
        runs.append((length, used.get(length, 0), many, first_bin, offset))
        used[length] = used.get(length, 0) + many
        left[length] -= many
        if not left[length]:
            del left[length]

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        length = large[-1]
        k = bisect.bisect_right(large, capacity - length) - 1
        partner = large[k] if k >= 0 else 0
        many = left[length] if not partner else left[length] // 2 if partner == length else min(left[length], left[partner])
        if not many:  # one piece is left that would pair with its like: the next shorter one takes its place
            partner = large[k - 1] if k > 0 else 0
            many = 1
        put(length, many, bins, 0)
        if partner:
            put(partner, many, bins, length)
        gaps.setdefault(capacity - length - partner, []).append((bins, many))
        bins += many
        for n in {length, partner} - {0} - set(left):
            large.remove(n)
    open_gaps = sorted(gaps)
    for length in sorted(left, reverse=True):
        while length in left:
            k = bisect.bisect_left(open_gaps, length)
            if k == len(open_gaps):  # nothing takes it: new bins, filled with as many of this length as fit
                each = min(capacity // length, left[length])
                many = left[length] // each
                for place in range(each):
                    put(length, many, bins, place * length)
                gap, run = capacity - each * length, (bins, many)
                bins += many
            else:
                gap = open_gaps[k]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], open_gaps[k]
                if many > left[length]:
                    _add(gaps, open_gaps, gap, (first + left[length], many - left[length]))
                    many = left[length]
                put(length, many, first, capacity - gap)
                gap, run = gap - length, (first, many)
            if gap:
                _add(gaps, open_gaps, gap, run)
    return runs


def _add(gaps: dict, open_gaps: list[int], gap: int, run: tuple[int, int]) -> None:
    if gap not in gaps:
        bisect.insort(open_gaps, gap)
        gaps[gap] = []
    gaps[gap].append(run)


def pack(cut: DataFrame, capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """cut (with a column length, 1 to capacity) with sequence_id and offset; its other columns stay, whatever their names, but for those two."""
    spark = cut.sparkSession
    salts = salts or 4 * shuffle_partitions(spark)
    rows = cut.select(F.struct(*cut.columns).alias("_row"), "length").withColumn("_salt", (F.monotonically_increasing_id() % salts).cast("int"))
    rows = materialise(rows, "pieces")
    sizes = rows.groupBy("length", "_salt").agg(F.count("*").alias("_many"))
    before = F.sum("_many").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    sizes = materialise(sizes.withColumn("_first", F.coalesce(before, F.lit(0))), "piece-lengths")
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("_many").alias("n")).collect()}  # one row a length
    runs = sorted(plan(counts, capacity))
    # One row a length, with its runs in order of rank: at most `capacity` rows.
    by_length: dict[int, list] = {}
    for length, *run in runs:
        by_length.setdefault(length, []).append(run)
    shared = spark.sparkContext.broadcast({n: np.array(r, "int64") for n, r in by_length.items()})

    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(F.monotonically_increasing_id())))
    ranked = ranked.join(sizes.select("length", "_salt", "_first"), ["length", "_salt"]).withColumn("_rank", F.col("_first") + F.col("_n") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            bins, offsets = np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64")
            order = np.argsort(lengths, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
                own = table[int(lengths[part[0]])]
                k = np.searchsorted(own[:, 0], ranks[part], "right") - 1
                bins[part], offsets[part] = own[k, 2] + ranks[part] - own[k, 0], own[k, 3]
            yield pa.record_batch([batch.column("_row"), pa.array(bins), pa.array(offsets)], ["_row", "sequence_id", "offset"])

    placed = ranked.select("_row", "length", "_rank").mapInArrow(place, T.StructType([rows.schema["_row"]]).add("sequence_id", "long").add("offset", "long"))
    return placed.select(*[F.col("_row")[c].alias(c) for c in cut.columns if c not in ("sequence_id", "offset")], "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids (binary) of each sequence, from packed pieces with their ids; a sequence holds one capacity at most."""
    joined = F.expr("unhex(array_join(transform(array_sort(collect_list(struct(offset, ids))), x -> hex(x.ids)), ''))")
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))
