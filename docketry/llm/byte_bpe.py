"""Byte-level BPE: encoding by overlapping chunks, decoding by concatenated bytes.

Short texts are one chunk. A long text is cut into chunks that overlap; tasks find the pre-token
boundaries of the chunks independently. A boundary is a fresh start for the pattern (it never looks
back), so where two neighbours agree on a boundary in their overlap, the right one has come into step
with the left one and the chunks are cut there. The pieces between two cuts are then encoded.
Should a pre-token be longer than the overlap, so that no boundary is shared, the document's chunks
are put together again and it is encoded as one piece.

Defined cases: a null text is the empty text, which has no tokens; rows with equal ids or texts are
encoded each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, materialise, slices

#: Code points of a chunk, and of the part that it shares with the next one.
CHUNK, OVERLAP = 32_768, 1_024
#: A boundary this near to a chunk's end may still move, as the pattern looks a few characters ahead.
AHEAD = 4
#: Most bytes of pre-tokens and ids that a task remembers; frequent ones come early, so later ones are not kept.
REMEMBERED = 32 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a rank file of lines `base64 id`."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank is merged first, the leftmost at ties."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))  # a part is known by its start
    alive = [True] * n
    heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n and (rank := ranks.get(piece[i : end[end[i]]])) is not None:
            heapq.heappush(heap, (rank, i, end[end[i]]))

    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        alive[end[i]] = False
        end[i] = stop
        if stop < n:
            left[stop] = i
        offer(left[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Remembered(dict):
    """Pre-token to its ids as little-endian unsigned 32-bit integers; filled as asked, bounded."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.held = ranks, 0

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", merge(piece.encode(), self.ranks)).tobytes()
        if self.held < REMEMBERED and len(piece) <= 64:
            self.held += 4 * len(piece) + len(ids) + 190  # with what objects and places take
            self[piece] = ids
        return ids


def encoder(path: str, pattern: str) -> Callable[[str], bytes]:
    """A function from text to packed ids; a task makes its own, and what it remembers goes with it."""
    find, known = regex.compile(pattern).findall, Remembered(load_ranks(path))
    look = known.__getitem__
    return lambda text: b"".join(map(look, find(text)))


def boundaries(text: str, find: Callable, start: int, stop: int) -> list[int]:
    """Ends of the pre-tokens of text within start..stop."""
    return [m.end() for m in find(text) if start <= m.end() <= stop]


def _encode_rows(path: str, pattern: str, keys: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern)
        for batch in slices(batches, "text"):
            ids = [encode(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([*[batch.column(k) for k in keys], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], [*keys, "n_tokens", "ids"])

    return run


def _chunk_rows(chunk: int, overlap: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: dict[str, list] = {"_key": [], "doc_id": [], "chunk": [], "chunks": [], "text": []}
            for key, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("_key", "doc_id", "text"))):
                starts = range(0, max(1, len(text) - overlap), chunk)
                for i, start in enumerate(starts):
                    for name, value in zip(out, (key, doc_id, i, len(starts), text[start : start + chunk + overlap])):
                        out[name].append(value)
            yield pa.record_batch([pa.array(v, pa.string() if k == "text" else pa.int64()) for k, v in out.items()], list(out))

    return run


def _boundary_rows(pattern: str, chunk: int, overlap: int) -> Callable:
    """Adds where the chunk could begin (head) and where it could hand over (tail), counted from the overlap's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).finditer
        for batch in slices(batches, "text"):
            heads, tails = [], []
            for i, n, text in zip(*(batch.column(c).to_pylist() for c in ("chunk", "chunks", "text"))):
                ends = boundaries(text, find, 0, len(text))
                heads.append([] if i == 0 else [e for e in ends if e <= overlap])
                tails.append([] if i == n - 1 else [e - chunk for e in ends[:-1] if chunk <= e <= len(text) - AHEAD])
            yield pa.record_batch([*batch.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], [*batch.schema.names, "head", "tail"])

    return run


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) of every row."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    is_long = F.length("text") > chunk + overlap
    schema = "doc_id long, n_tokens long, ids binary"
    short = in_batches(rows.filter(~is_long)).mapInArrow(_encode_rows(ranks_path, pattern, ["doc_id"]), schema)

    long = rows.filter(is_long).withColumn("_key", F.monotonically_increasing_id())
    chunks = in_batches(long).mapInArrow(_chunk_rows(chunk, overlap), "_key long, doc_id long, chunk long, chunks long, text string")
    chunks = materialise(chunks, "bpe-chunks").repartition(F.col("_key"), F.col("chunk"))
    marked = chunks.mapInArrow(_boundary_rows(pattern, chunk, overlap), "_key long, doc_id long, chunk long, chunks long, text string, head array<int>, tail array<int>")
    by_doc = Window.partitionBy("_key").orderBy("chunk")
    shared = F.array_min(F.array_intersect("head", F.lag("tail").over(by_doc)))
    cut = marked.withColumn("begin", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(shared))
    cut = cut.withColumn("stop", F.lead("begin").over(by_doc)).withColumn("agreed", F.min(F.col("begin").isNotNull()).over(Window.partitionBy("_key")))
    cut = cut.withColumn("core", F.when(F.col("chunk") == F.col("chunks") - 1, F.col("text")).otherwise(F.expr(f"substring(text, 1, {chunk})")))
    stop = F.when(F.col("chunk") == F.col("chunks") - 1, F.length("text")).otherwise(F.col("stop") + chunk)
    pieces = cut.filter("agreed").select("_key", "doc_id", "chunk", F.substring(F.col("text"), F.col("begin") + 1, stop - F.col("begin")).alias("text"))
    whole = cut.filter("not agreed").groupBy("_key", "doc_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(chunk, core))), x -> x.core), '')").alias("text"))
    pieces = pieces.unionByName(whole.select("_key", "doc_id", F.lit(0).cast("long").alias("chunk"), "text"))
    encoded = pieces.mapInArrow(_encode_rows(ranks_path, pattern, ["_key", "doc_id", "chunk"]), f"_key long, doc_id long, chunk long, {schema.split(', ', 1)[1]}")
    joined = encoded.groupBy("_key", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.expr("unhex(array_join(transform(array_sort(collect_list(struct(chunk, ids))), x -> hex(x.ids)), ''))").alias("ids"))
    return short.unionByName(joined.select("doc_id", "n_tokens", "ids"))


def decode(df: DataFrame, ranks_path: str) -> DataFrame:
    """Adds decoded (binary), the token bytes of the packed ids one after another; another column of that name is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(ranks_path)
        tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        look = tokens.__getitem__
        for batch in slices(batches, "_ids"):
            texts = [b"".join(map(look, array("I", ids or b""))) for ids in batch.column("_ids").to_pylist()]
            yield pa.record_batch([batch.column("_row"), pa.array(texts, pa.binary())], ["_row", "decoded"])

    rows = df.select(F.struct(*df.columns).alias("_row"), F.col("ids").alias("_ids"))
    out = in_batches(rows).mapInArrow(run, T.StructType([rows.schema["_row"]]).add("decoded", "binary"))
    return out.select(*[F.col("_row")[c].alias(c) for c in df.columns if c != "decoded"], "decoded")
