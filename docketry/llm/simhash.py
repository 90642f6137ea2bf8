"""SimHash near-duplicates found with Golay-code fuzzy hashing.

A 64-bit fingerprint is four segments of 16 bits. Two fingerprints that differ in at most three bits
have, by the pigeonhole principle, a segment without an error and another with at most one. The latter
is made to agree by the binary Golay code of length 23, distance 7: every word lies within three bits
of exactly one codeword. If a and b differ in one bit, the codeword nearest to a is at most four bits from
b, so a's one index is among the indices of all codewords within four bits of b, of which there are
one or six. A key is therefore (which segments, the exact segment's bits, a codeword's index); each
fingerprint has 12 keys of its own and about 60 to look under, and candidates are verified by counting bits.

Keys are formed over distinct fingerprints only, so exact copies never meet. Tasks read the keys in
sorted order, verify within each key's fingerprints and give back a forest of links, not all pairs. A key with
more fingerprints than a task should compare is handed on: its fingerprints are dealt into blocks, and
each pair of blocks is compared by a task of its own. Links become components by alternating large-star and
small-star rounds over tables in the shared folder.

`near_duplicates` has the narrow rule, 3 of 64 bits over shingles of 3 words. `first_of_each`, for pipelines, has
the usual one, a Jaccard similarity of 0.8 over the sets of 5-word shingles. A changed word changes five shingles, so
its keys come from six fingerprints of the set of words, which such a change hardly touches, and only from the codeword nearest to
a segment: more fingerprints find more than further codewords do. A 256-bit fingerprint of the set of shingles proposes
pairs (at similarity 0.8 about 39 of its bits differ, 6 more or less, and 50 may). Texts that such pairs connect are a cluster, and only
a cluster's sets of shingles are shuffled. A task counts what the sets of a cluster share and links those of 0.8 or more, so every link is
exact; it hands out a forest. Clusters with more shingles than a task should hold are dealt into blocks, and each pair of blocks is a task.

Defined cases: a null or empty text has fingerprint zero, linked like any other; fewer words than a shingle make one
shingle; repeated words and shingles count as often as they occur; a null id is kept but never is the
smallest id of a component that has another; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_batches, materialise, shuffle_partitions, slices

SHINGLE, SEED, MOST_BITS = 3, 42, 3
SEGMENTS, SEGMENT_BITS = 4, 16
#: (exact segment, segment that is decoded) of each kind of key.
KINDS = [(i, j) for i in range(SEGMENTS) for j in range(SEGMENTS) if i != j]
#: Generator polynomial of the binary Golay code of length 23.
GOLAY = 0b110001110101
#: The rule of pipelines: words a shingle, fingerprints of words that keys come from, longs of the verified fingerprint, its most differing bits.
SIMILAR_SHINGLE, WORD_CODES, SHINGLE_CODES, MOST_SIMILAR_BITS = 5, 6, 4, 50
#: Least similarity as a ratio: shared shingles to all.
LEAST_SHARED, LEAST_OF = 4, 5
#: Shingles of a cluster that a block holds.
BLOCK_SHINGLES = 500_000
WORD_COLUMNS = tuple(f"w{k}" for k in range(WORD_CODES))
SHINGLE_COLUMNS = tuple(f"s{k}" for k in range(SHINGLE_CODES))
#: Most fingerprints under one key that a task compares at once; beyond it they are dealt into blocks of this size.
BLOCK = 2048


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """Unsigned fingerprints. A bit is set where it is set in over half of the shingles' hashes."""
    digest, hashes, many = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII blanks split
        if len(words) <= SHINGLE:
            own = [digest(b" ".join(words), SEED)] if words else []
        else:
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = np.concatenate(([0], ends[: -SHINGLE])).tolist()
            joined = b" ".join(words)
            own = [digest(joined[s:e], SEED) for s, e in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())]
        hashes += own
        many.append(len(own))
    counts = np.array(many, "int64")
    out = np.zeros(len(texts), "<u8")
    if hashes:
        bits = np.unpackbits(np.array(hashes, "<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
        full = np.flatnonzero(counts)
        sums = np.add.reduceat(bits, (np.cumsum(counts) - counts)[full], axis=0, dtype="int32")
        out[full] = np.packbits(2 * sums > counts[full, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprint_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) and the columns in keep of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            columns = [batch.column(c) for c in ("doc_id", *keep)]
            yield pa.record_batch([*columns, pa.array(fingerprints(batch.column("text").to_pylist()).view("<i8"))], ["doc_id", *keep, "fp"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text_col).alias("text"))
    types = dict(df.dtypes)
    return in_batches(rows).mapInArrow(run, ", ".join(["doc_id long", *(f"`{c}` {types[c]}" for c in keep), "fp long"]))


def _majority(hashes: np.ndarray, longs: int) -> np.ndarray:
    """A fingerprint of 64 * longs bits: those set in over half of the hashes, each spread over that many longs (splitmix64)."""
    sums = np.zeros(64 * longs, "int64")
    for start in range(0, len(hashes), 1 << 14):
        x = hashes[start : start + (1 << 14), None] + np.arange(1, longs + 1, dtype="<u8") * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        sums += np.unpackbits(x.view("u1"), axis=1, bitorder="little").sum(0, dtype="int64")
    return np.packbits(2 * sums > len(hashes), bitorder="little").view("<u8")


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of a text's set of shingles, sorted; none without a word."""
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(0, len(words) - SIMILAR_SHINGLE)
    spans = zip(starts[: last + 1].tolist(), ends[len(words) - 1 - last :].tolist())
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans), "<u8", last + 1))


def similarity_codes(text: str | None) -> tuple[bytes, np.ndarray]:
    """A digest of a text's set of shingles, and the fingerprints of its sets of words and of shingles as longs; zeros without a word."""
    words = (text or "").encode().lower().split()
    shingles = shingle_hashes(words)
    digest = xxhash.xxh3_128_digest(shingles.tobytes(), SEED)
    if not words:
        return digest, np.zeros(WORD_CODES + SHINGLE_CODES, "<u8")
    own = {xxhash.xxh64_intdigest(w, SEED) for w in words}
    return digest, np.concatenate([_majority(np.fromiter(own, "<u8", len(own)), WORD_CODES), _majority(shingles, SHINGLE_CODES)])


def code_rows(df: DataFrame) -> DataFrame:
    """doc_id, _id, and the digest and longs of similarity_codes for rows (doc_id, _id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            told = [similarity_codes(t) for t in batch.column("text").to_pylist()]
            codes = np.array([c for _, c in told], "<u8").reshape(-1, WORD_CODES + SHINGLE_CODES)
            arrays = [batch.column("doc_id"), batch.column("_id"), pa.array([d for d, _ in told], pa.binary()), *(pa.array(np.ascontiguousarray(c).view("<i8")) for c in codes.T)]
            yield pa.record_batch(arrays, ["doc_id", "_id", "digest", *WORD_COLUMNS, *SHINGLE_COLUMNS])

    return in_batches(df).mapInArrow(run, "doc_id long, _id long, digest binary, " + ", ".join(f"{c} long" for c in (*WORD_COLUMNS, *SHINGLE_COLUMNS)))


def shingle_sets(df: DataFrame) -> DataFrame:
    """doc_id, cluster and hashes (of the set of shingles) for rows (doc_id, cluster, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingle_hashes((t or "").encode().lower().split()).view("<i8") for t in batch.column("text").to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
            held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, "<i8")])))
            yield pa.record_batch([batch.column("doc_id"), batch.column("cluster"), held], ["doc_id", "cluster", "hashes"])

    return in_batches(df).mapInArrow(run, "doc_id long, cluster long, hashes array<long>")


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error of least weight, whether it has weight three, and then the five errors of weight four."""

    def syndrome(words: np.ndarray) -> np.ndarray:
        words = words.copy()
        for bit in range(22, 10, -1):
            words ^= np.where(words >> bit & 1, GOLAY << bit - 11, 0)
        return words

    patterns = lambda w: np.array([sum(1 << b for b in c) for c in itertools.combinations(range(23), w)], "int64")
    nearest, three = np.zeros(2048, "int64"), np.zeros(2048, bool)
    for weight in (1, 2, 3):
        at = syndrome(patterns(weight))
        nearest[at], three[at] = patterns(weight), weight == 3
    fours = patterns(4)
    order = np.argsort(syndrome(fours), kind="stable")
    further = np.zeros((2048, 5), "int64")
    further[np.unique(syndrome(fours))] = fours[order].reshape(-1, 5)
    return nearest, three, further


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest codeword's index, indices of the five codewords four bits away or -1) of 23-bit words."""
    nearest, three, further = _golay()
    left = words.copy()
    for bit in range(22, 10, -1):
        left ^= np.where(left >> bit & 1, GOLAY << bit - 11, 0)
    own = (words ^ nearest[left]) >> 11
    others = np.where(three[left][:, None], (words[:, None] ^ further[left]) >> 11, -1)
    return own, others


def keys_of(fps: np.ndarray, lists: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys as (key, position of the fingerprint, whether the key is its own); without lists only own ones."""
    parts = [(fps >> np.uint64(SEGMENT_BITS * s) & np.uint64(0xFFFF)).astype("int64") for s in range(SEGMENTS)]
    codes = [golay_indices(p << (23 - SEGMENT_BITS)) for p in parts]
    keys, places, owns = [], [], []
    for kind, (exact, decoded) in enumerate(KINDS):
        own, others = codes[decoded]
        base = kind << 28 | parts[exact] << 12
        keys.append(base | own)
        places.append(np.arange(len(fps)))
        owns.append(np.ones(len(fps), bool))
        if not lists:
            continue
        at, column = np.nonzero(others >= 0)
        keys.append(base[at] | others[at, column])
        places.append(at)
        owns.append(np.zeros(len(at), bool))
    return np.concatenate(keys), np.concatenate(places), np.concatenate(owns)


def _key_rows(sources: tuple[str, ...], codes: tuple[str, ...], lists: bool = True):
    """Rows (key, fp, own) and the columns codes for every key of the fingerprints in the columns sources; without lists only for own keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                for which, source in enumerate(sources):
                    keys, places, owns = keys_of(part.column(source).to_numpy().view("<u8"), lists)
                    arrays = [pa.array(keys | which << 32), part.column("fp").take(pa.array(places)), pa.array(owns), *(part.column(c).take(pa.array(places)) for c in codes)]
                    yield pa.record_batch(arrays, ["key", "fp", "own", *codes])

    return run


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Whether columns of fingerprints differ in at most this many bits; each row is one of their longs."""
    return sum(np.bitwise_count((x ^ y).view("<u8")).astype("uint16") for x, y in zip(a, b)) <= most


def _forest(fps: np.ndarray, codes: np.ndarray, owns: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each fingerprint to the least place of its component within the group."""
    labels = np.arange(len(fps))
    rows = np.flatnonzero(owns)
    near = [_near(codes[:, r : r + 1], codes, bits) for r in rows]
    while True:
        before = labels.copy()
        for r, mask in zip(rows, near):
            labels[mask] = labels[mask].min()
        labels = labels[labels]
        if (labels == before).all():
            break
    moved = np.flatnonzero(labels != np.arange(len(fps)))
    return fps[moved], fps[labels[moved]]


def _group_links(frame: pd.DataFrame, codes: tuple[str, ...], bits: int, most: int | None) -> Iterator[pd.DataFrame]:
    """Links within each key of rows sorted by key; groups of more than most rows come back as they are."""
    keys, fps, owns = frame.key.to_numpy(), frame.fp.to_numpy(), frame.own.to_numpy()
    held = np.stack([frame[c].to_numpy() for c in codes or ("fp",)])
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    small = 8
    wide = np.repeat(sizes, sizes)
    a, b = [], []
    for shift in range(1, small):
        i = np.flatnonzero((keys[:-shift] == keys[shift:]) & (wide[shift:] <= small)) if len(keys) > shift else np.array([], "int64")
        i = i[(owns[i] | owns[i + shift]) & _near(held[:, i], held[:, i + shift], bits)]
        a.append(fps[i])
        b.append(fps[i + shift])
    for start, size in zip(starts[sizes > small], sizes[sizes > small]):
        part = slice(start, start + size)
        if most and size > most:
            yield _handed_on(frame.iloc[part], codes)
            continue
        x, y = _forest(fps[part], held[:, part], owns[part], bits)
        a.append(x)
        b.append(y)
    links = pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "key": -1, "own": False, **dict.fromkeys(codes, 0)})
    links = links[links.a != links.b]
    yield links.assign(a=links[["a", "b"]].min(axis=1), b=links[["a", "b"]].max(axis=1)).drop_duplicates(["a", "b"])


def _handed_on(frame: pd.DataFrame, codes: tuple[str, ...]) -> pd.DataFrame:
    """Rows of a key that is too large for one task, in the columns of links."""
    return pd.DataFrame({"a": frame.fp, "b": 0, "key": frame.key, "own": frame.own, **{c: frame[c] for c in codes}})


def _link_rows(codes: tuple[str, ...], bits: int, most: int | None):
    """Over rows (key, fp, own, codes) sorted by key within the task: verified links; the last key of a batch waits for the next.

    A key that is being handed on (its rows are more than most) does not gather in memory.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, passing = None, None
        for frame in frames:
            if passing is not None:
                same = frame.key == passing
                yield _handed_on(frame[same], codes)
                frame = frame[~same]
                if not len(frame):
                    continue
                passing = None
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = int(frame.key.to_numpy().searchsorted(frame.key.iloc[-1]))
            done, held = frame.iloc[:last], frame.iloc[last:]
            if most and len(held) > most:
                passing = int(held.key.iloc[0])
                yield _handed_on(held, codes)
                held = None
            if len(done):
                yield from _group_links(done, codes, bits, most)
        if held is not None and len(held):
            yield from _group_links(held, codes, bits, most)

    return run


def links(distinct: DataFrame, block: int = BLOCK, sources: tuple[str, ...] = ("fp",), codes: tuple[str, ...] = (), bits: int = MOST_BITS, lists: bool = True) -> DataFrame:
    """a, b: enough verified links between distinct fingerprints (column fp) to connect every component.

    Keys come from the 64-bit fingerprints in the columns sources. Candidates are verified by the columns codes together,
    where at most `bits` bits may differ; without codes fp itself is compared, else it only names its row. Without lists a
    fingerprint is looked for under its own keys only.
    """
    spark, extra = distinct.sparkSession, "".join(f", {c} long" for c in codes)
    narrow = distinct.select(*dict.fromkeys(("fp", *sources, *codes))).repartition(shuffle_partitions(spark), "fp")
    keyed = narrow.mapInArrow(_key_rows(sources, codes, lists), "key long, fp long, own boolean" + extra)
    sorted_keys = keyed.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key")
    schema = "a long, b long, key long, own boolean" + extra
    found = materialise(sorted_keys.mapInPandas(_link_rows(codes, bits, block), schema), "simhash-links")
    handed_on = found.filter("key >= 0")
    near = found.filter("key < 0").select("a", "b")
    if not handed_on.isEmpty():
        # Blocks of about `block` fingerprints; each row goes to the pairs of its block with every block of its key.
        sizes = handed_on.groupBy("key").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
        dealt = handed_on.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
        pairs = dealt.select("key", F.col("a").alias("fp"), "own", *codes, "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        pairs = pairs.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "fp", "own", *codes)
        blocked = pairs.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key").mapInPandas(_link_rows(codes, bits, None), schema)
        near = near.unionByName(blocked.select("a", "b"))
    return near.distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the least node reachable) for every node of the undirected edges.

    Large-star: each node's larger neighbours are linked to its least one; small-star: its smaller
    neighbours and itself are. When a round changes nothing, every component is a star around its least node.
    """
    edges = materialise(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        before, edges = edges, materialise(small.filter("u != v").distinct(), "small-star")
        discard(before)
        discard(large)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def group_fingerprints(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """fp, component_id from rows (doc_id, fp): the least id of all documents whose fingerprints are connected."""
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    roots = components(links(distinct, block))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialise(rooted, "simhash-roots")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    rows = materialise(fingerprint_rows(df, id_col, text_col), "simhash-documents")
    grouped = group_fingerprints(rows, block)
    return rows.join(grouped, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _cluster_links(ids: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], mixed: bool) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs whose sets have the least similarity or more; mixed: only pairs of different sides count."""
    sizes = np.array([len(x) for x in sets])
    holder = np.repeat(np.arange(len(sets)), sizes)
    hashes, own = np.unique(np.concatenate([*sets, np.zeros(0, "i8")]), return_inverse=True)
    held_by = holder[np.argsort(own, kind="stable")]  # the holders of each hash, one after another
    many = np.bincount(own, minlength=len(hashes))
    begins = np.cumsum(many) - many
    starts = np.cumsum(sizes) - sizes
    root, a, b = np.arange(len(sets)), [], []
    for k in range(len(sets)):
        if not mixed and (root == root[0]).all():
            break  # all are linked
        mine = own[starts[k] : starts[k] + sizes[k]]
        runs = many[mine]
        at = np.repeat(begins[mine] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
        shared = np.bincount(held_by[at], minlength=len(sets))
        # shared / all >= LEAST_SHARED / LEAST_OF, where all is the sum of both sizes less what is shared
        near = ((LEAST_OF + LEAST_SHARED) * shared >= LEAST_SHARED * (sizes + sizes[k])) & (root != root[k])
        for other in np.flatnonzero(near & (sides != sides[k]) if mixed else near).tolist():
            if root[other] != root[k]:
                a.append(ids[min(k, other)])
                b.append(ids[max(k, other)])
                x, y = sorted((root[k], root[other]))
                root[root == y] = x
    return np.array(a, "i8"), np.array(b, "i8")


def similar_links(sets: DataFrame, block: int = BLOCK_SHINGLES) -> DataFrame:
    """a, b: enough pairs of 0.8 or more to connect all such pairs within a cluster; sets: doc_id, cluster, hashes."""
    spark, n = sets.sparkSession, F.sum(F.size("hashes"))
    blocks = sets.groupBy("cluster").agg(F.greatest(F.lit(1), F.ceil(n / F.lit(block))).cast("int").alias("blocks"))
    dealt = sets.join(blocks, "cluster").withColumn("side", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("cluster", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "doc_id", "hashes")
    group = ["cluster", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done() -> pa.RecordBatch:
            a, b = _cluster_links(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [r[2] for r in rows], key[1] != key[2])
            return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            hashes = batch.column("hashes")
            ends, flat = hashes.offsets.to_numpy(), hashes.values.to_numpy()
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in (*group, "doc_id", "side")))):
                if row[:3] != key:
                    if len(rows) > 1:
                        yield done()
                    key, rows = row[:3], []
                rows.append((*row[3:], flat[ends[i] : ends[i + 1]].copy()))
        if len(rows) > 1:
            yield done()

    ordered = pairs.repartition(shuffle_partitions(spark), *group).sortWithinPartitions(*group, "doc_id")
    return in_batches(ordered).mapInArrow(run, "a long, b long")


def similar_groups(rows: DataFrame, texts: DataFrame, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """digest and component (the least doc_id) of every set of shingles in rows of code_rows; texts: doc_id, text."""
    columns = [*WORD_COLUMNS, *SHINGLE_COLUMNS]
    distinct = materialise(rows.groupBy("digest").agg(F.min("doc_id").alias("fp"), *[F.min(c).alias(c) for c in columns]), "similar-codes")
    clusters = materialise(components(links(distinct, block, WORD_COLUMNS, SHINGLE_COLUMNS, MOST_SIMILAR_BITS, False)), "similar-clusters")
    # Texts of clusters only, each once; they meet their cluster in a shuffle at any size.
    sets = materialise(shingle_sets(texts.join(clusters.select(F.col("node").alias("doc_id"), F.col("root").alias("cluster")).hint("merge"), "doc_id")), "similar-sets")
    roots = components(similar_links(sets, block_shingles))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    out = materialise(rooted.select("digest", F.coalesce("root", "fp").alias("component")), "similar-groups")
    for used in (distinct, clusters, sets):
        discard(used)
    return out


def first_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows without those near to a kept one by a chain of links: one row of each component stays, that of the least id.

    Rows with a similarity of 0.8 or more over 5-word shingles are near: no link is below, and those that the module's keys don't
    propose are missed. Rows with equal or null ids are told apart by their place: among equal ids the first one read stays, and a null
    id only where its component has no other. Null texts and those without a word are one group; fewer words than a shingle make one
    shingle. df's columns may have any names. Whole rows are not shuffled unless the removed ones are too many to broadcast.
    """
    numbered = materialise(df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.monotonically_increasing_id().alias("_at")), "simhash-rows")
    texts = numbered.select(F.col("_at").alias("doc_id"), "_id", F.col("_row").getField(text_col).alias("text"))
    rows = materialise(code_rows(texts), "simhash-documents")
    grouped = rows.select("doc_id", "_id", "digest").join(similar_groups(rows, texts.select("doc_id", "text")), "digest").select("doc_id", "_id", "component")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "doc_id")).alias("first")
    kept = grouped.groupBy("component").agg(first).select(F.col("first.doc_id").alias("doc_id"))
    removed = rows.select("doc_id").join(kept, "doc_id", "left_anti").withColumnRenamed("doc_id", "_at")
    return numbered.join(removed, "_at", "left_anti").select("_row.*")
