"""Periodic runs of words, found in a suffix tree by the smaller halves of its leaf lists.

Words are numbered, and the suffixes of all texts of a batch are sorted together by prefix doubling. The suffix tree is
read off the sorted suffixes and the longest common prefixes of neighbours: a node of depth d is a stretch of suffixes that share d words, and its
leaf list is that stretch. A square of period d that can't be shifted to the right, a branching tandem repeat, is a pair of leaves i
and i + d that part at a node of depth d. Such pairs are found by looking, for each leaf i on the smaller side of each parting, for i + d and
i - d on the other side, in n log n steps at most. All shifts to the left of a branching repeat (its rotations) up to the first word that
breaks its period, and the repeats of multiples of that period which end at the same word, are merged into one maximal run.

Runs shorter than min_length are of no interest, which saves work without a loss: a run of period q holds pairs of equal stretches of
min_length / 2 words, so texts in which no such stretch occurs twice are not sorted; and it holds a square of a multiple of q that lies between
min_length / 4 and half of the run, so nodes above that depth are passed over.

Defined cases: words are what lies between blanks (space, tab, line feed, vertical tab, form feed, carriage return), compared by case; a null or
empty text has no words and no runs; a run reaches both ends of its stretch, so overlapping runs of other periods are runs of their own;
whole texts are searched, whatever their length, each in one task; equal texts give equal results; null and repeated ids
stay as they are; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, slices

MIN_LENGTH = 12


def _repeats_itself(words: np.ndarray, starts: np.ndarray, gram: int) -> np.ndarray:
    """Whether a stretch of `gram` words occurs twice in each text; by hashes, so now and then a text is named in vain."""
    many = np.diff(starts)
    text_of = np.repeat(np.arange(len(many)), many)
    out = np.zeros(len(many), bool)
    if len(words) < gram:
        return out
    mixed = (words.astype("u8") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    hashes = np.zeros(len(words) - gram + 1, "u8")
    for k in range(gram):
        hashes = hashes * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + len(hashes)]
    at = np.flatnonzero(text_of[: len(hashes)] == text_of[gram - 1 :])
    keys = (hashes[at] ^ hashes[at] >> np.uint64(31)) * np.uint64(0x94D049BB133111EB) + text_of[at].astype("u8") * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(keys)
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    out[text_of[at[order[same]]]] = True
    return out


def _sorted_suffixes(words: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """(places in order, rank of each place, the ranks by the first 1, 2, 4, ... words).

    Each text ends with word 0, which occurs nowhere else in it, so places that tie over some words have those words all in their text.
    """
    n = len(words)
    keys = text_of.astype("i8") * (int(words.max()) + 1) + words
    order = np.argsort(keys, kind="stable").astype("i4")
    new = np.concatenate(([True], keys[order[1:]] != keys[order[:-1]]))
    rank = np.empty(n, "i4")
    rank[order] = np.flatnonzero(new).astype("i4")[np.cumsum(new) - 1]
    levels, length = [(1, rank.copy())], 1
    while True:
        alone = new & np.append(new[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            return order, rank, levels
        places = order[tied]
        keys = rank[places].astype("i8") * n + rank[places + length]
        by = np.argsort(keys, kind="stable")
        keys, places = keys[by], places[by]
        order[tied] = places
        new[tied] = np.concatenate(([True], keys[1:] != keys[:-1]))
        firsts = np.flatnonzero(new[tied])
        rank[places] = tied[firsts].astype("i4")[np.cumsum(new[tied]) - 1]
        length *= 2
        levels.append((length, rank.copy()))


def _partings(at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place `at` in the order where neighbours share `depth` words: where the stretches to its left and right that share as many begin and end.

    The left one reaches over partings of equal depth and the right one doesn't, so that each pair of leaves parts once.
    """
    left, right = [0] * len(at), [0] * len(at)
    depths, open_, expected, floor = depth.tolist(), [], -1, -1
    places = at.tolist()
    for t, (k, d) in enumerate(zip(places, depths)):
        if k != expected:
            for s in open_:
                right[s] = expected
            open_, floor = [], k - 1
        while open_ and depths[open_[-1]] >= d:
            right[open_.pop()] = k
        left[t] = places[open_[-1]] if open_ else floor
        open_.append(t)
        expected = k + 1
    for s in open_:
        right[s] = expected
    return np.array(left, "i8"), np.array(right, "i8")


def branching_repeats(words: np.ndarray, text_of: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(end, period) of every branching tandem repeat with a period of `least` or more; places count over all texts."""
    order, rank, levels = _sorted_suffixes(words, text_of)
    known = [r for length, r in levels if length <= least][-1]
    at = np.flatnonzero(known[order[1:]] == known[order[:-1]]) + 1
    a, b = order[at - 1].astype("i8"), order[at].astype("i8")
    depth = np.zeros(len(at), "i8")
    for length, ranks in reversed(levels):
        depth += length * (ranks[a + depth] == ranks[b + depth])
    at, depth = at[depth >= least], depth[depth >= least]
    left, right = _partings(at, depth)
    small_left = at - left <= right - at
    low, high = np.where(small_left, left, at), np.where(small_left, at, right)  # the smaller side
    other_low, other_high = np.where(small_left, at, left), np.where(small_left, right, at)
    ends, periods = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
    before, first = np.concatenate(([0], np.cumsum(high - low))), 0
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(before, before[first] + (1 << 19), "right")) - 1)
        own = (high - low)[first:last]
        which = np.repeat(np.arange(first, last), own)
        leaves = order[low[which] + np.arange(len(which)) - np.repeat(before[first:last] - before[first], own)].astype("i8")
        d, first = depth[which], last
        for shift in (1, -1):
            partner = leaves + shift * d
            inside = (partner >= 0) & (partner < len(words))
            ranked = rank[np.where(inside, partner, 0)]
            hit = inside & (ranked >= other_low[which]) & (ranked < other_high[which])
            ends.append(np.minimum(leaves, partner)[hit] + 2 * d[hit])
            periods.append(d[hit])
    return np.concatenate(ends), np.concatenate(periods)


def _reach(words: np.ndarray, place: int, period: int, floor: int) -> int:
    """The least place from which on each word up to `place` equals the one a period later."""
    size = 16
    while place > floor:
        low = max(floor, place - size)
        broken = np.flatnonzero(words[low:place] != words[low + period : place + period])
        if len(broken):
            return low + int(broken[-1]) + 1
        place, size = low, size * 4
    return floor


def maximal_runs(words: np.ndarray, starts: np.ndarray, min_length: int) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of all runs of min_length or more words; words: numbers from 1 of all texts, which begin at starts."""
    many = np.diff(starts)
    busy = np.flatnonzero(_repeats_itself(words, starts, -(-min_length // 2)))
    if not len(busy):
        return []
    least = min_length // 4 + 1
    begins = np.concatenate(([0], np.cumsum(many[busy] + 1)))
    own = np.zeros(begins[-1], "i8")
    text_of = np.repeat(np.arange(len(busy)), many[busy] + 1)
    own[np.delete(np.arange(len(own)), begins[1:] - 1)] = np.concatenate([words[starts[t] : starts[t + 1]] for t in busy.tolist()])
    ends, periods = branching_repeats(own, text_of, least)
    out = []
    by = np.lexsort((periods, ends))
    ends, periods = ends[by], periods[by]
    while len(ends):
        firsts = np.flatnonzero(np.concatenate(([True], ends[1:] != ends[:-1])))
        group = np.cumsum(np.concatenate(([True], ends[1:] != ends[:-1]))) - 1
        reached, real = [], []
        for e, q in zip(ends[firsts].tolist(), periods[firsts].tolist()):
            text = int(text_of[e - 1])
            s = e - 2 * q
            if q <= 2 * least - 2:  # periods above the depth of the nodes that are passed over
                q = next((r for r in range(1, least) if q % r == 0 and (own[s : e - r] == own[s + r : e]).all()), q)
            s = _reach(own, s, q, int(begins[text]))
            reached.append(s)
            real.append(q)
            if e - s >= max(min_length, 2 * q):
                out.append((int(busy[text]), s - int(begins[text]), e - s, q))
        # Of the other repeats that end there, those of a multiple of the period within the run are part of it.
        stay = (periods % np.array(real)[group] != 0) | (ends - 2 * periods < np.array(reached)[group])
        stay[firsts] = False
        ends, periods = ends[stay], periods[stay]
    return sorted(out, key=lambda r: (r[0], r[1], r[3]))


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_words, runs and collapsed of every row: texts are searched whole, no row is shuffled.

    runs: an array of (start, length, period) in words, by start, then period. collapsed: the words that no run contains after its
    first period, joined by one space.
    """
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            numbers: defaultdict[bytes, int] = defaultdict(count(1).__next__)
            texts = [(t or "").encode().split() for t in batch.column("text").to_pylist()]  # bytes: only ASCII blanks split
            starts = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype("i8")
            words = np.fromiter((numbers[w] for t in texts for w in t), "i8", int(starts[-1]))
            found = maximal_runs(words, starts, min_length)
            by_text: dict[int, list[tuple[int, int, int]]] = {}
            for text, *r in found:
                by_text.setdefault(text, []).append(r)
            collapsed = []
            for k, own in enumerate(texts):
                if k in by_text:
                    kept = np.ones(len(own) + 1, "i8")
                    kept[-1] = 0
                    for s, length, q in by_text[k]:
                        kept[s + q : s + length] = 0
                    own = [own[i] for i in np.flatnonzero(kept).tolist()]
                collapsed.append(b" ".join(own))
            offsets = np.concatenate(([0], np.cumsum([len(by_text.get(k, ())) for k in range(len(texts))])))
            fields = np.array([r[1:] for r in found], "i8").reshape(-1, 3).T
            structs = pa.StructArray.from_arrays([pa.array(f) for f in fields], fields=list(run_type))
            arrays = [batch.column("doc_id"), pa.array(np.diff(starts)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.record_batch(arrays, ["doc_id", "n_words", "runs", "collapsed"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_batches(rows).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
