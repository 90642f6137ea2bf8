"""Periodic runs against a loop over all periods, and the query against the rule that plants them."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from docketry.llm import queries, runs


def brute(words, least=12):
    """All (start, length, period) by comparing every word with the one a period later."""
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and not any(all(words[t] == words[t + r] for t in range(i, j + q - r)) for r in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def drawn(rng):
    n, k = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 6, 40])
    words = [rng.randint(1, k) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n:
            a, p = rng.randrange(n), rng.randint(1, 20)
            for i in range(a + p, min(n, a + rng.randint(0, 70))):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize("least", [2, 5, 8, 12, 20])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    for _ in range(60):
        texts = [drawn(rng) for _ in range(rng.randint(1, 7))]
        starts = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype("i8")
        found = runs.maximal_runs(np.array([w for t in texts for w in t], "i8"), starts, least)
        assert [(t, *r) for t, words in enumerate(texts) for r in brute(words, least)] == found


def test_words_of_fibonacci_and_of_one_letter():
    a, b = [1], [1, 2]
    while len(b) < 600:
        a, b = b, b + a
    assert [r[1:] for r in runs.maximal_runs(np.array(b, "i8"), np.array([0, len(b)]), 12)] == brute(b)
    assert runs.maximal_runs(np.ones(50_000, "i8"), np.array([0, 50_000]), 12) == [(0, 0, 50_000, 1)]


def expected(doc_id, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    exponent = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, exponent, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark, tmp_path, tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect() if len((r.text or "").split()) < 250]
    odd = [(None, "a b " * 20), (None, None), (-1, ""), (-2, " \t\n "), (-3, "x " * 12 + "  y"), (-3, "x " * 12 + "  y"), (-4, "Ab ab " * 9 + "Ab"), (-5, "é é " * 8), (-6, "q\x1cq " * 12), (-7, "x " * 11)]
    planted = [(i, " ".join(f"w{k}" for k in range(n))) for n, i in enumerate(i for i in range(10**6, 10**6 + 400) if zlib.crc32(str(i).encode()) % 10 == 0)]
    rows = docs + odd + planted
    spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, n_words long, collapsed string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).select(*COLUMNS).collect()), key=repr)
    assert len(planted) > 30 and sum(r[1] > 0 for r in got) > 30
    assert got == sorted((expected(*r) for r in rows), key=repr)


def test_long_text_and_empty_table(spark, empty):
    body = [f"word{i}" for i in range(40_000)]
    text = " ".join(body + body + body)  # some ten million characters with the next
    df = spark.createDataFrame([(1, text + " end", 0), (2, "tick " * 2_000_000, 0)], "doc_id long, text string, runs int")
    got = {r.doc_id: r for r in runs.find_runs(df).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 120_000, 40_000)] and got[1].collapsed == " ".join(body) + " end"
    assert [tuple(x) for x in got[2].runs] == [(0, 2_000_000, 1)] and got[2].collapsed == "tick"
    assert runs.find_runs(empty).count() == 0
