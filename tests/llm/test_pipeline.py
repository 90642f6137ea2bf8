"""The pipeline's stages one by one, each against what it was given."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from docketry.llm import quality
from docketry.llm.common import materialise


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages_keep_what_they_should(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        given, docs = docs, materialise(stage(spark, docs, tiny), f"test-{name}")
        if name != "packing":
            assert docs.columns == given.columns
            kept[name] = {r.doc_id: r for r in docs.collect()}
    assert len(kept["language_id"]) >= 0.97 * spark.read.parquet(f"{tiny}/documents.parquet").count()
    base = {r.doc_id for r in quality.with_counts(spark.read.parquet(f"{tiny}/documents.parquet")).filter("not base_failed").collect()}
    assert set(kept["quality"]) <= base
    clean = [i for i, q in labels.items() if q == 1 and i in base and i in kept["language_id"]]
    assert sum(i in kept["quality"] for i in clean) >= 0.98 * len(clean)
    ids = sorted(kept["quality"])
    sets = {i: shingles(kept["quality"][i].text) for i in ids}
    holders = {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    shared = Counter(p for held in holders.values() for p in itertools.combinations(held, 2))
    alike = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in shared.items()}
    near = [p for p, share in alike.items() if share >= 0.8]
    assert near and sum(not (a in kept["simhash"] and b in kept["simhash"]) for a, b in near) >= 0.95 * len(near)
    assert not any(alike[p] == 1 and set(p) <= set(kept["simhash"]) for p in near)  # no copies stay
    least = {i: i for i in ids}
    while any(least[a] != least[b] for a, b in near):
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
    assert set(kept["quality"]) - set(kept["simhash"]) <= {i for i in ids if least[i] != i}  # only what a chain of 0.8 or more takes
    assert kept["secrets"].keys() == kept["simhash"].keys()
    assert not any(re.search(r"[0-9a-f]{32}", r.text) for r in kept["secrets"].values())
    same = [i for i, r in kept["secrets"].items() if r.text == kept["simhash"][i].text]
    assert len(same) >= 0.9 * len(kept["secrets"]) and all(len(r.text) == r.n_chars for i, r in kept["secrets"].items() if i not in same)
    packed = docs.collect()
    assert {r.doc_id for r in packed} == set(kept["secrets"])
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        assert [o for o, _ in sorted(held)] == np.cumsum([0, *[n for _, n in sorted(held)]])[:-1].tolist() and sum(n for _, n in held) <= 4096


def test_pipeline_of_the_empty_table(spark, empty, tiny):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tiny)
    assert docs.count() == 0


def test_pipeline_of_awkward_rows(spark, odd, tiny):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, tiny), f"odd-{name}")
    assert docs.columns[:2] == ["doc_id", "piece"]
