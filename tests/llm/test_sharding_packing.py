from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm import packing, queries, sharding


def by_shard(rows):
    out = {}
    for r in rows:
        out.setdefault(r.shard, []).append(r)
    return out


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_shards_are_contiguous_balanced_and_gapless(spark, shards):
    rng = random.Random(shards)
    data = [(i, "é" * rng.randint(0, 60)) for i in range(500)]
    rng.shuffle(data)
    rows = sharding.assign_shards(spark.createDataFrame(data, "doc_id long, text string"), shards).collect()
    assert sorted(r.doc_id for r in rows) == list(range(500))
    own = by_shard(rows)
    assert set(own) == set(range(shards))
    sizes = [sum(r.size for r in x) for x in own.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)
    for x in own.values():
        assert sorted(r.slot for r in x) == list(range(len(x)))
    assert [r.shard for r in sorted(rows, key=lambda r: r.doc_id)] == sorted(r.shard for r in rows)
    texts = dict(data)
    assert all(r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)


def test_shards_of_awkward_rows(odd, empty):
    rows = sharding.assign_shards(odd, 4).collect()
    assert len(rows) == odd.count()
    assert [r.size for r in rows if r.doc_id == 2] == [16]
    assert sharding.assign_shards(empty, 4).count() == 0


def test_written_shards_hold_all_rows(spark, odd, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "out"), 3)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == odd.count() and {r.own_shard for r in rows} == {9} and {r.shard for r in rows} <= {0, 1, 2}


@pytest.mark.parametrize("seed", range(40))
def test_plan_places_every_piece_once_without_overlap(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 100])
    counts = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(1, 25))}
    bins, seen = {}, {}
    for length, rank, many, first, offset in packing.plan(dict(counts), capacity):
        assert rank == seen.get(length, 0)
        seen[length] = rank + many
        for k in range(many):
            bins.setdefault(first + k, []).append((offset, length))
    assert seen == counts
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    assert sum(3 * n > capacity for held in bins.values() for _, n in held) <= 2 * len(bins)
    assert len(bins) <= 1.25 * -(-sum(n * c for n, c in counts.items()) // capacity) + sum(c for n, c in counts.items() if 2 * n > capacity)


def test_plan_is_optimal_where_pairs_decide():
    assert len({b + k for _, _, m, b, _ in packing.plan({60: 5, 40: 5}, 100) for k in range(m)}) == 5
    assert len({b + k for _, _, m, b, _ in packing.plan({50: 7}, 100) for k in range(m)}) == 4


def test_pieces_match_the_library_and_pack_without_gaps(spark, odd, empty):
    import tokenizers

    path = queries.tokenizer("word_bpe_49k.json")
    model = tokenizers.Tokenizer.from_file(path)
    cut = packing.pieces(odd, path, capacity=256, with_ids=True)
    rows = packing.pack(cut, capacity=256).collect()
    got = sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = []
    for r in odd.collect():
        ids = np.array([*model.encode(r.text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        for n, start in enumerate(range(0, len(ids), 256)):
            part = ids[start : start + 256]
            want.append((r.doc_id or 0, n, start, len(part), zlib.crc32(part.tobytes())))
    assert got == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        assert [o for o, _ in sorted(held)] == list(np.cumsum([0, *[n for _, n in sorted(held)]])[:-1])
    whole = packing.sequences(packing.pack(cut, capacity=256)).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(x[3] for x in want) and max(r.length for r in whole) <= 256
    assert packing.pack(packing.pieces(empty, path)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "Σ", "İ", "ß", "é", "e\u0301", "\u0301", "\x01", "\x1c", "\x85", "\xa0", "\u2003", " ", "\n", "'s", "1", "!", "你", "<|endoftext|>", "<|startoftext|>", "\U0001f600"]) | st.text(max_size=3), max_size=15).map("".join))
def test_word_encoder_agrees_with_the_library(text):
    encode, model = test_word_encoder_agrees_with_the_library.pair
    assert np.frombuffer(encode([text])[0], "<u4").tolist() == model.encode(text, add_special_tokens=False).ids


@pytest.fixture(autouse=True, scope="module")
def _encoders():
    import tokenizers

    path = queries.tokenizer("word_bpe_49k.json")
    test_word_encoder_agrees_with_the_library.pair = packing.word_encoder(path), tokenizers.Tokenizer.from_file(path)


def test_word_encoder_beyond_its_memory(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 2000)
    import tokenizers

    path = queries.tokenizer("word_bpe_49k.json")
    encode, model = packing.word_encoder(path), tokenizers.Tokenizer.from_file(path)
    rng = random.Random(3)
    for _ in range(5):
        texts = [" ".join(f"w{rng.randrange(60)}x" for _ in range(40)) for _ in range(3)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [model.encode(t, add_special_tokens=False).ids for t in texts]
