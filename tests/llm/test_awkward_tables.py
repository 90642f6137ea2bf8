"""Clashing names, damaged images, keys beside identifiers, and what a model may not learn."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import byte_bpe, lm_scoring, media, packing, queries, secrets


def test_results_replace_columns_of_their_names_and_keep_others(spark):
    odd = ["_row", "_salt", "_rank", "_ids", "_media", "keep me"]
    rows = spark.createDataFrame([(1, "one two", 5, *range(6)), (2, None, 6, *range(6))], "doc_id long, text string, offset int, " + ", ".join(f"`{c}` int" for c in odd))
    cut = rows.withColumns({"length": F.lit(7), "sequence_id": F.lit("x"), "_n": F.lit(1), "_first": F.lit(2)})
    packed = packing.pack(cut)
    assert packed.columns == [c for c in cut.columns if c not in ("sequence_id", "offset")] + ["sequence_id", "offset"]
    assert sorted(r.offset for r in packed.collect()) == [0, 7] and packed.filter("`keep me` = 5 AND _rank = 2").count() == 2
    ranks = queries.tokenizer("byte_bpe_50k.tiktoken")
    coded = rows.join(byte_bpe.encode(rows, ranks, queries.pattern()), "doc_id").withColumn("decoded", F.lit(3))
    decoded = byte_bpe.decode(coded, ranks)
    assert {r.doc_id: bytes(r.decoded) for r in decoded.collect()} == {1: b"one two", 2: b""} and decoded.filter("_ids = 3").count() == 2
    stored = rows.join(media.store(rows), "doc_id").withColumns({c: F.lit(1) for c in ("payload", "feature", "error", "width", "rgb")})
    loaded = media.load(stored)
    assert {r.doc_id: bytes(r.payload)[:7] for r in loaded.collect()} == {1: b"one two", 2: bytes(7)}
    assert loaded.filter("error IS NULL AND width > 0 AND _media = 4").count() == 2


def test_damaged_images_give_a_reason(spark):
    rng = random.Random(8)
    whole = [media.write_jpeg(bytes(rng.randrange(256) for _ in range(n))) for n in (64, 128, 640)]
    damaged = []
    for k in range(4000):
        data = bytearray(rng.choice(whole))
        for _ in range(rng.choice([1, 1, 2, 4, 30])):
            at = rng.randrange(min(len(data), rng.choice([40, 200, 10_000])))
            if rng.random() < 0.8:
                data[at] = rng.choice([0, 255, rng.randrange(256)])
            else:
                del data[at : at + rng.randrange(40)]
        damaged.append(bytes(data))
    frame = whole[0].index(b"\xff\xc2")
    huge = whole[0][: frame + 5] + b"\xff\xff\xff\xff" + whole[0][frame + 9 :]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate([*damaged, huge, b"", None])], "doc_id long, media binary").repartition(4)
    got = {r.doc_id: r for r in media.load(rows, tensors=False).collect()}
    assert len(got) == 4003 and sum(r.error is not None for r in got.values()) > 300
    assert all(r.error for r in (got[4000], got[4001], got[4002]))
    assert all((r.error is None) == (r.feature is not None) for r in got.values())


@pytest.mark.parametrize("text, found", [("123e4567-e89b-12d3-a456-426614174000", False), ("id-123e4567-e89b-12d3-a456-426614174000", False), ("123e4567-e89b-12d3-a456-426614174000Zq8KxT9vLm2Rb7Ny", True), ("x=Zq8KxT9vLm2Rb7Ny-123e4567-e89b-12d3-a456-426614174000", True)])
def test_a_key_beside_an_identifier_is_a_secret(text, found):
    test = secrets.token_test(queries.pattern(), queries.tokenizer("byte_bpe_50k.tiktoken"))
    assert any(kind == 3 for _, kind, _ in secrets.spans_of(text, test)) == found


def test_scores_of_training_rows_do_not_depend_on_held_out_texts(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(30)]
    rows = [(i, " ".join(rng.choices(words, range(30, 0, -1), k=40))) for i in range(60)]
    other = [(i, " ".join(rng.choices(["new", "newer", *words[20:]], k=500)) if zlib.crc32(str(i).encode()) % 5 == 1 else t) for i, t in rows]
    one, two = ({r.doc_id: r for r in lm_scoring.score(spark.createDataFrame(x, "doc_id long, text string"), head=4).collect()} for x in (rows, other))
    trained = [i for i, r in one.items() if not r.held_out]
    assert 30 < len(trained) < 60
    assert all(one[i][:5] == two[i][:5] for i in trained)
    assert max(abs(one[i][k] - two[i][k]) for i in trained for k in (5, 6)) < 1e-9  # sums may be taken in another order
    total = sum(len(t.split()) + 1 for i, t in other if i in trained)
    counts = {}
    for i, t in other:
        for w in [*t.split(), ""] if i in trained else []:
            counts[w] = counts.get(w, 0) + 1
    for i, t in other:  # and the base score is the stated one for words that only held-out texts have, too
        base = sum(np.log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in [*t.split(), ""])
        assert abs(base - two[i].base_score) < 1e-6


@pytest.mark.parametrize("operator", ["op1_sharding", "op2_byte_bpe", "op4_quality", "op5_packing", "op6_simhash", "op7_secrets", "op8_media", "op9_lm_scoring", "op10_language_id", "op11_periodic_runs", "op12_filter_audit"])
def test_texts_of_ten_million_characters(spark, tmp_path_factory, operator):
    folder = tmp_path_factory.getbasetemp() / "long"
    if not folder.exists():
        rng = random.Random(1)
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(20_000)]
        long = " ".join(rng.choices(words, k=1_600_000))
        rows = [(1, long, "en", "s", len(long)), (2, long, "en", "s", len(long)), (3, "a short text of some words", "en", "t", 26), (4, None, None, None, None)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rows = queries.QUERIES[operator](spark, str(folder)).collect()
    if operator == "op12_filter_audit":
        assert len(rows) == 3 * 600
    else:
        assert {r.doc_id for r in rows} == {1, 2, 3, 4}
