from __future__ import annotations

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docketry.llm import language_id, lm_scoring, media, queries


@pytest.mark.parametrize("n", [64, 128, 378, 6400])
def test_images_keep_payloads_and_both_readers_agree(n, monkeypatch):
    data = os.urandom(n)
    image = media.write_jpeg(data)
    width, height, components, quantisers, comment = media.read_jpeg(image)
    assert media.payload_of(components, comment) == data
    monkeypatch.setattr(media, "_lone", lambda codes: None)
    slow = media.read_jpeg(image)[2]
    assert all((a.coefficients == b.coefficients).all() for a, b in zip(components, slow))
    tensor = media.rgb_tensor(width, height, components, quantisers)
    assert tensor.shape == (height, width, 3) and tensor.dtype == np.uint8


def test_inverse_transform_is_the_textbook_one():
    c = media.Component(1, 1, 0)
    c.allot(8, 8, 1, 1)
    c.coefficients[0] = np.random.default_rng(2).integers(-30, 30, 64)
    square = np.zeros(64)
    square[media.zigzag()] = c.coefficients[0]
    square = square.reshape(8, 8)
    root = lambda k: math.sqrt(0.5) if k == 0 else 1.0
    want = [[128 + sum(root(u) * root(v) / 4 * square[v, u] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)]
    assert abs(media.plane(c, np.ones(64)) - np.clip(np.array(want), 0, 255)).max() <= 0.7


def test_general_codes_with_zero_runs_and_ends_of_bands():
    """A hand-made scan: run of zeros, an end of band over two blocks, then a refinement that makes a new coefficient."""
    c = media.Component(1, 1, 0)
    c.allot(24, 8, 1, 1)
    codes = {(1, 0): 0x21, (2, 2): 0x10, (3, 6): 0x01}  # two zeros then a value of one bit; end of two or three blocks; a value at once
    bits = "0" + "1" + "110" + "0" + "10" + "0"  # block 0: +2 at 3, -2 at 4, then the band ends, for two blocks
    bits += "0" + "0" + "10" + "0"  # block 2: -2 at 3, ends
    bits += "1" * (-len(bits) % 8)
    media._ac_first(c, codes, int(bits, 2).to_bytes(len(bits) // 8, "big"), 1, 63, 1)
    assert c.coefficients[0, 3] == 2 and c.coefficients[0, 4] == -2 and not c.coefficients[1].any() and c.coefficients[2, 3] == -2
    codes = {(1, 0): 0x01, (2, 2): 0x00}
    bits = "0" + "1" + "10" + "1" + "0"  # block 0: +1 at 1; ends; corrections of 3 (yes) and 4 (no)
    bits += "10" + "10" + "1"  # block 1 ends; block 2 ends, correction of 3
    bits += "1" * (-len(bits) % 8)
    media._ac_refine(c, codes, int(bits, 2).to_bytes(len(bits) // 8, "big"), 1, 63, 0)
    assert c.coefficients[0, [1, 3, 4]].tolist() == [1, 3, -2] and c.coefficients[2, 3] == -3


def test_media_columns(odd, empty):
    loaded = media.load(media.store(odd)).collect()
    want = Counter()
    for r in odd.collect():
        raw = (r.text or "").encode()
        want[r.doc_id, len(raw), raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))] += 1
    assert Counter((r.doc_id, r.n_bytes, bytes(r.payload)) for r in loaded) == want
    assert all(len(r.rgb) == 3 * r.width * r.height for r in loaded)
    same = [r for r in loaded if r.doc_id == 1]
    assert same[0].media == same[1].media and same[0].feature == same[1].feature
    assert media.load(media.store(empty)).count() == 0


def test_media_query_digests(spark, tiny):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    for r in queries.op8_media(spark, tiny).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_language_is_right_on_held_out_rows(spark, tiny):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = queries.op10_language_id(spark, tiny).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_codewords_are_apart():
    for k in (2, 3, 4, 5, 9, 30):
        codes = language_id.codewords(k)
        apart = (codes[:, None] != codes[None]).sum(2)[~np.eye(k, dtype=bool)].min()
        assert apart >= (1 if k == 2 else 2)


def test_language_of_awkward_rows(spark, odd, empty):
    rows = {r.doc_id: r for r in language_id.identify(odd).collect()}
    assert {rows[i].lang_pred for i in (2, 3, 4, 9)} == {"und"}
    assert rows[7].lang_pred in ("en", "de")
    assert language_id.keep_identified(odd).columns == odd.columns
    assert language_id.identify(empty).count() == 0
    one = spark.createDataFrame([(1, "alpha beta", "xx"), (3, "gamma", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(one).collect()} == {"xx"}


def brute_base(rows):
    words = [(r.doc_id, [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")), ""]) for r in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for i, ws in words if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return Counter((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in words)


@pytest.mark.parametrize("head", [5, 200, 50_000])
def test_base_scores_agree_with_plain_counting(spark, odd, tiny, head):
    df = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm_scoring.score(df, head=head).collect())
    assert got == brute_base(df.collect())


def test_tokens_are_those_of_plain_splitting(odd):
    more = ["a\x1cb\x1d c\x1f\x85\xa0d", " \u2003\u00c9 \u00c0A\u0130 ", "\x00 a\x00b ", "A B\nC\r\n", "\x0b", "x" * 70_000 + " Y", " lead", "trail\t"]
    texts = [r.text for r in odd.collect()] + more
    words, codes, starts = lm_scoring.tokens_of(pa.array(["cut off", *texts, "too"], pa.string()).slice(1, len(texts)))
    words, ends = words.to_pylist(), [*starts[1:].tolist(), len(codes)]
    want = [[w.decode() for w in (t or "").encode().lower().split()] + [lm_scoring.END] for t in texts]
    assert [[words[c] for c in codes[i:j]] for i, j in zip(starts.tolist(), ends)] == want
    assert len(set(words)) == len(words)


def test_tokens_cost_less_than_a_python_loop_over_words():
    rng = np.random.default_rng(8)
    texts = [" ".join(f"word{k}" for k in np.minimum(rng.zipf(1.2, 500), 10**6)) for _ in range(800)]
    given = pa.array(texts)

    def arrays():
        words, codes, _ = lm_scoring.tokens_of(given)
        return dict(zip(words.to_pylist(), np.bincount(codes).tolist()))

    def loop():
        counts = Counter()
        for t in given.to_pylist():
            counts.update([*t.encode().lower().split(), b""])
        return {w.decode(): c for w, c in counts.items()}

    def cost(f):
        begun = time.process_time()
        f()
        return time.process_time() - begun

    assert arrays() == loop()
    assert min(cost(arrays) for _ in range(5)) < 0.9 * min(cost(loop) for _ in range(5))


def test_scores_of_the_empty_table(empty):
    assert lm_scoring.score(empty).count() == 0


@pytest.mark.parametrize("size", [0.3, 40])
def test_probabilities_of_short_and_long_vectors_are_those_of_the_formula(size):
    """Long vectors would overflow an exponential that isn't shifted."""
    rng = np.random.default_rng(5)
    mass = np.append(np.sort(rng.integers(1, 500, 1500))[::-1] + 0.5, 90.0)
    v = lm_scoring.Vocabulary({}, np.array([1]), np.array([0]), mass, 10, 10)
    model = lm_scoring.LogBilinear.start(v)
    for a in (model.q, model.k):
        a[:, :-1] = rng.normal(0, size, a[:, :-1].shape)
    context, target = rng.integers(0, 1501, (300, lm_scoring.CONTEXT)), rng.integers(0, 1501, 300)
    h = sum(model.r[context[:, i]].astype("float64") * model.w[i] for i in range(lm_scoring.CONTEXT))
    for got, hidden, t in zip(model.log_probabilities(context, target, v), h, target):
        want, own = 0.0, v.of[t]
        for vectors, pick in ((model.k, own), (model.q[v.starts[own] : v.stops[own]], t - v.starts[own])):
            scores = vectors[:, :-1].astype("float64") @ hidden + vectors[:, -1]
            want += scores[pick] - scores.max() - math.log(np.exp(scores - scores.max()).sum())
        assert got == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_probabilities_sum_to_one():
    mass = np.append(np.arange(700, 0, -1.0), 30.5)
    v = lm_scoring.Vocabulary({}, np.array([1]), np.array([0]), mass, 10, 10)
    assert (v.class_mass.sum(), v.stops[-1], len(v.of)) == (pytest.approx(mass.sum()), 701, 701)
    model, rng = lm_scoring.LogBilinear.start(v), np.random.default_rng(3)
    context = np.tile([0, 1, 2], (701, 1))
    assert np.exp(model.log_probabilities(context, np.arange(701), v)) == pytest.approx(mass / mass.sum(), rel=1e-4)  # unigram before training
    model.q[:, :-1], model.k[:, :-1] = rng.normal(0, 2, (701, lm_scoring.WIDTH)), rng.normal(0, 2, (len(v.starts), lm_scoring.WIDTH))
    logs = model.log_probabilities(context, np.arange(701), v)
    assert np.exp(logs).sum() == pytest.approx(1, rel=1e-4)
    h = model.hidden(context[:1])[0]
    score = lambda a: a[:, :-1] @ h + a[:, -1]
    c, k = v.of[500], score(model.k)
    inner = score(model.q)[v.starts[c] : v.stops[c]]
    assert logs[500] == pytest.approx(k[c] - np.log(np.exp(k).sum()) + inner[500 - v.starts[c]] - np.log(np.exp(inner).sum()), rel=1e-3)


@pytest.mark.parametrize("size", [0.3, 40])
def test_factors_of_classes_give_the_same_probabilities_or_are_refused(size):
    mass = np.append(np.arange(1500, 0, -1.0), 90.0)
    v = lm_scoring.Vocabulary({}, np.array([1]), np.array([0]), mass, 10, 10)
    model, rng = lm_scoring.LogBilinear.start(v), np.random.default_rng(6)
    model.q[:, :-1], model.k[:, :-1] = rng.normal(0, size, (1501, lm_scoring.WIDTH)), rng.normal(0, size, (len(v.starts), lm_scoring.WIDTH))
    context, target = rng.integers(0, 1501, (3000, lm_scoring.CONTEXT)), rng.integers(0, 1501, 3000)
    factors = model.factors()
    assert (factors is None) == (size == 40)
    assert model.log_probabilities(context, target, v, factors) == pytest.approx(model.log_probabilities(context, target, v), rel=1e-5, abs=1e-4)


def per_token(rows):
    held = [r for r in rows if r.held_out]
    return [-sum(r[c] for r in held) / sum(r.n_tokens for r in held) for c in ("base_score", "score")]


def test_training_learns_order_however_the_table_is_split(spark, monkeypatch):
    """In texts where each word follows from the one before, the model must beat the unigram score by far on held-out rows."""
    monkeypatch.setattr(lm_scoring, "BUCKET_TOKENS", 30_000)  # two buckets
    rng = random.Random(4)
    chain = {f"w{k}": [f"w{(3 * k + 1) % 40}", f"w{(3 * k + 2) % 40}"] for k in range(40)}
    rows = []
    for i in range(600):
        word, text = f"w{rng.randrange(40)}", []
        for _ in range(120):
            text.append(word)
            word = rng.choice(chain[word])
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = ({r.doc_id: r for r in lm_scoring.score(df.repartition(n)).collect()} for n in (1, 32))
    assert max(abs(many[i].score / one[i].score - 1) for i in one) < 1e-5  # single precision, summed in other batches
    base, own = per_token(one.values())
    assert own < 0.8 * base


def test_scores_of_held_out_texts_beat_the_unigram_score(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    base, own = per_token(lm_scoring.score(docs).collect())
    assert own < base - 0.02


def test_every_label_is_learned(spark):
    rng = np.random.default_rng(3)
    letters = [chr(0x4E00 + 3 * k) for k in range(90)]
    own = lambda k: " ".join("".join(rng.choice([letters[k], "a", "b"], 4)) + letters[k] for _ in range(30))
    rows = spark.createDataFrame([(10 * k + i, own(k), f"l{k:02}") for k in range(90) for i in range(10)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(rows).collect()}
    assert {r.lang_pred for r in got.values()} == {f"l{k:02}" for k in range(90)}
    assert sum(r.lang_pred == f"l{i // 10:02}" and not r.ambiguous for i, r in got.items()) >= 0.95 * len(got)


def test_images_that_cannot_be_read(spark):
    good, cut = media.write_jpeg(b"x" * 64), media.write_jpeg(b"y" * 64)[:60]
    rows = spark.createDataFrame([(1, good), (2, None), (3, b""), (4, b"no image at all"), (5, cut), (6, good.replace(b"\xff\xc2", b"\xff\xc0"))], "doc_id long, media binary")
    got = {r.doc_id: r for r in media.load(rows).collect()}
    assert got[1].error is None and got[1].payload == b"x" * 64
    assert all(got[i].error and got[i].rgb is None and got[i].payload is None for i in range(2, 7))
