"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword of bits; one linear classifier over hashed byte n-grams predicts each
bit. Decoding weighs the losses: a language's loss is the sum over bits of the logistic loss of its
bit under the classifier's margin, and the language of least loss wins. The score is the winner's share
of exp(-loss); a document whose two nearest codewords are almost as near as each other is ambiguous.

Every label is learned. The classifiers are fitted on the driver on a sample of labelled rows (SAMPLE rows in all,
as many of each language, but LEAST_SAMPLE at least; different texts, those of least hash), of which only
the n-gram vectors leave the tasks; prediction reads whole texts.

Defined cases: null text or one without a letter is `und` with score 0; languages that are null in training are
left out; a language seen alone gives that language; with no labelled row every document is `und`; equal
texts get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_bucket, in_batches, slices

UNKNOWN = "und"
#: The sample that the classifiers are fitted on: rows in all, unless the least rows a language are more.
SAMPLE, LEAST_SAMPLE = 600, 8
#: Rows whose vectors are written out in full at once while fitting.
FITTED = 1024
#: Slots that n-grams are hashed into, and the lengths of the n-grams in bytes.
SLOTS, GRAMS = 1 << 14, (1, 2, 3)
#: Least share of the nearest codeword over the second for a document to be unambiguous.
CLEAR = 0.6
LETTER = regex.compile(r"\p{L}")


def codewords(k: int) -> np.ndarray:
    """k rows of -1 and 1. Up to five languages: all ways to part them; beyond: random rows whose least distance is greatest among tries."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        columns = np.arange(1, 1 << (k - 1))
        return np.array([[1 if row == k - 1 or not c >> row & 1 else -1 for c in columns] for row in range(k)], float)
    rng, best, most = np.random.default_rng(7), None, -1
    for _ in range(50):
        codes = rng.choice([-1.0, 1.0], (k, 8 + 4 * int(np.ceil(np.log2(k)))))
        least = codes.shape[1]
        for start in range(0, k, 512):
            apart = (codes.shape[1] - codes[start : start + 512] @ codes.T) / 2
            apart[np.arange(len(apart)), start + np.arange(len(apart))] = codes.shape[1]
            least = min(least, apart.min())
        if least > most:
            best, most = codes, least
    return best


def gram_counts(data: bytes) -> np.ndarray:
    """Square roots of the counts of hashed n-grams, as a vector of length one; letters in lower case, digits as one class."""
    b = np.frombuffer(b" " + data.lower() + b" ", "u1").astype("uint32")
    slots = []
    for n in GRAMS:
        code = np.zeros(max(0, len(b) - n + 1), "uint32")
        for k in range(n):
            code = code * np.uint32(257) + b[k : len(b) - n + 1 + k]
        slots.append((code + np.uint32(n)) * np.uint32(2654435761) >> np.uint32(18))
    counts = np.sqrt(np.bincount(np.concatenate(slots), minlength=SLOTS).astype("float32"))
    return counts / max(1e-9, float(np.sqrt((counts * counts).sum())))


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # slots x bits
    bias: np.ndarray

    def losses(self, features: np.ndarray) -> np.ndarray:
        """Loss of every language for every row of features."""
        margins = features @ self.weights + self.bias
        return (np.logaddexp(0, -margins) @ (self.codes > 0).T + np.logaddexp(0, margins) @ (self.codes < 0).T) / self.codes.shape[1]


Sparse = tuple[np.ndarray, np.ndarray]  # the slots of a vector that are not zero, and their values


def in_full(vectors: list[Sparse]) -> np.ndarray:
    out = np.zeros((len(vectors), SLOTS), "float32")
    for row, (slots, values) in zip(out, vectors):
        row[slots] = values
    return out


def fit(vectors: list[Sparse], languages: list[str], steps: int = 150, rate: float = 8.0, decay: float = 1e-4) -> Model:
    """Logistic classifiers of the codewords' bits by gradient descent; every language weighs the same."""
    names = sorted(set(languages))
    codes = codewords(len(names))
    at = np.array([names.index(x) for x in languages], int)
    target = codes[at]
    weight = (1 / np.bincount(at))[at] / len(names)
    weights, bias = np.zeros((SLOTS, codes.shape[1]), "float32"), np.zeros(codes.shape[1], "float32")
    parts = [slice(i, i + FITTED) for i in range(0, len(vectors), FITTED)]
    whole = in_full(vectors) if len(parts) == 1 else None
    for _ in range(steps):
        slope_weights, slope_bias = decay * weights, np.zeros(codes.shape[1])
        for part in parts:
            features = in_full(vectors[part]) if whole is None else whole
            slope = -target[part] / (1 + np.exp(np.clip(target[part] * (features @ weights + bias), -30, 30))) * weight[part, None]
            slope_weights = slope_weights + features.T @ slope
            slope_bias += slope.sum(0)
        weights -= (rate * slope_weights).astype("float32")
        bias -= (rate * 0.1 * slope_bias).astype("float32")
    return Model(names, codes, weights, bias)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = [gram_counts(t.encode()) for t in batch.column("text").to_pylist()]
        slots = [np.flatnonzero(v).astype("int32") for v in found]
        values = [v[at] for v, at in zip(found, slots)]
        columns = [pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
        yield pa.record_batch([batch.column("lang"), batch.column("_hash"), *columns], ["lang", "_hash", "slots", "values"])


def learn(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model | None:
    """The model from a sample of labelled rows; None if there is none. Which texts are sampled is settled on their hashes alone."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null").withColumn("_hash", F.xxhash64("text"))
    found = rows.groupBy("lang").agg(F.approx_count_distinct("_hash").alias("texts")).collect()
    if not found:
        return None
    each = max(LEAST_SAMPLE, SAMPLE // len(found))
    # Hashes are even over their range, so a low part of it holds a few times the sample: no language's rows meet in one task.
    place = F.shiftrightunsigned("_hash", 33) / float(1 << 31)
    parts = labelled.sparkSession.createDataFrame([(r.lang, min(1.0, 4 * each / max(1, r.texts))) for r in found], "lang string, part double")
    low = rows.join(F.broadcast(parts), "lang").filter(place <= F.col("part")).drop("part")  # a row a language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("_hash", 33), "_hash"))
    hashes = low.select("lang", "_hash").distinct().withColumn("_rank", rank).filter(F.col("_rank") <= each)
    texts = low.join(F.broadcast(hashes.select("lang", "_hash")), ["lang", "_hash"])  # `each` rows a language at most are broadcast
    sample = texts.groupBy("lang", "_hash").agg(F.min("text").alias("text")).mapInArrow(_vectors, "lang string, _hash long, slots array<int>, values array<float>")
    found = sorted(sample.collect(), key=lambda r: (r.lang, r._hash))
    return fit([(np.array(r.slots, "int32"), np.array(r["values"], "float32")) for r in found], [r.lang for r in found])


def predict(df: DataFrame, model: Model | None, text_col: str, keep: list[str]) -> DataFrame:
    """The columns in keep with lang_pred, score and ambiguous."""
    types = dict(df.dtypes)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, text_col):
            texts = batch.column(batch.schema.names.index(text_col)).to_pylist()
            names, scores, unclear = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            known = [i for i, t in enumerate(texts) if own and t and LETTER.search(t)]
            for start in range(0, len(known), 256):
                part = known[start : start + 256]
                losses = own.losses(np.stack([gram_counts(texts[i].encode()) for i in part]))
                share = np.exp(-4 * own.codes.shape[1] * (losses - losses.min(1, keepdims=True)))
                share /= share.sum(1, keepdims=True)
                order = np.argsort(losses, axis=1)
                for i, row, by in zip(part, share, order):
                    names[i], scores[i] = own.languages[by[0]], float(row[by[0]])
                    unclear[i] = len(by) > 1 and row[by[0]] < CLEAR
            columns = [batch.column(batch.schema.names.index(c)) for c in keep]
            yield pa.record_batch([*columns, pa.array(names), pa.array(scores, pa.float64()), pa.array(unclear)], [*keep, "lang_pred", "score", "ambiguous"])

    return in_batches(df).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + (", " if keep else "") + "lang_pred string, score double, ambiguous boolean")


def training_rows(df: DataFrame, id_col: str = "doc_id", mod: int = 4, held_out: int = 2) -> DataFrame:
    return df.filter(id_bucket(F.col(id_col), mod) != held_out)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", mod: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row; held-out rows teach nothing."""
    model = learn(training_rows(df, id_col, mod, held_out), lang_col, text_col)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), (id_bucket(F.col(id_col), mod) == held_out).alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, model, "text", ["doc_id", "held_out"])


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", mod: int = 4, held_out: int = 2) -> DataFrame:
    """df's rows whose language is known and clear; their columns stay as they are."""
    model = learn(training_rows(df, id_col, mod, held_out), lang_col, text_col)
    nested = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), F.col(text_col).alias("_text"))
    judged = predict(nested, model, "_text", ["_row"])
    return judged.filter((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")).select("_row.*")
