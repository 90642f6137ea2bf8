"""Scores of texts under a log-bilinear language model, beside a smoothed unigram score.

Counts cover all training documents: tasks count their words and the counts are added up by word. The
most frequent words (HEAD at most, by count) are known to every task and have vectors of their own, so their number grows
with the data up to HEAD; the rest stay in a table, and the rare tokens of the documents are joined with it.

The model is factored: known words are dealt into classes by rank, frequent words into small ones; one more class holds
all rare and unknown words. A class's score is the product of its vector with the sum of the weighted vectors of the
CONTEXT words before it, plus a bias, and so is a word's score within its class; a rare word has its smoothed share of
its class. All words together have probability one. Before training the model is the unigram model.

Training is by noise-contrastive estimation in numpy, in ROUNDS rounds that begin at the last average. Training documents
are dealt into buckets and rounds by checksums of their ids and taken in order of ids, and the number of buckets follows
from the number of training tokens (a bucket for every BUCKET_TOKENS, MOST_BUCKETS at most), so the model is a
function of the rows and not of how the table is split. Each bucket's changes are averaged by how often it met each
word. Scoring takes batched matrix products and normalises over all classes and over the word's class.

Defined cases: a null or empty text is its end token alone; a null id counts as the empty text when rows are
held out; without training documents every word is unknown and has the class of rare words; equal
texts get equal scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import BATCH_BYTES, id_bucket, in_batches, materialise, slices

#: The end of a text, which no word equals.
END = ""
#: Most words that every task knows; places of words are kept in two bytes.
HEAD = 50_000
#: (up to rank, words of a class): frequent words are in small classes, which keeps the mean cost of a token low.
CLASSES = [(1024, 64), (5120, 128), (HEAD + 512, 512)]
CONTEXT, WIDTH = 2, 16
#: Noise classes of a minibatch, noise words of each class in it, step size.
NOISE_CLASSES, NOISE_WORDS, RATE = 32, 16, 0.1
#: Tokens of a minibatch: the bucket's part of a round is dealt into STEPS, within these bounds.
LEAST_BATCH, BATCH, STEPS = 256, 4096, 128
ROUNDS, BUCKET_TOKENS, MOST_BUCKETS = 4, 4_000_000, 4096
#: Rows of a block of parameters when buckets are averaged.
BLOCK = 2048
#: Words that a task counts before it hands counts on; as many more may wait to be added to them.
COUNTED = 500_000


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a batch of texts, each token's number among them, and where each text begins; a text's last token is END."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null("")))
    # The blank added makes an empty last word of each text; the empty text is one empty word as it is.
    split = pc.ascii_split_whitespace(pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(texts, " ", "")))
    coded = split.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), split.offsets.to_numpy()[:-1].astype("int64")


def word_counts(df: DataFrame) -> DataFrame:
    """word, c (occurrences in training rows), n (in all rows), from text and held_out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting = [], 0

        def added() -> pa.Table:
            found = pa.Table.from_batches(parts).group_by("word", use_threads=False).aggregate([("c", "sum"), ("n", "sum")])
            return found.select(["word", "c_sum", "n_sum"]).rename_columns(["word", "c", "n"]).combine_chunks()

        for batch in slices(batches, "text", BATCH_BYTES):
            words, codes, starts = tokens_of(batch.column("text"))
            seen = ~batch.column("held_out").to_numpy(zero_copy_only=False).repeat(np.diff(np.append(starts, len(codes))))
            parts.append(pa.record_batch([words, pa.array(np.bincount(codes[seen], minlength=len(words))), pa.array(np.bincount(codes, minlength=len(words)))], ["word", "c", "n"]))
            waiting += len(words)
            if waiting > COUNTED:
                table = added()
                parts, waiting = table.to_batches(), 0
                if table.num_rows > COUNTED:
                    yield from parts
                    parts = []
        if parts:
            yield from added().to_batches()

    return in_batches(df.select("text", "held_out")).mapInArrow(run, "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What every task knows: the head's words with counts, places and classes, and the mass of all others."""

    words: pa.Array
    c: np.ndarray  # occurrences in training, by the head's places
    place: np.ndarray  # rank among words with occurrences in training, or the rare place after all of these
    mass: np.ndarray  # smoothed mass by place, the rare one's last
    tokens: int  # N
    kinds: int  # V

    def __post_init__(self):
        n = self.rare
        starts, at = [], 0
        for rank, size in CLASSES:
            while at < min(rank, n):
                starts.append(at)
                at += size
        self.starts = np.array([*starts, n], "int64")  # first place of each class; the last is the rare one's
        self.stops = np.minimum(np.append(self.starts[1:], n + 1), n + 1)
        self.of = np.searchsorted(self.starts, np.arange(n + 1), "right") - 1
        self.class_mass = np.add.reduceat(self.mass, self.starts)

    @property
    def rare(self) -> int:
        return len(self.mass) - 1

    @property
    def end(self) -> int:
        return int(self.places(self.ids(pa.array([END])))[0])

    def ids(self, words: pa.Array) -> np.ndarray:
        """Numbers in the head, -1 for others."""
        return pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype("int64")

    def places(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < 0, self.rare, self.place[ids])


def head_threshold(counts: DataFrame, most: int, by: str) -> float:
    """The least eighth of a power of two such that at most `most` words occur more often, by that column; one row a step reaches the driver."""
    counts = counts.filter(F.col(by) > 0)
    step = F.floor(F.log2(by) * 8).cast("int")
    at, held = None, 0
    for row in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect(), reverse=True):
        held += row.k
        if held > most:
            return 2 ** ((row.step + 1) / 8)
        at = row.step
    return 2 ** ((at or 0) / 8)


def vocabulary(counts: DataFrame, head: int = HEAD) -> tuple[Vocabulary, Column]:
    """The vocabulary, and which rows of counts it holds.

    The model's words are those that occur most in training rows (c). Words that are frequent over all rows (n) but not
    among them, held-out ones for instance, are only looked up, so that no word that is left to a join is a hot key.
    """
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count_if(F.col("c") > 0).alias("kinds")).first()
    least, common = head_threshold(counts, head, "c"), head_threshold(counts, head, "n")
    modelled = lambda r: r.c > 0 and (r.c >= least or r.word == "")
    held = (F.col("c") >= least) | (F.col("n") >= common) | (F.col("word") == "")
    rows = sorted(counts.filter(held).collect(), key=lambda r: (not modelled(r), -r.c, r.word))  # twice `head` and one at most
    if not any(r.word == "" for r in rows):  # there is no document at all
        rows.append(Row(word="", c=0, n=0))
    c = np.array([r.c for r in rows], "int64")
    known = sum(map(modelled, rows))  # these come first
    place = np.minimum(np.arange(len(rows)), known)
    mass = np.append(c[:known] + 0.5, max(0.5, total.tokens + 0.5 * (total.kinds + 1) - (c[:known] + 0.5).sum()))
    return Vocabulary(pa.array([r.word for r in rows], pa.string()), c, place, mass, total.tokens, total.kinds), held


@dataclass
class LogBilinear:
    r: np.ndarray  # vectors of context words, by place
    q: np.ndarray  # vectors of words within their class, the last column the bias
    k: np.ndarray  # vectors of classes, the last column the bias
    w: np.ndarray  # weights of the context's places, elementwise

    @staticmethod
    def start(v: Vocabulary) -> LogBilinear:
        """The unigram model: words and classes have their masses as biases and no vector yet."""
        rng = np.random.default_rng(11)
        n, classes = len(v.mass), len(v.starts)
        flat = lambda bias: np.column_stack([np.zeros((len(bias), WIDTH)), bias]).astype("float32")
        return LogBilinear(rng.normal(0, 0.3, (n, WIDTH)).astype("float32"), flat(np.log(v.mass / v.class_mass[v.of])), flat(np.log(v.class_mass / v.class_mass.sum())), np.full((CONTEXT, WIDTH), 1 / CONTEXT, "float32"))

    def arrays(self) -> list[np.ndarray]:
        return [self.r, self.q, self.k, self.w]

    def hidden(self, context: np.ndarray) -> np.ndarray:
        out = (self.r * self.w[0]).take(context[:, 0], axis=0)
        for i in range(1, CONTEXT):
            out += (self.r * self.w[i]).take(context[:, i], axis=0)
        return out

    def factors(self) -> list[np.ndarray] | None:
        """For each place of the context, by word and class, what the word multiplies the class's exponential by; None where these may overflow."""
        scores = [(self.r * w) @ self.k[:, :-1].T for w in self.w]
        scores[0] += self.k[:, -1]
        if sum(max(s.max(), -s.min()) for s in scores) > 75:
            return None
        return [np.exp(s, out=s) for s in scores]

    def log_probabilities(self, context: np.ndarray, target: np.ndarray, v: Vocabulary, factors: list[np.ndarray] | None = None) -> np.ndarray:
        """Natural log probability of each target place: that of its class, and in it; in products small enough for a core's cache.

        With this model's factors a class's exponential is their product, and no exponential is computed for it.
        """
        out, h, own = np.empty(len(target)), np.ones((len(target), WIDTH + 1), "float32"), v.of[target]
        h[:, :-1] = self.hidden(context)
        reach = float(np.sqrt(np.einsum("ij,ij->i", h[:, :-1], h[:, :-1]).max(initial=0.0)))  # the longest hidden vector
        if factors:
            ones = np.ones(len(self.k), "float32")
            for start in range(0, len(target), 512):
                at = slice(start, start + 512)
                s = factors[0].take(context[at, 0], axis=0)
                for i in range(1, CONTEXT):
                    s *= factors[i].take(context[at, i], axis=0)
                out[at] = np.log(s[np.arange(len(s)), own[at]] / (s @ ones))
        else:
            self._add_log_softmax(out, h, np.arange(len(target)), own, self.k, reach, fresh=True)
        order = np.argsort(own.astype("int16"), kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1) if len(order) else []:
            first, stop = v.starts[own[part[0]]], v.stops[own[part[0]]]
            if stop - first > 1:
                self._add_log_softmax(out, h, part, target[part] - first, self.q[first:stop], reach)
        return out

    @staticmethod
    def _add_log_softmax(out: np.ndarray, h: np.ndarray, rows: np.ndarray, chosen: np.ndarray, vectors: np.ndarray, reach: float, fresh: bool = False) -> None:
        longest = np.sqrt(np.einsum("ij,ij->i", vectors[:, :-1], vectors[:, :-1]).max())
        across, safe, ones = np.ascontiguousarray(vectors.T), reach * longest + np.abs(vectors[:, -1]).max() <= 75, np.ones(len(vectors), "float32")
        for start in range(0, len(rows), 512):
            at, pick = rows[start : start + 512], chosen[start : start + 512]
            s = (h[start : start + 512] if fresh else h.take(at, axis=0)) @ across
            own = s[np.arange(len(s)), pick]
            if not safe:  # else no exponential overflows, nor do they all vanish
                top = s.max(1, keepdims=True)
                s -= top
                own = own - top[:, 0]
            gained = own - np.log(np.exp(s, out=s) @ ones)
            out[at] = gained if fresh else out[at] + gained


def contexts(places: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """The CONTEXT places before each token of texts that begin at starts; before a text there are ends."""
    out = np.full((len(places), CONTEXT), end, "int64")
    text = np.cumsum(np.bincount(starts, minlength=len(places) + 1)[: len(places)])
    for k in range(1, CONTEXT + 1):
        same = text[k:] == text[:-k]
        out[k:, k - 1] = np.where(same, places[:-k], end)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in x's own memory."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive estimation with steps scaled by the squares of past slopes; counts how often each row was met."""

    def __init__(self, model: LogBilinear, v: Vocabulary, rate: float, batch: int, seed: int):
        self.model, self.v, self.rate, self.batch = model, v, rate, batch
        self.squares = [np.ones_like(a) for a in model.arrays()]
        self.met = [np.zeros(len(a), "float32") for a in model.arrays()]
        self.class_log = np.log(NOISE_CLASSES * v.class_mass / v.class_mass.sum()).astype("float32")
        self.class_cut = np.cumsum(v.class_mass / v.class_mass.sum())
        self.word_log = np.log(NOISE_WORDS * v.mass / v.class_mass[v.of]).astype("float32")
        self.cut = np.cumsum(v.mass)
        self.below = np.concatenate(([0.0], self.cut))[v.starts]
        self.rng = np.random.default_rng(seed)

    def learn(self, context: np.ndarray, target: np.ndarray) -> None:
        for start in range(0, len(target), self.batch):
            self._step(context[start : start + self.batch], target[start : start + self.batch])

    def _move(self, which: int, at: np.ndarray, slopes: np.ndarray) -> None:
        """A step on the rows at, whose slopes are added up where a row is named more than once."""
        order = np.argsort(at.astype("uint16"), kind="stable")  # short integers sort fast
        rows = at[order]
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        rows, total = rows[first], np.add.reduceat(slopes.take(order, axis=0), first, axis=0)
        array, square = self.model.arrays()[which], self.squares[which]
        grown = square.take(rows, axis=0)
        grown += total * total
        square[rows] = grown
        total *= self.rate
        total /= np.sqrt(grown, out=grown)
        total += array.take(rows, axis=0)
        array[rows] = total
        self.met[which][rows] += np.diff(np.append(first, len(at)))

    def _step(self, context: np.ndarray, target: np.ndarray) -> None:
        m, v = self.model, self.v
        order = np.argsort(target.astype("uint16"), kind="stable")  # by rank, thus by class too
        context, target = context.take(order, axis=0), target.take(order)
        own = v.of[target]
        vectors = [m.r.take(context[:, i], axis=0) for i in range(CONTEXT)]
        h = np.ones((len(target), WIDTH + 1), "float32")
        h[:, :-1] = sum(x * m.w[i] for i, x in enumerate(vectors))
        # Classes: the noise is shared by the minibatch.
        noise = np.minimum(np.searchsorted(self.class_cut, self.rng.random(NOISE_CLASSES)), len(m.k) - 1)
        mine, others = m.k.take(own, axis=0), m.k[noise]
        true = sigmoid(self.class_log[own] - np.einsum("ij,ij->i", h, mine))[:, None]
        false = sigmoid(h @ others.T - self.class_log[noise])
        mine *= true
        back = mine
        back -= false @ others
        self._move(2, np.concatenate([own, noise]), np.concatenate([true * h, -(false.T @ h)]))
        # Words: the noise comes from a token's class and is shared by the tokens of that class; the rare class has no words.
        n = int(np.searchsorted(own, len(v.starts) - 1))
        hi, at, q = h[:n], target[:n], m.q.take(target[:n], axis=0)
        pull = sigmoid(self.word_log[at] - np.einsum("ij,ij->i", hi, q))[:, None]
        q *= pull
        back[:n] += q
        first = np.flatnonzero(np.concatenate(([True], own[1:n] != own[: n - 1]))) if n else np.array([], "int64")
        drawn = self.below[own[first], None] + self.rng.random((len(first), NOISE_WORDS)) * v.class_mass[own[first], None]
        words = np.clip(np.searchsorted(self.cut, drawn.reshape(-1), "right").reshape(drawn.shape), v.starts[own[first], None], v.stops[own[first], None] - 1)
        noisy, pushed, scores = m.q[words], np.empty((*words.shape, WIDTH + 1), "float32"), np.empty((n, NOISE_WORDS), "float32")
        groups = list(zip(first.tolist(), [*first[1:].tolist(), n]))
        for (start, stop), some in zip(groups, noisy):
            np.matmul(h[start:stop], some.T, out=scores[start:stop])
        scores -= self.word_log[words].repeat(np.diff(np.append(first, n)), axis=0)
        false = sigmoid(scores)
        for (start, stop), some, push in zip(groups, noisy, pushed):
            back[start:stop] -= false[start:stop] @ some
            np.matmul(false[start:stop].T, h[start:stop], out=push)
        if n:
            self._move(1, np.concatenate([at, words.reshape(-1)]), np.concatenate([pull * hi, -pushed.reshape(-1, WIDTH + 1)]))
        back = np.ascontiguousarray(back[:, :-1])
        self._move(0, context.T.reshape(-1), np.concatenate([back * w for w in m.w]))
        self._move(3, np.arange(CONTEXT), np.stack([np.einsum("ij,ij->j", back, x) for x in vectors]))


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Places of all tokens of a batch of encoded texts, and where each text begins."""
    coded = batch.column("places").to_pylist()
    sizes = np.array([len(x) // 2 for x in coded], "int64")
    return np.frombuffer(b"".join(coded), "<u2").astype("int64"), np.cumsum(sizes) - sizes


def train(coded: DataFrame, shared, v: Vocabulary) -> LogBilinear:
    """The model after all rounds over the encoded training rows (doc_id, places, part)."""
    context = coded.sparkSession.sparkContext
    buckets = max(1, min(MOST_BUCKETS, -(-v.tokens // BUCKET_TOKENS)))
    batch = max(LEAST_BATCH, min(BATCH, v.tokens // (buckets * ROUNDS * STEPS)))
    model = LogBilinear.start(v)
    keyed = coded.withColumns({"bucket": (F.col("part") % buckets).cast("int"), "round": (F.shiftrightunsigned("part", 40) % ROUNDS).cast("int")})
    for number in range(ROUNDS if v.tokens else 0):
        sent = context.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            own, begun, trainer, bucket = shared.value, sent.value, None, None
            end = own.end

            def changes() -> Iterator[pa.RecordBatch]:
                for which, (array, old, met) in enumerate(zip(trainer.model.arrays(), begun.arrays(), trainer.met)):
                    for row in range(0, len(array), BLOCK):
                        part = slice(row, row + BLOCK)
                        columns = [[bucket], [which], [row // BLOCK], [met[part].tobytes()], [(array[part] - old[part]).astype("float16").tobytes()]]
                        yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "which", "block", "met", "change"])

            for rows in batches:
                names = rows.column("bucket").to_numpy()
                for first, stop in zip(cuts := [0, *(np.flatnonzero(np.diff(names)) + 1).tolist()], [*cuts[1:], len(names)]):
                    if first == stop:
                        continue
                    if bucket != int(names[first]):
                        if trainer:
                            yield from changes()
                        bucket = int(names[first])
                        trainer = Trainer(LogBilinear(*[a.copy() for a in begun.arrays()]), own, RATE / (1 + number), batch, bucket)
                    for piece in slices(iter([rows.slice(first, stop - first)]), "places"):
                        places, starts = _texts(piece)
                        trainer.learn(contexts(places, starts, end), places)
            if trainer:
                yield from changes()

        mine = keyed.filter(F.col("round") == number).select("bucket", "doc_id", "places")
        dealt = mine.repartition(buckets, "bucket").sortWithinPartitions("bucket", "doc_id", F.xxhash64("places"))
        found = in_batches(dealt).mapInArrow(run, "bucket int, which int, block int, met binary, change binary")
        # One row a block reaches the driver: as many numbers as the model has.
        blocks = found.repartition("which", "block").sortWithinPartitions("which", "block", "bucket").mapInArrow(_averages, "which int, block int, mean binary").collect()
        arrays = [a.copy() for a in model.arrays()]
        for b in blocks:
            part = arrays[b.which][b.block * BLOCK : (b.block + 1) * BLOCK]
            part += np.frombuffer(b["mean"], "float32").reshape(part.shape)
        model = LogBilinear(*arrays)
    return model


def _averages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means of changes by block, weighted by how often each row was met, from rows sorted by block."""
    key = weights = sums = None

    def out() -> pa.RecordBatch:
        mean = (sums / np.maximum(weights, 1e-9)[:, None]).astype("float32")
        return pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([mean.tobytes()], pa.binary())], ["which", "block", "mean"])

    for batch in batches:
        for which, block, met, change in zip(*(batch.column(c).to_pylist() for c in ("which", "block", "met", "change"))):
            if key != (which, block):
                if key:
                    yield out()
                key, weights, sums = (which, block), 0.0, 0.0
            met = np.frombuffer(met, "float32").astype("float64")
            weights = weights + met
            sums = sums + met[:, None] * np.frombuffer(change, "float16").astype("float64").reshape(len(met), -1)
    if key:
        yield out()


def encoded(df: DataFrame, shared) -> DataFrame:
    """Each row's places (two bytes a token), what can be told without the rare words' counts, and those words with how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        share = np.log10(v.c + 0.5)
        for batch in slices(batches, "text", BATCH_BYTES):
            words, codes, starts = tokens_of(batch.column("text"))
            ends = np.append(starts, len(codes))
            ids = v.ids(words)  # this and the next are by distinct word
            places, head = v.places(ids), ids >= 0
            own = np.where(head, share[ids], 0.0)
            add = lambda x: pa.array(np.add.reduceat(x[codes], starts))
            missing = np.flatnonzero(~head[codes])
            found, times = np.unique(np.searchsorted(starts, missing, "right") * len(words) + codes[missing], return_counts=True)
            text, word = found // len(words) - 1, found % len(words)
            rare = pa.MapArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(ends))), pa.int32()), words.take(pa.array(word)), pa.array(times))
            coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((2 * ends).astype("int32")), pa.py_buffer(places.astype("<u2")[codes])])
            columns = [batch.column(c) for c in ("_row", "doc_id", "held_out", "part")]
            columns += [pa.array(np.diff(ends)), add((head & (v.c[ids] > 0)).astype("int64")), add(own), add(np.where(places == v.rare, own, 0.0)), rare, coded]
            yield pa.record_batch(columns, ["_row", "doc_id", "held_out", "part", "n_tokens", "n_known", "own", "own_rare", "rare", "places"])

    return in_batches(df).mapInArrow(run, "_row long, doc_id long, held_out boolean, part long, n_tokens long, n_known long, own double, own_rare double, rare map<string,long>, places binary")


def modelled(coded: DataFrame, shared, learned) -> DataFrame:
    """_row and learned: the model's log10 probability of all places, less the rare class's mass for each rare token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model = shared.value, learned.value
        factors = model.factors()  # two tables of words by classes, so texts come in small slices
        end, mass = v.end, math.log10(v.mass[-1])
        for batch in slices(batches, "places", 1 << 18):
            if batch.num_rows:
                places, starts = _texts(batch)
                logs = model.log_probabilities(contexts(places, starts, end), places, v, factors) / math.log(10) - mass * (places == v.rare)
                yield pa.record_batch([*[batch.column(c) for c in KEPT], pa.array(np.add.reduceat(logs, starts))], [*KEPT, "learned"])

    return in_batches(coded.select(*KEPT, "places")).mapInArrow(run, "_row long, doc_id long, held_out boolean, n_tokens long, n_known long, own double, own_rare double, learned double")


KEPT = ("_row", "doc_id", "held_out", "n_tokens", "n_known", "own", "own_rare")


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 5, held_out: int = 1, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    context = df.sparkSession.sparkContext
    # Ids' checksums are even over their range, and other bits than those that hold rows out deal them into buckets.
    part = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string")), 1)
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("doc_id"), (id_bucket(F.col(id_col), mod) == held_out).alias("held_out"), part.alias("part"), F.col(text_col).alias("text"))
    counts = materialise(word_counts(rows), "word-counts")
    known, held = vocabulary(counts, head)
    shared = context.broadcast(known)
    coded = materialise(encoded(rows, shared), "coded-texts")
    model = train(coded.filter("not held_out").select("doc_id", "part", "places"), shared, known)
    scored = modelled(coded, shared, context.broadcast(model))
    # A word that occurs once in all rows needs no look-up: it was seen in training if its own row was.
    tail = counts.filter(~held & (F.col("n") > 1)).select("word", "c")
    # Rare words only: none occurs as often as the words that are held, so none is a hot key.
    rare = coded.select("_row", "held_out", F.explode("rare").alias("word", "times")).join(tail, "word", "left")
    rare = rare.withColumn("c", F.coalesce("c", F.when(F.col("held_out"), 0).otherwise(1)))
    rare = rare.groupBy("_row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("rare_own"), F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("rare_known"))
    beyond = F.coalesce("rare_own", F.lit(0.0))
    return scored.join(rare, "_row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("own") + beyond - F.col("n_tokens") * math.log10(known.tokens + 0.5 * (known.kinds + 1))).alias("base_score"),
        (F.col("learned") + F.col("own_rare") + beyond).alias("score"),
    )
