"""Quality rules by weak supervision, in DataFrame operations only.

Each rule looks at a document's counts and votes bad (2), good (1) or abstains (0), so votes of one document often
conflict. Expectation-maximisation estimates, for good and for bad documents, how often each rule that votes votes which way, and
the prior share of good ones (a rule that abstains says nothing either way); the posterior probability of being good then decides, in place of the demand that
every rule passes. The classes are told apart by where the estimates start and by pseudo-counts of that start, and by
nothing else: a rule whose bad votes are common among good documents loses its weight.

The rules only meet as combinations of votes, at most 3 to the power of the number of rules whatever the number of
documents. Their counts over all documents reach the driver, where the iterations run.

Defined cases: a null or empty text has no words and fails the base test; equal texts get equal verdicts, however
often they occur; texts of any length are counted whole; a table of few rows leaves the estimates near their start; an
empty table gives an empty result. `score` ignores other columns; `keep_good` returns them as they are, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

BLANK = r"[\x20\x09-\x0D]"
#: What a line of prose ends with.
SENTENCE_ENDS = (".", "!", "?", ":", "。", "！", "？", "…")
#: Words in a window of the repetition count.
WINDOW = 8
#: Base test: least words, most words in repeated windows (per cent).
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Least posterior probability of being good for a document to be kept.
KEEP_AT = 0.5
ITERATIONS = 100
#: Documents of each class that the start counts for.
PSEUDO_COUNT = 10.0
BAD, GOOD, ABSTAIN = 2, 1, 0


def _bind(value: Column, use) -> Column:
    """use(value), where value is worked out once however often use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _windows(hashes: Column) -> Column:
    """A hash of every window of words."""
    ahead = F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)]))
    return F.slice(ahead, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0)))


def _places(ordered: Column) -> Column:
    """Places of the windows that equal a neighbour, from windows sorted by hash and place."""
    n = F.size(ordered)
    hash_at = lambda k: F.element_at(ordered, k)["h"]  # noqa: E731  k counts from 1

    def if_twice(x: Column, k: Column) -> Column:
        before = F.when(k > 0, hash_at(F.greatest(k, F.lit(1))) == x["h"]).otherwise(False)
        after = F.when(k + 2 <= n, hash_at(F.least(k + 2, n)) == x["h"]).otherwise(False)
        return F.when(before | after, x["i"])

    return F.sort_array(F.filter(F.transform(ordered, if_twice), lambda i: i.isNotNull()))


def _covered(places: Column) -> Column:
    """Words under the windows that begin at these places, in ascending order."""
    return F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).cast("long").alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )


def _repeated(windows: Column) -> Column:
    """Words in windows that occur twice or more; most texts have none, as the set of distinct windows shows."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(_bind(ordered, lambda s: _bind(_places(s), _covered)))


def counts_of(text: Column) -> Column:
    """A struct with all counts of one text."""
    left = lambda c, pattern: F.length(F.regexp_replace(c, pattern, "")).cast("long")
    words = F.filter(F.split(text, BLANK + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_chars = lambda c: F.struct(
        F.length(c).cast("long").alias("word_chars"),
        left(c, r"[^#*$%&|<>]+").alias("n_symbols"),
        left(c, r"[^\p{L}]+").alias("n_letters"),
        left(c, r"[^\p{Lu}]+").alias("n_capitals"),
    )
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        F.size(F.filter(w, lambda x: F.length(x) <= 3)).cast("long").alias("n_short"),
        _bind(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _bind(_windows(h), _repeated)).alias("n_repeat_words"),
        _bind(F.array_join(w, ""), of_chars).alias("c"),
    )
    of_lines = lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(x, lambda y: F.right(F.rtrim(y), F.lit(1)).isin(*SENTENCE_ENDS))).cast("long").alias("n_ended"),
    )
    return F.struct(_bind(words, of_words).alias("w"), _bind(lines, of_lines).alias("l"))


def with_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the counts of its text and base_failed.

    The generator over one struct keeps the optimiser from repeating the work for each use of a count.
    """
    counted = df.select("*", F.explode(F.array(counts_of(F.coalesce(F.col(text_col), F.lit(""))))).alias("_c"))
    names = {c: f"w.{c}" for c in ("n_words", "n_distinct", "n_short", "n_repeat_words")} | {c: f"l.{c}" for c in ("n_lines", "n_dup_lines", "n_ended")}
    names |= {c: f"w.c.{c}" for c in ("word_chars", "n_symbols", "n_letters", "n_capitals")}
    counted = counted.select(*df.columns, *[F.col(f"_c.{path}").alias(name) for name, path in names.items()])
    return counted.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def _graded(value: Column, good: Column, bad: Column) -> Column:
    """A vote from two tests; what passes neither is left open, and so is a value that can't be told."""
    return F.when(value.isNull(), ABSTAIN).when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """Votes by rule, from the counts; each rule can speak for and against a document."""
    words, chars, lines = (F.nullif(F.col(c), F.lit(0)) for c in ("n_words", "word_chars", "n_lines"))
    symbols, others, length = F.col("n_symbols") / words, 1 - F.col("n_letters") / chars, F.col("word_chars") / words
    repeated, variety = F.col("n_repeat_words") / words, F.col("n_distinct") / F.pow(words, F.lit(0.75))
    twice, ended, short, capitals = F.col("n_dup_lines") / lines, F.col("n_ended") / lines, F.col("n_short") / words, F.col("n_capitals") / F.nullif(F.col("n_letters"), F.lit(0))
    many = F.col("n_words") >= 30
    return {
        "symbols": _graded(symbols, symbols < 0.01, symbols > 0.1),
        "non_letters": _graded(others, others < 0.06, others > 0.12),
        "repeated_lines": _graded(twice, (twice == 0) & (F.col("n_lines") >= 3), twice > 0.2),
        "repeated_words": _graded(repeated, (repeated == 0) & many, repeated > 0.1),
        "variety": _graded(variety, many & (variety > 2.2), many & (variety < 1.5)),
        "word_length": _graded(length, length.between(4.2, 6), (length < 3) | (length > 7)),
        "capitals": _graded(capitals, capitals < 0.06, capitals > 0.2),
        "line_ends": _graded(ended, ended > 0.9, ended < 0.6),
        "short_words": _graded(short, many & short.between(0.2, 0.45), many & ~short.between(0.1, 0.6)),
        "n_words": _graded(words, words >= 100, words < 40),
    }


#: Chance that a vote is good or bad before learning, for bad and for good documents, and the share of good ones.
START = {"bad": (0.45, 0.55), "good": (0.92, 0.08)}
START_PRIOR = 0.85


def _odds(model: dict) -> list[list[float]]:
    """By rule, what each vote (abstain, good, bad) adds to the log odds of being good."""
    return [[0.0, *(math.log(g / b) for g, b in zip(good, bad))] for good, bad in zip(model["good"], model["bad"])]


def _posterior(votes: Column, model: dict) -> Column:
    """Probability of being good under the model, from an array of votes."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in _odds(model)])
    said = F.zip_with(votes, table, lambda v, row: F.element_at(row, v + 1))
    return 1 / (1 + F.exp(-F.aggregate(said, F.lit(math.log(model["prior"] / (1 - model["prior"]))), lambda total, x: total + x)))


def fit(combined: list[tuple[list[int], int]], n_rules: int) -> dict:
    """Vote chances and prior by expectation-maximisation over (votes, number of documents with them)."""
    model = {"prior": START_PRIOR} | {k: [START[k]] * n_rules for k in START}
    whole = sum(n for _, n in combined)
    for _ in range(ITERATIONS):
        odds, first = _odds(model), math.log(model["prior"] / (1 - model["prior"]))
        sums = {k: [[PSEUDO_COUNT * x for x in START[k]] for _ in range(n_rules)] for k in START}
        n_good = 0.0
        for votes, n in combined:
            good = n / (1 + math.exp(-max(-500.0, min(500.0, first + sum(row[v] for row, v in zip(odds, votes))))))
            n_good += good
            for j, v in enumerate(votes):
                if v != ABSTAIN:
                    sums["good"][j][v - 1] += good
                    sums["bad"][j][v - 1] += n - good
        prior = (n_good + START_PRIOR * 2 * PSEUDO_COUNT) / (whole + 2 * PSEUDO_COUNT)
        moved = abs(prior - model["prior"])
        model = {"prior": prior} | {k: [tuple(x / sum(row) for x in row) for row in sums[k]] for k in START}
        if moved < 1e-7:
            break
    return model


def learn(counts: DataFrame) -> dict:
    """The model for a table of counts; documents that fail the base test vote too."""
    combined = counts.select(F.array(*rules().values()).alias("votes")).groupBy("votes").agg(F.count("*").alias("n"))
    return fit([(r.votes, r.n) for r in combined.collect()], len(rules()))  # 3 to the power of the number of rules at most


def judged(counts: DataFrame, model: dict) -> DataFrame:
    """counts with quality (posterior) and kept."""
    return counts.withColumn("quality", _posterior(F.array(*rules().values()), model)).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_AT))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_letters", "n_capitals", "n_lines", "n_ended", "n_short", "n_distinct")


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, quality and kept of every row; the counts are made once and kept, the texts are not."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    counts = materialise(with_counts(rows, "_text").select("doc_id", *COUNTS), "quality-counts")
    return judged(counts, learn(counts))


def keep_good(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df that are kept, with df's own columns. Counts are written beside the rows, so they are made once."""
    nested = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), F.col(text_col).alias("_text"))
    rows = materialise(with_counts(nested, "_text").select("_row", *COUNTS), "quality-rows")
    return judged(rows, learn(rows.select(*COUNTS))).filter("kept").select("_row.*")
