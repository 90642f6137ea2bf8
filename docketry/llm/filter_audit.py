"""How filters interact: what each step of every order of filters removes, from one pass over the rows.

A row meets the audit only as its mask, one bit for each filter that it fails. Rows are counted by part and mask, so that a part
is one array of 2^n counts whatever its size. The subset-zeta transform turns these in n passes into the number of rows
whose mask lies within each set of filters; the survivors of a set of filters are those whose mask lies within its complement.
Every step of every order is then a difference of the survivors of two neighbouring sets, and so are the labels it
loses; Shapley sums are differences weighted by the number of orders in which they occur.

Defined cases: a null text is empty; a filter that is null for a row doesn't fail it; a null part is the empty string; rows without a
label, or with a null id, lose no label; of several labels of one id any that says 1 counts; a null id is no smaller id, so
such a row never fails for a repeated text nor makes another fail; rows of equal id and text don't fail each other; an empty table has
no part and gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

BLANK = r"[\x20\x09-\x0D]"


def _bind(value: Column, use) -> Column:
    """use(value), where value is worked out once however often use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text_measures(text: Column) -> Column:
    """A struct of n_words, n_distinct, n_capitals (A-Z), n_points (code points) of a whole text."""
    words = F.filter(F.split(text, BLANK + "+"), lambda w: w != "")
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.length(text).cast("long").alias("n_points"),
    )
    return _bind(words, of_words)


def subset_sums(counts: Column, filters: int) -> Column:
    """The zeta transform: entry m of an array of 2^filters becomes the sum of the entries of all subsets of m."""

    def passed(bit: int):
        # Each set with the bit gains what the same set without it has.
        return lambda a: F.transform(a, lambda x, m: F.when(m.bitwiseAND(bit) != 0, x + F.get(a, m.bitwiseXOR(bit))).otherwise(x))

    for k in range(filters):
        counts = _bind(counts, passed(1 << k))
    return counts


def earlier_copies(rows: DataFrame) -> DataFrame:
    """rows (doc_id, digest, ...) with `repeated`: whether a smaller id has the same digest.

    The least id of each digest is a sum of partial minima, so a text with most rows is no hot key; rows then meet it by digest and
    id together, and of a digest only rows of that one id find a partner.
    """
    first = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    joined = rows.join(first, ["digest", "doc_id"], "left")
    return joined.withColumn("repeated", F.col("doc_id").isNotNull() & F.col("_first").isNull()).drop("_first")


def mask_counts(rows: DataFrame, filters: int) -> DataFrame:
    """part and the arrays n, good, toxic of 2^filters counts from rows (part, mask, good, toxic)."""
    counted = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    by_mask = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("_by"))
    all_masks = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    at = lambda name: F.transform(all_masks, lambda m: F.coalesce(F.try_element_at("_by", m)[name], F.lit(0).cast("long"))).alias(name)
    return by_mask.select("part", at("n"), at("good"), at("toxic"))


def audit(rows: DataFrame, names: str) -> DataFrame:
    """part, filter_order, step and the counts of that step for every order of the filters, one letter of names each.

    rows: part, mask (bit k: the row fails filter k), good, toxic (booleans). Per part: kept after the step, removed by it,
    redundant (failing its filter, removed before), unique_fails (failing its filter only), good_lost and toxic_lost (removed
    with that label), shapley (removed by its filter, summed over all orders).
    """
    n, full = len(names), (1 << len(names)) - 1
    summed = F.struct(*[subset_sums(F.col(c), n).alias(c) for c in ("n", "good", "toxic")])
    sums = mask_counts(rows, n).select("part", F.explode(F.array(summed)).alias("_z")).select("part", "_z.*")  # worked out once a part
    # From here on entry m counts the rows whose mask lies within m.
    left = lambda c, applied: F.get(F.col(c), F.lit(full).bitwiseXOR(applied))
    # |S|! orders of the filters before this one, times those of the rest.
    weights = F.array(*[F.lit(math.factorial(size) * math.factorial(n - 1 - size)) for size in range(n)])
    gain = lambda s, k: F.get(weights, F.bit_count(s)) * (left("n", s) - left("n", s.bitwiseOR(F.call_function("shiftleft", F.lit(1), k))))
    without = lambda k: F.filter(F.sequence(F.lit(0), F.lit(full)), lambda s: F.call_function("shiftright", s, k).bitwiseAND(1) == 0)
    shapley = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.aggregate(without(k), F.lit(0).cast("long"), lambda total, s: total + gain(s, k)))
    orders = list(itertools.permutations(range(n)))
    steps = [{"filter_order": "".join(names[j] for j in o), "step": i + 1, "k": k, "before": sum(1 << j for j in o[:i])} for o in orders for i, k in enumerate(o)]
    steps = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, k: int, before: int>>")
    each = sums.withColumn("shapley", shapley).withColumn("_s", F.explode(steps)).select("*", "_s.*")
    own = F.call_function("shiftleft", F.lit(1), F.col("k"))
    after = F.col("before").bitwiseOR(own)
    removed = left("n", F.col("before")) - left("n", after)
    failing = F.get("n", F.lit(full)) - left("n", own)
    return each.select(
        "part",
        "filter_order",
        "step",
        left("n", after).alias("kept"),
        removed.alias("removed"),
        (failing - removed).alias("redundant"),
        (F.get("n", own) - F.get("n", F.lit(0))).alias("unique_fails"),
        (left("good", F.col("before")) - left("good", after)).alias("good_lost"),
        (left("toxic", F.col("before")) - left("toxic", after)).alias("toxic_lost"),
        F.get("shapley", F.col("k")).alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame, filters: dict[str, str], repeated: str | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """`audit` of documents: filters are failure conditions in SQL by letter over the columns text, n_words, n_distinct, n_capitals, n_points.

    repeated: the letter of a further filter, which a text that equals one of a smaller id fails, removed or not. Labels (doc_id,
    quality, toxic) join by id. Texts are read once; what is shuffled is an id, a digest of 32 bytes, the part and the mask.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    measured = rows.select("*", F.explode(F.array(text_measures(F.col("text")))).alias("_m")).select("doc_id", "part", "text", "_m.*")
    mask = sum((F.when(F.expr(failed), 1 << k).otherwise(0) for k, failed in enumerate(filters.values())), F.lit(0))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)) if repeated else F.lit(None).cast("binary")
    masked = materialise(measured.select("doc_id", "part", digest.alias("digest"), mask.alias("mask")), "audit-masks")
    names = "".join(filters)
    if repeated:
        masked = earlier_copies(masked).withColumn("mask", F.col("mask") + F.when(F.col("repeated"), 1 << len(names)).otherwise(0))
        names += repeated
    told = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return audit(masked.join(told, "doc_id", "left"), names)
