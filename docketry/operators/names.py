"""Names that equal or contain one another, by an inverted index of n-grams.

A name that another contains has all its n-grams there, so it need only be looked for under one of them: the one that the fewest
of the other names have. Candidates share that gram and are verified. Both directions are equi-joins on grams, so no
side is broadcast for its own sake and nothing compares all names with all; a gram that many names have is split by adaptive execution
like any skewed key. Equal names are looked up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram; shorter names are looked for as they are.
GRAM = 3


def grams(name: Column, n: int) -> Column:
    """The distinct stretches of n characters of a name."""
    starts = F.when(F.length(name) >= n, F.sequence(F.lit(1), F.length(name) - F.lit(n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: name.substr(i, F.lit(n))))


def contained(needles: DataFrame, names: DataFrame, n: int = GRAM) -> DataFrame:
    """needle, name: all pairs where the name contains the needle. Both inputs have one column, `needle` and `name`, of distinct texts that aren't empty."""
    every = F.array_union(grams(F.col("name"), n), F.array_distinct(F.flatten(F.array(*[grams(F.col("name"), k) for k in range(1, n)])))) if n > 1 else grams(F.col("name"), n)
    index = names.select("name", F.explode(every).alias("gram"))
    # A needle of n characters or more looks under grams of n, a shorter one under itself.
    looked = needles.select("needle", F.explode(F.when(F.length("needle") >= n, grams(F.col("needle"), n)).otherwise(F.array("needle"))).alias("gram"))
    many = index.groupBy("gram").agg(F.count("*").alias("many"))
    # A gram that no name has rules the needle out: it is the rarest.
    counted = looked.join(many, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("many", F.lit(0)).alias("many"), "gram")).alias("rarest"))
    under = counted.filter("rarest.many > 0").select("needle", F.col("rarest.gram").alias("gram"))
    return under.join(index, "gram").filter(F.col("name").contains(F.col("needle"))).select("needle", "name")


def match_names(rows: DataFrame, known: DataFrame, name_col: str, known_col: str, rank_col: str, n: int = GRAM) -> DataFrame:
    """rows with `matched` and `matched_rank`: the known name that equals theirs, else the first by rank that contains theirs or that theirs contains; rows without one stay, with nulls.

    Blank names match nothing. Of equal known names the least rank counts.
    """
    ranked = known.filter(F.trim(known_col) != "").groupBy(F.col(known_col).alias("known")).agg(F.min(rank_col).alias("rank"))
    own = rows.filter(F.trim(name_col) != "").select(F.col(name_col).alias("own")).distinct()
    exact = own.join(ranked, F.col("own") == F.col("known")).select("own", "known", "rank")
    rest = own.join(exact.select("own"), "own", "left_anti")
    holds = contained(ranked.select(F.col("known").alias("needle")), rest.select(F.col("own").alias("name")), n).select(F.col("name").alias("own"), F.col("needle").alias("known"))
    held = contained(rest.select(F.col("own").alias("needle")), ranked.select(F.col("known").alias("name")), n).select(F.col("needle").alias("own"), F.col("name").alias("known"))
    found = holds.unionByName(held).join(ranked, "known").groupBy("own").agg(F.min(F.struct("rank", "known")).alias("first"))
    best = exact.unionByName(found.select("own", F.col("first.known").alias("known"), F.col("first.rank").alias("rank")))
    best = best.select(F.col("own").alias(name_col), F.col("known").alias("matched"), F.col("rank").alias("matched_rank"))
    return rows.join(best, name_col, "left")
