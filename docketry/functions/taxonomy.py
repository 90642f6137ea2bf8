"""Canonical names of multi-value tags, driven by a taxonomy that is given as data.

A taxonomy is a list of `Tag`s in order of priority. A fragment gets the first tag whose name it contains,
else the first one of whose aliases it contains; some names only match whole. What matches nothing is kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DELIMITERS, ordered_unique, text_or_empty

UNCLASSIFIED = "unclassified"


@dataclass(frozen=True)
class Tag:
    name: str
    aliases: tuple[str, ...] = ()
    labels: dict[str, str] = field(default_factory=dict)  # dataset: wording
    whole: bool = False  # the name must equal the fragment


def match_fragment(c: Column, taxonomy: list[Tag]) -> Column:
    """Name of the tag that a fragment belongs to, else null: a chain of tests, names first."""
    by_name = [F.when(c == t.name if t.whole else c.contains(t.name), t.name) for t in taxonomy]
    by_alias = [F.when(c.contains(a), t.name) for t in taxonomy for a in t.aliases]
    return F.coalesce(*by_name, *by_alias, F.lit(None).cast("string"))


def normalise(c: Column, taxonomy: list[Tag]) -> Column:
    """Tags of a multi-value field in order, unknown fragments kept; an empty field is unclassified."""
    fragments = ordered_unique(F.split(text_or_empty(c), f"[{DELIMITERS}:：]"))
    tags = F.array_distinct(F.transform(fragments, lambda x: F.coalesce(match_fragment(x, taxonomy), x)))
    return F.when(F.size(tags) == 0, F.array(F.lit(UNCLASSIFIED))).otherwise(tags)


def canonical(c: Column, taxonomy: list[Tag]) -> Column:
    """Only the tags of the taxonomy."""
    return F.array_intersect(normalise(c, taxonomy), F.array(*[F.lit(t.name) for t in taxonomy]))


def label(name: Column, dataset: Column, taxonomy: list[Tag]) -> Column:
    """A dataset's own wording of a tag, else its name."""
    pairs = [(t.name, d, w) for t in taxonomy for d, w in t.labels.items()]
    return F.coalesce(*[F.when((name == n) & (dataset == d), w) for n, d, w in pairs], name)


def tags_text(tags: Column, dataset: Column, taxonomy: list[Tag], delimiter: str = "、") -> Column:
    """Tags in a dataset's wording, joined."""
    return F.array_join(F.transform(tags, lambda x: label(x, dataset, taxonomy)), delimiter)


def wordings(taxonomy: list[Tag], dataset: str) -> list[str]:
    """What a dataset calls each tag, in the taxonomy's order."""
    return [t.labels.get(dataset, t.name) for t in taxonomy]


def advice(c: Column, taxonomy: list[Tag], given: dict[str, str], default: str) -> Column:
    """The caller's advice for a field: for its own text, else for the first of its tags that has any, else the default."""
    said = lambda x: F.coalesce(*[F.when(x == k, v) for k, v in given.items()], F.lit(None).cast("string"))
    by_tag = F.get(F.filter(F.transform(normalise(c, taxonomy), said), lambda x: x.isNotNull()), 0)
    return F.coalesce(said(F.trim(text_or_empty(c))), by_tag, F.lit(default))


def category(c: Column, categories: list[tuple[str, tuple[str, ...]]], default: str = "other") -> Column:
    """The first category one of whose keywords the text contains."""
    tests = [F.when(F.exists(F.array(*[F.lit(k) for k in keys]), lambda k: text_or_empty(c).contains(k)), name) for name, keys in categories]
    return F.coalesce(*tests, F.lit(default))
