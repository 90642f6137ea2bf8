"""Names of punished parties: found in titles and bodies, cleaned, and judged; all are built-in expressions.

What is particular to a language or a regulator is data of the caller: a `Lexicon`. Nothing here knows any word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, text_or_empty


@dataclass(frozen=True)
class Lexicon:
    """Words as they stand in texts; the order of `org_types` and `title_forms` is their priority."""

    measures: tuple[str, ...] = ()  # what a name is cut at
    sentence_marks: tuple[str, ...] = ()  # what no name holds
    org_suffixes: tuple[str, ...] = ()  # what an organisation's name ends with
    party_prefixes: tuple[str, ...] = ()  # what stands before the party in a body
    title_forms: tuple[tuple[str, str], ...] = ()  # texts before and after a party in a title
    org_types: tuple[tuple[str, str], ...] = ()  # text, type
    action_marks: tuple[str, ...] = ()  # what stands before the parties of an action in a title
    actions: tuple[str, ...] = ()  # what stands after them
    pronouns: tuple[str, ...] = ()  # what may stand before a party and is no part of its name
    clause_ends: str = "，,。；;（）()"  # what the parties of one action don't reach across
    separators: str = "、，,;；"
    trailing: str = "、，,：:；;（(【[ -"
    longest: int = 60

    def any_of(self, words: tuple[str, ...]) -> str:
        """A pattern for any of the words, longer ones first; one that never matches where there are none."""
        return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) or r"(?!)"


def _first(*columns: Column) -> Column:
    """The first that is neither null nor empty, else the empty text; each is written once in the plan, and worked out only if those before are empty."""
    return F.coalesce(*[bound(c, lambda x: F.when(x != "", x)) for c in columns], F.lit(""))


_class = lambda chars: "[" + re.sub(r"([\[\]\\^&-])", r"\\\1", chars) + "]"
_other_than = lambda chars: "[^" + _class(chars)[1:]
_flat = lambda c: F.trim(F.regexp_replace(text_or_empty(c), r"\s+", " "))


def parts_of(c: Column, words: Lexicon) -> Column:
    """Names of a multi-value field, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text_or_empty(c), _class(words.separators)), _flat), lambda x: x != "")


def strip_measure(c: Column, words: Lexicon) -> Column:
    """A name up to the first measure, without trailing marks."""
    head = F.regexp_replace(_flat(c), rf"(?s)\s*(?:{words.any_of(words.measures)}).*$", "")
    return F.regexp_replace(head, f"{_class(words.trailing)}+$", "")


def clean_parties(c: Column, words: Lexicon) -> Column:
    """Every part of a multi-value field without what a measure adds; single characters and repeats go."""
    cut = F.transform(parts_of(c, words), lambda x: strip_measure(x, words))
    return F.array_join(F.array_distinct(F.filter(cut, lambda x: F.length(x) >= 2)), words.separators[0])


def is_organisation(c: Column, words: Lexicon) -> Column:
    return _flat(c).rlike(rf"(?:{words.any_of(words.org_suffixes)})$")


def is_person(c: Column, words: Lexicon) -> Column:
    """A short name of letters alone (two to four CJK characters, or up to four capitalised words) that is no organisation."""
    return _flat(c).rlike(r"^(?:[一-鿿]{2,4}|\p{Lu}[\p{L}'.]*(?: \p{Lu}[\p{L}'.]*){1,3})$") & ~is_organisation(c, words)


def is_person_line(c: Column, words: Lexicon) -> Column:
    """Whether a field lists persons only, two at least."""
    names = parts_of(c, words)
    return (F.size(names) >= 2) & F.forall(names, lambda x: is_person(x, words))


def is_dirty(c: Column, words: Lexicon) -> Column:
    """Whether a field is text rather than names: a sentence mark or end, a measure, a date, an open bracket, or a part that is too long."""
    return bound(_flat(c), lambda flat: _dirty(flat, words))


def _dirty(flat: Column, words: Lexicon) -> Column:
    """is_dirty of a text whose white space is collapsed; all that a pattern can tell is one pattern."""
    told = "|".join([words.any_of(words.sentence_marks), r"[。！？!?]|\.\s|\d{4}\s*[-年]\s*\d{1,2}", words.any_of(words.measures), r"[（(][^)）]*$"])
    return (flat != "") & (flat.rlike(told) | F.exists(parts_of(flat, words), lambda x: F.length(x) > words.longest))


def _usable(c: Column, words: Lexicon, longest: int = 160) -> Column:
    """The text if it can be a name, else empty."""
    return bound(_flat(c), lambda flat: F.when(F.length(flat).between(2, longest) & ~_dirty(flat, words), flat).otherwise(""))


def party_from_title(title: Column, words: Lexicon) -> Column:
    """The party of a title: between texts of a stated form, in brackets at the end (closed or cut off), before a measure, or after a dash."""
    return bound(_flat(title), lambda t: _party_from_flat(t, words))


def _party_from_flat(t: Column, words: Lexicon) -> Column:
    stated = [F.regexp_extract(t, rf"{re.escape(a)}\s*(.+?)\s*{re.escape(b) if b else '$'}", 1) for a, b in words.title_forms]
    bracket = F.regexp_extract(t, r"[（(]([^（()）]{2,40})[)）]?\s*$", 1)
    before = F.regexp_extract(t, rf"(?:^|[:：]\s*)([^:：]+?)\s*(?:{words.any_of(words.measures)})", 1)
    dash = F.regexp_extract(t, r"\s[-—–]\s*([^-—–]+)$", 1)
    return _first(*[_usable(x, words, 80) for x in (*stated, bracket, before, dash)])


def action_segments(title: Column, words: Lexicon) -> Column:
    """The parties of each action that a title tells of, as they stand: texts from a mark to the next action, within one clause."""
    segment = rf"(?:{words.any_of(words.action_marks)})({_other_than(words.clause_ends)}+?)\s*(?:{words.any_of(words.actions)})"
    return F.transform(F.regexp_extract_all(text_or_empty(title), F.lit(segment), 1), _flat)


def is_compound(title: Column, words: Lexicon) -> Column:
    """Whether a title tells of two actions or more."""
    return F.size(action_segments(title, words)) >= 2


def parties_of_actions(title: Column, words: Lexicon) -> Column:
    """The parties of all actions of a title, in order, joined by the first separator; empty where there are none.

    Every segment is split into its parties, and each is judged by itself: one that is dirty, or not of 2 to 160 characters, goes, and
    the others of its segment stay. A party of two actions stands once.
    """
    bare = lambda x: F.regexp_replace(x, rf"^(?:{words.any_of(words.pronouns)})\s*", "")
    parties = F.transform(F.flatten(F.transform(action_segments(title, words), lambda x: parts_of(x, words))), lambda x: _usable(bare(x), words))
    return F.array_join(F.array_distinct(F.filter(parties, lambda x: x != "")), words.separators[0])


def organisations_in(c: Column, words: Lexicon) -> Column:
    """Names in a text that end with an organisation's suffix, in order: capitalised words, or a run of CJK characters."""
    return F.transform(F.regexp_extract_all(text_or_empty(c), F.lit(_organisation(words)), 1), _flat)


def _organisation(words: Lexicon) -> str:
    return rf"((?:\p{{Lu}}[\p{{L}}&']* ){{0,5}}(?:\p{{Lu}}[\p{{L}}&']* )?(?:{words.any_of(words.org_suffixes)})\b|[一-鿿]{{2,30}}?(?:{words.any_of(words.org_suffixes)}))"


def organisation_from_title(title: Column, words: Lexicon) -> Column:
    """The first organisation of a title, else empty."""
    return _flat(F.regexp_extract(text_or_empty(title), _organisation(words), 1))


def organisation_from_body(body: Column, short: Column, words: Lexicon) -> Column:
    """The full name in a body: one that holds the short name's letters, else one after a party's prefix, else the first."""
    key = text_or_empty(short)
    after = F.regexp_extract(text_or_empty(body), rf"(?:{words.any_of(words.party_prefixes)})\s*([^\n，,。.;；]{{2,80}})", 1)
    anchored = F.when(key != "", F.get(F.filter(organisations_in(body, words), lambda x: x.contains(key)), 0))
    return _first(anchored, _usable(after, words), organisation_from_title(body, words))


def authoritative_entity(candidates: list[Column], words: Lexicon) -> Column:
    """The first candidate that is a name of 2 to 160 characters and not dirty, cleaned; else empty."""
    return _first(*[_usable(clean_parties(c, words), words) for c in candidates])


def punished_entity(stored: Column, title: Column, body: Column, words: Lexicon) -> Column:
    """The cascade: what is stored if it is clean, the title's party, an organisation of the title, then of the body.

    Titles of several actions are for `authoritative_entity`, to which the caller gives `parties_of_actions` first.
    """
    return _first(_usable(stored, words), party_from_title(title, words), organisation_from_title(title, words), organisation_from_body(body, F.lit(""), words))


def organisation_type(c: Column, words: Lexicon, head: int = 3000) -> Column:
    """The first listed type whose text occurs in the head of a text, else empty."""
    near = F.substring(text_or_empty(c), 1, head)
    return F.coalesce(*[F.when(near.contains(w), kind) for w, kind in words.org_types], F.lit(""))
