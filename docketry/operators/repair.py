"""Deterministic repair of case rows in ordered passes, with a dry run, an audit and the backfill of organisation types.

A pass is a rule for one column: when it applies, and the new value. Applied in order, later passes see what earlier ones
wrote; in a dry run every pass is judged on the rows as they are. What a title and a body say is worked out once, so the
passes run on narrow columns. Words are the caller's (`entities.Lexicon`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import entities
from ..functions.entities import Lexicon
from ..functions.text import bound, contains_any, document_number, entity_type, first_filled, sign_off_date, strict_date, text_or_empty

#: Columns that passes may change, and those they look at besides.
REPAIRED = ("punished_entity", "punished_entities", "summary_entity", "entity_type", "document_number", "punishment_date")
LOOKED_AT = ("dataset", "status", "status_note", "_titled", "_signed", "_number", "_truth", "_compound")


@dataclass(frozen=True)
class Pass:
    name: str
    column: str
    applies: Column
    value: Column


blank = lambda c: F.trim(text_or_empty(F.col(c))) == ""


def facts(rows: DataFrame, words: Lexicon) -> DataFrame:
    """rows with what their titles and bodies say: _titled, _signed, _number, _truth, and whether the title tells of several actions, _compound.

    _truth is the parties of the title's actions if it has any, else its party, its organisation, or the body's.
    """
    title, body = F.col("title"), F.col("raw_text")
    told = rows.withColumns({"_titled": entities.party_from_title(title, words), "_signed": sign_off_date(body), "_number": document_number(title, body), "_acted": entities.parties_of_actions(title, words), "_compound": entities.is_compound(title, words)})
    return _settled(told).withColumn(
        "_truth", entities.authoritative_entity([F.col("_acted"), F.col("_titled"), entities.organisation_from_title(title, words), entities.organisation_from_body(body, F.lit(""), words)], words)
    )


def passes(words: Lexicon, first_dataset: str, mismatch: str = "mismatch") -> list[Pass]:
    """The passes in order; the first dataset keeps its party in punished_entity, all others in punished_entities."""
    first, one, many, entity = F.col("dataset") == first_dataset, F.col("punished_entity"), F.col("punished_entities"), F.col("summary_entity")
    titled, truth, dirty = F.col("_titled"), F.col("_truth"), lambda c: entities.is_dirty(c, words)
    truncated = (titled != one) & titled.startswith(text_or_empty(one))
    cleaned = entities.clean_parties(many, words)
    # A title of several actions also replaces clean parties, unless what is held is longer (full names for the title's short ones).
    fuller = F.col("_compound") & ~blank("punished_entities") & (F.length(truth) >= F.length(F.trim(many)))
    held = F.when(first, one).otherwise(many)
    fixed = entity_type(F.col("entity_type"))
    return [
        Pass("fill_first_party", "punished_entity", first & (titled != "") & (dirty(one) | truncated), titled),
        Pass("fill_other_party", "punished_entities", ~first & blank("punished_entities") & (truth != ""), truth),
        Pass("clear_description", "punished_entity", dirty(one) & (truth == ""), F.lit("")),
        Pass("clear_summary_description", "summary_entity", dirty(entity) & (truth == ""), F.lit("")),
        Pass("clean_suffix", "punished_entities", ~blank("punished_entities") & (cleaned != many) & (cleaned != ""), cleaned),
        Pass("replace_dirty_party", "punished_entities", (dirty(many) | fuller) & (truth != ""), truth),
        Pass("replace_dirty_entity", "summary_entity", dirty(entity), bound(held, lambda h: F.when(~dirty(h), first_filled(h, truth)).otherwise(first_filled(truth, entity)))),
        Pass("fill_number", "document_number", blank("document_number") & (F.col("_number") != ""), F.col("_number")),
        Pass("fill_date", "punishment_date", (F.col("status") == "done") & blank("punishment_date") & ~text_or_empty(F.col("status_note")).contains(mismatch) & (F.col("_signed") != ""), F.col("_signed")),
        Pass("clear_date", "punishment_date", ~blank("punishment_date") & strict_date(F.col("punishment_date")).isNull(), F.lit("")),
        Pass("backfill_entity", "summary_entity", blank("summary_entity") & (text_or_empty(held) != ""), held),
        Pass("entity_type", "entity_type", fixed != text_or_empty(F.col("entity_type")), fixed),
    ]


def repair(rows: DataFrame, words: Lexicon, first_dataset: str) -> DataFrame:
    """rows after all passes, each seeing the ones before, with the names of those that changed something (repairs)."""
    kept = [c for c in rows.columns if c not in (*REPAIRED, *LOOKED_AT)]
    out = facts(rows, words).select(F.struct(*kept).alias("_kept"), *REPAIRED, *LOOKED_AT, F.array().cast("array<string>").alias("repairs"))
    for p in passes(words, first_dataset):
        # The value stands once in the plan; it is null where the pass doesn't change the row.
        held = text_or_empty(F.col(p.column))
        changed = bound(F.when(p.applies, p.value), _unless(held))
        out = _settled(out.withColumn("_value", changed))
        hit = F.col("_value").isNotNull()
        out = out.withColumn(p.column, F.coalesce("_value", p.column)).withColumn("repairs", F.when(hit, F.array_append("repairs", F.lit(p.name))).otherwise(F.col("repairs"))).drop("_value")
    return out.select("_kept.*", *REPAIRED, *[c for c in LOOKED_AT if c[0] != "_"], "repairs")


def _unless(held: Column):
    """A function that leaves a value only where it isn't what is held."""
    return lambda v: F.when(~held.eqNullSafe(v), v)


def _settled(rows: DataFrame) -> DataFrame:
    """The same rows behind a generator of one row each: the optimiser would otherwise put each pass's expressions into all later ones."""
    return rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("_r")).select("_r.*")


def dry_run(rows: DataFrame, words: Lexicon, first_dataset: str) -> DataFrame:
    """How often each pass would change the rows as they are: name, candidates."""
    ready = _settled(facts(rows, words))
    found = passes(words, first_dataset)
    counts = ready.agg(*[F.count_if(F.coalesce(p.applies & ~text_or_empty(F.col(p.column)).eqNullSafe(p.value), F.lit(False))).alias(p.name) for p in found])
    return counts.unpivot([], [p.name for p in found], "name", "candidates")


def audit(repaired: DataFrame) -> DataFrame:
    """How many rows each pass changed: name, rows."""
    return repaired.select(F.explode("repairs").alias("name")).groupBy("name").agg(F.count("*").alias("rows"))


def resolve_types(names: DataFrame, known: DataFrame, words: Lexicon, answers: DataFrame | None = None) -> DataFrame:
    """name, org_type, source by the chain: cached type (name, org_type), an injected answer of the same shape, the name's text, its body's text."""
    looked = names.join(known.groupBy("name").agg(F.min("org_type").alias("_cached")), "name", "left")
    if answers is not None:
        looked = looked.join(answers.groupBy("name").agg(F.min("org_type").alias("_answered")), "name", "left")
    steps = [("cache", F.col("_cached")), *([("answer", F.col("_answered"))] if answers is not None else []), ("name", entities.organisation_type(F.col("name"), words)), ("text", entities.organisation_type(F.col("text"), words))]
    source = F.coalesce(*[F.when(text_or_empty(c) != "", F.lit(s)) for s, c in steps], F.lit("unresolved"))
    return looked.select(*names.columns, first_filled(*[c for _, c in steps]).alias("org_type"), source.alias("source"))


def short_bodies(cases: DataFrame, bodies: DataFrame, n: int = 200) -> DataFrame:
    """Keys and lengths of bodies shorter than n, shortest first."""
    joined = cases.select("dataset", "case_id").join(bodies, ["dataset", "case_id"])
    return joined.withColumn("length", F.length("raw_text")).filter(F.col("length") < n).select("dataset", "case_id", "length").orderBy("length", "dataset", "case_id")


#: Columns whose missing values may be listed.
CHECKED = ("entity_type", "punished_entity", "summary_entity", "violation_type", "punishment", "punishment_date", "violation_summary", "legal_basis")


def missing(rows: DataFrame, column: str, present: bool = False) -> DataFrame:
    """dataset, case_id of rows whose column is blank (or is not); a column that isn't listed is an error."""
    if column not in CHECKED:
        raise ValueError(f"can't look for {column!r}")
    return rows.filter(~blank(column) if present else blank(column)).select("dataset", "case_id")


def title_relevance(title: Column, wanted: tuple[str, ...], stopped: tuple[str, ...]) -> Column:
    """True where a wanted word stands, false where a stop word does, else null."""
    return F.when(contains_any(title, wanted), True).when(contains_any(title, stopped), False)


def classify(rows: DataFrame, wanted: tuple[str, ...] = ("fund",), empty_fails: bool = True) -> DataFrame:
    """Ingest outcome of fetched rows (title_relevant: boolean or null, raw_text): success, failed, skipped_title or skipped_content.

    An empty or null body failed. Without empty_fails it is judged like any other: an empty one has no wanted word, a null one is not known to lack it.
    """
    text = F.col("raw_text")
    outcome = F.when(~F.col("title_relevant"), "skipped_title")
    if empty_fails:
        outcome = outcome.when(text_or_empty(text) == "", "failed")
    outcome = outcome.when(F.col("title_relevant").isNull() & text.isNotNull() & ~contains_any(text, wanted), "skipped_content").otherwise("success")
    return rows.withColumn("outcome", outcome)


def placeholders(classified: DataFrame) -> DataFrame:
    """Rows that stand for excluded items, so that they aren't fetched again: their keys and titles, no body, status skipped."""
    out = classified.filter(F.col("outcome").startswith("skipped"))
    return out.select("dataset", "case_id", "title", F.lit("skipped").alias("status"), F.col("outcome").alias("status_note"), F.lit("").alias("raw_text"))


def candidates(rows: DataFrame, retry_failed: bool = True, include_done: bool = False) -> DataFrame:
    """Rows to summarise: pending ones, failed ones on retry, done ones on a redo, skipped ones never."""
    return rows.filter(F.col("status").isin("pending", *["failed"] * retry_failed, *["done"] * include_done))


def model_input(rows: DataFrame, limits: dict[str, int], default: int, least: int = 50) -> DataFrame:
    """rows whose body is long enough, with input: the body cut to the dataset's limit."""
    most = F.coalesce(*[F.when(F.col("dataset") == d, n) for d, n in limits.items()], F.lit(default))
    return rows.filter(F.length(F.trim(text_or_empty(F.col("raw_text")))) >= least).withColumn("input", F.substring(F.col("raw_text"), F.lit(1), most))
