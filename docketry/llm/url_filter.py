"""URL verdicts: stated rules first, else a tree of path templates for each host.

Segments that are variable by their look (numbers, hashes, dates) become typed wildcards at once, after which a host
has few distinct templates however many urls it has. Then, level by level from the top, literal segments become `*`
below a node that has too many different ones. From the deepest level up, sibling branches are merged where a
two-sample likelihood-ratio test on the counts of their suffixes finds them alike: the divergence may exceed a
tolerated one by what chance gives for so many urls. Two branches that both have labels must be alike in these too;
one without joins a labelled one if it can, so branches without labels share those of what they look like. A template is rejected when the smoothed share of
bad labels among its labelled urls is above a limit; the smoothing pulls a template with few labels to its host's share, and
a host's to the share of all, so templates without any label are judged by these.

Labels are what the rules say about the urls they fit, or any boolean column of the caller's (true: bad).

A level at which the templates of no host differ can't change, so only the others are walked: a very deep path alone costs nothing.

Defined cases: a null url, or one without `://`, has an empty host and path; paths of any depth are kept whole and judged by the same rule at every level;
rows with equal ids or urls are judged each for itself; ties between equally large branches go to the lesser name; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

#: A node with more different segments than this, or with this share of different ones, is variable.
MAX_CHILDREN, VARIABLE_SHARE, VARIABLE_LEAST = 24, 0.5, 12
#: Divergence (in nats) of two branches' suffixes that is tolerated at any size, and what chance adds to it in standard deviations.
TOLERATED, DEVIATIONS = 0.02, 2.33
#: Weight of the host's share in a template's purity, and of the share of all in a host's.
SMOOTHING, HOST_SMOOTHING = 4.0, 20.0
#: Smoothed share of bad labels above which a template is rejected.
REJECT_AT = 0.6


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    """The rule's host or a subdomain of it, and a path that starts with the rule's."""
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def longest_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """Text of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: -len(r.text))
    return F.coalesce(*[F.when(fits(r, host, path), F.lit(r.text)) for r in ordered], F.lit(None).cast("string"))


def typed(segment: Column) -> Column:
    """Segments that are variable by their look become wildcards; an extension stays."""
    stem, ending = F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z]{1,5})?$", 2)
    kind = (
        F.when(stem.rlike(r"^\d{4}-\d{1,2}(-\d{1,2})?$"), "<date>")
        .when(stem.rlike(r"^\d+$"), "<number>")
        .when(stem.rlike(r"^(?i)[0-9a-f]{8}-[0-9a-f-]{27}$|^(?=.*\d)[0-9a-f]{8,}$"), "<hash>")
        .when(stem.rlike(r"^[^\d]*\d{4,}[^\d]*$"), "<numbered>")
        .otherwise(stem)
    )
    return F.concat(kind, ending)


def _prefix(level: int) -> Column:
    """The segments above a level, which counts from 1."""
    return F.concat_ws("/", F.slice("template", 1, level - 1))


def _wide(children: DataFrame) -> DataFrame:
    """host, _prefix of nodes with too many different segments, from rows (host, _prefix, _segment, n)."""
    kinds = children.groupBy("host", "_prefix", "_segment").agg(F.sum("n").alias("n")).groupBy("host", "_prefix").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
    return kinds.filter((F.col("kinds") > MAX_CHILDREN) | ((F.col("n") >= VARIABLE_LEAST) & (F.col("kinds") > VARIABLE_SHARE * F.col("n")))).select("host", "_prefix")


def varied_levels(nodes: DataFrame) -> list[int]:
    """The levels, from the top, at which two templates of one host differ; a node with two branches lies at one of them.

    The driver gets the levels alone, at most as many as the deepest such path has segments.
    """
    kinds = nodes.select("host", F.posexplode("template").alias("_level", "_segment")).distinct().groupBy("host", "_level").count().filter("count > 1")
    return sorted(r._level + 1 for r in kinds.select("_level").distinct().collect())


def generalise(nodes: DataFrame) -> DataFrame:
    """nodes (host, shape, template, n) with `*` for the literal segments of variable nodes."""
    starred = lambda at: F.transform("template", lambda x, i: F.when(at(i) & ~x.startswith("<"), F.lit("*")).otherwise(x))
    for level in varied_levels(nodes):
        # Read twice below, so it is written: the plan would double with every level.
        placed = materialise(nodes.withColumn("_prefix", _prefix(level)).withColumn("_segment", F.try_element_at("template", F.lit(level))), "url-level")
        wide = _wide(placed.filter("_segment is not null")).withColumn("_wide", F.lit(True))
        here = lambda i, level=level: i == level - 1
        nodes = placed.join(wide, ["host", "_prefix"], "left").withColumn("template", F.when(F.col("_wide") & F.col("_segment").isNotNull(), starred(here)).otherwise(F.col("template"))).drop("_prefix", "_segment", "_wide")
    return nodes


def _xlogx(c: Column) -> Column:
    return F.when(c > 0, c * F.log(c)).otherwise(0.0)


def alike(parts: DataFrame) -> DataFrame:
    """host, parent, branch, to, place: pairs of siblings that the test finds alike, each with itself; from rows (host, parent, branch, suffix, n, labelled, bad).

    Suffixes of one branch alone add nothing to the statistic but to its freedom, so only shared ones are joined, and a
    pair without one is never alike. A node's branches are few, as it would be variable otherwise.
    """
    keys, facts = ["host", "parent"], ("total", "kinds", "labels", "bads")
    totals = parts.groupBy(*keys, "branch").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("labelled").alias("labels"), F.sum("bad").alias("bads"))
    own = parts.select(*keys, "branch", "suffix", "n").join(totals, [*keys, "branch"])
    to = own.select(*keys, "suffix", *[F.col(c).alias(f"to_{c}") for c in ("branch", "n", *facts)])
    shared = own.join(to, [*keys, "suffix"]).groupBy(*keys, "branch", *facts, "to_branch", *[f"to_{c}" for c in facts])
    both = lambda c: F.col(c) + F.col(f"to_{c}")
    gain = lambda c: _xlogx(F.col(c)) + _xlogx(F.col(f"to_{c}")) - _xlogx(both(c))
    pairs = shared.agg(F.sum(gain("n")).alias("gain"), F.count("*").alias("common"))
    pairs = pairs.withColumns({"goods": F.col("labels") - F.col("bads"), "to_goods": F.col("to_labels") - F.col("to_bads")})
    limit = lambda n, free: TOLERATED * 2 * n + free + DEVIATIONS * F.sqrt(2 * free)
    suffixes = 2 * (F.col("gain") - gain("total")) <= limit(both("total"), F.greatest(both("kinds") - F.col("common") - 1, F.lit(1)))
    labels = 2 * (gain("goods") + gain("bads") - gain("labels")) <= limit(both("labels"), F.lit(1))
    judged = (F.col("labels") == 0) | ((F.col("to_labels") > 0) & labels)
    found = pairs.filter((F.col("branch") == F.col("to_branch")) | (suffixes & judged))
    return found.select(*keys, "branch", F.col("to_branch").alias("to"), F.struct(F.col("to_labels") > 0, "to_total", "to_branch").alias("place"))


def merge_branches(parts: DataFrame) -> DataFrame:
    """host, parent, branch, merged: the least name of the branches that are alike, from rows (host, parent, branch, suffix, n, labelled, bad).

    Every branch points to the largest one it is like, labelled ones first and ties by name; who ends at one root is merged.
    """
    links = alike(parts).groupBy("host", "parent", "branch").agg(F.max_by("to", "place").alias("to"))
    maps = links.groupBy("host", "parent").agg(F.map_from_entries(F.collect_list(F.struct("branch", "to"))).alias("to"))  # a node's branches are few
    twice = lambda m, _: F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["key"], F.element_at(m, e["value"]))))
    steps = F.sequence(F.lit(1), F.lit((2 * MAX_CHILDREN).bit_length()))  # each doubles the steps taken
    rooted = maps.select("host", "parent", F.explode(F.aggregate(steps, F.col("to"), twice)).alias("branch", "root"))
    names = rooted.groupBy("host", "parent", "root").agg(F.min("branch").alias("merged"))
    return rooted.join(names, ["host", "parent", "root"]).select("host", "parent", "branch", "merged")


def merge_levels(nodes: DataFrame) -> DataFrame:
    """nodes whose templates name merged branches by their least member, deepest level first."""
    for level in reversed(varied_levels(nodes)):
        placed = nodes.withColumn("parent", _prefix(level)).withColumn("branch", F.try_element_at("template", F.lit(level)))
        placed = materialise(placed.withColumn("suffix", F.when(F.size("template") > level, F.concat_ws("/", F.expr(f"slice(template, {level + 1}, size(template))")))), "url-level")
        # A branch that ends here is a page of its own: only what lies below branches is compared.
        parts = placed.filter("suffix is not null").groupBy("host", "parent", "branch", "suffix").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
        named = placed.join(merge_branches(parts), ["host", "parent", "branch"], "left")
        here = F.transform("template", lambda x, i: F.when(i == level - 1, F.col("merged")).otherwise(x))  # noqa: B023
        nodes = named.withColumn("template", F.when(F.col("merged").isNotNull() & F.col("suffix").isNotNull(), here).otherwise(F.col("template"))).drop("parent", "branch", "suffix", "merged")
    return nodes


def learn_templates(urls: DataFrame) -> DataFrame:
    """From host, shape (typed segments), bad (boolean or null): one row per (host, shape) with template, purity, learned (the verdict)."""
    shapes = urls.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.count_if("bad").alias("bad"))
    nodes = materialise(shapes.withColumn("template", F.col("shape")), "url-shapes")
    nodes = materialise(merge_levels(materialise(generalise(nodes), "url-general")), "url-templates")

    overall = nodes.agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")).first()
    share_of_all = (overall.bad or 0) / overall.labelled if overall.labelled else 0.0
    hosts = nodes.groupBy("host").agg(F.sum("bad").alias("_hb"), F.sum("labelled").alias("_hl"))
    groups = nodes.groupBy("host", "template").agg(F.sum("bad").alias("_b"), F.sum("labelled").alias("_l"))
    prior = (F.col("_hb") + HOST_SMOOTHING * share_of_all) / (F.col("_hl") + HOST_SMOOTHING)
    purity = (F.col("_b") + SMOOTHING * prior) / (F.col("_l") + SMOOTHING)
    judged = groups.join(hosts, "host").select("host", "template", purity.alias("purity"))
    return nodes.join(judged, ["host", "template"]).select("host", "shape", F.concat_ws("/", "template").alias("template"), "purity", F.when(F.col("purity") > REJECT_AT, "block").otherwise("allow").alias("learned"))


def judge_urls(df: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", bad_col: str | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    says = {r.text: r.verdict for r in rules}
    verdict = F.coalesce(*[F.when(F.col("rule") == text, F.lit(v)) for text, v in says.items()], F.lit(None).cast("string"))
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), (F.col(bad_col) if bad_col else F.lit(None)).cast("boolean").alias("_given"))
    rows = rows.withColumn("rule", longest_rule(rules, F.col("host"), F.col("path"))).withColumn("_stated", verdict)
    rows = rows.withColumn("shape", F.transform(segments, typed)).withColumn("bad", F.coalesce("_given", F.col("_stated") == "block"))
    learned = learn_templates(rows.select("host", "shape", "bad"))
    return rows.join(learned, ["host", "shape"], "left").select("page_id", "host", "path", "rule", F.coalesce("_stated", "learned").alias("verdict"), "template", "purity")
