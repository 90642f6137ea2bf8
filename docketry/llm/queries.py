"""One query per operator of this package, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, filter_audit, language_id, lm_scoring, media, packing, quality, runs, secrets, sharding, simhash, url_filter, vector_dedup

#: Folder of the public vocabularies; None: the installed package's own.
TOKENIZERS: str | None = None


def tokenizer(name: str) -> str:
    import public_tokenizers

    return f"{TOKENIZERS}/{name}" if TOKENIZERS else public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(read(spark, sf_dir, "documents"), shards=40, overhead=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokenizer("byte_bpe_50k.tiktoken")
    decoded = byte_bpe.decode(byte_bpe.encode(read(spark, sf_dir, "documents"), ranks, pattern()), ranks)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: Fixed rules of the url query.
URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_spans(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), pattern())
    return secrets.digest_columns(found)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = media.load(media.store(read(spark, sf_dir, "documents")), tensors=False)
    return loaded.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, -{media.UNIT}, {media.UNIT})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where about each tenth document repeats words of its own from some word on, as its id says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    told = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_w"), g.alias("_g")).withColumn("_n", F.size("_w"))
    # The explode keeps the words from being split again for each use of them.
    told = told.select("doc_id", "text", "_g", "_n", F.explode(F.array("_w")).alias("_w"))
    told = told.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    told = told.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")))
    tail = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.slice(again, F.lit(1), F.col("_n") - F.col("_a"))), " ")
    return told.select("doc_id", F.when(F.col("_n") > 0, tail).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_periodic_tails(read(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("_l"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("_l.start"), F.col("_l.length"), -F.col("_l.period")
    return told.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: Failure conditions of the audit's filters; E is the repeated text.
AUDITED = {
    "A": "n_words < 50",
    "B": "100 * n_distinct < 65 * n_words",
    "C": "100 * n_capitals > 5 * n_points",
    "D": "text RLIKE '[#$%&*|]'",
}


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), AUDITED, repeated="E")


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


QUERIES = {"op1_sharding": op1_sharding, "op2_byte_bpe": op2_byte_bpe, "op3_url_filter": op3_url_filter, "op4_quality": op4_quality, "op5_packing": op5_packing, "op6_simhash": op6_simhash, "op7_secrets": op7_secrets, "op8_media": op8_media, "op9_lm_scoring": op9_lm_scoring, "op10_language_id": op10_language_id, "op11_periodic_runs": op11_periodic_runs, "op12_filter_audit": op12_filter_audit, "op13_vector_dedup": op13_vector_dedup}
#: The audit by the position of a document's first failed filter in each order.
AUDIT_SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), measured AS (
    SELECT doc_id, part, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM texts
), told AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), masked AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails
    FROM measured LEFT JOIN told USING (doc_id)
), counted AS (
    SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY part, fails
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
    SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders
), placed AS (
    SELECT part, filter_order, step, n, good, toxic, fails, substr(filter_order, step, 1) AS own,
        coalesce(list_min(list_transform(string_split(fails, ''), lambda x: CASE WHEN x = '' THEN 6 ELSE strpos(filter_order, x) END)), 6) AS gone
    FROM counted, steps
), summed AS (
    SELECT part, filter_order, step, own,
        CAST(coalesce(sum(n) FILTER (gone > step), 0) AS BIGINT) AS kept,
        CAST(coalesce(sum(n) FILTER (gone = step), 0) AS BIGINT) AS removed,
        CAST(coalesce(sum(n) FILTER (gone < step AND contains(fails, own)), 0) AS BIGINT) AS redundant,
        CAST(coalesce(sum(n) FILTER (fails = own), 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(sum(good) FILTER (gone = step), 0) AS BIGINT) AS good_lost,
        CAST(coalesce(sum(toxic) FILTER (gone = step), 0) AS BIGINT) AS toxic_lost
    FROM placed GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM summed
"""

#: All pairs of equal label, and the closure of their links.
VECTOR_SQL = """
WITH RECURSIVE fit AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reached AS (
    SELECT vec_id, vec_id AS other FROM embeddings
    UNION
    SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other
), least AS (
    SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id
), counted AS (
    SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN counted USING (vec_id)
"""

ORACLE_SQL: dict[str, str] = {"op12_filter_audit": AUDIT_SQL, "op13_vector_dedup": VECTOR_SQL}
