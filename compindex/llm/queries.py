"""Registered queries of this package, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compindex.llm import bpe, chat, exact, language, mixing, negatives, packing, passages, quality, search, secrets, simhash, toxicity
from compindex.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


@query(
    "op7_exact_dedup",
    """WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
        doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY text)""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(table(spark, sf_dir, "documents"))


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


@query("op3_bpe_tokens")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.default_path())


@query("op4_substring_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document with shared passages: the component each belongs to, and how many windows of 20 words it has of it and where."""
    found = passages.repeated(table(spark, sf_dir, "documents"))
    return found.groupBy("doc_id", "component_id", "kept").agg(
        F.count(F.lit(1)).alias("n_paragraphs"), F.min("start").alias("first_word"), F.max(F.col("start") + F.col("n_words") - 1).alias("last_word")
    )


@query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by place; the value itself is shown as a digest."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("word_no").cast("long").alias("word_no"), F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score", "is_secret")


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP8_SQL = """WITH t AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), c AS (
    SELECT conv_id, turn, role AS r0, text AS t0, coalesce(role, '') AS role, coalesce(text, '') AS text,
        replace(replace(replace(coalesce(role, ''), '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS head,
        replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS body FROM t
), p AS (
    SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
        sum(length(replace(head, chr(10), '&#10;')) + length(body) + 11) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
    FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id"""


@query("op8_chat_format", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation as read back from its examples."""
    control = F.lit("</s>[INST] ok [/INST]").alias("text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), control)
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    back = chat.read_back(chat.examples(given.unionByName(extra)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"), F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


OP9_SQL = r"""WITH d AS (
    SELECT doc_id, CASE WHEN source IS NULL THEN '~' ELSE '=' || source END AS key,
        CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY key
), w AS (
    SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY key) - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 2 AS cap FROM s
), a AS (
    SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 3 / 2 AS wanted, sum(weight) OVER () AS weights,
        coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(weight) OVER b, 0) AS weight_before
    FROM w WINDOW b AS (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT *, cap * (weights - weight_before) <= weight * (wanted - cap_before) AS is_full FROM a
), t AS (
    SELECT key, source_size, CASE WHEN is_full THEN cap ELSE
        weight * (wanted - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () END AS target,
        CAST(CAST('0x' || substr(sha256('20240229:' || key), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS start FROM f
), r AS (
    SELECT doc_id, size, source_size, target, start, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
        row_number() OVER (PARTITION BY key ORDER BY size, doc_id NULLS FIRST) - 1 AS before FROM d JOIN t USING (key)
)
SELECT doc_id, size, source_size, target,
    size * least(CAST(floor((before + 1) * rate + start) - floor(before * rate + start) AS BIGINT), 2) AS taken FROM r"""


@query("op9_mix_sources", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


OP11_SQL = r"""WITH q AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), d AS (
    SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), c AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0
), t AS (
    SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY k, term
), w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, c GROUP BY term, n_docs
), m AS (SELECT k, doc_id, 100 - 90 + (90 * len(terms) * n_docs) // n_terms AS m FROM d, c WHERE len(terms) > 0
), s AS (
    SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (k) GROUP BY item_id, k, doc_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""


@query("op11_ranked_search", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_best_fit_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pieces(table(spark, sf_dir, "documents"), bpe.default_path())
    return packing.packed(found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


OP13_SQL = """WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM r AS a JOIN r AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), n AS (
    SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
        CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
) SELECT * FROM n WHERE rank <= 3"""



@query("op13_hard_negatives", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh row are shifted first; every fiftieth row is an anchor."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", shifted), F.col("vec_id") % 50 == 0)
