"""Secret scan with a random forest that removes false positives, in DataFrame operations only.

Candidates are long runs of key-like characters with a digit, and whatever word is assigned to or follows a credential
name, of any length and characters. The forest sees a candidate's length, its changes
between letters, digits and cases, how much of it the corpus's own words cover, whether it looks like a path, address or
number, and the words beside it. It learns from labelled findings: by default those that plain signs settle (a random-looking
value assigned to a credential name; an address, number or name that words cover), at most ``LEARN_ROWS`` in hash order.
All others are left to the forest. Null and empty texts have no candidates; repeated rows give repeated findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compindex.llm.common import lookup
from compindex.session import cut_lineage

# What a candidate is made of, and names that hold credentials or stand for nothing.
CANDIDATE = r"[A-Za-z0-9_+/.@:-]{12,}"
BLANKS = r"[\x20\x09-\x0D]+"
CREDENTIAL = r"(?i)(token|secret|passw(or)?d|pwd|credential|api_?key|access_?key|private_?key|auth|bearer)"
# A name that ends its word, and one with its value in the same word.
NAME = r"(?i)(?:token|secret|passw(?:or)?d|pwd|credential|api_?key|access_?key|private_?key|auth(?!or)|bearer)[A-Za-z0-9_-]*"
NAMED = NAME + r"[\"'`\])]*(?::=|=>|=|:)?$"
INLINE = NAME + r"[\"'`\])]*(?::=|=>|=|:)([^\x20]+)$"
SIGN = r"^(?::=|=>|=|:)$"
# What encloses a value or ends its sentence, but is no part of it.
EDGES = "\"'`,;()[]{}<>"
PLACEHOLDER = r"(?i)(example|sample|dummy|placeholder|your|xxxx|changeme)"
LEARN_ROWS = 20_000
DICTIONARY_DOCS = 3
TREES, DEPTH, SEED = 24, 6, 11
ACCEPT = 0.5
FEATURES = (
    "length", "changes", "digits", "uppers", "kinds", "covered", "path_marks", "at_marks", "dots", "only_digits",
    "assigned", "quoted", "credential_near", "placeholder_near", "left_length", "right_length",
)


def _long(word: Column) -> Column:
    return (F.char_length(word) >= 12) & word.rlike(CANDIDATE) & word.rlike("[0-9]")


def _given(word: Column, left1: Column, left2: Column) -> Column:
    """The value that a credential name gives this word, without quotes; empty if there is none."""
    inline = F.regexp_extract(word, INLINE, 1)
    follows = left1.rlike(NAMED) | (left1.rlike(SIGN) & left2.rlike(NAMED))
    value = F.when(inline != "", inline).when(follows & ~word.rlike(SIGN) & ~word.rlike(NAMED), word)
    return F.btrim(F.coalesce(value, F.lit("")), F.lit(EDGES))


def _holds(words: Column, i: Column) -> Column:
    """Whether word ``i`` holds a candidate."""
    at = lambda d: F.coalesce(F.get(words, i + d), F.lit(""))
    return _long(at(0)) | (_given(at(0), at(-1), at(-2)) != "")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, word_no, value, left2, left1, word, right1) for every candidate."""
    words = docs.where("text IS NOT NULL").select("doc_id", F.split("text", BLANKS).alias("words"))
    near = lambda i, d: F.coalesce(F.get("words", i + d), F.lit(""))
    # a candidate takes its neighbours along, so that no row carries the text's words
    beside = lambda i: F.struct(i.alias("word_no"), *[near(i, d).alias(n) for n, d in (("left2", -2), ("left1", -1), ("word", 0), ("right1", 1))])
    places = F.filter(F.transform("words", lambda w, i: F.when(_holds(F.col("words"), i), beside(i))), lambda c: c.isNotNull())
    found = words.select("doc_id", F.inline(places))
    given = _given(F.col("word"), F.col("left1"), F.col("left2"))
    runs = F.filter(F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0)), lambda v: v.rlike("[0-9]"))
    # a given value replaces the runs it holds; runs beside it stay
    values = F.when(given == "", runs).otherwise(F.concat(F.array(given), F.filter(runs, lambda v: ~F.contains(given, v) & ~F.contains(v, given))))
    return found.select("*", F.explode(values).alias("value"))


def dictionary(docs: DataFrame) -> DataFrame:
    """(part): words of four letters or more in at least ``DICTIONARY_DOCS`` distinct texts, over all documents.

    Words that hold candidates do not count: a key must not vouch for itself.
    """
    texts = docs.select("text").distinct().select(F.split("text", BLANKS).alias("words"))
    plain = F.array_join(F.filter("words", lambda w, i: ~_holds(F.col("words"), i)), " ")
    parts = F.array_distinct(F.split(F.lower(plain), "[^a-z]+"))
    words = texts.select(F.explode(F.filter(parts, lambda p: F.char_length(p) >= 4)).alias("part"))
    return words.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= DICTIONARY_DOCS).select("part")


def coverage(found: DataFrame, known: DataFrame) -> DataFrame:
    """(value, covered): the share of a candidate's characters in letter runs that the dictionary knows."""
    values = found.select("value").distinct()
    parts = cut_lineage(values.select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{4,}"), F.lit(0))).alias("part")))
    met = cut_lineage(parts.select("part").distinct().join(known, "part").withColumn("hit", F.lit(True)))
    hits = lookup(parts, met, ["part"]).groupBy("value").agg(F.sum(F.char_length("part")).alias("n"))
    return hits.select("value", (F.col("n") / F.char_length("value")).alias("covered"))


def _share(pattern: str, column: str = "value") -> Column:
    return F.regexp_count(F.col(column), F.lit(pattern)) / F.char_length(column)


def described(found: DataFrame, covered: DataFrame) -> DataFrame:
    """Findings with the columns named in ``FEATURES``."""
    c = F.col
    around = F.concat_ws(" ", "left2", "left1")
    number = lambda b: b.cast("double")
    return lookup(found, covered, ["value"], "left").select(
        "doc_id", "word_no", "value",
        F.char_length("value").cast("double").alias("length"),
        _share("[a-z](?=[0-9A-Z])|[0-9](?=[a-zA-Z])|[A-Z](?=[0-9])").alias("changes"),
        _share("[0-9]").alias("digits"), _share("[A-Z]").alias("uppers"),
        (F.size(F.array_distinct(F.split("value", ""))) / F.char_length("value")).alias("kinds"),
        F.coalesce("covered", F.lit(0.0)).alias("covered"),
        F.regexp_count(c("value"), F.lit("[/]")).cast("double").alias("path_marks"),
        F.regexp_count(c("value"), F.lit("@")).cast("double").alias("at_marks"),
        F.regexp_count(c("value"), F.lit("[.]")).cast("double").alias("dots"),
        number(c("value").rlike("^[0-9.:-]+$")).alias("only_digits"),
        number(around.rlike("[=:]$") | c("word").rlike("[A-Za-z_]+[\"']?[=:]")).alias("assigned"),
        number(c("word").rlike("[\"'`]")).alias("quoted"),
        number(F.concat_ws(" ", "left2", "left1", "word").rlike(CREDENTIAL)).alias("credential_near"),
        number(F.concat_ws(" ", "left1", "word", "right1").rlike(PLACEHOLDER)).alias("placeholder_near"),
        F.char_length("left1").cast("double").alias("left_length"), F.char_length("right1").cast("double").alias("right_length"),
    )


def sign_label() -> Column:
    """1 or 0 where plain signs settle a finding, else null."""
    c = F.col
    random_looking = (c("digits") > 0.1) & (c("covered") < 0.3) & (c("only_digits") == 0) & (c("at_marks") == 0) & (c("length") >= 16)
    secret = (c("assigned") == 1) & (c("credential_near") == 1) & (c("placeholder_near") == 0) & random_looking
    credential = (c("assigned") == 1) & (c("credential_near") == 1)
    harmless = (c("placeholder_near") == 1) | ~credential & ((c("at_marks") > 0) | (c("only_digits") == 1) | (c("covered") > 0.6))
    return F.when(secret, 1.0).when(harmless, 0.0)


def train(labelled: DataFrame, rows: int = LEARN_ROWS):
    """A forest from findings with ``label``: the first ``rows`` in hash order, or None if one label is missing.

    Half of the bound goes to either label; the sorted sample is materialised, so that the forest's random choices repeat.
    """
    order = F.xxhash64("doc_id", "word_no", "value")
    half = [labelled.where(F.col("label") == v).orderBy(order, "doc_id", "word_no", "value").limit(rows // 2) for v in (0.0, 1.0)]
    chosen = cut_lineage(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(half[0].unionByName(half[1])).select("label", "features"))
    if chosen.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(chosen)


def scan(docs: DataFrame, label: Column | None = None, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, word_no, value, score, is_secret) for every candidate of ``docs`` (doc_id, text)."""
    found = cut_lineage(candidates(docs))
    findings = cut_lineage(described(found, cut_lineage(coverage(found, dictionary(docs)))))
    model = train(findings.withColumn("label", sign_label() if label is None else label).where("label IS NOT NULL"))
    if model is None:
        scored = findings.withColumn("score", F.coalesce(sign_label() if label is None else label, F.lit(0.0)))
    else:
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(findings)
        scored = model.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "word_no", "value", "score", (F.col("score") >= accept).alias("is_secret"))
