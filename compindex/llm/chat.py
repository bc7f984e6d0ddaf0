"""Chat formatting by prefix-target expansion, in DataFrame operations only.

A turn is written as ``<s>[role]`` + line feed + text + ``</s>`` + line feed. Inside roles and texts ``&``, ``<`` and ``[`` are
written as entities, so no control string can occur there and every text comes back exactly. Every assistant
turn becomes one example: all earlier turns as context, its own text (still escaped) as the only trainable
span. Turns after the last assistant turn form one more example without a trainable span, so nothing is lost.

A conversation's turns are gathered, since its last example holds them all. Turns order by number, then role,
then text (nulls first), so ties have a fixed order; null roles and texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template. The ampersand is written first and read last.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescaped(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def _head(role: Column) -> Column:
    # a line feed in a role would end the header
    return F.concat(F.lit("<s>["), F.replace(escaped(role), F.lit("\n"), F.lit("&#10;")), F.lit("]\n"))


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example_no, n_turns, complete, formatted, loss_start, loss_length) from rows (conv_id, turn, role, text).

    The trainable span starts at code point ``loss_start`` (from 1); both are null where nothing is trained.
    ``complete`` marks the one example of a conversation that holds all of its turns.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct("turn", F.col("role").alias("r"), F.col("text").alias("t"), _head(role).alias("head"), escaped(text).alias("body"), (role == TRAINED_ROLE).alias("trained"))
    gathered = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # 1-based places of the turns that end an example
    ends = F.array_distinct(F.concat(
        F.filter(F.transform("turns", lambda t, i: F.when(t["trained"], i + 1)), lambda i: i.isNotNull()), F.array(F.size("turns"))
    ))
    one = gathered.select("conv_id", "turns", F.posexplode(ends).alias("example_no", "end"))
    shown = F.slice("turns", F.lit(1), F.col("end"))
    last = F.element_at("turns", F.col("end"))
    written = one.select(
        "conv_id", "example_no", F.col("end").alias("n_turns"), (F.col("end") == F.size("turns")).alias("complete"), last.alias("last"),
        F.array_join(F.transform(shown, lambda t: F.concat(t["head"], t["body"], F.lit("</s>\n"))), "").alias("formatted"),
    )
    length = F.when(F.col("last.trained"), F.char_length("last.body"))
    return written.select(
        "conv_id", "example_no", "n_turns", "complete", "formatted",
        (F.char_length("formatted") - 5 - length + 1).alias("loss_start"), length.alias("loss_length"),
    )


def turns_of(formatted: Column) -> Column:
    """Array of (role, text) read back from formatted text."""
    pieces = F.filter(F.split(formatted, "</s>\n"), lambda p: p != "")
    role = lambda p: unescaped(F.replace(F.substring_index(F.substring_index(p, "]\n", 1), "<s>[", -1), F.lit("&#10;"), F.lit("\n")))
    text = lambda p: unescaped(F.substring(p, F.instr(p, "]\n") + 2, F.char_length(p)))
    return F.transform(pieces, lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))


def trained_text(formatted: Column, start: Column, length: Column) -> Column:
    """The text under the loss mask, unescaped; empty where nothing is trained."""
    return F.coalesce(unescaped(F.substring(formatted, start, length)), F.lit(""))


def read_back(made: DataFrame) -> DataFrame:
    """(conv_id, turns, trained, formatted_chars) of every conversation, from its examples alone."""
    spans = made.select("conv_id", "example_no", "complete", "formatted", trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("span"))
    whole = spans.groupBy("conv_id").agg(
        F.max(F.when(F.col("complete"), F.col("formatted"))).alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example_no", "span"))), lambda s: s["span"]), "").alias("trained"),
        F.sum(F.char_length("formatted")).alias("formatted_chars"),
    )
    return whole.select("conv_id", turns_of(F.col("whole")).alias("turns"), "trained", F.col("formatted_chars").cast("long").alias("formatted_chars"))
