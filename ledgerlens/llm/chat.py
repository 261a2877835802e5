"""Chat formatting: cumulative snapshots collapse, maximal conversations are rendered.

Loggers often store a conversation again after every turn. Such a snapshot is a prefix of
a longer conversation. Each conversation's turns are hashed into rolling prefix hashes; a
conversation whose whole hash is a prefix hash of a longer one goes, and of conversations
with the same turns the smallest id stays. Only the rest are rendered.

Everything is built-in expressions. A prefix hash is the XOR of position-salted turn
hashes (two of 64 bits each), a running aggregate that needs no array of turns. Prefixes
are made distinct before they meet the conversations, so a first turn that a third of the
conversations share is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import persisted

ROLE_OPEN, ROLE_CLOSE, TURN_END = "<|", "|>", "<|end|>"


def prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """(conv_id, n, h1, h2): the hashes of each conversation's first n turns.

    Turns are ordered by turn number (nulls first), then by hash. Null roles and
    texts hash like empty ones. Texts are hashed in the scan; only hashes are shuffled.
    """
    parts = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                        F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))
    placed = rows.withColumn("n", F.row_number().over(
        Window.partitionBy("conv_id").orderBy("turn", "a", "b")))
    salted = placed.select("conv_id", "n", F.xxhash64("n", "a").alias("a"), F.xxhash64("n", "b").alias("b"))
    upto = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return salted.select("conv_id", "n", F.bit_xor("a").over(upto).alias("h1"),
                         F.bit_xor("b").over(upto).alias("h2"))


def maximal(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that no longer one begins with;
    n_copies counts the conversations with the very same turns."""
    hashes = persisted(prefixes(turns, conv, turn, role, text))
    whole = hashes.groupBy("conv_id").agg(F.max_by(F.struct("n", "h1", "h2"), "n").alias("w"))
    whole = whole.groupBy("w").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    whole = whole.select("conv_id", "w.n", "w.h1", "w.h2", "n_copies")
    # a prefix is proper if its conversation goes on: the same conversation has n + 1 turns
    sizes = hashes.groupBy("conv_id").agg(F.max("n").alias("last"))
    known = hashes.join(sizes, hashes["conv_id"].eqNullSafe(sizes["conv_id"])).where("n < last")
    proper = known.groupBy("n", "h1", "h2").agg(F.count(F.lit(1)).alias("seen")).drop("seen")
    return whole.join(proper, ["n", "h1", "h2"], "left_anti").select(
        "conv_id", F.col("n").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of the maximal conversations.

    Edge cases: a null text is rendered empty, a null role as ``unknown``; turns with the
    same number are rendered by role and text, repeated rows are turns of their own; null
    conversation ids form one conversation; an empty table gives an empty result; other
    columns play no part. A conversation is one output value, so it has to fit one row.
    """
    kept = persisted(maximal(turns, conv, turn, role, text))
    rows = turns.select(F.col(conv).alias("_c"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                        F.col(text).alias("text"))
    own = rows.join(kept, rows["_c"].eqNullSafe(kept["conv_id"]))
    by = own.groupBy("conv_id", "n_turns", "n_copies").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    shown = F.transform("t", lambda x: F.concat(
        F.lit(ROLE_OPEN), F.coalesce(x["role"], F.lit("unknown")), F.lit(ROLE_CLOSE + "\n"),
        F.coalesce(x["text"], F.lit("")), F.lit("\n" + TURN_END)))
    return by.select("conv_id", "n_turns", "n_copies", F.array_join(shown, "\n").alias("rendered"))
