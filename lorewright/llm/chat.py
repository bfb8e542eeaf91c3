"""Operator 6: chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

A service that logs a conversation after every turn leaves snapshots, each the beginning of the
next. Rolling hashes over a conversation's turns identify every such beginning: the hash after k
turns is the XOR of the hashes of its first k turns with their places. A conversation whose whole
hash is the beginning of a longer one goes (an anti-join), of equal ones the smallest id stays, and
what stays is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewright.store import stored

BEGIN, END = "<|im_start|>", "<|im_end|>"


def maximal(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_turns long, copies long) of the conversations that no longer one begins with.

    copies counts the conversations with the same turns, itself included.
    """
    rolled = _rolled(turns, id, turn, role, text)
    return _maximal(stored(rolled.select("conv_id", "place", "h1", "h2"), "prefixes"))


def _rolled(turns: DataFrame, id: str, turn: str, role: str, text: str) -> DataFrame:
    rows = turns.where(F.col(id).isNotNull()).select(
        F.col(id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    row = F.struct("turn", "role", "text")
    rows = rows.withColumn("again", F.coalesce(F.lag(row).over(order).eqNullSafe(row), F.lit(False))).where("not again").drop("again")
    rows = rows.withColumn("place", F.row_number().over(order).cast("long"))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name, seed in (("h1", 1), ("h2", 2)):
        rows = rows.withColumn(name, F.bit_xor(F.xxhash64(F.lit(seed), "place", "role", "text")).over(so_far))
    return rows


def _maximal(prefixes: DataFrame) -> DataFrame:
    whole = prefixes.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("w"))
    ends = prefixes.join(whole, "conv_id")
    # Keys are made distinct before the anti-join, so a beginning that many share is one row.
    inner = ends.where("place < w.place").select("place", "h1", "h2").distinct()
    last = whole.groupBy("w.place", "w.h1", "w.h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    return last.join(inner, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "copies")


def render(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per maximal conversation: conv_id, n_turns long, copies long, text string.

    Turns are ordered by turn (null first), role and text; a row repeated in a conversation counts
    once. A null role or text is empty. Rows with a null conv_id take no part. An empty table gives
    an empty result. A conversation is one value of the result and is put together in one task.
    """
    rolled = stored(_rolled(turns, id, turn, role, text), "turns")
    keep = _maximal(rolled.select("conv_id", "place", "h1", "h2"))
    # Only what stays is rendered; a turn is one string before turns come together.
    line = F.concat(F.lit(BEGIN), "role", F.lit("\n"), "text", F.lit(END + "\n"))
    kept = rolled.select("conv_id", "place", line.alias("line")).join(keep, "conv_id")
    out = kept.groupBy("conv_id", "n_turns", "copies").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    return out.select("conv_id", "n_turns", "copies", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"))
