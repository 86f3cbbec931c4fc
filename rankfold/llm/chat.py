"""Chat formatting with collapse of cumulative snapshots, in DataFrame functions only.

A logged conversation may be a prefix of a longer one, logged again as it grew.
Each turn has a rolling hash of the turns up to it: position-bound hashes of
role and text, folded by exclusive or in two independent 64-bit words, so it is
one running window function. A conversation whose last hash is another's inner
hash is a prefix of it; an anti-join keeps the maximal ones, and of equal
conversations the smallest id. Only what stays is rendered.

A conversation is one output row, so its size is bounded by a row's; the
hashing and the anti-join hold none in memory. Hot prefixes (a greeting that a
third of all conversations begin with) are reduced to one row before the
shuffle of the anti-join.

Defined cases: rows without a conversation id are left out; null role and text
differ from empty ones and are rendered as empty; turns are ordered by turn
(null first), then role and text; repeated rows are turns; other columns play
no part; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfold.llm.text import rows_of

_KEY = ["pos", "p1", "p2"]


def rendered_turn() -> Column:
    return F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_turns, n_copies, rendered) of each maximal conversation;
    n_copies counts equal conversations, itself included."""
    t = rows_of(turns, conv, turn, role, text).toDF("conv", "turn", "role", "text").where("conv is not null")
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    t = t.withColumn("pos", F.row_number().over(order))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    said = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"), F.col("pos")]
    hashed = t.select("conv", "turn", "role", "text", "pos", F.xxhash64(F.lit(1), *said).alias("h1"), F.xxhash64(F.lit(2), *said).alias("h2"))
    hashed = hashed.select(
        "conv", "role", "text", "pos", F.bit_xor("h1").over(running).alias("p1"), F.bit_xor("h2").over(running).alias("p2"),
        F.lead("pos").over(order).isNull().alias("last"))
    whole = hashed.where("last").groupBy(*_KEY).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies"))
    inner = hashed.where("not last").select(*_KEY).distinct()
    kept = whole.join(inner, _KEY, "left_anti").select("conv", "n_copies", F.col("pos").alias("n_turns"))
    lines = t.select("conv", "pos", rendered_turn().alias("line")).join(kept.select("conv"), "conv", "left_semi")
    texts = lines.groupBy("conv").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "").alias("rendered"))
    return kept.join(texts, "conv").select(F.col("conv").alias(conv), F.col("n_turns").cast("long").alias("n_turns"), "n_copies", "rendered")
