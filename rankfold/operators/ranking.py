"""Exact global / per-key ordering that never funnels a whole table — or one
hot key — into a single task.

``global_rank``: ``orderBy`` range-partitions on the full sort key (a hot value
of the first key is still split by the tie-break columns across partitions);
``monotonically_increasing_id`` numbers rows inside each sorted partition; the
numbered table is materialised once (reliable checkpoint); per-partition row
counts (one row per partition, broadcast) give the offsets.

``rank_within``: position of a row inside its key, by a window per key; keys of
more than ``HOT_KEY`` rows in the way above — the key's first global position
comes from a partial+final aggregate, so a key holding a third of the table is
ranked by many tasks, not one window task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfold.session import shared_dir

_LOW33 = (1 << 33) - 1
#: Rows of a key up to which one task numbers them.
HOT_KEY = 200_000


def global_rank(df: DataFrame, order, rank_col: str = "grank", materialize: bool = True) -> DataFrame:
    """Add the 1-based position of every row in a total order.

    The sorted, numbered table is written once as a reliable checkpoint in the
    shared folder: the stored ids fix the partition boundaries, so the
    partition-size pass and the row pass agree. (Reading the sort twice is
    not safe: adaptive execution may coalesce the two reads of one shuffle
    differently, and the offsets would no longer line up.) The checkpoint also
    survives executor loss.
    """
    if not materialize:
        raise ValueError("global_rank needs a materialised sort (see docstring)")
    shared_dir(df.sparkSession)
    s = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    pid = F.shiftright(F.col("_mid"), 33)
    sizes = s.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_c"))
    # one row per partition: a global window over it is tiny
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("_pid", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    out = s.join(F.broadcast(offs), pid == F.col("_pid"))
    return out.withColumn(rank_col, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW33)) + 1).drop(
        "_mid", "_pid", "_off")


def rank_within(df: DataFrame, keys, order, rank_col: str = "rank", count_col: str | None = None) -> DataFrame:
    """Add the 1-based position inside ``keys`` for the given ``order`` (and
    optionally the key's row count); rows with a null key have none and go.

    Keys of at most ``HOT_KEY`` rows are numbered by a window of their own: one
    shuffle by key. The others (at most the number of rows / ``HOT_KEY``) are
    ranked by many tasks each, from a sort over all their rows."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    df = df.where(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    columns = [*keys, *[c for c in df.columns if c not in keys]]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = [tuple(r) for r in counts.where(F.col("_rows") > HOT_KEY).select(*keys).collect()]
    light, out = df, None
    if hot:
        named = F.broadcast(df.sparkSession.createDataFrame(hot, df.select(*keys).schema))
        light = df.join(named, keys, "left_anti")
        g = global_rank(df.join(named, keys, "left_semi"), [*[F.col(k).asc() for k in keys], *order], "_gr")
        starts = g.groupBy(*keys).agg(F.min("_gr").alias("_start"), F.count(F.lit(1)).alias("_rows"))
        out = g.join(F.broadcast(starts), keys).withColumn("_pos", F.col("_gr") - F.col("_start") + 1).select(*columns, "_rows", "_pos")
    w = Window.partitionBy(*keys)
    light = light.withColumn("_pos", F.row_number().over(w.orderBy(*order)).cast("long"))
    if count_col:
        light = light.withColumn("_rows", F.count(F.lit(1)).over(w))  # at most HOT_KEY rows are held
    light = light.select(*columns, *(["_rows"] if count_col else []), "_pos")
    if out is not None:
        light = light.unionByName(out if count_col else out.drop("_rows"))
    return light.withColumnsRenamed({"_pos": rank_col, **({"_rows": count_col} if count_col else {})})


def top_n(df: DataFrame, n: int, order, small: int = 1000) -> DataFrame:
    """The first ``n`` rows in a total order.

    Small n: ``orderBy().limit()`` (TakeOrderedAndProject: every partition
    sends at most n rows to the final merge). Large n (e.g. a 50,000-user or
    16,000-item cap): that merge would pull n rows per partition into one
    task, so rank with ``global_rank`` instead and keep positions <= n.
    """
    if n <= small:
        return df.orderBy(*order).limit(n)
    return global_rank(df, order, "_top_rank").where(F.col("_top_rank") <= n).drop("_top_rank")
