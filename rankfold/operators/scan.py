"""Scans along time that carry a state over blocks, so one series is not one task.

A series is cut into blocks of time. Windows run inside a block only; a block
gives one summary row, and the state that comes in from the blocks before is
found by the same scan over the summaries, ``FAN`` blocks at a time. A task
orders the rows of one series and block, or at most ``FAN`` summaries; the top
level orders span / (block x FAN) summaries of a series.

The state at a row is what happened since the latest marked row: that row's
value and the number of rows after it. It is joined with an incoming state
without looking at rows again, which is what makes the cut possible.

Defined cases: null keys are a series of their own; rows of a series at the
same time have no defined order among them; rows without a time come before
all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfold.session import materialize

FAN = 1000  # summaries one task orders


def _position(df: DataFrame, order: str) -> Column:
    """Seconds of a time, or the number itself."""
    kind = dict(df.dtypes)[order]
    return F.unix_micros(F.col(order).cast("timestamp")) / 1e6 if kind.startswith("timestamp") else F.col(order)


def _local(df: DataFrame, names, order: str) -> DataFrame:
    """The state at a row (``_at``) and before it (``_before``) within ``names``."""
    w = Window.partitionBy(*names).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_i", F.row_number().over(w)).withColumn("_c", F.sum("_n").over(upto))
    df = df.withColumn("_mark", F.last(F.when(F.col("_r"), F.struct(F.col("_v").alias("v"), (F.col("_c") - F.col("_n")).alias("c"))),
                                       ignorenulls=True).over(upto))
    df = df.withColumn("_at", F.struct(F.col("_mark").isNotNull().alias("r"), F.col("_mark.v").alias("v"),
                                       (F.col("_c") - F.coalesce(F.col("_mark.c"), F.lit(0))).alias("n")))
    return df.withColumn("_before", F.lag("_at").over(w)).drop("_c", "_mark", "_r", "_v", "_n")


def _joined(first: Column, then: Column) -> Column:
    """The state after ``first`` and ``then``."""
    both = F.struct(first["r"].alias("r"), first["v"].alias("v"), (first["n"] + then["n"]).alias("n"))
    return F.when(then.isNull(), first).when(first.isNull() | then["r"], then).otherwise(both)


def _scan(df: DataFrame, keys, order: str, blocks) -> DataFrame:
    if not blocks:
        return _local(df, keys, order)
    at = F.coalesce(F.floor(_position(df, order) / F.lit(float(blocks[0]))), F.lit(-(1 << 53)))
    df = _local(df.withColumn("_block", at.cast("long")), [*keys, "_block"], order)
    if len(blocks) > 1:  # the rows themselves: read once for the summaries, once for the result
        df = materialize(df)
    sums = df.groupBy(*keys, "_block").agg(F.max_by("_at", "_i").alias("_at"))
    sums = sums.select(*keys, "_block", F.col("_at.r").alias("_r"), F.col("_at.v").alias("_v"), F.col("_at.n").alias("_n"))
    ends = _scan(sums.withColumnRenamed("_block", "_pos"), keys, "_pos", blocks[1:])
    ends = ends.select(*[F.col(k).alias(f"_to_{k}") for k in keys], F.col("_pos").alias("_end"), F.col("_before").alias("_in"))
    same = F.col("_block") == F.col("_end")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_to_{k}"))
    j = df.join(ends, same, "left")
    j = j.withColumn("_at", _joined(F.col("_in"), F.col("_at"))).withColumn("_before", _joined(F.col("_in"), F.col("_before")))
    return j.drop("_block", "_end", "_in", *[f"_to_{k}" for k in keys])


def since(df: DataFrame, keys, order: str, mark: Column, value: Column, block: float) -> DataFrame:
    """``df`` with ``_at`` and ``_before``: structs of r (was there a marked row),
    v (``value`` of the latest one) and n (rows after it, all rows if there was
    none), up to and including the row, and before it.

    ``block`` is a length in seconds, or in units of a numeric ``order``.
    """
    marked = F.coalesce(mark, F.lit(False))
    df = df.select("*", marked.alias("_r"), F.when(marked, value).alias("_v"), F.when(marked, 0).otherwise(1).cast("long").alias("_n"))
    return _scan(df, list(keys), order, [block, FAN]).drop("_i")


def carry_last(df: DataFrame, keys, order: str, value: str, out: str, block: float, include: bool = True) -> DataFrame:
    """Adds ``out``: the latest non-null ``value`` of the series, up to the row or (``include=False``) before it."""
    s = since(df, keys, order, F.col(value).isNotNull(), F.col(value), block)
    return s.withColumn(out, F.col("_at.v" if include else "_before.v")).drop("_at", "_before")


def run_length(df: DataFrame, keys, order: str, flag: str, out: str, block: float) -> DataFrame:
    """Adds ``out`` (int): rows in a row, up to this one, on which ``flag`` holds."""
    s = since(df, keys, order, ~F.coalesce(F.col(flag), F.lit(False)), F.lit(True), block)
    return s.withColumn(out, F.col("_at.n").cast("int")).drop("_at", "_before")
