"""Data-quality contracts as Spark jobs (Q-*).

Row rules (not null, range, enum, castable, non-empty, finite) compile to one
``count_if`` each and run together in a single aggregate — one scan however
many rules. Set rules (unique, bijection, same count) are small aggregates of
their own. ``quarantine`` splits rows into good / bad with the failed rule names.
The same row rules apply to a stream through ``foreachBatch`` (see streaming).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    column: str

    def bad(self) -> Column:  # row rules: True when the row violates the rule
        raise NotImplementedError

    @property
    def row_rule(self) -> bool:
        return True


@dataclass(frozen=True)
class NotNull(Rule):
    def bad(self):
        return F.col(self.column).isNull()


@dataclass(frozen=True)
class Between(Rule):
    low: float | None = None
    high: float | None = None
    low_inclusive: bool = True
    high_inclusive: bool = True

    def bad(self):
        c = F.col(self.column)
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & ((c >= self.low) if self.low_inclusive else (c > self.low))
        if self.high is not None:
            ok = ok & ((c <= self.high) if self.high_inclusive else (c < self.high))
        return c.isNotNull() & ~ok


@dataclass(frozen=True)
class IsIn(Rule):
    values: tuple = ()

    def bad(self):
        c = F.col(self.column)
        return c.isNotNull() & ~c.isin(*self.values)


@dataclass(frozen=True)
class Castable(Rule):
    to: str = "bigint"

    def bad(self):
        c = F.col(self.column)
        return c.isNotNull() & c.try_cast(self.to).isNull()


@dataclass(frozen=True)
class NonEmpty(Rule):
    def bad(self):
        c = F.col(self.column)
        return c.isNull() | (F.length(c) == 0)


@dataclass(frozen=True)
class Finite(Rule):
    def bad(self):
        c = F.col(self.column).cast("double")
        return c.isNotNull() & (F.isnan(c) | (F.abs(c) == float("inf")))


@dataclass(frozen=True)
class Unique(Rule):
    keys: tuple = ()

    @property
    def row_rule(self):
        return False


@dataclass(frozen=True)
class Bijection(Rule):
    other: str = ""

    @property
    def row_rule(self):
        return False


@dataclass(frozen=True)
class SameCount(Rule):
    other_df: object = field(default=None, compare=False, hash=False)

    @property
    def row_rule(self):
        return False


def check(df: DataFrame, rules) -> DataFrame:
    """Q-10: one report row per rule: (rule, column, violations, rows, passed)."""
    spark = df.sparkSession
    row_rules = [r for r in rules if r.row_rule]
    parts = []
    if row_rules:
        aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count_if(r.bad()).alias(f"_r{i}") for i, r in enumerate(row_rules)]
        one = df.agg(*aggs)  # single scan for all row rules
        arr = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.column).alias("column"),
                                 F.col(f"_r{i}").cast("bigint").alias("violations"),
                                 F.col("_rows").cast("bigint").alias("rows")) for i, r in enumerate(row_rules)])
        parts.append(one.select(F.inline(arr)))
    for r in rules:
        if r.row_rule:
            continue
        if isinstance(r, Unique):
            keys = list(r.keys) or [r.column]
            dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
            # violations = rows that belong to a duplicated key
            v = dup.agg(F.coalesce(F.sum(F.when(F.col("_c") > 1, F.col("_c"))), F.lit(0)).cast("bigint").alias("violations"),
                        F.coalesce(F.sum("_c"), F.lit(0)).cast("bigint").alias("rows"))
        elif isinstance(r, Bijection):
            a = df.agg(F.count(F.lit(1)).alias("_n"), F.countDistinct(r.column).alias("_a"),
                       F.countDistinct(r.other).alias("_b"))
            v = a.select(((F.col("_n") - F.col("_a")) + (F.col("_n") - F.col("_b"))).cast("bigint").alias("violations"),
                         F.col("_n").cast("bigint").alias("rows"))
        elif isinstance(r, SameCount):
            a = df.agg(F.count(F.lit(1)).alias("_n"))
            b = r.other_df.agg(F.count(F.lit(1)).alias("_m"))
            v = a.crossJoin(b).select(F.abs(F.col("_n") - F.col("_m")).cast("bigint").alias("violations"),  # one-row sides
                                      F.col("_n").cast("bigint").alias("rows"))
        else:
            raise TypeError(type(r))
        parts.append(v.select(F.lit(r.name).alias("rule"), F.lit(r.column).alias("column"), "violations", "rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    del spark
    return out.withColumn("passed", F.col("violations") == 0)


def quarantine(df: DataFrame, rules) -> tuple[DataFrame, DataFrame]:
    """Split rows into (good, bad); bad rows carry the names of the failed rules."""
    row_rules = [r for r in rules if r.row_rule]
    failed = F.filter(F.array(*[F.when(r.bad(), F.lit(r.name)) for r in row_rules]), lambda x: x.isNotNull())
    tagged = df.withColumn("_failed", failed)
    good = tagged.where(F.size("_failed") == 0).drop("_failed")
    bad = tagged.where(F.size("_failed") > 0).withColumnRenamed("_failed", "failed_rules")
    return good, bad


# fixed values: the reference's contracts for raw events, interactions and recommendations
EVENT_TYPES = ("view", "addtocart", "transaction")


def event_rules(event_types=EVENT_TYPES, user="visitorid", item="itemid", event="event", ts="timestamp"):
    return [NotNull("timestamp_not_null", ts), NotNull("visitor_not_null", user), NotNull("event_not_null", event),
            Between("visitor_positive", user, low=0, low_inclusive=False), IsIn("event_enum", event, tuple(event_types)),
            Castable("item_castable", item, "double")]


def interaction_rules(user="user_id", item="item_id", weight="weight", max_weight=100.0):
    return [NotNull("user_not_null", user), NotNull("item_not_null", item), NotNull("weight_not_null", weight),
            Between("weight_range", weight, low=0, high=max_weight, low_inclusive=False), Finite("weight_finite", weight),
            Unique("pair_unique", user, keys=(user, item))]


def recommendation_rules(score="score", product="product_id"):
    return [NonEmpty("product_non_empty", product), NotNull("score_not_null", score),
            Between("score_range", score, low=0, high=1), Finite("score_finite", score)]
