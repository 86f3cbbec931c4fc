"""Reusable Column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def id_string(c) -> Column:
    """B-3: numeric id (int or float) -> canonical string ('456', never '456.0')."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("double").cast("bigint").cast("string")


def coerce_long(c) -> Column:
    """B-4: numeric coercion, bad values become null (ANSI-safe)."""
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("bigint")


def event_weight(event_col, weights: dict, default: float = 1.0) -> Column:
    """B-5: map event type -> weight; unknown types get ``default``."""
    c = F.col(event_col) if isinstance(event_col, str) else event_col
    items = list(weights.items())
    if not items:
        return F.lit(float(default))
    expr = F.when(c == items[0][0], F.lit(float(items[0][1])))
    for k, v in items[1:]:
        expr = expr.when(c == k, F.lit(float(v)))
    return expr.otherwise(F.lit(float(default)))


#: Popularity tokens; an item has one of them.
BUCKET_TOKENS = ("popular_high", "popular_medium", "popular_low")


def popularity_bucket(pop_col, high: int = 100, medium: int = 20) -> Column:
    """B-8: popularity bucket token (> high, > medium, else low)."""
    c = F.col(pop_col) if isinstance(pop_col, str) else pop_col
    top, middle, low = BUCKET_TOKENS
    return F.when(c > high, F.lit(top)).when(c > medium, F.lit(middle)).otherwise(F.lit(low))


def clip01(c) -> Column:
    """B-12: clip to [0, 1]."""
    c = F.col(c) if isinstance(c, str) else c
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def discount(rank_col) -> Column:
    """W-6: rank-discounted gain 1/log2(rank+1) for 1-based rank."""
    c = F.col(rank_col) if isinstance(rank_col, str) else rank_col
    return F.lit(1.0) / F.log2(c + F.lit(1))


def ideal_dcg(n_col) -> Column:
    """IDCG of a binary list with n relevant items in front (n <= k)."""
    c = F.col(n_col) if isinstance(n_col, str) else n_col
    # sequence(1, 0) would count down, so n <= 0 is handled explicitly
    return F.when(c < 1, F.lit(0.0)).otherwise(
        F.aggregate(F.sequence(F.lit(1), c.cast("int")), F.lit(0.0),
                    lambda acc, r: acc + F.lit(1.0) / F.log2(r + F.lit(1))))


def safe_div(a, b) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.try_divide(a.cast("double"), b.cast("double"))


def all_of(conds) -> Column:
    return reduce(lambda x, y: x & y, conds)


def round4(c) -> Column:
    """4-dp rounding used by reports: half-up on the 9-dp value, so float
    noise never decides a half step (the SQL oracle does the same)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.round(c.cast("double"), 9), 4)
