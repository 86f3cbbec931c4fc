"""Temporal splits, top-k, samples and set operators (W-*, S-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

U, I = "user_id", "item_id"


def _sort_cols(order):
    out = []
    for o in order:
        if isinstance(o, str) and o.startswith("-"):
            out.append(F.col(o[1:]).desc())
        else:
            out.append(F.col(o).asc() if isinstance(o, str) else o)
    return out


def temporal_holdout(df: DataFrame, key: str = U, order=("last_ts", I),
                     test_fraction: float = 0.2, singletons: str = "train") -> DataFrame:
    """W-1 / W-2: per-key temporal hold-out; adds ``is_train``.

    n < 2: all train (``singletons='train'``) or dropped (``'drop'``);
    otherwise the first max(1, floor(n*(1-f))) rows in ``order`` are train.
    Positions come from ``rank_within`` (a globally range-partitioned sort), so
    a user holding a large share of all rows is split over many tasks.
    """
    from rankfold.operators.ranking import rank_within
    keep = 1.0 - test_fraction
    out = rank_within(df, [key], _sort_cols(order), "_rn", count_col="_n")
    if singletons == "drop":
        out = out.where(F.col("_n") >= 2)
    cut = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(keep)))
    return (out.withColumn("is_train", (F.col("_n") < 2) | (F.col("_rn") <= cut))
               .drop("_rn", "_n"))


def global_split(df: DataFrame, ts: str = "ts", tiebreak: str = "event_id",
                 train_fraction: float = 0.8) -> DataFrame:
    """W-3: order ALL rows by (ts, tiebreak); the first floor(N*f) rows are train.

    ``global_rank`` gives exact positions from a range-partitioned sort — no
    single-partition ``row_number``, and ties on ``ts`` (even one timestamp
    holding most rows) are split by the tie-break across partitions.
    """
    from rankfold.operators.ranking import global_rank
    g = global_rank(df, [F.col(ts).asc(), F.col(tiebreak).asc()], "_g")
    n = df.agg(F.count(F.lit(1)).alias("_N"))
    j = g.crossJoin(F.broadcast(n))  # one-row side
    return j.withColumn("is_train", F.col("_g") <= F.floor(F.col("_N") * F.lit(train_fraction))).drop("_g", "_N")


def top_k(df: DataFrame, k: int, by, partition=U, ties=(I,), rank_col: str = "rank") -> DataFrame:
    """W-4: top-k per partition key, deterministic total order.

    ``row_number() <= k`` plans as WindowGroupLimit, which drops rows before
    the shuffle-sorted window so each key keeps at most k rows per task.
    """
    order = _sort_cols(by if isinstance(by, (list, tuple)) else [by]) + _sort_cols(ties)
    w = Window.partitionBy(*([partition] if isinstance(partition, str) else partition)).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def global_top_k(df: DataFrame, k: int, by, ties=(I,)) -> DataFrame:
    """W-5: global top-k (``ranking.top_n``); adds 1-based rank (k rows)."""
    from rankfold.operators.ranking import top_n
    order = _sort_cols(by if isinstance(by, (list, tuple)) else [by]) + _sort_cols(ties)
    top = top_n(df, k, order)
    # k rows only: ranking them in one window is bounded by k
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def sample_users(users: DataFrame, n: int | None, seed: int | None = None, key: str = U) -> DataFrame:
    """W-9 (seed=None: first n users in id order) / W-10 (seeded hash order)."""
    if n is None:
        return users.select(key).distinct()
    from rankfold.operators.ranking import top_n
    u = users.select(key).distinct()
    if seed is None:
        return top_n(u, n, [F.asc(key)])
    return top_n(u, n, [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))).asc(), F.asc(key)])


def union_parts(*dfs: DataFrame) -> DataFrame:
    """S-1."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def distinct_items(recs: DataFrame) -> DataFrame:
    """S-2."""
    return recs.select(I).distinct()


def intersect_with(df: DataFrame, other: DataFrame, on=I) -> DataFrame:
    """S-3."""
    return df.join(other.select(on).distinct() if isinstance(on, str) else other, on, "left_semi")


def minus(df: DataFrame, other: DataFrame, on=(U, I)) -> DataFrame:
    """S-4 / J-4: remove rows present in ``other`` (e.g. seen items)."""
    return df.join(other.select(*on), list(on), "left_anti")
