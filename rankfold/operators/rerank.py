"""Bias-mitigation re-rankers (M-*), one list per user.

A list has at most ``max_recommendations`` (100) entries, so each user's
list is gathered into one row and the greedy selection runs as a native
``aggregate`` fold over ``sequence(1, n)`` — JVM expressions, no Python, and
linear in the number of users (no global state).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfold.config import DEFAULTS
from rankfold.functions.exprs import clip01

U, I = "user_id", "item_id"
NEG = float("-inf")


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _explode_order(lists: DataFrame, order_col: str) -> DataFrame:
    """(user, order array of 1-based list positions) -> (user, rank, item, score)."""
    out = lists.select(U, F.posexplode(order_col).alias("_p", "_idx"), "_l")
    e = F.element_at(F.col("_l"), F.col("_idx"))
    return out.select(U, (F.col("_p") + 1).cast("int").alias("rank"), e[I].alias(I), e["score"].alias("score"))


def rerank_mmr(recs: DataFrame, factors: DataFrame, lam: float | None = None) -> DataFrame:
    """M-1: maximal marginal relevance over the list's item factors.

    First pick = highest score (earliest on ties); then argmax of
    lam*score - (1-lam)*max cosine to the picked items (earliest on ties).
    The fold state keeps each candidate's running max similarity, so a step
    costs one dot product per candidate. Lists with a missing factor stay as is.
    """
    lam = DEFAULTS.mmr_lambda if lam is None else lam
    j = recs.select(U, "rank", I, F.round("score", 6).alias("score")).join(
        factors.select(F.col("id").alias(I), "factor"), I, "left")
    lists = j.groupBy(U).agg(F.sort_array(F.collect_list(F.struct("rank", I, "score", "factor"))).alias("_l"))
    n = F.size("_l")
    sc = F.transform("_l", lambda x: x["score"])
    V = F.transform("_l", lambda x: x["factor"])
    lists = lists.withColumn("_sc", sc).withColumn("_V", V)
    first = F.array_position(F.col("_sc"), F.array_max("_sc")).cast("int")
    init = F.struct(F.array(first).alias("sel"),
                    F.transform("_V", lambda v: _dot(v, F.element_at(F.col("_V"), first))).alias("ms"))

    def step(state, _):
        cand = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(
            F.array_contains(state["sel"], i), F.lit(NEG)).otherwise(
            F.lit(lam) * F.element_at(F.col("_sc"), i) - F.lit(1.0 - lam) * F.element_at(state["ms"], i)))
        best = F.array_position(cand, F.array_max(cand)).cast("int")
        ms = F.transform(state["ms"], lambda m, i: F.greatest(
            m, _dot(F.element_at(F.col("_V"), i + 1), F.element_at(F.col("_V"), best))))
        return F.struct(F.concat(state["sel"], F.array(best)).alias("sel"), ms.alias("ms"))

    fold = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), init, step)
    ok = (n > 1) & F.forall("_l", lambda x: x["factor"].isNotNull())
    lists = lists.withColumn("_order", F.when(ok, fold["sel"]).otherwise(F.sequence(F.lit(1), n)))
    return _explode_order(lists, "_order")


def penalize_popularity(recs: DataFrame, pop: DataFrame) -> DataFrame:
    """M-2: score * (1 - 0.5 * log1p(pop)/log1p(max pop)), clipped, 6 dp,
    re-sorted by the new score (stable: ties keep the old order)."""
    mx = pop.agg(F.max("popularity").alias("_mx"))
    j = (recs.join(pop.select(I, "popularity"), I, "left")
             .crossJoin(F.broadcast(mx)))  # one-row side
    pen = F.log1p(F.coalesce("popularity", F.lit(1))) / F.log1p(F.greatest(F.col("_mx"), F.lit(1)))
    j = j.withColumn("_new", F.round(clip01(F.col("score") * (F.lit(1.0) - F.lit(0.5) * pen)), 6))
    w = Window.partitionBy(U).orderBy(F.desc("_new"), F.asc("rank"))
    return j.select(U, F.row_number().over(w).cast("int").alias("rank"), I, F.col("_new").alias("score"))


def rerank_calibrated(recs: DataFrame, history: DataFrame, categories: DataFrame) -> DataFrame:
    """M-3: greedy calibration of the list's category shares to the history's.

    Each step takes the first remaining item whose category minimises
    KL(target || shares after adding it); shares divide by all picked items but
    only history categories enter the sum. KL is compared on 9 decimals.
    Users without history keep their list.
    """
    cats = categories.select(I, "category")
    h = (history.select(U, I).join(cats, I, "left")
               .withColumn("category", F.coalesce("category", F.lit("unknown")))
               .groupBy(U, "category").agg(F.count(F.lit(1)).alias("_c")))
    h = h.withColumn("_p", F.col("_c") / F.sum("_c").over(Window.partitionBy(U)))
    tgt = h.groupBy(U).agg(F.sort_array(F.collect_list(F.struct("category", "_p"))).alias("_t"))
    # one entry per history category: bounded by the number of categories
    tgt = tgt.select(U, F.transform("_t", lambda x: x["category"]).alias("_tc"),
                     F.transform("_t", lambda x: x["_p"]).alias("_tp"))
    r = (recs.select(U, "rank", I, "score").join(cats, I, "left")
             .withColumn("category", F.coalesce("category", F.lit("unknown"))))
    lists = r.groupBy(U).agg(F.sort_array(F.collect_list(F.struct("rank", I, "score", "category"))).alias("_l"))
    lists = lists.join(tgt, U, "left")
    n = F.size("_l")
    m = F.size("_tc")
    cl = F.transform("_l", lambda x: x["category"])
    lists = lists.withColumn("_cats", cl)

    def kl_after(state, i):
        return F.aggregate(F.sequence(F.lit(1), m), F.lit(0.0), lambda acc, jj: acc + F.element_at(F.col("_tp"), jj) * F.log(
            (F.element_at(F.col("_tp"), jj) + F.lit(1e-12)) /
            ((F.element_at(state["cnt"], jj) + F.when(F.element_at(F.col("_tc"), jj) == F.element_at(F.col("_cats"), i), 1).otherwise(0))
             / (state["tot"] + F.lit(1.0)) + F.lit(1e-12))))

    init = F.struct(F.array().cast("array<int>").alias("sel"),
                    F.transform("_tc", lambda x: F.lit(0).cast("long")).alias("cnt"),
                    F.lit(0).cast("long").alias("tot"))

    def step(state, _):
        kls = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(
            F.array_contains(state["sel"], i), F.lit(1e300)).otherwise(F.round(kl_after(state, i), 9)))
        best = F.array_position(kls, F.array_min(kls)).cast("int")
        cnt = F.transform(state["cnt"], lambda c, jj: c + F.when(
            F.element_at(F.col("_tc"), jj + 1) == F.element_at(F.col("_cats"), best), 1).otherwise(0).cast("long"))
        return F.struct(F.concat(state["sel"], F.array(best)).alias("sel"), cnt.alias("cnt"),
                        (state["tot"] + 1).alias("tot"))

    fold = F.aggregate(F.sequence(F.lit(1), n), init, step)
    lists = lists.withColumn("_order", F.when(F.col("_tc").isNull(), F.sequence(F.lit(1), n)).otherwise(fold["sel"]))
    return _explode_order(lists, "_order")
