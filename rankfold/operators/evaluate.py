"""Offline evaluation (V-*): ranking quality, diversity, novelty, coverage.

Inputs are long tables: recs (user_id, rank, item_id) and truth
(user_id, item_id). Per-user metrics are one ``groupBy(user)`` after a join on
(user_id, item_id); the global means are a second, tiny aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfold.functions.exprs import clip01, discount, ideal_dcg, round4, safe_div

U, I = "user_id", "item_id"


def per_user_ranking(recs: DataFrame, truth: DataFrame, k: int = 10,
                     empty_list: str = "skip") -> DataFrame:
    """V-1..V-5 per user: precision, recall, ndcg, mrr, hit.

    Users are those of ``truth``; users without a list are skipped
    (``empty_list='skip'``, evaluator rule) or scored 0 (``'zero'``, trainer).
    Users unknown to the model must be removed from ``truth`` by the caller.
    """
    t = truth.select(U, I).distinct()
    tn = t.groupBy(U).agg(F.count(F.lit(1)).alias("n_truth"))
    r = recs.where(F.col("rank") <= k).select(U, I, "rank")
    hit = r.join(t.withColumn("_t", F.lit(True)), [U, I], "left")
    h = F.col("_t").isNotNull()
    per = hit.groupBy(U).agg(
        F.count_if(h).alias("hits"),
        F.sum(F.when(h, discount("rank")).otherwise(F.lit(0.0))).alias("dcg"),
        F.min(F.when(h, F.col("rank"))).alias("first_hit"),
        F.count(F.lit(1)).alias("n_recs"))
    how = "inner" if empty_list == "skip" else "left"
    j = tn.join(per, U, how)
    hits = F.coalesce(F.col("hits"), F.lit(0))
    return j.select(
        U,
        (hits / F.lit(float(k))).alias("precision"),
        (hits / F.col("n_truth")).alias("recall"),
        F.coalesce(F.col("dcg") / ideal_dcg(F.least(F.col("n_truth"), F.lit(k))), F.lit(0.0)).alias("ndcg"),
        F.coalesce(F.lit(1.0) / F.col("first_hit"), F.lit(0.0)).alias("mrr"),
        F.when(hits > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("hit"))


def ranking_metrics(recs: DataFrame, truth: DataFrame, k: int = 10,
                    empty_list: str = "skip") -> DataFrame:
    """V-6/V-7: means of the per-user metrics, F1 of the means, n_eval_users."""
    per = per_user_ranking(recs, truth, k, empty_list)
    m = per.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "ndcg", "mrr", "hit")],
                F.count(F.lit(1)).alias("n_eval_users"))
    p, r = F.coalesce(F.col("precision"), F.lit(0.0)), F.coalesce(F.col("recall"), F.lit(0.0))
    f1 = F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))
    return m.select(
        F.round(p, 6).alias("precision_at_k"), F.round(r, 6).alias("recall_at_k"),
        F.round(F.coalesce("ndcg", F.lit(0.0)), 6).alias("ndcg_at_k"),
        F.round(F.coalesce("mrr", F.lit(0.0)), 6).alias("mrr_at_k"),
        F.round(F.coalesce("hit", F.lit(0.0)), 6).alias("hit_rate_at_k"),
        F.round(f1, 6).alias("f1_at_k"),
        F.col("n_eval_users").cast("bigint").alias("n_eval_users"))


def f1(p, r):
    """V-6 on two columns."""
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def intra_list_diversity(recs: DataFrame, factors: DataFrame) -> DataFrame:
    """V-8 per user: 1 - mean pairwise cosine, lists with >= 2 factor items.

    Sum over pairs i != j of v_i.v_j = ||sum v||^2 - sum ||v||^2, so no pair
    join: one aggregate of the summed vector per user.
    """
    j = recs.select(U, I).join(factors.select(F.col("id").alias(I), "factor"), I)
    agg = j.groupBy(U).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum(F.aggregate("factor", F.lit(0.0), lambda a, x: a + x * x)).alias("sq"),
        F.array_agg("factor").alias("_vs"))
    # _vs holds the user's list (<= k <= 100 vectors): bounded by the list length
    summed = F.aggregate(
        "_vs", F.array_repeat(F.lit(0.0), F.size(F.col("_vs")[0])),
        lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    norm2 = F.aggregate(summed, F.lit(0.0), lambda a, x: a + x * x)
    out = agg.where(F.col("k") >= 2).select(
        U, "k", clip01(F.lit(1.0) - (norm2 - F.col("sq")) / (F.col("k") * (F.col("k") - 1))).alias("ild"))
    return out


def category_entropy(recs: DataFrame, categories: DataFrame) -> DataFrame:
    """V-9 per user: Shannon entropy of the list's categories / ln(#categories)."""
    c = (recs.select(U, I).join(categories.select(I, "category"), I, "left")
             .withColumn("category", F.coalesce("category", F.lit("unknown"))))
    cnt = c.groupBy(U, "category").agg(F.count(F.lit(1)).alias("c"))
    tot = F.sum("c").over(Window.partitionBy(U))
    p = cnt.withColumn("p", F.col("c") / tot)
    per = p.groupBy(U).agg(F.count(F.lit(1)).alias("n_cats"),
                           (-F.sum(F.col("p") * F.log(F.col("p") + F.lit(1e-12)))).alias("h"))
    return per.select(U, "n_cats", F.when(F.col("n_cats") > 1, F.col("h") / F.log(F.col("n_cats")))
                      .otherwise(F.lit(0.0)).alias("entropy"))


def novelty(recs: DataFrame, pop: DataFrame) -> DataFrame:
    """V-10 per user: mean -log2(pop/total + 1e-12); unknown pop = 1."""
    total = pop.agg(F.greatest(F.coalesce(F.sum("popularity"), F.lit(0)).cast("double"), F.lit(1.0)).alias("_tot"))
    j = (recs.select(U, I).join(pop.select(I, "popularity"), I, "left")
             .crossJoin(F.broadcast(total)))  # one-row side
    v = -F.log2(F.coalesce("popularity", F.lit(1)).cast("double") / F.col("_tot") + F.lit(1e-12))
    return j.groupBy(U).agg(F.avg(v).alias("novelty"))


def coverage_metrics(recs: DataFrame, users: DataFrame, items: DataFrame, pop: DataFrame) -> DataFrame:
    """V-11..V-13: catalog, user and long-tail coverage (tail: pop <= p50)."""
    rec_items = recs.select(I).distinct()
    n_items = items.select(I).distinct().agg(F.count(F.lit(1)).alias("total_catalog_items"))
    n_rec = rec_items.agg(F.count(F.lit(1)).alias("unique_items_recommended"))
    us = users.select(U).distinct()
    uc = (us.join(recs.select(U).distinct().withColumn("_r", F.lit(1)), U, "left")
            .agg(F.count(F.lit(1)).alias("n_users"), F.count("_r").alias("users_with_recs")))
    p50 = pop.agg(F.percentile(F.col("popularity").cast("double"), 0.5).alias("_p50"))
    tail = (pop.join(items.select(I), I, "left_semi").crossJoin(F.broadcast(p50))  # one-row side
               .where(F.col("popularity") <= F.col("_p50")).select(I))
    tail_n = tail.agg(F.count(F.lit(1)).alias("tail_items_in_catalog"))
    tail_hit = tail.join(rec_items, I, "left_semi").agg(F.count(F.lit(1)).alias("_tail_rec"))
    row = n_items.crossJoin(n_rec).crossJoin(uc).crossJoin(tail_n).crossJoin(tail_hit)  # one-row sides
    return row.select(
        round4(F.coalesce(safe_div("unique_items_recommended", "total_catalog_items"), F.lit(0.0))).alias("catalog_coverage"),
        round4(F.coalesce(safe_div("users_with_recs", "n_users"), F.lit(0.0))).alias("user_coverage"),
        round4(F.coalesce(safe_div("_tail_rec", "tail_items_in_catalog"), F.lit(0.0))).alias("long_tail_coverage"),
        F.col("unique_items_recommended").cast("bigint").alias("unique_items_recommended"),
        F.col("total_catalog_items").cast("bigint").alias("total_catalog_items"),
        F.col("tail_items_in_catalog").cast("bigint").alias("tail_items_in_catalog"))


def evaluation_report(recs: DataFrame, truth: DataFrame, pairs: DataFrame, pop: DataFrame,
                      factors: DataFrame, categories: DataFrame, k: int = 10, metadata: dict | None = None) -> DataFrame:
    """V-14: ranking, diversity/novelty, coverage and metadata as one long
    (section, metric, value, text) table. ``metadata`` (a bundle's) comes as text.

    Diversity, entropy and novelty are averaged over lists with >= 2 factor
    items, as the reference does; every part is an aggregate of one recs table.
    """
    rk = ranking_metrics(recs, truth, k)
    ild = intra_list_diversity(recs, factors)
    ild_users = ild.select(U)
    ent = category_entropy(recs, categories).join(ild_users, U, "left_semi")
    nov = novelty(recs, pop).join(ild_users, U, "left_semi")
    div = (ild.agg(F.avg("ild").alias("a"))
              .crossJoin(ent.agg(F.avg("entropy").alias("b")))
              .crossJoin(nov.agg(F.avg("novelty").alias("c"))))  # one-row sides
    cov = coverage_metrics(recs, pairs, pairs, pop)
    row = rk.crossJoin(div).crossJoin(cov)  # one-row sides
    size = pairs.agg(F.countDistinct(U).alias("_users"), F.countDistinct(I).alias("_items"))  # one row
    sections = {
        "ranking_metrics": [
            *[(f"{m}_at_{k}", F.col(f"{m}_at_k")) for m in ("precision", "recall", "ndcg", "mrr", "hit_rate", "f1")],
            ("n_eval_users", F.col("n_eval_users"))],
        "diversity_metrics": [
            ("intra_list_diversity", round4(F.coalesce("a", F.lit(0.0)))),
            (f"category_entropy_at_{k}", round4(F.coalesce("b", F.lit(0.0)))), (f"novelty_at_{k}", round4(F.coalesce("c", F.lit(0.0))))],
        "coverage_metrics": [(m, F.col(m)) for m in ("catalog_coverage", "user_coverage", "long_tail_coverage")],
        "metadata": [("training_users", F.col("_users")), ("training_items", F.col("_items")),
                     *[(m, F.lit(str(t))) for m, t in {"k": k, **(metadata or {})}.items()]],
    }
    texts = {"k", *(metadata or {})}
    none = F.lit(None)
    arr = F.array(*[F.struct(
        F.lit(section).alias("section"), F.lit(m).alias("metric"),
        (none if section == "metadata" and m in texts else v).cast("double").alias("value"),
        (v if section == "metadata" and m in texts else none).cast("string").alias("text"))
        for section, metrics in sections.items() for m, v in metrics])
    return row.crossJoin(size).select(F.inline(arr))


def popularity_baseline(ev: DataFrame, k: int = 10, ts: str = "ts", tiebreak: str = "event_id") -> DataFrame:
    """V-15: global time split (W-3), the k most frequent train items (W-5),
    share of test users with any test item among them."""
    from rankfold.operators.split import global_split, global_top_k
    sp = global_split(ev.select(U, I, ts, tiebreak), ts, tiebreak, 0.8)
    train, test = sp.where(F.col("is_train")), sp.where(~F.col("is_train"))
    counts = train.groupBy(I).agg(F.count(F.lit(1)).alias("n"))
    top = global_top_k(counts, k, F.desc("n")).select(I)  # k rows
    hit = (test.join(F.broadcast(top).withColumn("_h", F.lit(1)), I, "left")
               .groupBy(U).agg(F.max(F.coalesce("_h", F.lit(0))).alias("hit")))
    return hit.agg(F.round(F.avg("hit"), 6).alias("hit_rate_at_10"),
                   F.sum("hit").cast("bigint").alias("hits"),
                   F.count(F.lit(1)).cast("bigint").alias("n_test_users"))
