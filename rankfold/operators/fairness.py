"""Fairness audit operators (F-*), bulk over a recs table (user_id, rank, item_id).

Per-user metrics are a join of the recs with small item attributes
(popularity, category) and one ``groupBy(user)``; system metrics are a few
more aggregates over the same recs. Percentile thresholds are exact linear
percentiles (``percentile``), computed once as a one-row table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfold.config import DEFAULTS
from rankfold.functions.exprs import round4
from rankfold.session import materialize

U, I = "user_id", "item_id"

# fixed values: interpretation texts of the fairness report
TXT_BIASED = "High popularity bias: recommendations over-represent popular items."
TXT_UNBIASED = "Acceptable popularity distribution."
TXT_DIVERSE = "Good category diversity."
TXT_NOT_DIVERSE = "Low category diversity: recommendations concentrated in few categories."
TXT_FAIR = "Good overall fairness."
TXT_UNFAIR = "Fairness concerns detected — consider diversification."
TXT_SEG_UNFAIR = "Significant disparity between power and casual users detected."
TXT_SEG_FAIR = "Recommendation quality is relatively equitable across user segments."
TXT_TAIL_LOW = ("Long-tail items are underexposed (", " coverage). Consider diversity re-ranking or popularity penalty.")
TXT_TAIL_OK = ("Acceptable long-tail exposure (", ").")


def thresholds(pop: DataFrame, pcts=(20, 50, 80, 95)) -> DataFrame:
    """F-1: one row of exact linear percentiles of item popularity."""
    arr = F.percentile(F.col("popularity").cast("double"), [p / 100.0 for p in pcts])
    return pop.agg(arr.alias("_p")).select(*[F.col("_p")[i].alias(f"p{p}") for i, p in enumerate(pcts)])


def gini(df: DataFrame, key, value: str, reference_compat: bool = False) -> DataFrame:
    """F-3: Gini of ``value`` per ``key`` (None = whole table).

    Standard form (2 sum_i i*v_(i) - (n+1) sum v) / (n sum v) over ascending
    values; 0 for empty or zero-sum groups. ``reference_compat`` negates it.
    """
    keys = [] if key is None else ([key] if isinstance(key, str) else list(key))
    v = F.col(value).cast("double")
    if keys:
        w = Window.partitionBy(*keys).orderBy(v)
        ranked = df.withColumn("_i", F.row_number().over(w))
    else:
        from rankfold.operators.ranking import global_rank
        ranked = global_rank(df.select(value), [F.asc(value)], "_i")
    agg = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(v).alias("_s"),
                                    F.sum(F.col("_i") * v).alias("_iv"))
    g = F.when((F.col("_n") == 0) | (F.col("_s") == 0), F.lit(0.0)).otherwise(
        (F.lit(2.0) * F.col("_iv") - (F.col("_n") + 1) * F.col("_s")) / (F.col("_n") * F.col("_s")))
    if reference_compat:
        g = -g
    return agg.select(*keys, g.alias("gini"))


def popularity_bias(recs: DataFrame, pop: DataFrame, threshold: float | None = None) -> DataFrame:
    """F-2: share of recommended items with popularity >= p80 (missing = 0), flag, Gini."""
    threshold = DEFAULTS.popularity_bias_threshold if threshold is None else threshold
    p80 = thresholds(pop, (80,))
    j = (recs.select(U, I).join(pop.select(I, "popularity"), I, "left")
             .withColumn("popularity", F.coalesce("popularity", F.lit(0)))
             .crossJoin(F.broadcast(p80)))  # one-row side
    per = j.groupBy(U).agg(F.count(F.lit(1)).alias("n_recommendations"),
                           F.count_if(F.col("popularity") >= F.col("p80")).alias("_pc"),
                           F.first("p80").alias("p80"))
    g = gini(j, U, "popularity")
    frac = F.col("_pc") / F.col("n_recommendations")
    return per.join(g, U).select(
        U, round4(frac).alias("popular_items_fraction"),
        (frac > threshold).alias("popularity_bias_detected"),
        F.round("p80", 1).alias("p80_popularity_count"),
        round4("gini").alias("gini_coefficient"),
        F.col("n_recommendations").cast("bigint").alias("n_recommendations"),
        F.when(frac > threshold, F.lit(TXT_BIASED)).otherwise(F.lit(TXT_UNBIASED)).alias("interpretation"))


def category_diversity(recs: DataFrame, categories: DataFrame, threshold: float | None = None) -> DataFrame:
    """F-4: normalised Shannon entropy of the list's categories (missing =
    'unknown'), with the ten most frequent categories (ties: by name)."""
    threshold = DEFAULTS.min_category_diversity if threshold is None else threshold
    c = (recs.select(U, I).join(categories.select(I, "category"), I, "left")
             .withColumn("category", F.coalesce("category", F.lit("unknown"))))
    cnt = c.groupBy(U, "category").agg(F.count(F.lit(1)).alias("_c"))
    p = cnt.withColumn("_p", F.col("_c") / F.sum("_c").over(Window.partitionBy(U)))
    per = p.groupBy(U).agg(F.count(F.lit(1)).alias("n_unique_categories"),
                           (-F.sum(F.col("_p") * F.log(F.col("_p") + F.lit(1e-12)))).alias("_h"),
                           # a list's categories, so at most as many as the list has items
                           F.slice(F.sort_array(F.collect_list(F.struct((-F.col("_c")).alias("_k"), "category"))), 1, 10).alias("_top"))
    score = F.when(F.col("n_unique_categories") <= 1, F.lit(0.0)).otherwise(
        F.col("_h") / F.log(F.col("n_unique_categories")))
    # round on 9 dp first so float noise cannot flip a 4-dp half step
    s4 = round4(score)
    return per.select(U, s4.alias("category_diversity_score"),
                      F.col("n_unique_categories").cast("bigint").alias("n_unique_categories"),
                      F.transform("_top", lambda t: F.struct(t["category"].alias("category"), (-t["_k"]).alias("n"))).alias("category_distribution"),
                      (s4 >= threshold).alias("meets_diversity_threshold"),
                      F.when(score >= threshold, F.lit(TXT_DIVERSE)).otherwise(F.lit(TXT_NOT_DIVERSE))
                      .alias("interpretation"))


def catalog_concentration(recs: DataFrame, catalog: DataFrame) -> DataFrame:
    """F-5: coverage and the share of all rec slots taken by the top 10% items."""
    counts = recs.groupBy(I).agg(F.count(F.lit(1)).alias("_c"))
    stats = counts.agg(F.count(F.lit(1)).alias("unique_items_recommended"), F.sum("_c").alias("_tot"))
    n_cat = catalog.select(I).distinct().agg(F.count(F.lit(1)).alias("total_catalog_items"))
    # top counts do not depend on how equal counts are ordered; rank on counts only
    from rankfold.operators.ranking import global_rank
    ranked = global_rank(counts, [F.desc("_c"), F.asc(I)], "_r")
    n_top = stats.select(F.greatest(F.lit(1), F.floor(F.col("unique_items_recommended") * 0.1)).alias("_nt"))
    top = ranked.crossJoin(F.broadcast(n_top)).where(F.col("_r") <= F.col("_nt")).agg(F.sum("_c").alias("_top"))
    row = stats.crossJoin(n_cat).crossJoin(top)  # one-row sides
    conc = F.col("_top") / F.col("_tot")
    return row.select(
        round4(F.col("unique_items_recommended") / F.col("total_catalog_items")).alias("catalog_coverage"),
        F.col("unique_items_recommended").cast("bigint").alias("unique_items_recommended"),
        F.col("total_catalog_items").cast("bigint").alias("total_catalog_items"),
        round4(conc).alias("top_10pct_items_concentration"),
        (conc > 0.5).alias("high_concentration"))


def user_fairness(recs: DataFrame, pop: DataFrame, categories: DataFrame) -> DataFrame:
    """F-6: overall = mean(1 - popular_fraction, diversity) of the 4-dp parts."""
    recs = materialize(recs.select(U, I))  # the lists are read three times
    pb = popularity_bias(recs, pop).select(U, "popular_items_fraction", "gini_coefficient")
    cd = category_diversity(recs, categories).select(U, "category_diversity_score")
    j = pb.join(cd, U, "full_outer")
    pf = F.coalesce("popular_items_fraction", F.lit(0.5))
    dv = F.coalesce("category_diversity_score", F.lit(0.0))
    overall = round4((F.lit(1.0) - pf + dv) / 2.0)
    return j.select(U, overall.alias("overall_fairness_score"), pf.alias("popular_items_fraction"),
                    dv.alias("category_diversity_score"),
                    F.when(overall >= 0.5, F.lit(TXT_FAIR)).otherwise(F.lit(TXT_UNFAIR)).alias("fairness_interpretation"))


def user_segments(train: DataFrame, users: DataFrame) -> DataFrame:
    """F-7: power (cnt >= p80, tested first) / casual (cnt <= p20) / mid over the given users."""
    cnt = (train.join(users.select(U).distinct(), U, "left_semi")
                .groupBy(U).agg(F.count(F.lit(1)).alias("cnt")))
    q = cnt.agg(F.percentile(F.col("cnt").cast("double"), [0.2, 0.8]).alias("_q"))
    j = cnt.crossJoin(F.broadcast(q))  # one-row side
    seg = (F.when(F.col("cnt") >= F.col("_q")[1], F.lit("power"))
            .when(F.col("cnt") <= F.col("_q")[0], F.lit("casual")).otherwise(F.lit("mid")))
    return j.select(U, F.col("cnt").cast("bigint").alias("cnt"), seg.alias("segment"))


def segment_parity(recs: DataFrame, segments: DataFrame, pop: DataFrame, categories: DataFrame) -> DataFrame:
    """F-8: per segment n_users and means of the per-user 4-dp metrics (users
    without recs are counted in n_users but skipped in the means)."""
    spark = recs.sparkSession
    pb = popularity_bias(recs, pop).select(U, "popular_items_fraction")
    cd = category_diversity(recs, categories).select(U, "category_diversity_score")
    per = segments.join(pb, U, "left").join(cd, U, "left")
    agg = per.groupBy("segment").agg(F.count(F.lit(1)).alias("n_users"),
                                     F.avg("popular_items_fraction").alias("_pf"),
                                     F.avg("category_diversity_score").alias("_dv"))
    # fixed values: the three activity segments
    names = spark.createDataFrame([("power",), ("mid",), ("casual",)], "segment string")
    out = names.join(agg, "segment", "left")
    return out.select("segment", F.coalesce(F.col("n_users"), F.lit(0)).cast("bigint").alias("n_users"),
                      round4(F.coalesce("_pf", F.lit(0.0))).alias("avg_popular_fraction"),
                      round4(F.coalesce("_dv", F.lit(0.0))).alias("avg_diversity_score"))


def segment_gaps(parity: DataFrame, threshold: float | None = None) -> DataFrame:
    """F-8 summary: |power - casual| gaps of diversity and popular fraction."""
    threshold = DEFAULTS.segment_gap_threshold if threshold is None else threshold
    p = parity.groupBy().pivot("segment", ["power", "casual"]).agg(
        F.first("avg_diversity_score").alias("dv"), F.first("avg_popular_fraction").alias("pf"))
    dg = round4(F.abs(F.col("power_dv") - F.col("casual_dv")))
    pg = round4(F.abs(F.col("power_pf") - F.col("casual_pf")))
    return p.select(dg.alias("diversity_gap_power_vs_casual"), pg.alias("popularity_gap_power_vs_casual"),
                    ((dg > threshold) | (pg > threshold)).alias("unfairness_detected"),
                    F.when((dg > threshold) | (pg > threshold), F.lit(TXT_SEG_UNFAIR))
                    .otherwise(F.lit(TXT_SEG_FAIR)).alias("interpretation"))


def popularity_tiers(pop: DataFrame, catalog: DataFrame) -> DataFrame:
    """Head (>= p80, tested first) / tail (<= p20) / torso over catalog items."""
    q = thresholds(pop, (20, 80))
    j = pop.join(catalog.select(I).distinct(), I, "left_semi").crossJoin(F.broadcast(q))  # one-row side
    tier = (F.when(F.col("popularity") >= F.col("p80"), F.lit("head"))
             .when(F.col("popularity") <= F.col("p20"), F.lit("tail")).otherwise(F.lit("torso")))
    return j.select(I, "popularity", tier.alias("tier"))


def long_tail_exposure(recs: DataFrame, pop: DataFrame, catalog: DataFrame,
                       threshold: float | None = None) -> DataFrame:
    """F-9: per tier exposed / total items; tail suppressed if tail exposure < 0.2."""
    threshold = DEFAULTS.long_tail_threshold if threshold is None else threshold
    spark = recs.sparkSession
    t = popularity_tiers(pop, catalog)
    rec_items = recs.select(I).distinct().withColumn("_e", F.lit(1))
    agg = t.join(rec_items, I, "left").groupBy("tier").agg(
        F.count(F.lit(1)).alias("total_items"), F.count("_e").alias("exposed_items"))
    # fixed values: the three popularity tiers
    names = spark.createDataFrame([("head",), ("torso",), ("tail",)], "tier string")
    out = names.join(agg, "tier", "left").fillna({"total_items": 0, "exposed_items": 0})
    exp = round4(F.coalesce(F.try_divide(F.col("exposed_items").cast("double"), F.col("total_items").cast("double")),
                             F.lit(0.0)))
    return out.select("tier", F.col("total_items").cast("bigint").alias("total_items"),
                      F.col("exposed_items").cast("bigint").alias("exposed_items"), exp.alias("exposure"),
                      F.when(F.col("tier") == "tail", exp < threshold).alias("tail_suppression_detected"))


def system_report(recs: DataFrame, pop: DataFrame, catalog: DataFrame, train: DataFrame,
                  categories: DataFrame) -> DataFrame:
    """F-10: catalog concentration + long-tail exposure + segment parity as
    (metric, value, text). Flags have the value 0 or 1; those with an
    interpretation carry it as text."""
    users = recs.select(U).distinct()
    cc = catalog_concentration(recs, catalog)
    lt = long_tail_exposure(recs, pop, catalog)
    sp = segment_parity(recs, user_segments(train, users), pop, categories)
    gaps = segment_gaps(sp)

    def rows(df: DataFrame, *metrics: tuple) -> DataFrame:
        return df.select(F.inline(F.array(*[F.struct(
            (F.lit(name) if isinstance(name, str) else name).alias("metric"), value.cast("double").alias("value"),
            (F.lit(None).cast("string") if not text else text[0]).alias("text")) for name, value, *text in metrics])))

    shown = F.concat(F.format_number(F.round(F.col("exposure") * 100, 1), 1), F.lit("%"))
    tail = F.when(F.col("tail_suppression_detected"), F.concat(F.lit(TXT_TAIL_LOW[0]), shown, F.lit(TXT_TAIL_LOW[1]))).otherwise(
        F.concat(F.lit(TXT_TAIL_OK[0]), shown, F.lit(TXT_TAIL_OK[1])))
    parts = [
        rows(cc, *[(c, F.col(c)) for c in ("catalog_coverage", "top_10pct_items_concentration", "high_concentration")]),
        rows(lt, (F.concat(F.col("tier"), F.lit("_exposure")), F.col("exposure"))),
        rows(lt.where(F.col("tier") == "tail"), ("tail_suppression_detected", F.col("tail_suppression_detected"), tail)),
        rows(sp, *[(F.concat(F.col("segment"), F.lit(f"_{c}")), F.col(c)) for c in ("avg_diversity_score", "avg_popular_fraction", "n_users")]),
        rows(gaps, *[(c, F.col(c)) for c in ("diversity_gap_power_vs_casual", "popularity_gap_power_vs_casual")],
             ("unfairness_detected", F.col("unfairness_detected"), F.col("interpretation"))),
    ]
    return reduce(DataFrame.unionByName, parts)
