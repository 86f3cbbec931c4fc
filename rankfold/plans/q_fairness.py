"""Registered fairness queries (F-1..F-11) over EASE / hybrid lists of table E."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold.operators import fairness as FA
from rankfold.operators import recommend as R
from rankfold.plans import flows
from rankfold.plans import sqlfrag as Q
from rankfold.plans.q_eval import _EASE_ALL, ease_recs_all
from rankfold.plans.registry import query
from rankfold.sources import testtables as TT

E, L = "E", "L"

_PB = """p80 AS (SELECT quantile_cont(popularity, 0.8) AS q FROM pop),
rp AS (SELECT r.user_id, CAST(COALESCE(p.popularity, 0) AS DOUBLE) AS pop FROM {recs} r LEFT JOIN pop p ON r.item_id = p.item_id),
gi AS (SELECT user_id, COUNT(*) AS n, SUM(pop) AS s, SUM(i * pop) AS iv
       FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pop) AS i FROM rp) GROUP BY user_id),
pb AS (SELECT user_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE pop >= (SELECT q FROM p80)) AS pc FROM rp GROUP BY user_id),
pbf AS (SELECT pb.user_id, CAST(ROUND(CAST(CAST(ROUND(pc / pb.n, 9) AS VARCHAR) AS DECIMAL(38, 12)), 4) AS DOUBLE) AS popular_items_fraction, pc / pb.n > 0.3 AS popularity_bias_detected,
               ROUND((SELECT q FROM p80), 1) AS p80_popularity_count,
               CAST(ROUND(CAST(CAST(ROUND(CASE WHEN gi.n = 0 OR gi.s = 0 THEN 0.0 ELSE (2 * iv - (gi.n + 1) * gi.s) / (gi.n * gi.s) END, 9) AS VARCHAR) AS DECIMAL(38, 12)), 4) AS DOUBLE) AS gini_coefficient,
               CAST(pb.n AS BIGINT) AS n_recommendations,
               CASE WHEN pc / pb.n > 0.3 THEN 'High popularity bias: recommendations over-represent popular items.'
                    ELSE 'Acceptable popularity distribution.' END AS interpretation
        FROM pb JOIN gi ON pb.user_id = gi.user_id)"""

_CD = """fcc AS (SELECT r.user_id, COALESCE(c.category, 'unknown') AS category, COUNT(*) AS c
        FROM {recs} r LEFT JOIN cat c ON r.item_id = c.item_id GROUP BY 1, 2),
fcp AS (SELECT user_id, c / SUM(c) OVER (PARTITION BY user_id) AS p FROM fcc),
fce AS (SELECT user_id, COUNT(*) AS n_cats, -SUM(p * ln(p + 1e-12)) AS h FROM fcp GROUP BY user_id),
cdf AS (SELECT user_id, CAST(ROUND(CAST(CAST(ROUND(CASE WHEN n_cats <= 1 THEN 0.0 ELSE h / ln(n_cats) END, 9) AS VARCHAR) AS DECIMAL(38, 12)), 4) AS DOUBLE) AS category_diversity_score,
               CAST(n_cats AS BIGINT) AS n_unique_categories,
               CASE WHEN n_cats <= 1 THEN 0.0 ELSE h / ln(n_cats) END AS raw_score
        FROM fce)"""

_SEG = """ucnt AS (SELECT user_id, COUNT(*) AS cnt FROM train WHERE user_id IN (SELECT user_id FROM {recs}) GROUP BY user_id),
uq AS (SELECT quantile_cont(cnt, 0.2) AS q20, quantile_cont(cnt, 0.8) AS q80 FROM ucnt),
seg AS (SELECT user_id, CAST(cnt AS BIGINT) AS cnt,
               CASE WHEN cnt >= (SELECT q80 FROM uq) THEN 'power' WHEN cnt <= (SELECT q20 FROM uq) THEN 'casual'
                    ELSE 'mid' END AS segment FROM ucnt),
segnames AS (SELECT * FROM (VALUES ('power'), ('mid'), ('casual')) t(segment)),
par AS (SELECT n.segment, CAST(COUNT(s.user_id) AS BIGINT) AS n_users,
               CAST(ROUND(CAST(CAST(ROUND(COALESCE(AVG(pbf.popular_items_fraction), 0.0), 9) AS VARCHAR) AS DECIMAL(38, 12)), 4) AS DOUBLE) AS avg_popular_fraction,
               CAST(ROUND(CAST(CAST(ROUND(COALESCE(AVG(cdf.category_diversity_score), 0.0), 9) AS VARCHAR) AS DECIMAL(38, 12)), 4) AS DOUBLE) AS avg_diversity_score
        FROM segnames n LEFT JOIN seg s ON s.segment = n.segment
        LEFT JOIN pbf ON pbf.user_id = s.user_id LEFT JOIN cdf ON cdf.user_id = s.user_id
        GROUP BY n.segment),
gaps AS (SELECT CAST(ROUND(CAST(CAST(ROUND(ABS((SELECT avg_diversity_score FROM par WHERE segment = 'power')
                        - (SELECT avg_diversity_score FROM par WHERE segment = 'casual')), 9) AS VARCHAR) AS DECIMAL(38, 12)), 4) AS DOUBLE) AS dg,
                CAST(ROUND(CAST(CAST(ROUND(ABS((SELECT avg_popular_fraction FROM par WHERE segment = 'power')
                        - (SELECT avg_popular_fraction FROM par WHERE segment = 'casual')), 9) AS VARCHAR) AS DECIMAL(38, 12)), 4) AS DOUBLE) AS pg)"""

_CC = """icnt AS (SELECT item_id, COUNT(*) AS c FROM {recs} GROUP BY item_id),
ist AS (SELECT COUNT(*) AS u, SUM(c) AS tot FROM icnt),
itop AS (SELECT SUM(c) AS top FROM (SELECT c, row_number() OVER (ORDER BY c DESC, item_id) AS r FROM icnt)
         WHERE r <= GREATEST(1, FLOOR((SELECT u FROM ist) * 0.1))),
ccf AS (SELECT CAST(ROUND(CAST(CAST(ROUND(u / (SELECT COUNT(DISTINCT item_id) FROM pairs), 9) AS VARCHAR) AS DECIMAL(38, 12)), 4) AS DOUBLE) AS catalog_coverage,
               CAST(u AS BIGINT) AS unique_items_recommended,
               CAST((SELECT COUNT(DISTINCT item_id) FROM pairs) AS BIGINT) AS total_catalog_items,
               CAST(ROUND(CAST(CAST(ROUND((SELECT top FROM itop) / tot, 9) AS VARCHAR) AS DECIMAL(38, 12)), 4) AS DOUBLE) AS top_10pct_items_concentration,
               (SELECT top FROM itop) / tot > 0.5 AS high_concentration FROM ist)"""

_LT = """tq AS (SELECT quantile_cont(popularity, 0.2) AS q20, quantile_cont(popularity, 0.8) AS q80 FROM pop),
tiers AS (SELECT item_id, CASE WHEN popularity >= (SELECT q80 FROM tq) THEN 'head'
                               WHEN popularity <= (SELECT q20 FROM tq) THEN 'tail' ELSE 'torso' END AS tier
          FROM pop WHERE item_id IN (SELECT item_id FROM pairs)),
tiernames AS (SELECT * FROM (VALUES ('head'), ('torso'), ('tail')) t(tier)),
ltf AS (SELECT n.tier, CAST(COUNT(t.item_id) AS BIGINT) AS total_items,
               CAST(COUNT(t.item_id) FILTER (WHERE t.item_id IN (SELECT item_id FROM {recs})) AS BIGINT) AS exposed_items
        FROM tiernames n LEFT JOIN tiers t ON t.tier = n.tier GROUP BY n.tier),
ltx AS (SELECT tier, total_items, exposed_items,
               CAST(ROUND(CAST(CAST(ROUND(COALESCE(exposed_items / NULLIF(total_items, 0), 0.0), 9) AS VARCHAR) AS DECIMAL(38, 12)), 4) AS DOUBLE) AS exposure,
               CASE WHEN tier = 'tail' THEN CAST(ROUND(CAST(CAST(ROUND(COALESCE(exposed_items / NULLIF(total_items, 0), 0.0), 9) AS VARCHAR) AS DECIMAL(38, 12)), 4) AS DOUBLE) < 0.2 END
                 AS tail_suppression_detected FROM ltf)"""


def _f(s, recs="erecs"):
    return s.replace("{recs}", recs)


def _ease(spark, sf_dir):
    p, recs = ease_recs_all(spark, sf_dir)
    return p, recs, TT.categories(spark, sf_dir)


@query("f1_popularity_thresholds_e", Q.with_prep(E, body="""
SELECT ROUND(quantile_cont(popularity, 0.5), 6) AS p50, ROUND(quantile_cont(popularity, 0.8), 6) AS p80,
       ROUND(quantile_cont(popularity, 0.95), 6) AS p95 FROM pop"""))
def f1_popularity_thresholds_e(spark, sf_dir):
    t = FA.thresholds(flows.prepared(spark, sf_dir, E).pop, (50, 80, 95))
    return t.select(*[F.round(c, 6).alias(c) for c in t.columns])


@query("f2_popularity_bias_e", Q.with_prep(E, *_EASE_ALL, _f(_PB), body="SELECT * FROM pbf", recursive=True))
def f2_popularity_bias_e(spark, sf_dir):
    p, recs, _ = _ease(spark, sf_dir)
    return FA.popularity_bias(recs, p.pop)


@query("f3_gini_item_popularity_l", Q.with_prep(L, body="""
SELECT ROUND((2 * SUM(i * v) - (COUNT(*) + 1) * SUM(v)) / (COUNT(*) * SUM(v)), 6) AS gini
FROM (SELECT CAST(popularity AS DOUBLE) AS v, row_number() OVER (ORDER BY popularity) AS i FROM pop)"""))
def f3_gini_item_popularity_l(spark, sf_dir):
    """F-3 over the whole catalog (standard sign)."""
    g = FA.gini(flows.prepared(spark, sf_dir, L).pop, None, "popularity")
    return g.select(F.round("gini", 6).alias("gini"))


@query("f4_category_diversity_e", Q.with_prep(E, Q.CATS, *_EASE_ALL, _f(_CD), body="""
SELECT user_id, category_diversity_score, n_unique_categories,
       category_diversity_score >= 0.3 AS meets_diversity_threshold,
       CASE WHEN raw_score >= 0.3 THEN 'Good category diversity.'
            ELSE 'Low category diversity: recommendations concentrated in few categories.' END AS interpretation,
       (SELECT string_agg(category || ':' || c, ',' ORDER BY c DESC, category) FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, category) AS r FROM fcc) t
        WHERE r <= 10 AND t.user_id = cdf.user_id) AS category_distribution
FROM cdf""", recursive=True))
def f4_category_diversity_e(spark, sf_dir):
    _, recs, cats = _ease(spark, sf_dir)
    d = FA.category_diversity(recs, cats)
    said = F.transform("category_distribution", lambda x: F.concat(x["category"], F.lit(":"), x["n"].cast("string")))
    return d.withColumn("category_distribution", F.array_join(said, ","))


@query("f5_catalog_concentration_e", Q.with_prep(E, *_EASE_ALL, _f(_CC), body="SELECT * FROM ccf", recursive=True))
def f5_catalog_concentration_e(spark, sf_dir):
    p, recs, _ = _ease(spark, sf_dir)
    return FA.catalog_concentration(recs, p.pairs)


_F6_BODY = """SELECT COALESCE(pbf.user_id, cdf.user_id) AS user_id,
       CAST(ROUND(CAST(CAST(ROUND((1 - COALESCE(pbf.popular_items_fraction, 0.5) + COALESCE(cdf.category_diversity_score, 0.0)) / 2.0, 9) AS VARCHAR) AS DECIMAL(38, 12)), 4) AS DOUBLE)
         AS overall_fairness_score,
       COALESCE(pbf.popular_items_fraction, 0.5) AS popular_items_fraction,
       COALESCE(cdf.category_diversity_score, 0.0) AS category_diversity_score,
       CASE WHEN CAST(ROUND(CAST(CAST(ROUND((1 - COALESCE(pbf.popular_items_fraction, 0.5) + COALESCE(cdf.category_diversity_score, 0.0)) / 2.0, 9) AS VARCHAR) AS DECIMAL(38, 12)), 4) AS DOUBLE) >= 0.5
            THEN 'Good overall fairness.' ELSE 'Fairness concerns detected — consider diversification.' END
         AS fairness_interpretation
FROM pbf FULL OUTER JOIN cdf ON pbf.user_id = cdf.user_id"""


@query("f6_user_fairness_report_e", Q.with_prep(E, Q.CATS, *_EASE_ALL, _f(_PB), _f(_CD), body=_F6_BODY, recursive=True))
def f6_user_fairness_report_e(spark, sf_dir):
    p, recs, cats = _ease(spark, sf_dir)
    return FA.user_fairness(recs, p.pop, cats)


@query("f7_user_segments_e", Q.with_prep(E, Q.CATS, *_EASE_ALL, _f(_PB), _f(_CD), _f(_SEG), body="""
SELECT user_id, cnt, segment FROM seg""", recursive=True))
def f7_user_segments_e(spark, sf_dir):
    p, recs, _ = _ease(spark, sf_dir)
    return FA.user_segments(p.train, recs.select("user_id"))


@query("f8_segment_parity_e", Q.with_prep(E, Q.CATS, *_EASE_ALL, _f(_PB), _f(_CD), _f(_SEG), body="""
SELECT segment, n_users, avg_popular_fraction, avg_diversity_score FROM par""", recursive=True))
def f8_segment_parity_e(spark, sf_dir):
    p, recs, cats = _ease(spark, sf_dir)
    return FA.segment_parity(recs, FA.user_segments(p.train, recs.select("user_id")), p.pop, cats)


@query("f8_segment_gaps_e", Q.with_prep(E, Q.CATS, *_EASE_ALL, _f(_PB), _f(_CD), _f(_SEG), body="""
SELECT dg AS diversity_gap_power_vs_casual, pg AS popularity_gap_power_vs_casual,
       dg > 0.2 OR pg > 0.2 AS unfairness_detected,
       CASE WHEN dg > 0.2 OR pg > 0.2 THEN 'Significant disparity between power and casual users detected.'
            ELSE 'Recommendation quality is relatively equitable across user segments.' END AS interpretation
FROM gaps""", recursive=True))
def f8_segment_gaps_e(spark, sf_dir):
    p, recs, cats = _ease(spark, sf_dir)
    par = FA.segment_parity(recs, FA.user_segments(p.train, recs.select("user_id")), p.pop, cats)
    return FA.segment_gaps(par)


@query("f9_long_tail_exposure_e", Q.with_prep(E, *_EASE_ALL, _f(_LT), body="SELECT * FROM ltx", recursive=True))
def f9_long_tail_exposure_e(spark, sf_dir):
    p, recs, _ = _ease(spark, sf_dir)
    return FA.long_tail_exposure(recs, p.pop, p.pairs)


@query("f9_long_tail_exposure_popular_l", Q.with_prep(
    L, "tu AS (SELECT DISTINCT user_id FROM test)", Q.popular_masked("tu", 10), _f(_LT, "precs"),
    body="SELECT * FROM ltx"))
def f9_long_tail_exposure_popular_l(spark, sf_dir):
    """F-9 on L where popularity lists never reach the tail (suppression detected)."""
    from rankfold.plans.q_eval import popular_eval_recs
    p, recs = popular_eval_recs(spark, sf_dir, L)
    return FA.long_tail_exposure(recs, p.pop, p.pairs)


@query("f10_system_fairness_report_e", Q.with_prep(
    E, Q.CATS, *_EASE_ALL, _f(_PB), _f(_CD), _f(_SEG), _f(_CC), _f(_LT), body="""
SELECT 'catalog_coverage' AS metric, CAST(catalog_coverage AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS text FROM ccf
UNION ALL SELECT 'top_10pct_items_concentration', top_10pct_items_concentration, NULL FROM ccf
UNION ALL SELECT 'high_concentration', CAST(high_concentration AS DOUBLE), NULL FROM ccf
UNION ALL SELECT tier || '_exposure', exposure, NULL FROM ltx
UNION ALL SELECT 'tail_suppression_detected', CAST(tail_suppression_detected AS DOUBLE),
  CASE WHEN tail_suppression_detected THEN '""" + FA.TXT_TAIL_LOW[0] + """' || printf('%.1f%%', exposure * 100) || '""" + FA.TXT_TAIL_LOW[1] + """'
       ELSE '""" + FA.TXT_TAIL_OK[0] + """' || printf('%.1f%%', exposure * 100) || '""" + FA.TXT_TAIL_OK[1] + """' END
  FROM ltx WHERE tier = 'tail'
UNION ALL SELECT segment || '_avg_diversity_score', avg_diversity_score, NULL FROM par
UNION ALL SELECT segment || '_avg_popular_fraction', avg_popular_fraction, NULL FROM par
UNION ALL SELECT segment || '_n_users', CAST(n_users AS DOUBLE), NULL FROM par
UNION ALL SELECT 'diversity_gap_power_vs_casual', dg, NULL FROM gaps
UNION ALL SELECT 'popularity_gap_power_vs_casual', pg, NULL FROM gaps
UNION ALL SELECT 'unfairness_detected', CAST(dg > 0.2 OR pg > 0.2 AS DOUBLE),
  CASE WHEN dg > 0.2 OR pg > 0.2 THEN '""" + FA.TXT_SEG_UNFAIR + """' ELSE '""" + FA.TXT_SEG_FAIR + """' END FROM gaps""", recursive=True))
def f10_system_fairness_report_e(spark, sf_dir):
    """F-10: one recs table (10 collaborative items per user) feeding three aggregates."""
    p, recs, cats = _ease(spark, sf_dir)
    return FA.system_report(recs, p.pop, p.pairs, p.train, cats)


_HK = 30


@query("f11_fairness_check_hybrid_e", Q.with_prep(
    E, Q.CATS, Q.content(), Q.ease(), "warm AS (SELECT DISTINCT user_id FROM train)",
    Q.ease_recs("warm", _HK), Q.content_recs("warm", _HK), Q.blend("erecs", "crecs", 10),
    _f(_PB, "hrecs"), _f(_CD, "hrecs"), body=_F6_BODY, recursive=True))
def f11_fairness_check_hybrid_e(spark, sf_dir):
    """F-11: per-user fairness of the hybrid lists (n = 10)."""
    p, b = flows.bundle(spark, sf_dir, E)
    users = p.train.select("user_id").distinct()
    recs = R.recommend_hybrid(users, b, 10)
    return FA.user_fairness(recs, p.pop, b.categories)
