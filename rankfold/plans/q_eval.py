"""Registered evaluation queries (V-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold.operators import evaluate as V
from rankfold.operators import recommend as R
from rankfold.plans import flows
from rankfold.plans import sqlfrag as Q
from rankfold.plans.registry import query

K = flows.K


def popular_eval_recs(spark, sf_dir, table="E"):
    p = flows.prepared(spark, sf_dir, table)
    recs = R.recommend_popular(flows.test_users(p), p.pop, K, seen=p.train)
    return p, recs


_POP_RANK_SQL = lambda t: Q.with_prep(
    t, "tu AS (SELECT DISTINCT user_id FROM test)", Q.popular_masked("tu", K),
    Q.ranking_report("precs", "test", K), body=Q.RANKING_SELECT)


@query("v7_ranking_report_popular_e", _POP_RANK_SQL("E"))
def v7_ranking_report_popular_e(spark, sf_dir):
    """Flagship: popularity recs (train-masked) scored on the temporal hold-out."""
    p, recs = popular_eval_recs(spark, sf_dir, "E")
    return V.ranking_metrics(recs, p.test, K)


@query("v7_ranking_report_popular_l", _POP_RANK_SQL("L"))
def v7_ranking_report_popular_l(spark, sf_dir):
    p, recs = popular_eval_recs(spark, sf_dir, "L")
    return V.ranking_metrics(recs, p.test, K)


# ---------------------------------------------------------------- EASE-based evaluation (E)

from rankfold.operators import ease as EA  # noqa: E402
from rankfold.operators import split as S  # noqa: E402
from rankfold.sources import testtables as TT  # noqa: E402


def ease_recs_all(spark, sf_dir, k=K):
    """EASE top-k (train-masked) for every user with training history."""
    p = flows.prepared(spark, sf_dir, "E")
    B = EA.ease_fit(p.train, 500.0)
    users = p.train.select("user_id").distinct()
    recs = R.recommend_scored(users, EA.score_ease_topk(p.train, B, k), p.train, k)
    return p, recs


def events_truth(p):
    """W-2 + G-12: evaluator hold-out over raw events of known users."""
    ev = p.events.join(p.active.select("user_id"), "user_id", "left_semi")
    sp = S.temporal_holdout(ev, order=("ts", "event_id"), singletons="drop")
    return sp.where(~F.col("is_train")).groupBy("user_id", "item_id").agg(F.sum("weight").alias("weight"))


_EASE_ALL = [Q.ease(), "allu AS (SELECT DISTINCT user_id FROM train)", Q.ease_recs("allu", K)]
_EV_TRUTH = """evs AS (
  SELECT user_id, item_id, weight,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
         COUNT(*) OVER (PARTITION BY user_id) AS n
  FROM ev WHERE user_id IN (SELECT user_id FROM act)),
evtruth AS (SELECT user_id, item_id, SUM(weight) AS weight FROM evs
            WHERE n >= 2 AND rn > GREATEST(1, FLOOR(n * 0.8)) GROUP BY user_id, item_id)"""


def _per_user_sql(col):
    return Q.with_prep("E", *_EASE_ALL, Q.ranking_report("erecs", "test", K),
                       body=f"SELECT user_id, ROUND({col}, 6) AS {col} FROM pu", recursive=True)


def _per_user(spark, sf_dir, col):
    p, recs = ease_recs_all(spark, sf_dir)
    per = V.per_user_ranking(recs, p.test, K)
    return per.select("user_id", F.round(col, 6).alias(col))


@query("v1_precision_at_k_e", _per_user_sql("precision"))
def v1_precision_at_k_e(spark, sf_dir):
    return _per_user(spark, sf_dir, "precision")


@query("v2_recall_at_k_e", _per_user_sql("recall"))
def v2_recall_at_k_e(spark, sf_dir):
    return _per_user(spark, sf_dir, "recall")


@query("v3_ndcg_at_k_e", _per_user_sql("ndcg"))
def v3_ndcg_at_k_e(spark, sf_dir):
    return _per_user(spark, sf_dir, "ndcg")


@query("v4_mrr_at_k_e", _per_user_sql("mrr"))
def v4_mrr_at_k_e(spark, sf_dir):
    return _per_user(spark, sf_dir, "mrr")


@query("v5_hit_rate_at_k_e", _per_user_sql("hit"))
def v5_hit_rate_at_k_e(spark, sf_dir):
    return _per_user(spark, sf_dir, "hit")


@query("v6_f1_at_k_e", Q.with_prep("E", *_EASE_ALL, Q.ranking_report("erecs", "test", K), body="""
SELECT ROUND(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1_at_k FROM agg""", recursive=True))
def v6_f1_at_k_e(spark, sf_dir):
    """V-6: harmonic mean of the mean precision and mean recall."""
    p, recs = ease_recs_all(spark, sf_dir)
    return V.ranking_metrics(recs, p.test, K).select("f1_at_k")


@query("v7_ranking_report_trainer_e", Q.with_prep(
    "E", *_EASE_ALL, Q.ranking_report("erecs", "test", K, empty="zero"), body=Q.RANKING_SELECT, recursive=True))
def v7_ranking_report_trainer_e(spark, sf_dir):
    """V-7, trainer protocol: pair-level hold-out, users without a list count as 0."""
    p, recs = ease_recs_all(spark, sf_dir)
    return V.ranking_metrics(recs, p.test, K, empty_list="zero")


@query("v7_ranking_report_evaluator_e", Q.with_prep(
    "E", *_EASE_ALL, _EV_TRUTH, Q.ranking_report("erecs", "evtruth", K), body=Q.RANKING_SELECT, recursive=True))
def v7_ranking_report_evaluator_e(spark, sf_dir):
    """V-7, evaluator protocol: raw-event hold-out truth (may contain seen items)."""
    p, recs = ease_recs_all(spark, sf_dir)
    return V.ranking_metrics(recs, events_truth(p), K)


_FACT = """v AS (SELECT CAST(vec_id AS VARCHAR) AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings)"""
_ILD = _FACT + """,
rf AS (SELECT r.user_id, v.f FROM erecs r JOIN v ON v.id = r.item_id),
ps AS (SELECT user_id, unnest(f) AS x, generate_subscripts(f, 1) AS p FROM rf),
sv AS (SELECT user_id, p, SUM(x) AS s, SUM(x * x) AS q FROM ps GROUP BY user_id, p),
n2 AS (SELECT user_id, SUM(s * s) AS n2, SUM(q) AS sq FROM sv GROUP BY user_id),
kk AS (SELECT user_id, COUNT(*) AS k FROM rf GROUP BY user_id),
ild AS (SELECT n2.user_id, LEAST(1.0, GREATEST(0.0, 1 - (n2 - sq) / (k * (k - 1.0)))) AS ild
        FROM n2 JOIN kk ON n2.user_id = kk.user_id WHERE k >= 2)"""


@query("v8_intra_list_diversity_e", Q.with_prep("E", *_EASE_ALL, _ILD, body="""
SELECT user_id, ROUND(ild, 6) AS ild FROM ild""", recursive=True))
def v8_intra_list_diversity_e(spark, sf_dir):
    """V-8: 1 - mean pairwise cosine of the list's item factors (embeddings)."""
    _, recs = ease_recs_all(spark, sf_dir)
    d = V.intra_list_diversity(recs, TT.factors(spark, sf_dir))
    return d.select("user_id", F.round("ild", 6).alias("ild"))


_ENT = """cc AS (SELECT r.user_id, COALESCE(c.category, 'unknown') AS category, COUNT(*) AS c
       FROM erecs r LEFT JOIN cat c ON r.item_id = c.item_id GROUP BY 1, 2),
cp AS (SELECT user_id, category, c / SUM(c) OVER (PARTITION BY user_id) AS p FROM cc),
ent AS (SELECT user_id, COUNT(*) AS n_cats, -SUM(p * ln(p + 1e-12)) AS h FROM cp GROUP BY user_id)"""


@query("v9_category_entropy_e", Q.with_prep("E", Q.CATS, *_EASE_ALL, _ENT, body="""
SELECT user_id, CAST(n_cats AS BIGINT) AS n_cats,
       ROUND(CASE WHEN n_cats > 1 THEN h / ln(n_cats) ELSE 0.0 END, 6) AS entropy FROM ent""", recursive=True))
def v9_category_entropy_e(spark, sf_dir):
    _, recs = ease_recs_all(spark, sf_dir)
    e = V.category_entropy(recs, TT.categories(spark, sf_dir))
    return e.select("user_id", F.col("n_cats").cast("bigint").alias("n_cats"), F.round("entropy", 6).alias("entropy"))


_NOV = """tot AS (SELECT GREATEST(CAST(COALESCE(SUM(popularity), 0) AS DOUBLE), 1.0) AS t FROM pop),
nov AS (SELECT r.user_id, AVG(-log2(COALESCE(p.popularity, 1) / (SELECT t FROM tot) + 1e-12)) AS novelty
        FROM erecs r LEFT JOIN pop p ON r.item_id = p.item_id GROUP BY r.user_id)"""


@query("v10_novelty_e", Q.with_prep("E", *_EASE_ALL, _NOV, body="""
SELECT user_id, ROUND(novelty, 6) AS novelty FROM nov""", recursive=True))
def v10_novelty_e(spark, sf_dir):
    p, recs = ease_recs_all(spark, sf_dir)
    return V.novelty(recs, p.pop).select("user_id", F.round("novelty", 6).alias("novelty"))


_COV = """catalog AS (SELECT DISTINCT item_id FROM pairs),
users_all AS (SELECT DISTINCT user_id FROM pairs),
recitems AS (SELECT DISTINCT item_id FROM erecs),
p50 AS (SELECT quantile_cont(popularity, 0.5) AS q FROM pop),
tail AS (SELECT item_id FROM pop WHERE popularity <= (SELECT q FROM p50) AND item_id IN (SELECT item_id FROM catalog)),
cov AS (SELECT
  (SELECT COUNT(*) FROM recitems) AS unique_items_recommended,
  (SELECT COUNT(*) FROM catalog) AS total_catalog_items,
  (SELECT COUNT(*) FROM users_all) AS n_users,
  (SELECT COUNT(*) FROM users_all WHERE user_id IN (SELECT user_id FROM erecs)) AS users_with_recs,
  (SELECT COUNT(*) FROM tail) AS tail_items_in_catalog,
  (SELECT COUNT(*) FROM tail WHERE item_id IN (SELECT item_id FROM recitems)) AS tail_rec)"""


def _coverage(spark, sf_dir):
    p, recs = ease_recs_all(spark, sf_dir)
    return V.coverage_metrics(recs, p.pairs, p.pairs, p.pop)


@query("v11_catalog_coverage_e", Q.with_prep("E", *_EASE_ALL, _COV, body="""
SELECT CAST(ROUND(CAST(CAST(ROUND(unique_items_recommended / total_catalog_items, 9) AS VARCHAR) AS DECIMAL(38, 12)), 4) AS DOUBLE) AS catalog_coverage,
       CAST(unique_items_recommended AS BIGINT) AS unique_items_recommended,
       CAST(total_catalog_items AS BIGINT) AS total_catalog_items FROM cov""", recursive=True))
def v11_catalog_coverage_e(spark, sf_dir):
    return _coverage(spark, sf_dir).select("catalog_coverage", "unique_items_recommended", "total_catalog_items")


@query("v12_user_coverage_e", Q.with_prep("E", *_EASE_ALL, _COV, body="""
SELECT CAST(ROUND(CAST(CAST(ROUND(users_with_recs / n_users, 9) AS VARCHAR) AS DECIMAL(38, 12)), 4) AS DOUBLE) AS user_coverage FROM cov""", recursive=True))
def v12_user_coverage_e(spark, sf_dir):
    return _coverage(spark, sf_dir).select("user_coverage")


@query("v13_long_tail_coverage_e", Q.with_prep("E", *_EASE_ALL, _COV, body="""
SELECT CAST(ROUND(CAST(CAST(ROUND(COALESCE(tail_rec / NULLIF(tail_items_in_catalog, 0), 0.0), 9) AS VARCHAR) AS DECIMAL(38, 12)), 4) AS DOUBLE) AS long_tail_coverage,
       CAST(tail_items_in_catalog AS BIGINT) AS tail_items_in_catalog FROM cov""", recursive=True))
def v13_long_tail_coverage_e(spark, sf_dir):
    return _coverage(spark, sf_dir).select("long_tail_coverage", "tail_items_in_catalog")


@query("v14_evaluation_report_e", Q.with_prep(
    "E", Q.CATS, *_EASE_ALL, _EV_TRUTH, Q.ranking_report("erecs", "evtruth", K), _ILD, _ENT, _NOV, _COV, body="""
SELECT CASE WHEN metric IN ('intra_list_diversity', 'category_entropy_at_10', 'novelty_at_10') THEN 'diversity_metrics'
            WHEN metric IN ('catalog_coverage', 'user_coverage', 'long_tail_coverage') THEN 'coverage_metrics' ELSE 'ranking_metrics' END AS section,
       metric, value, CAST(NULL AS VARCHAR) AS text FROM (
  SELECT 'precision_at_10' AS metric, ROUND(COALESCE(p, 0.0), 6) AS value FROM agg
  UNION ALL SELECT 'recall_at_10', ROUND(COALESCE(r, 0.0), 6) FROM agg
  UNION ALL SELECT 'ndcg_at_10', ROUND(COALESCE(nd, 0.0), 6) FROM agg
  UNION ALL SELECT 'mrr_at_10', ROUND(COALESCE(mr, 0.0), 6) FROM agg
  UNION ALL SELECT 'hit_rate_at_10', ROUND(COALESCE(h, 0.0), 6) FROM agg
  UNION ALL SELECT 'f1_at_10', ROUND(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) FROM agg
  UNION ALL SELECT 'n_eval_users', CAST(n AS DOUBLE) FROM agg
  UNION ALL SELECT 'intra_list_diversity', CAST(ROUND(CAST(CAST(ROUND(COALESCE((SELECT AVG(ild) FROM ild), 0.0), 9) AS VARCHAR) AS DECIMAL(38, 12)), 4) AS DOUBLE)
  UNION ALL SELECT 'category_entropy_at_10', CAST(ROUND(CAST(CAST(ROUND(COALESCE((SELECT AVG(CASE WHEN n_cats > 1 THEN h / ln(n_cats) ELSE 0.0 END)
                                                            FROM ent WHERE user_id IN (SELECT user_id FROM ild)), 0.0), 9) AS VARCHAR) AS DECIMAL(38, 12)), 4) AS DOUBLE)
  UNION ALL SELECT 'novelty_at_10', CAST(ROUND(CAST(CAST(ROUND(COALESCE((SELECT AVG(novelty) FROM nov WHERE user_id IN (SELECT user_id FROM ild)), 0.0), 9) AS VARCHAR) AS DECIMAL(38, 12)), 4) AS DOUBLE)
  UNION ALL SELECT 'catalog_coverage', CAST(ROUND(CAST(CAST(ROUND(unique_items_recommended / total_catalog_items, 9) AS VARCHAR) AS DECIMAL(38, 12)), 4) AS DOUBLE) FROM cov
  UNION ALL SELECT 'user_coverage', CAST(ROUND(CAST(CAST(ROUND(users_with_recs / n_users, 9) AS VARCHAR) AS DECIMAL(38, 12)), 4) AS DOUBLE) FROM cov
  UNION ALL SELECT 'long_tail_coverage', CAST(ROUND(CAST(CAST(ROUND(COALESCE(tail_rec / NULLIF(tail_items_in_catalog, 0), 0.0), 9) AS VARCHAR) AS DECIMAL(38, 12)), 4) AS DOUBLE) FROM cov)
UNION ALL SELECT 'metadata', m, NULL, t FROM (VALUES ('algorithm', 'ease'), ('k', '10'), ('model_type', 'hybrid')) v(m, t)
UNION ALL SELECT 'metadata', 'training_users', n_users, NULL FROM cov
UNION ALL SELECT 'metadata', 'training_items', total_catalog_items, NULL FROM cov""",
    recursive=True))
def v14_evaluation_report_e(spark, sf_dir):
    """V-14: unified report as a long (section, metric, value, text) table; diversity means over
    lists of >= 2 items with factors (as the reference)."""
    p, recs = ease_recs_all(spark, sf_dir)
    rep = V.evaluation_report(recs, events_truth(p), p.pairs, p.pop, TT.factors(spark, sf_dir),
                              TT.categories(spark, sf_dir), K, {"algorithm": "ease", "model_type": "hybrid"})
    return rep


@query("v15_popularity_baseline_e", """
WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS item_id, ts, event_id FROM events),
r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn, COUNT(*) OVER () AS n FROM ev),
tr AS (SELECT * FROM r WHERE rn <= FLOOR(n * 0.8)),
te AS (SELECT * FROM r WHERE rn > FLOOR(n * 0.8)),
top AS (SELECT item_id FROM tr GROUP BY item_id ORDER BY COUNT(*) DESC, item_id LIMIT 10),
u AS (SELECT user_id, MAX(CASE WHEN item_id IN (SELECT item_id FROM top) THEN 1 ELSE 0 END) AS hit FROM te GROUP BY user_id)
SELECT ROUND(AVG(hit), 6) AS hit_rate_at_10, CAST(SUM(hit) AS BIGINT) AS hits, CAST(COUNT(*) AS BIGINT) AS n_test_users FROM u""")
def v15_popularity_baseline_e(spark, sf_dir):
    """V-15: global time split, 10 most frequent train items, share of test users hitting one."""
    ev = TT.events_e(spark, sf_dir)
    return V.popularity_baseline(ev, K)


@query("s2_distinct_recommended_items_e", Q.with_prep("E", *_EASE_ALL, body="""
SELECT DISTINCT item_id FROM erecs""", recursive=True))
def s2_distinct_recommended_items_e(spark, sf_dir):
    """S-2: distinct union of all users' lists."""
    from rankfold.operators.split import distinct_items
    _, recs = ease_recs_all(spark, sf_dir)
    return distinct_items(recs)


@query("g9_ground_truth_lists_l", Q.with_prep("L", body="""
SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS BIGINT) AS pos,
       COUNT(*) OVER (PARTITION BY user_id) AS n_truth FROM test"""))
def g9_ground_truth_lists_l(spark, sf_dir):
    """G-9: each user's held-out set kept long (position in the user's sorted
    list + its size) — no per-user array, so a huge history is never one row."""
    from rankfold.operators.ranking import rank_within
    p = flows.prepared(spark, sf_dir, "L")
    r = rank_within(p.test.select("user_id", "item_id"), ["user_id"], [F.asc("item_id")], "pos", count_col="n_truth")
    return r.select("user_id", "item_id", F.col("pos").cast("bigint").alias("pos"),
                    F.col("n_truth").cast("bigint").alias("n_truth"))


@query("c12_train_flow_e", Q.with_prep(
    "E", Q.CATS, Q.ease(), "tu AS (SELECT DISTINCT user_id FROM test)", Q.ease_recs("tu", K),
    Q.ranking_report("erecs", "test", K, empty="zero"), "rep AS (" + Q.RANKING_SELECT + ")", body=f"""
SELECT rep.*, {Q.r4("(SELECT COUNT(DISTINCT item_id) FROM erecs) / (SELECT COUNT(DISTINCT item_id) FROM pairs)")} AS catalog_coverage
FROM rep""", recursive=True))
def c12_train_flow_e(spark, sf_dir):
    """C-12: split -> content -> EASE -> SVD -> evaluate -> bundle + run log
    (the run's SVD figure is c10_explained_variance_e's)."""
    from rankfold.functions.exprs import round4
    from rankfold.plans.training import train_table
    m = train_table(spark, sf_dir, "E").drop("explained_variance_ratio")
    return m.select(*[round4(c).alias(c) if c == "catalog_coverage" else F.round(c, 6).alias(c) if t == "double" else F.col(c)
                      for c, t in m.dtypes])


@query("w10_random_user_sample_l", Q.with_prep("L", body="""
SELECT user_id FROM (SELECT DISTINCT user_id FROM pairs) ORDER BY md5('42:' || user_id), user_id LIMIT 100"""))
def w10_random_user_sample_l(spark, sf_dir):
    """W-10: 100 users in seeded-hash order (repeatable sample)."""
    from rankfold.operators.split import sample_users
    return sample_users(flows.prepared(spark, sf_dir, "L").pairs, 100, seed=42)
