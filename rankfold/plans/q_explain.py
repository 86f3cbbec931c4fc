"""Registered explanation queries (X-1..X-7) for the top-3 collaborative items
of every customer on table E (cold customers produce error rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold.operators import explain as X
from rankfold.operators import recommend as R
from rankfold.plans import flows
from rankfold.plans import sqlfrag as Q
from rankfold.plans.registry import query

E = "E"

_XP = [Q.CATS, Q.ease(), Q.REQS, Q.ease_recs("warm", 3), Q.popular_top(3), Q.cold_popular("crec"),
       """xp AS (SELECT user_id, item_id FROM erecs UNION SELECT user_id, item_id FROM crec)""",
       """vv AS (SELECT CAST(vec_id AS VARCHAR) AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f
       FROM embeddings)"""]


def _pairs_and_bundle(spark, sf_dir, ease=True, factors=False):
    p, b = flows.bundle(spark, sf_dir, E, ease=ease, factors=factors)
    pairs = R.recommend(flows.customers(spark, sf_dir), b, 3, "collaborative").select(
        "user_id", F.col("product_id").alias("item_id"))
    return p, b, pairs


def _ids(df, evidence: str, field: str):
    """The evidence structs' ids in order, comma-joined."""
    return F.array_join(F.transform(F.col(evidence), lambda e: e[field].cast("string")), ",")


_X1 = """xev AS (
  SELECT x.user_id, x.item_id, b.src, b.weight,
         row_number() OVER (PARTITION BY x.user_id, x.item_id ORDER BY ABS(b.weight) DESC, b.src) AS pos
  FROM xp x JOIN train t ON t.user_id = x.user_id JOIN bw b ON b.src = t.item_id AND b.dst = x.item_id),
xsum AS (SELECT user_id, item_id, SUM(weight) AS tot, COUNT(*) AS n, string_agg(src, ',' ORDER BY pos) AS items FROM xev WHERE pos <= 5 GROUP BY user_id, item_id),
chk AS (SELECT user_id, COUNT(*) AS c FROM train WHERE item_id IN (SELECT src FROM bw) GROUP BY user_id),
x1 AS (
  SELECT x.user_id, x.item_id,
         CASE WHEN x.user_id NOT IN (SELECT user_id FROM train) THEN 'User not found in training data (cold-start user)'
              WHEN x.item_id NOT IN (SELECT item_id FROM pairs) THEN 'Product not found in training data'
              WHEN x.item_id NOT IN (SELECT dst FROM bw) THEN 'Product is outside the EASE active item set'
              WHEN COALESCE(chk.c, 0) = 0 THEN 'None of the user''s history items overlap with the EASE active item set. Recommendation may use popularity fallback.'
         END AS error, chk.c, xsum.tot, xsum.n, xsum.items
  FROM xp x LEFT JOIN chk ON chk.user_id = x.user_id
  LEFT JOIN xsum ON xsum.user_id = x.user_id AND xsum.item_id = x.item_id)"""


@query("x1_ease_explanation_e", Q.with_prep(E, *_XP, _X1, body=f"""
SELECT user_id, item_id, 'ease_cooccurrence' AS method, error,
       CASE WHEN error IS NULL THEN CAST(c AS BIGINT) END AS history_items_checked,
       CASE WHEN error IS NULL THEN ROUND(COALESCE(tot, 0.0), 6) END AS ease_score_contribution,
       CASE WHEN error IS NULL THEN {Q.r4("CASE WHEN COALESCE(tot, 0.0) > 0 THEN LEAST(1.0, GREATEST(0.0, tot)) ELSE 0.0 END")} END AS confidence,
       CASE WHEN error IS NULL THEN CAST(n AS BIGINT) END AS n_supporting, CASE WHEN error IS NULL THEN items END AS history_items
FROM x1""", recursive=True))
def x1_ease_explanation_e(spark, sf_dir):
    """X-1 + X-7: EASE contribution of the history to each recommended item."""
    p, b, pairs = _pairs_and_bundle(spark, sf_dir)
    x = X.explain_ease(pairs, p.train, b.B, b.items, categories=b.categories)
    return x.withColumn("history_items", _ids(x, "top_contributing_history_items", "item_id")).drop("top_contributing_history_items")


@query("x1_ease_contributions_e", Q.with_prep(E, *_XP, _X1, body="""
SELECT x.user_id, x.item_id, CAST(x.pos AS INTEGER) AS pos, x.src AS history_item, ROUND(x.weight, 6) AS ease_weight,
       c.category
FROM xev x LEFT JOIN cat c ON c.item_id = x.src WHERE x.pos <= 5""", recursive=True))
def x1_ease_contributions_e(spark, sf_dir):
    """X-1 evidence rows: top-5 history items by |B(h, target)| with category."""
    p, b, pairs = _pairs_and_bundle(spark, sf_dir)
    ev = X.ease_contributions(pairs, p.train, b.B)
    return ev.join(b.categories.withColumnRenamed("item_id", "src"), "src", "left").select(
        "user_id", "item_id", F.col("pos").cast("int").alias("pos"), F.col("src").alias("history_item"),
        F.round("weight", 6).alias("ease_weight"), "category")


@query("x2_neighbor_evidence_e", Q.with_prep(E, *_XP, """mu AS (SELECT id, f FROM vv WHERE id IN (SELECT user_id FROM train)),
xu AS (SELECT DISTINCT user_id FROM xp WHERE user_id IN (SELECT id FROM mu)),
nbs AS (SELECT user_id, nb FROM (
  SELECT a.id AS user_id, b.id AS nb,
         row_number() OVER (PARTITION BY a.id ORDER BY list_inner_product(a.f, b.f) DESC, b.id) AS r
  FROM mu a JOIN xu ON xu.user_id = a.id CROSS JOIN mu b WHERE a.id <> b.id) WHERE r <= 5),
has AS (SELECT x.user_id, x.item_id, n.nb,
               EXISTS (SELECT 1 FROM train t WHERE t.user_id = n.nb AND t.item_id = x.item_id) AS h
        FROM xp x JOIN nbs n ON n.user_id = x.user_id),
ncnt AS (SELECT user_id, item_id, COUNT(*) FILTER (WHERE h) AS c FROM has GROUP BY user_id, item_id),
f5 AS (SELECT user_id AS nb, item_id AS nb_item FROM (
         SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS r FROM train) WHERE r <= 5),
sup AS (SELECT DISTINCT h.user_id, h.item_id, f.nb_item FROM has h JOIN f5 f ON f.nb = h.nb
        WHERE h.h AND f.nb_item <> h.item_id),
supl AS (SELECT user_id, item_id, string_agg(nb_item, ',' ORDER BY nb_item) AS s FROM (
           SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY nb_item) AS r FROM sup) WHERE r <= 5
         GROUP BY user_id, item_id),
x2 AS (SELECT x.user_id, x.item_id,
              CASE WHEN x.user_id NOT IN (SELECT user_id FROM train) THEN 'User not found in training data (cold-start user)'
                   WHEN x.item_id NOT IN (SELECT item_id FROM train) THEN 'Product not found in training data' END AS error,
              COALESCE(ncnt.c, 0) AS c, COALESCE(supl.s, '') AS s
       FROM xp x LEFT JOIN ncnt ON ncnt.user_id = x.user_id AND ncnt.item_id = x.item_id
       LEFT JOIN supl ON supl.user_id = x.user_id AND supl.item_id = x.item_id)""", body="""
SELECT user_id, item_id, 'collaborative_neighbors' AS method, error,
       CASE WHEN error IS NULL THEN CAST(c AS BIGINT) END AS similar_user_count,
       CASE WHEN error IS NULL THEN ROUND(c / 5.0, 3) END AS confidence,
       CASE WHEN error IS NULL THEN s END AS supporting_items
FROM x2""", recursive=True))
def x2_neighbor_evidence_e(spark, sf_dir):
    """X-2: 5 nearest users by factor dot product (embeddings as user factors)."""
    p, b, pairs = _pairs_and_bundle(spark, sf_dir, factors=True)
    return X.explain_neighbors(pairs, b.user_factors, p.train)


_X3 = """xcev AS (
  SELECT x.user_id, x.item_id, t.item_id AS seen, COALESCE(s.sim, 0.0) AS sim,
         row_number() OVER (PARTITION BY x.user_id, x.item_id ORDER BY ROUND(COALESCE(s.sim, 0.0), 9) DESC, t.item_id) AS pos
  FROM xp x JOIN train t ON t.user_id = x.user_id
  LEFT JOIN isim s ON s.item_a = t.item_id AND s.item_b = x.item_id),
xcagg AS (SELECT user_id, item_id, AVG(sim) AS av, COUNT(*) FILTER (WHERE pos <= 3) AS ns,
       string_agg(seen, ',' ORDER BY pos) FILTER (WHERE pos <= 3) AS seen FROM xcev GROUP BY user_id, item_id),
ucat AS (SELECT DISTINCT t.user_id, c.category FROM train t JOIN cat c ON c.item_id = t.item_id),
x3 AS (SELECT x.user_id, x.item_id,
              CASE WHEN x.user_id NOT IN (SELECT user_id FROM train) THEN 'User not found in training data'
                   WHEN x.item_id NOT IN (SELECT item_id FROM items) THEN 'Product not found in training data' END AS error,
              pc.category AS product_category,
              pc.category IS NOT NULL AND EXISTS (SELECT 1 FROM ucat u WHERE u.user_id = x.user_id AND u.category = pc.category) AS m,
              xcagg.av, xcagg.ns, xcagg.seen
       FROM xp x LEFT JOIN cat pc ON pc.item_id = x.item_id
       LEFT JOIN xcagg ON xcagg.user_id = x.user_id AND xcagg.item_id = x.item_id)"""


@query("x3_content_explanation_e", Q.with_prep(E, *_XP, Q.content(), _X3, body=f"""
SELECT user_id, item_id, 'content_similarity' AS method, error,
       CASE WHEN error IS NULL THEN product_category END AS product_category,
       CASE WHEN error IS NULL THEN m END AS category_match,
       CASE WHEN error IS NULL THEN {Q.r4("COALESCE(av, 0.0)")} END AS average_similarity_to_history,
       CASE WHEN error IS NULL THEN CAST(ns AS BIGINT) END AS n_similar, CASE WHEN error IS NULL THEN seen END AS similar_items,
       CASE WHEN error IS NULL THEN '""" + X.TXT_CONTENT.format(3).replace("'", "''") + f"""' || CASE WHEN m THEN '{X.TXT_SAME_CATEGORY}'
            ELSE '{X.TXT_PROPERTIES}' END END AS explanation_text
FROM x3""", recursive=True))
def x3_content_explanation_e(spark, sf_dir):
    p, b, pairs = _pairs_and_bundle(spark, sf_dir)
    x = X.explain_content(pairs, p.train, b.item_class, b.class_vec, b.categories)
    return x.withColumn("similar_items", _ids(x, "most_similar_seen_items", "item_id")).drop("most_similar_seen_items")


@query("x3_content_evidence_e", Q.with_prep(E, *_XP, Q.content(), _X3, body=f"""
SELECT user_id, item_id, CAST(pos AS INTEGER) AS pos, seen AS history_item, {Q.r4("sim")} AS similarity
FROM xcev WHERE pos <= 3""", recursive=True))
def x3_content_evidence_e(spark, sf_dir):
    """X-3 evidence rows: the 3 history items most similar to the target."""
    from rankfold.functions.exprs import round4
    p, b, pairs = _pairs_and_bundle(spark, sf_dir)
    ev = X.content_evidence(pairs, p.train, b.item_class, b.class_vec)
    return ev.where(F.col("pos") <= 3).select("user_id", "item_id", F.col("pos").cast("int").alias("pos"),
                                              F.col("seen").alias("history_item"), round4("sim").alias("similarity"))


_X4 = """xs AS (
  SELECT x.user_id, x.item_id,
         unnest(list_transform(range(1, len(u.f) + 1), lambda i: u.f[i] * v.f[i])) AS shap,
         unnest(range(0, len(u.f))) AS dim
  FROM xp x JOIN vv u ON u.id = x.user_id JOIN vv v ON v.id = x.item_id),
xsr AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ABS(shap) DESC, dim) AS pos FROM xs)"""


@query("x4_shap_explanation_e", Q.with_prep(E, *_XP, _X4, body="""
SELECT x.user_id, x.item_id, 'shap_latent' AS method,
       CASE WHEN x.user_id NOT IN (SELECT id FROM vv) THEN 'User not found in training data (cold-start user)'
            WHEN x.item_id NOT IN (SELECT id FROM vv) THEN 'Product not found in training data' END AS error,
       ROUND(a.tot, 6) AS total_score, CAST(a.n AS BIGINT) AS n_components, CAST(a.td AS INTEGER) AS top_dimension, a.tds AS top_dimensions
FROM xp x LEFT JOIN (SELECT user_id, item_id, SUM(shap) AS tot, COUNT(*) AS n,
                            MAX(CASE WHEN pos = 1 THEN dim END) AS td,
                            string_agg(CAST(dim AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE pos <= 5) AS tds FROM xsr GROUP BY user_id, item_id) a
  ON a.user_id = x.user_id AND a.item_id = x.item_id""", recursive=True))
def x4_shap_explanation_e(spark, sf_dir):
    """X-4: exact SHAP of the dot-product score (embeddings as user and item factors)."""
    p, b, pairs = _pairs_and_bundle(spark, sf_dir, factors=True)
    x = X.explain_shap(pairs, b.user_factors, b.item_factors)
    return x.withColumn("top_dimensions", _ids(x, "top_dimensions", "dimension"))


@query("x4_shap_top_dimensions_e", Q.with_prep(E, *_XP, _X4, """dimi AS (
  SELECT dim, string_agg(id, ',' ORDER BY r) AS items FROM (
    SELECT id, dim, row_number() OVER (PARTITION BY dim ORDER BY x DESC, id) AS r FROM (
      SELECT id, unnest(f) AS x, unnest(range(0, len(f))) AS dim FROM vv)) WHERE r <= 3 GROUP BY dim)""", body="""
SELECT s.user_id, s.item_id, CAST(s.pos AS INTEGER) AS pos, CAST(s.dim AS INTEGER) AS dimension,
       ROUND(s.shap, 6) AS shap_value, CASE WHEN s.shap >= 0 THEN 'positive' ELSE 'negative' END AS direction,
       d.items AS representative_items
FROM xsr s JOIN dimi d ON d.dim = s.dim WHERE s.pos <= 5""", recursive=True))
def x4_shap_top_dimensions_e(spark, sf_dir):
    """X-4 evidence: top-5 |shap| dimensions with the 3 items most aligned per dimension."""
    p, b, pairs = _pairs_and_bundle(spark, sf_dir, factors=True)
    s = X.shap_values(pairs, b.user_factors, b.item_factors).where(F.col("pos") <= 5)
    d = X.dimension_items(b.item_factors)
    return s.join(d, "dim").select(
        "user_id", "item_id", F.col("pos").cast("int").alias("pos"), F.col("dim").cast("int").alias("dimension"),
        F.round("shap", 6).alias("shap_value"),
        F.when(F.col("shap") >= 0, F.lit("positive")).otherwise(F.lit("negative")).alias("direction"),
        "representative_items")


@query("x5_lime_explanation_e")
def x5_lime_explanation_e(spark, sf_dir):
    """X-5 (rows check): closed-form LIME, 50 seeded perturbations, weighted ridge."""
    p, b, pairs = _pairs_and_bundle(spark, sf_dir, factors=True)
    lm = X.explain_lime(pairs, b.user_factors, b.item_factors, 64)
    return lm.select("user_id", "item_id", "method", "error", "n_samples", "local_fidelity",
                     F.array_join(F.col("top_dimensions").cast("array<string>"), ",").alias("top_dimensions"))


@query("x6_explain_all_e")
def x6_explain_all_e(spark, sf_dir):
    """X-6 (rows check): EASE + content + SHAP + LIME explanations side by side."""
    p, b, pairs = _pairs_and_bundle(spark, sf_dir, factors=True)
    a = X.explain(pairs, b, "all")
    return a.select("user_id", "item_id", F.col("ease.confidence").alias("ease_confidence"),
                    F.col("content.average_similarity_to_history").alias("content_similarity"),
                    F.col("shap.total_score").alias("shap_total"), F.col("lime.local_fidelity").alias("lime_fidelity"))


_X6 = "x4t AS (SELECT user_id, item_id, SUM(shap) AS tot, COUNT(*) AS n FROM xsr GROUP BY user_id, item_id)"


@query("x6_explain_combined_e", Q.with_prep(E, *_XP, _X1, Q.content(), _X3, _X4, _X6, body=f"""
SELECT a.user_id, a.item_id, a.error AS ease_error,
       CASE WHEN a.error IS NULL THEN {Q.r4("CASE WHEN COALESCE(a.tot, 0.0) > 0 THEN LEAST(1.0, GREATEST(0.0, a.tot)) ELSE 0.0 END")} END AS ease_confidence,
       CASE WHEN a.error IS NULL THEN CAST(a.n AS BIGINT) END AS ease_supporting,
       CASE WHEN c.error IS NULL THEN {Q.r4("COALESCE(c.av, 0.0)")} END AS content_similarity,
       CASE WHEN a.user_id IN (SELECT id FROM vv) AND a.item_id IN (SELECT id FROM vv) THEN ROUND(s.tot, 6) END AS shap_total,
       CASE WHEN a.user_id IN (SELECT id FROM vv) AND a.item_id IN (SELECT id FROM vv) THEN CAST(s.n AS BIGINT) END AS shap_components,
       a.user_id IN (SELECT id FROM vv) AND a.item_id IN (SELECT id FROM vv) AS lime_given
FROM x1 a JOIN x3 c ON c.user_id = a.user_id AND c.item_id = a.item_id
LEFT JOIN x4t s ON s.user_id = a.user_id AND s.item_id = a.item_id""", recursive=True))
def x6_explain_combined_e(spark, sf_dir):
    """X-6: one row per pair with what every explainer says; of the sampled one (LIME) only whether it is given."""
    p, b, pairs = _pairs_and_bundle(spark, sf_dir, factors=True)
    a = X.explain(pairs, b, "all")
    return a.select("user_id", "item_id", F.col("ease.error").alias("ease_error"), F.col("ease.confidence").alias("ease_confidence"),
                    F.col("ease.n_supporting").alias("ease_supporting"),
                    F.col("content.average_similarity_to_history").alias("content_similarity"),
                    F.col("shap.total_score").alias("shap_total"), F.col("shap.n_components").alias("shap_components"),
                    F.col("lime.error").isNull().alias("lime_given"))
