"""Registered model queries: TF-IDF / content (C-1..C-4), EASE (C-5..C-7),
factors (C-8..C-10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold.operators import ease as EA
from rankfold.operators import factors as FX
from rankfold.operators import features as FT
from rankfold.operators.model import content_model
from rankfold.plans import flows
from rankfold.plans import sqlfrag as Q
from rankfold.plans.registry import query
from rankfold.sources import testtables as TT

E, L = "E", "L"

_DOC_TOK = r"""dtok AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS token FROM documents),
dtf AS (SELECT doc, token, COUNT(*) AS tf FROM dtok GROUP BY doc, token),
dvoc AS (SELECT token, SUM(tf) AS total_tf, COUNT(*) AS df FROM dtf GROUP BY token ORDER BY total_tf DESC, token LIMIT 500)"""


@query("c1_vocabulary_documents", "WITH " + _DOC_TOK + """
SELECT token, CAST(total_tf AS BIGINT) AS total_tf, CAST(df AS BIGINT) AS df FROM dvoc""")
def c1_vocabulary_documents(spark, sf_dir):
    """C-1 at scale: the 500 most frequent tokens of all documents (whole texts)."""
    docs = TT.table(spark, sf_dir, "documents").select("doc_id", "text")
    v = FT.vocabulary(FT.term_stats(docs, "doc_id"), 500)
    return v.select("token", F.col("total_tf").cast("bigint").alias("total_tf"), F.col("df").cast("bigint").alias("df"))


@query("c2_tfidf_documents", "WITH " + _DOC_TOK + """,
didf AS (SELECT token, ln((1 + (SELECT COUNT(*) FROM documents)) / (1.0 + df)) + 1 AS idf FROM dvoc),
dx AS (SELECT doc, token, tf * idf AS x FROM dtf JOIN didf USING (token))
SELECT doc AS doc_id, token, ROUND(x / sqrt(SUM(x * x) OVER (PARTITION BY doc)), 6) AS value FROM dx""")
def c2_tfidf_documents(spark, sf_dir):
    """C-2: smooth-idf TF-IDF over whole documents, L2-normalised per document."""
    docs = TT.table(spark, sf_dir, "documents").select("doc_id", "text")
    t = FT.tfidf(docs, "doc_id", "text", 500)
    return t.select(F.col("doc").alias("doc_id"), "token", F.round("value", 6).alias("value"))


@query("c3_item_features_e", Q.with_prep(E, Q.CATS, Q.content(), body="SELECT item_id, text FROM itxt"))
def c3_item_features_e(spark, sf_dir):
    p = flows.prepared(spark, sf_dir, E)
    return FT.item_features(p.pairs, TT.categories(spark, sf_dir), p.pop)


@query("c3_item_features_l_30_25", Q.with_prep(L, Q.CATS, Q.content(30, 25), body="SELECT item_id, text FROM itxt"))
def c3_item_features_l_30_25(spark, sf_dir):
    """Bucket limits (30, 25) so that L (all items below 100) gets three buckets."""
    p = flows.prepared(spark, sf_dir, L)
    return FT.item_features(p.pairs, TT.categories(spark, sf_dir), p.pop, 30, 25)


@query("c2_tfidf_items_e", Q.with_prep(E, Q.CATS, Q.content(), body="""
SELECT doc AS item_id, token, ROUND(value, 6) AS value FROM tfidf"""))
def c2_tfidf_items_e(spark, sf_dir):
    p = flows.prepared(spark, sf_dir, E)
    _, tf, _, _ = content_model(p.pairs, TT.categories(spark, sf_dir), p.pop)
    return tf.select(F.col("doc").alias("item_id"), "token", F.round("value", 6).alias("value"))


@query("c4_item_similarity_e", Q.with_prep(E, Q.CATS, Q.content(), body="""
SELECT i.item_id AS item_a, j.item_id AS item_b, ROUND(COALESCE(s.sim, 0.0), 6) AS sim
FROM items i CROSS JOIN items j LEFT JOIN isim s ON s.item_a = i.item_id AND s.item_b = j.item_id"""))
def c4_item_similarity_e(spark, sf_dir):
    """C-4 expanded to item pairs for checking (table E has a fixed 100-item catalog;
    the model itself stays at class level)."""
    p = flows.prepared(spark, sf_dir, E)
    _, _, ic, vec = content_model(p.pairs, TT.categories(spark, sf_dir), p.pop)
    sim = FT.class_similarity(vec)
    a = ic.select(F.col("item_id").alias("item_a"), F.col("cls").alias("cls_a"))
    b = ic.select(F.col("item_id").alias("item_b"), F.col("cls").alias("cls_b"))
    return (a.crossJoin(b).join(sim, ["cls_a", "cls_b"], "left")
             .select("item_a", "item_b", F.round(F.coalesce("sim", F.lit(0.0)), 6).alias("sim")))


@query("c4_class_similarity_l_30_25", Q.with_prep(L, Q.CATS, Q.content(30, 25), """cls AS (
  SELECT doc, string_agg(token, ' ' ORDER BY token) AS cls FROM tfidf GROUP BY doc)""", body="""
SELECT DISTINCT ca.cls AS cls_a, cb.cls AS cls_b, ROUND(s.sim, 6) AS sim
FROM isim s JOIN cls ca ON s.item_a = ca.doc JOIN cls cb ON s.item_b = cb.doc"""))
def c4_class_similarity_l_30_25(spark, sf_dir):
    """C-4 at class level on L (nonzero pairs)."""
    p = flows.prepared(spark, sf_dir, L)
    _, _, _, vec = content_model(p.pairs, TT.categories(spark, sf_dir), p.pop, 30, 25)
    sim = FT.class_similarity(vec)
    return sim.where(F.col("sim") > 0).select("cls_a", "cls_b", F.round("sim", 6).alias("sim"))


@query("c5_ease_active_items_e", Q.with_prep(E, Q.ease(), body="""
SELECT item_id, ROUND(total, 6) AS total FROM ai"""))
def c5_ease_active_items_e(spark, sf_dir):
    p = flows.prepared(spark, sf_dir, E)
    return EA.active_items(p.train).select("item_id", F.round("total", 6).alias("total"))


@query("c5_ease_active_items_l_cap", Q.with_prep(L, Q.ease(cap=300), body="""
SELECT item_id, ROUND(total, 6) AS total FROM ai"""))
def c5_ease_active_items_l_cap(spark, sf_dir):
    """C-5 with the cap as the feature: the 300 heaviest items of L."""
    p = flows.prepared(spark, sf_dir, L)
    return EA.active_items(p.train, 300).select("item_id", F.round("total", 6).alias("total"))


@query("c6_gram_e", Q.with_prep(E, Q.ease(), body="""
SELECT a.item_id AS i, b.item_id AS j, ROUND(g.v + CASE WHEN g.r = g.c THEN 500.0 ELSE 0.0 END, 6) AS g
FROM g JOIN ix a ON g.r = a.idx JOIN ix b ON g.c = b.idx"""))
def c6_gram_e(spark, sf_dir):
    p = flows.prepared(spark, sf_dir, E)
    g = EA.gram(p.train, EA.active_items(p.train), l2=500.0)
    return g.select("i", "j", F.round("g", 6).alias("g"))


@query("c7_ease_weights_e", Q.with_prep(E, Q.ease(), body="""
SELECT src, dst, ROUND(weight, 6) AS weight FROM bw""", recursive=True))
def c7_ease_weights_e(spark, sf_dir):
    """C-7: blocked inverse of G + 500 I on the lower triangle -> B (checked
    against an exact Gauss-Jordan inverse in SQL)."""
    p = flows.prepared(spark, sf_dir, E)
    B = EA.ease_fit(p.train, 500.0).table()
    return B.select("src", "dst", F.round("weight", 6).alias("weight"))


@query("c9_l2_normalize_embeddings", """
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (1 + label)) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm FROM s),
u AS (SELECT vec_id, unnest(list_transform(v, lambda x: x / nrm)) AS x, generate_subscripts(v, 1) AS pos FROM n)
SELECT CAST(vec_id AS VARCHAR) AS id, CAST(pos - 1 AS INTEGER) AS pos, ROUND(x, 6) AS value FROM u""")
def c9_l2_normalize_embeddings(spark, sf_dir):
    """C-9: embeddings scaled by (1 + label), then L2-normalised back."""
    e = TT.table(spark, sf_dir, "embeddings")
    f = e.select(F.col("vec_id").cast("string").alias("id"),
                 F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1)).alias("factor"))
    n = FX.l2_normalize(f)
    return n.select("id", F.posexplode("factor").alias("pos", "value")).select(
        "id", F.col("pos").cast("int").alias("pos"), F.round("value", 6).alias("value"))


@query("c8_svd_factors_l")
def c8_svd_factors_l(spark, sf_dir):
    """C-8 (rows check): user factors U*S (L2-normalised) from distributed SVD of L's train matrix."""
    p = flows.prepared(spark, sf_dir, L)
    uf, vf, evr = FX.svd_fit(p.train, k=50)
    return uf.select("id", F.size("factor").alias("k"), F.lit(evr).alias("explained_variance_ratio"))


@query("c10_explained_variance_e")
def c10_explained_variance_e(spark, sf_dir):
    """C-10 (rows check): explained variance ratio of the k=50 SVD of E's train matrix."""
    p = flows.prepared(spark, sf_dir, E)
    _, vf, evr = FX.svd_fit(p.train, k=50)
    return vf.agg(F.count(F.lit(1)).alias("n_items")).withColumn("explained_variance_ratio", F.lit(evr))
