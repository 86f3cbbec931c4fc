"""Registered source / sink queries (A-1, A-2, A-5..A-8).

Each derives its input files from the driver's tables with Spark, writes them
to the shared folder, reads them back through the operator under test, and
returns a result the SQL oracle computes from the tables directly.
"""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from rankfold.operators import prepare as P
from rankfold.operators.features import class_similarity
from rankfold.plans import flows
from rankfold.plans import sqlfrag as Q
from rankfold.plans.registry import query
from rankfold.session import scratch_path
from rankfold.sources import io as IO
from rankfold.sources import testtables as TT


def _raw_events(spark, sf_dir):
    ev = TT.table(spark, sf_dir, "events")
    return ev.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
                     F.col("user_id").alias("visitorid"), F.col("event_type").alias("event"),
                     F.get_json_object("props", "$.k").cast("double").alias("itemid"),
                     F.when(F.col("event_type") == "purchase", F.col("event_id").cast("double")).alias("transactionid"))


@query("a1_event_source_csv", """
SELECT event_type AS event, COUNT(*) AS n, COUNT(DISTINCT user_id) AS n_users,
       COUNT(DISTINCT json_extract_string(props, '$.k')) AS n_items,
       COUNT(*) FILTER (WHERE event_type = 'purchase') AS n_transactions
FROM events GROUP BY event_type""")
def a1_event_source_csv(spark, sf_dir):
    """A-1 + B-1..B-3: events written as CSV with header, read back with the fixed schema."""
    path = scratch_path(spark, "events-csv")
    _raw_events(spark, sf_dir).write.option("header", True).csv(path)
    raw = IO.read_events(spark, path, fmt="csv")
    ev = P.clean_events(raw, keep=("transactionid",))
    return ev.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"),
                                   F.countDistinct("item_id").alias("n_items"),
                                   F.count("transactionid").alias("n_transactions"))


@query("a2_property_source_multi", """
WITH p AS (SELECT json_extract_string(props, '$.k') AS item_id, event_type AS value, ts,
                  row_number() OVER (PARTITION BY json_extract_string(props, '$.k') ORDER BY ts DESC, event_type DESC) AS rn
           FROM events)
SELECT item_id, value FROM p WHERE rn = 1""")
def a2_property_source_multi(spark, sf_dir):
    """A-2 + G-7: a property log in two part files (and one missing part) read as
    one source; latest 'categoryid' value per item."""
    ev = TT.table(spark, sf_dir, "events")
    props = ev.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
                      F.get_json_object("props", "$.k").cast("bigint").alias("itemid"),
                      F.lit("categoryid").alias("property"), F.col("event_type").alias("value"))
    base = scratch_path(spark, "properties")
    props.where(F.col("value").isin("view", "click")).write.option("header", True).csv(f"{base}/part1")
    props.where(~F.col("value").isin("view", "click")).write.option("header", True).csv(f"{base}/part2")
    p = IO.read_properties(spark, [f"{base}/part1", f"{base}/part2", f"{base}/part3_missing"])
    return P.latest_property(p, "categoryid", ts="timestamp")


@query("a5_a6_bundle_roundtrip", Q.with_prep(
    "E", Q.CATS, Q.content(), Q.ease(), "cls AS (SELECT doc, string_agg(token, ' ' ORDER BY token) AS cls FROM tfidf GROUP BY doc)", body="""
SELECT "table", CAST(n AS BIGINT) AS n_rows, 'ease+tfidf' AS algorithm, '500.0' AS ease_lambda FROM (
  SELECT 'train' AS "table", COUNT(*) AS n FROM train
  UNION ALL SELECT 'pop', COUNT(*) FROM pop
  UNION ALL SELECT 'items', COUNT(*) FROM items
  UNION ALL SELECT 'categories', COUNT(*) FROM cat
  UNION ALL SELECT 'tfidf', COUNT(*) FROM tfidf
  UNION ALL SELECT 'item_class', COUNT(*) FROM items
  UNION ALL SELECT 'class_vec', COUNT(*) FROM (SELECT DISTINCT cls, token FROM tfidf JOIN cls ON cls.doc = tfidf.doc)
  UNION ALL SELECT 'class_sim', COUNT(*) FROM (SELECT DISTINCT ca.cls AS a, cb.cls AS b FROM isim s JOIN cls ca ON s.item_a = ca.doc JOIN cls cb ON s.item_b = cb.doc)
  UNION ALL SELECT 'B', (SELECT n * (n - 1) FROM nn))""", recursive=True))
def a5_a6_bundle_roundtrip(spark, sf_dir):
    """A-5 / A-6: save a trained bundle to the shared folder, load it
    back, report each table's row count and the metadata."""
    p, b = flows.bundle(spark, sf_dir, "E")
    b.class_sim = class_similarity(b.class_vec)
    path = scratch_path(spark, "bundle")
    IO.save_bundle(b, path, {"model_type": "hybrid", "algorithm": "ease+tfidf", "ease_lambda": 500.0,
                             "hybrid_collab_weight": 0.6, "hybrid_content_weight": 0.4})
    lb, meta = IO.load_bundle(spark, path)
    counts = [getattr(lb, n).agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("n_rows"))
              for n in IO.BUNDLE_TABLES if getattr(lb, n) is not None]
    counts.append(lb.B.table().agg(F.lit("B").alias("table"), F.count(F.lit(1)).alias("n_rows")))
    info = IO.model_info(meta).select(F.col("info.algorithm").alias("algorithm"), F.col("info.ease_lambda").alias("ease_lambda"))
    return functools.reduce(lambda a, b: a.unionByName(b), counts).crossJoin(info)  # one-row side


@query("a7_report_json_sink", Q.with_prep("E", "tu AS (SELECT DISTINCT user_id FROM test)", Q.popular_masked("tu", 10),
                                           Q.ranking_report("precs", "test", 10), body=Q.RANKING_SELECT))
def a7_report_json_sink(spark, sf_dir):
    """A-7: the evaluation report written as JSON and read back."""
    from rankfold.plans.q_eval import v7_ranking_report_popular_e
    rep = v7_ranking_report_popular_e(spark, sf_dir)
    path = scratch_path(spark, "report-json")
    IO.write_report(rep, path)
    return spark.read.schema(rep.schema).json(path)


@query("a8_run_log", Q.with_prep("E", "tu AS (SELECT DISTINCT user_id FROM test)", Q.popular_masked("tu", 10),
                                  Q.ranking_report("precs", "test", 10),
                                  "rep AS (" + Q.RANKING_SELECT + ")", body="""
SELECT 'popularity' AS kind, 'metric' AS key_type, replace(key, '@', '_at_') AS key, value FROM (
  SELECT 'precision@10' AS key, precision_at_k AS value FROM rep
  UNION ALL SELECT 'recall@10', recall_at_k FROM rep
  UNION ALL SELECT 'ndcg@10', ndcg_at_k FROM rep
  UNION ALL SELECT 'mrr@10', mrr_at_k FROM rep
  UNION ALL SELECT 'hit_rate@10', hit_rate_at_k FROM rep
  UNION ALL SELECT 'f1@10', f1_at_k FROM rep
  UNION ALL SELECT 'n_eval_users', CAST(n_eval_users AS DOUBLE) FROM rep)"""))
def a8_run_log(spark, sf_dir):
    """A-8: a run's float metrics appended to the run-log table ('@' -> '_at_')."""
    from rankfold.plans.q_eval import v7_ranking_report_popular_e
    rep = v7_ranking_report_popular_e(spark, sf_dir)
    named = rep.select(*[F.col(c).alias(c.replace("_at_k", "@10")) for c in rep.columns])
    rows = IO.run_rows(spark, named, "popularity", params={"k": 10, "table": "events"})
    path = scratch_path(spark, "runs")
    IO.append_run(rows, path)
    back = spark.read.parquet(path).where(F.col("key_type") == "metric")
    return back.select("kind", "key_type", "key", F.col("value").cast("double").alias("value"))
