"""Registered queries for sources, scalar functions, joins, aggregates,
windows and set operators (A-3, B-*, G-*, J-*, W-*, S-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold.functions import exprs as X
from rankfold.operators import prepare as P
from rankfold.operators import recommend as R
from rankfold.operators import split as S
from rankfold.plans import flows
from rankfold.plans import sqlfrag as Q
from rankfold.plans.registry import query
from rankfold.sources import testtables as TT

E, L = "E", "L"


def _micros(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


# ---------------------------------------------------------------- A-3 / B-*

@query("a3_pruned_scan", """
SELECT l_partkey AS item, COUNT(*) AS n, ROUND(SUM(l_quantity), 6) AS qty
FROM lineitem GROUP BY l_partkey""")
def a3_pruned_scan(spark, sf_dir):
    li = TT.table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity")
    return li.groupBy(F.col("l_partkey").alias("item")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 6).alias("qty"))


@query("b1_drop_null_items", """
WITH x AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_type AS event, COUNT(*) AS n FROM x WHERE k IS NOT NULL GROUP BY event_type""")
def b1_drop_null_items(spark, sf_dir):
    ev = TT.table(spark, sf_dir, "events").select(
        "event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    return ev.dropna(subset=["k"]).groupBy(F.col("event_type").alias("event")).agg(
        F.count(F.lit(1)).alias("n"))


@query("b2_epoch_ms_timestamp", """
SELECT event_id, epoch_us(ts) // 1000 AS ts_ms,
       epoch_us(make_timestamp((epoch_us(ts) // 1000) * 1000)) AS ts_back_us,
       CAST(CAST(ts AS DATE) AS VARCHAR) AS day
FROM events""")
def b2_epoch_ms_timestamp(spark, sf_dir):
    ev = TT.table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return ev.select("event_id", ms.alias("ts_ms"),
                     F.unix_micros(F.timestamp_millis(ms)).alias("ts_back_us"),
                     F.col("ts").cast("date").cast("string").alias("day"))


@query("b3_id_normalisation", """
SELECT CAST(CAST(CAST(p_partkey AS DOUBLE) AS BIGINT) AS VARCHAR) AS item_id, p_type
FROM part""")
def b3_id_normalisation(spark, sf_dir):
    p = TT.table(spark, sf_dir, "part")
    return p.select(X.id_string(F.col("p_partkey").cast("double")).alias("item_id"), "p_type")


@query("b4_numeric_coercion", """
SELECT event_type,
       COUNT(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_ok,
       COUNT(TRY_CAST(props AS BIGINT)) AS props_ok,
       COUNT(*) AS n
FROM events GROUP BY event_type""")
def b4_numeric_coercion(spark, sf_dir):
    ev = TT.table(spark, sf_dir, "events")
    return ev.groupBy("event_type").agg(
        F.count(X.coerce_long(F.get_json_object("props", "$.k"))).alias("k_ok"),
        F.count(X.coerce_long("props")).alias("props_ok"),
        F.count(F.lit(1)).alias("n"))


@query("b5_event_weights", """
WITH """ + Q.E_EVENTS + """
SELECT event, COUNT(*) AS n, CAST(SUM(weight) AS DOUBLE) AS total_weight FROM ev GROUP BY event""")
def b5_event_weights(spark, sf_dir):
    ev = P.weigh(TT.events_e(spark, sf_dir), TT.E_WEIGHTS, 1.0)
    return ev.groupBy("event").agg(F.count(F.lit(1)).alias("n"),
                                   F.sum("weight").cast("double").alias("total_weight"))


@query("b7_membership_filter_l", Q.with_prep(L, body="""
SELECT COUNT(*) AS n_pairs, COUNT(DISTINCT user_id) AS n_users, COUNT(DISTINCT item_id) AS n_items FROM pairs"""))
def b7_membership_filter_l(spark, sf_dir):
    p = flows.prepared(spark, sf_dir, L)
    return p.pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("user_id").alias("n_users"),
                       F.countDistinct("item_id").alias("n_items"))


_B8 = lambda hi, md: Q.with_prep(L, body=f"""
SELECT item_id, popularity,
       CASE WHEN popularity > {hi} THEN 'popular_high' WHEN popularity > {md} THEN 'popular_medium'
            ELSE 'popular_low' END AS bucket
FROM pop""")


@query("b8_popularity_bucket_l", _B8(100, 20))
def b8_popularity_bucket_l(spark, sf_dir):
    return P.with_bucket(flows.prepared(spark, sf_dir, L).pop, 100, 20)


@query("b8_popularity_bucket_l_30_25", _B8(30, 25))
def b8_popularity_bucket_l_30_25(spark, sf_dir):
    return P.with_bucket(flows.prepared(spark, sf_dir, L).pop, 30, 25)


@query("b10_category_filter_popular_l", Q.with_prep(
    L, "mx AS (SELECT MAX(popularity) AS m FROM pop)",
    "cat AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_type AS category FROM part)",
    """f AS (SELECT p.item_id, p.popularity,
              LEAST(1.0, ln(1 + p.popularity) / ln(1 + (SELECT m FROM mx))) AS score
       FROM pop p JOIN cat c ON p.item_id = c.item_id WHERE c.category = 'STANDARD')""",
    body="""SELECT CAST(rk AS INTEGER) AS rank, item_id, ROUND(score, 6) AS score FROM (
  SELECT item_id, score, row_number() OVER (ORDER BY popularity DESC, item_id) AS rk FROM f)
WHERE rk <= 10"""))
def b10_category_filter_popular_l(spark, sf_dir):
    """B-10 + R-7: popular list restricted to one category; score uses the global max."""
    p = flows.prepared(spark, sf_dir, L)
    one = spark.range(1).select(F.lit("cold").alias("user_id"))
    recs = R.recommend_popular(one, p.pop, 10, categories=TT.categories(spark, sf_dir),
                               category="STANDARD")
    return recs.select(F.col("rank").cast("int").alias("rank"), "item_id", F.round("score", 6).alias("score"))


@query("b12_scalar_functions", """
SELECT event_id,
       ROUND(LEAST(1.0, GREATEST(0.0, value / 100.0)), 6) AS clipped,
       ROUND(value, 4) AS r4, ROUND(ABS(value - 50), 6) AS a,
       ROUND(ln(1 + value), 6) AS l1p, ROUND(log2(value + 1), 6) AS l2,
       ROUND(ln(value + 1), 6) AS ln1, ROUND(exp(-value / 100.0), 6) AS e
FROM events""")
def b12_scalar_functions(spark, sf_dir):
    v = F.col("value")
    return TT.table(spark, sf_dir, "events").select(
        "event_id", F.round(X.clip01(v / 100.0), 6).alias("clipped"), F.round(v, 4).alias("r4"),
        F.round(F.abs(v - 50), 6).alias("a"), F.round(F.log1p(v), 6).alias("l1p"),
        F.round(F.log2(v + 1), 6).alias("l2"), F.round(F.log(v + 1), 6).alias("ln1"),
        F.round(F.exp(-v / 100.0), 6).alias("e"))


# ---------------------------------------------------------------- G-*

_INTER_SELECT = """SELECT user_id, item_id, ROUND(weight, 6) AS weight, epoch_us(last_ts) AS last_ts_us,
       CAST(n_events AS BIGINT) AS n_events FROM inter"""


@query("g1_interactions_l", Q.with_prep(L, body=_INTER_SELECT))
def g1_interactions_l(spark, sf_dir):
    i = flows.prepared(spark, sf_dir, L).inter
    return i.select("user_id", "item_id", F.round("weight", 6).alias("weight"),
                    _micros("last_ts").alias("last_ts_us"), F.col("n_events").cast("bigint").alias("n_events"))


@query("g1_interactions_e", Q.with_prep(E, body=_INTER_SELECT))
def g1_interactions_e(spark, sf_dir):
    i = flows.prepared(spark, sf_dir, E).inter
    return i.select("user_id", "item_id", F.round("weight", 6).alias("weight"),
                    _micros("last_ts").alias("last_ts_us"), F.col("n_events").cast("bigint").alias("n_events"))


@query("g2_active_users_l", Q.with_prep(L, body="SELECT user_id, CAST(n_items AS BIGINT) AS n_items FROM act"))
def g2_active_users_l(spark, sf_dir):
    a = flows.prepared(spark, sf_dir, L).active
    return a.select("user_id", F.col("n_items").cast("bigint").alias("n_items"))


@query("g3_most_active_cap_l", Q.with_prep(L, body="""
SELECT user_id, CAST(n_items AS BIGINT) AS n_items FROM (
  SELECT user_id, COUNT(*) AS n_items FROM inter GROUP BY user_id HAVING COUNT(*) >= 5
  ORDER BY n_items DESC, user_id LIMIT 100)"""))
def g3_most_active_cap_l(spark, sf_dir):
    """G-3 with a cap of 100 users (the cap is the feature being tested)."""
    i = flows.prepared(spark, sf_dir, L).inter
    a = P.active_users(i, 5, 100)
    return a.select("user_id", F.col("n_items").cast("bigint").alias("n_items"))


@query("g4_item_popularity_l", Q.with_prep(L, body="SELECT item_id, CAST(popularity AS BIGINT) AS popularity FROM pop"))
def g4_item_popularity_l(spark, sf_dir):
    return flows.prepared(spark, sf_dir, L).pop.select("item_id", F.col("popularity").cast("bigint").alias("popularity"))


@query("g5_event_type_counts_e", Q.with_prep(E, body="SELECT event, CAST(COUNT(*) AS BIGINT) AS n FROM ev GROUP BY event"))
def g5_event_type_counts_e(spark, sf_dir):
    ev = flows.prepared(spark, sf_dir, E).events
    return P.event_type_counts(ev).select("event", F.col("n").cast("bigint").alias("n"))


_G6 = """SELECT CAST(COUNT(DISTINCT user_id) AS BIGINT) AS num_users,
       CAST(COUNT(DISTINCT item_id) AS BIGINT) AS num_items,
       CAST(COUNT(*) AS BIGINT) AS num_interactions,
       ROUND(1 - COUNT(*) / (COUNT(DISTINCT user_id) * COUNT(DISTINCT item_id))::DOUBLE, 6) AS sparsity
FROM pairs"""


def _g6(spark, sf_dir, t):
    s = P.dataset_stats(flows.prepared(spark, sf_dir, t).pairs)
    return s.select(F.col("num_users").cast("bigint").alias("num_users"),
                    F.col("num_items").cast("bigint").alias("num_items"),
                    F.col("num_interactions").cast("bigint").alias("num_interactions"),
                    F.round("sparsity", 6).alias("sparsity"))


@query("g6_dataset_stats_l", Q.with_prep(L, body=_G6))
def g6_dataset_stats_l(spark, sf_dir):
    return _g6(spark, sf_dir, L)


@query("g6_dataset_stats_e", Q.with_prep(E, body=_G6))
def g6_dataset_stats_e(spark, sf_dir):
    return _g6(spark, sf_dir, E)


@query("g7_latest_property_e", """
WITH props AS (
  SELECT json_extract_string(props, '$.k') AS itemid, event_type AS property,
         CAST(value AS VARCHAR) AS value, ts AS timestamp FROM events),
f AS (SELECT itemid, value, row_number() OVER (PARTITION BY itemid ORDER BY timestamp DESC, value DESC) AS rn
      FROM props WHERE property = 'purchase' AND value IS NOT NULL)
SELECT itemid AS item_id, value FROM f WHERE rn = 1""")
def g7_latest_property_e(spark, sf_dir):
    """B-6 + G-7 over a key/value log derived from events (item, property, value, ts)."""
    ev = TT.table(spark, sf_dir, "events")
    props = ev.select(F.get_json_object("props", "$.k").alias("itemid"),
                      F.col("event_type").alias("property"),
                      F.col("value").cast("string").alias("value"), F.col("ts").alias("timestamp"))
    return P.latest_property(props, "purchase", ts="timestamp")


_G10 = """SELECT ROUND(quantile_cont(popularity, 0.2), 6) AS p20, ROUND(quantile_cont(popularity, 0.5), 6) AS p50,
       ROUND(quantile_cont(popularity, 0.8), 6) AS p80, ROUND(quantile_cont(popularity, 0.95), 6) AS p95 FROM pop"""


@query("g10_popularity_percentiles_l", Q.with_prep(L, body=_G10))
def g10_popularity_percentiles_l(spark, sf_dir):
    q = P.popularity_percentiles(flows.prepared(spark, sf_dir, L).pop)
    return q.select(*[F.round(c, 6).alias(c) for c in q.columns])


@query("g10_popularity_percentiles_e", Q.with_prep(E, body=_G10))
def g10_popularity_percentiles_e(spark, sf_dir):
    q = P.popularity_percentiles(flows.prepared(spark, sf_dir, E).pop)
    return q.select(*[F.round(c, 6).alias(c) for c in q.columns])


@query("g11_top_category_counts_l", Q.with_prep(L, body="""
SELECT c.p_brand AS category, CAST(COUNT(*) AS BIGINT) AS n FROM pairs p
JOIN part c ON p.item_id = CAST(c.p_partkey AS VARCHAR) GROUP BY c.p_brand
ORDER BY n DESC, category LIMIT 10"""))
def g11_top_category_counts_l(spark, sf_dir):
    """G-11: top-10 value counts (brand of interacted items)."""
    p = flows.prepared(spark, sf_dir, L)
    cats = TT.categories(spark, sf_dir, "p_brand")
    c = p.pairs.join(cats, "item_id").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.desc("n"), "category").limit(10).select("category", F.col("n").cast("bigint").alias("n"))


@query("g12_test_pairs_from_events_e", Q.with_prep(
    E, """evs AS (
  SELECT user_id, item_id, weight,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
         COUNT(*) OVER (PARTITION BY user_id) AS n
  FROM ev WHERE user_id IN (SELECT user_id FROM act))""",
    body="""SELECT user_id, item_id, ROUND(SUM(weight), 6) AS weight FROM evs
WHERE n >= 2 AND rn > GREATEST(1, FLOOR(n * 0.8)) GROUP BY user_id, item_id"""))
def g12_test_pairs_from_events_e(spark, sf_dir):
    """W-2 + G-12: evaluator protocol — split raw events of known users, aggregate the test part."""
    p = flows.prepared(spark, sf_dir, E)
    ev = p.events.join(p.active.select("user_id"), "user_id", "left_semi")
    sp = S.temporal_holdout(ev, order=("ts", "event_id"), singletons="drop")
    t = sp.where(~F.col("is_train")).groupBy("user_id", "item_id").agg(F.round(F.sum("weight"), 6).alias("weight"))
    return t


# ---------------------------------------------------------------- W-*

_SPLIT_SELECT = "SELECT user_id, item_id, is_train FROM sp"


@query("w1_temporal_holdout_l", Q.with_prep(L, body=_SPLIT_SELECT))
def w1_temporal_holdout_l(spark, sf_dir):
    return flows.prepared(spark, sf_dir, L).split.select("user_id", "item_id", "is_train")


@query("w1_temporal_holdout_e", Q.with_prep(E, body=_SPLIT_SELECT))
def w1_temporal_holdout_e(spark, sf_dir):
    return flows.prepared(spark, sf_dir, E).split.select("user_id", "item_id", "is_train")


@query("w3_global_split_e", """
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn, COUNT(*) OVER () AS n FROM events)
SELECT event_id, rn <= FLOOR(n * 0.8) AS is_train FROM r""")
def w3_global_split_e(spark, sf_dir):
    ev = TT.table(spark, sf_dir, "events").select("event_id", "ts")
    return S.global_split(ev, "ts", "event_id", 0.8).select("event_id", "is_train")


@query("w3_global_split_l", """
WITH r AS (SELECT l_orderkey * 100 + l_linenumber AS event_id,
                  row_number() OVER (ORDER BY l_shipdate, l_orderkey * 100 + l_linenumber) AS rn,
                  COUNT(*) OVER () AS n FROM lineitem)
SELECT event_id, rn <= FLOOR(n * 0.8) AS is_train FROM r""")
def w3_global_split_l(spark, sf_dir):
    """W-3 on lineitem, whose ship dates tie heavily (split by the tie-break)."""
    li = TT.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("event_id"), F.col("l_shipdate").alias("ts"))
    return S.global_split(li, "ts", "event_id", 0.8).select("event_id", "is_train")


@query("w4_top_k_per_user_l", Q.with_prep(L, body="""
SELECT user_id, item_id, CAST(rk AS INTEGER) AS rank FROM (
  SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, item_id) AS rk FROM pairs)
WHERE rk <= 3"""))
def w4_top_k_per_user_l(spark, sf_dir):
    """W-4: each user's 3 heaviest items."""
    p = flows.prepared(spark, sf_dir, L)
    return S.top_k(p.pairs, 3, F.desc("weight")).select("user_id", "item_id", F.col("rank").cast("int"))


@query("w5_global_top_k_items_l", Q.with_prep(L, body="""
SELECT item_id, CAST(popularity AS BIGINT) AS popularity, CAST(row_number() OVER (ORDER BY popularity DESC, item_id) AS INTEGER) AS rank
FROM pop ORDER BY popularity DESC, item_id LIMIT 10"""))
def w5_global_top_k_items_l(spark, sf_dir):
    pop = flows.prepared(spark, sf_dir, L).pop
    return S.global_top_k(pop, 10, F.desc("popularity")).select(
        "item_id", F.col("popularity").cast("bigint").alias("popularity"), F.col("rank").cast("int").alias("rank"))


@query("w9_first_n_users_l", Q.with_prep(L, body="SELECT user_id FROM (SELECT DISTINCT user_id FROM pairs) ORDER BY user_id LIMIT 100"))
def w9_first_n_users_l(spark, sf_dir):
    return S.sample_users(flows.prepared(spark, sf_dir, L).pairs, 100)


# ---------------------------------------------------------------- S-* / J-*

@query("s1_union_train_test_l", Q.with_prep(L, body="""
SELECT part, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(weight), 6) AS w FROM (
  SELECT 'train' AS part, weight FROM train UNION ALL SELECT 'test' AS part, weight FROM test) GROUP BY part"""))
def s1_union_train_test_l(spark, sf_dir):
    p = flows.prepared(spark, sf_dir, L)
    u = S.union_parts(p.train.withColumn("part", F.lit("train")), p.test.withColumn("part", F.lit("test")))
    return u.groupBy("part").agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.round(F.sum("weight"), 6).alias("w"))


@query("s3_intersect_tail_l", Q.with_prep(
    L, "p20 AS (SELECT quantile_cont(popularity, 0.2) AS q FROM pop)",
    body="""SELECT DISTINCT t.item_id FROM test t JOIN pop p ON t.item_id = p.item_id
WHERE p.popularity <= (SELECT q FROM p20)"""))
def s3_intersect_tail_l(spark, sf_dir):
    """S-3: held-out items that are tail items (pop <= p20)."""
    p = flows.prepared(spark, sf_dir, L)
    q = P.popularity_percentiles(p.pop, (20,))
    tail = p.pop.crossJoin(F.broadcast(q)).where(F.col("popularity") <= F.col("p20")).select("item_id")  # one-row side
    return S.intersect_with(p.test.select("item_id").distinct(), tail)


@query("s4_unseen_candidates_e", Q.with_prep(E, body="""
SELECT u.user_id, CAST(COUNT(*) AS BIGINT) AS n_unseen FROM (SELECT DISTINCT user_id FROM train) u
CROSS JOIN (SELECT DISTINCT item_id FROM pairs) i
WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = u.user_id AND t.item_id = i.item_id)
GROUP BY u.user_id"""))
def s4_unseen_candidates_e(spark, sf_dir):
    """S-4 / J-4: per user, catalog items minus the user's train items (counted).

    Count = |catalog| - |train items of user|: a join-free identity, so the
    catalog is never paired with users.
    """
    p = flows.prepared(spark, sf_dir, E)
    n_items = p.pairs.select("item_id").distinct().agg(F.count(F.lit(1)).alias("_n"))
    seen = p.train.groupBy("user_id").agg(F.count(F.lit(1)).alias("_s"))
    return seen.crossJoin(F.broadcast(n_items)).select(  # one-row side
        "user_id", (F.col("_n") - F.col("_s")).cast("bigint").alias("n_unseen"))


@query("j1_last_timestamp_join_l", Q.with_prep(
    L, "w AS (SELECT user_id, item_id, SUM(weight) AS weight FROM ev GROUP BY user_id, item_id)",
    "t AS (SELECT user_id, item_id, MAX(ts) AS last_ts FROM ev GROUP BY user_id, item_id)",
    body="""SELECT w.user_id, w.item_id, ROUND(w.weight, 6) AS weight, epoch_us(t.last_ts) AS last_ts_us
FROM w LEFT JOIN t ON w.user_id = t.user_id AND w.item_id = t.item_id"""))
def j1_last_timestamp_join_l(spark, sf_dir):
    """J-1: the reference re-joins max(ts) onto the pairs; here it is folded into G-1's aggregate."""
    i = flows.prepared(spark, sf_dir, L).inter
    return i.select("user_id", "item_id", F.round("weight", 6).alias("weight"), _micros("last_ts").alias("last_ts_us"))


@query("j3_dictionary_encode_e", Q.with_prep(E, body="""
SELECT item_id, CAST(row_number() OVER (ORDER BY item_id) - 1 AS BIGINT) AS item_idx
FROM (SELECT DISTINCT item_id FROM pairs)"""))
def j3_dictionary_encode_e(spark, sf_dir):
    p = flows.prepared(spark, sf_dir, E)
    return P.dictionary_encode(p.pairs, "item_id", name="item_idx")


@query("j5_cooccurrence_e", Q.with_prep(E, body="""
SELECT a.item_id AS item_a, b.item_id AS item_b, ROUND(SUM(a.weight * b.weight), 6) AS g
FROM train a JOIN train b ON a.user_id = b.user_id AND a.item_id <= b.item_id
GROUP BY a.item_id, b.item_id"""))
def j5_cooccurrence_e(spark, sf_dir):
    from rankfold.operators import ease
    p = flows.prepared(spark, sf_dir, E)
    g = ease.gram(p.train, mirror=False)
    return g.select(F.col("i").alias("item_a"), F.col("j").alias("item_b"), F.round("g", 6).alias("g"))


@query("j7_hits_l", Q.with_prep(L, "tu AS (SELECT DISTINCT user_id FROM test)", Q.popular_masked("tu", 10), body="""
SELECT r.user_id, r.item_id, r.rank, t.item_id IS NOT NULL AS hit
FROM precs r LEFT JOIN test t ON r.user_id = t.user_id AND r.item_id = t.item_id"""))
def j7_hits_l(spark, sf_dir):
    p = flows.prepared(spark, sf_dir, L)
    recs = R.recommend_popular(flows.test_users(p), p.pop, 10, seen=p.train)
    t = p.test.select("user_id", "item_id", F.lit(True).alias("_t"))
    j = recs.join(t, ["user_id", "item_id"], "left")
    return j.select("user_id", "item_id", F.col("rank").cast("bigint").alias("rank"),
                    F.col("_t").isNotNull().alias("hit"))


@query("j5_cooccurrence_l", Q.with_prep(L, body="""
SELECT a.item_id AS item_a, b.item_id AS item_b, ROUND(SUM(a.weight * b.weight), 6) AS g
FROM train a JOIN train b ON a.user_id = b.user_id AND a.item_id <= b.item_id
GROUP BY a.item_id, b.item_id"""))
def j5_cooccurrence_l(spark, sf_dir):
    """J-5 at scale: salted user self-join of L's train pairs (i <= j)."""
    from rankfold.operators import ease
    p = flows.prepared(spark, sf_dir, L)
    g = ease.gram(p.train_alone(), mirror=False)
    return g.select(F.col("i").alias("item_a"), F.col("j").alias("item_b"), F.round("g", 6).alias("g"))
