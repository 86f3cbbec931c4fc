"""Registered data-quality queries (Q-1..Q-10) over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold.operators import prepare as P
from rankfold.operators import quality as DQ
from rankfold.plans import flows
from rankfold.plans import sqlfrag as Q
from rankfold.plans.registry import query
from rankfold.sources import testtables as TT

E, L = "E", "L"
# fixed value: the event enum of table E (its 'error' and 'signup' rows are violations)
E_ENUM = ("view", "click", "purchase")


def _raw_events(spark, sf_dir):
    ev = TT.table(spark, sf_dir, "events")
    return ev.select(F.col("ts").alias("timestamp"), F.col("user_id").alias("visitorid"),
                     F.col("event_type").alias("event"), F.get_json_object("props", "$.k").alias("itemid"),
                     "value", "props")


_RAW = """raw AS (SELECT ts AS timestamp, user_id AS visitorid, event_type AS event,
                json_extract_string(props, '$.k') AS itemid, value, props FROM events)"""


def _report(rows):
    return " UNION ALL ".join(
        f"SELECT '{n}' AS rule, '{c}' AS \"column\", CAST({v} AS BIGINT) AS violations, CAST({r} AS BIGINT) AS rows, "
        f"({v}) = 0 AS passed FROM {src}" for n, c, v, r, src in rows)


@query("q1_not_null_events", "WITH " + _RAW + "\n" + _report([
    ("timestamp_not_null", "timestamp", "COUNT(*) FILTER (WHERE timestamp IS NULL)", "COUNT(*)", "raw"),
    ("visitor_not_null", "visitorid", "COUNT(*) FILTER (WHERE visitorid IS NULL)", "COUNT(*)", "raw"),
    ("event_not_null", "event", "COUNT(*) FILTER (WHERE event IS NULL)", "COUNT(*)", "raw")]))
def q1_not_null_events(spark, sf_dir):
    rules = [DQ.NotNull("timestamp_not_null", "timestamp"), DQ.NotNull("visitor_not_null", "visitorid"),
             DQ.NotNull("event_not_null", "event")]
    return DQ.check(_raw_events(spark, sf_dir), rules)


@query("q2_range_rules", Q.with_prep(L, _RAW, body=_report([
    ("visitor_positive", "visitorid", "COUNT(*) FILTER (WHERE visitorid IS NOT NULL AND NOT (visitorid > 0))", "COUNT(*)", "raw"),
    ("value_range", "value", "COUNT(*) FILTER (WHERE value IS NOT NULL AND NOT (value >= 0 AND value <= 50))", "COUNT(*)", "raw"),
    ("weight_range", "weight", "COUNT(*) FILTER (WHERE weight IS NOT NULL AND NOT (weight > 0 AND weight <= 10))", "COUNT(*)", "inter")])))
def q2_range_rules(spark, sf_dir):
    """Q-2: visitor > 0 and a value limit on events; 0 < weight <= 10 on L pairs."""
    a = DQ.check(_raw_events(spark, sf_dir), [DQ.Between("visitor_positive", "visitorid", low=0, low_inclusive=False),
                                              DQ.Between("value_range", "value", low=0, high=50)])
    b = DQ.check(flows.prepared(spark, sf_dir, L).inter,
                 [DQ.Between("weight_range", "weight", low=0, high=10, low_inclusive=False)])
    return a.unionByName(b)


@query("q3_enum_membership_events", "WITH " + _RAW + "\n" + _report([
    ("event_enum", "event", "COUNT(*) FILTER (WHERE event IS NOT NULL AND event NOT IN ('view', 'click', 'purchase'))",
     "COUNT(*)", "raw")]))
def q3_enum_membership_events(spark, sf_dir):
    return DQ.check(_raw_events(spark, sf_dir), [DQ.IsIn("event_enum", "event", E_ENUM)])


@query("q4_castable_events", "WITH " + _RAW + "\n" + _report([
    ("item_castable", "itemid", "COUNT(*) FILTER (WHERE itemid IS NOT NULL AND TRY_CAST(itemid AS BIGINT) IS NULL)", "COUNT(*)", "raw"),
    ("props_castable", "props", "COUNT(*) FILTER (WHERE props IS NOT NULL AND TRY_CAST(props AS BIGINT) IS NULL)", "COUNT(*)", "raw")]))
def q4_castable_events(spark, sf_dir):
    return DQ.check(_raw_events(spark, sf_dir), [DQ.Castable("item_castable", "itemid", "bigint"),
                                                 DQ.Castable("props_castable", "props", "bigint")])


@query("q5_non_empty_names", _report([
    ("name_non_empty", "p_name", "COUNT(*) FILTER (WHERE p_name IS NULL OR length(p_name) = 0)", "COUNT(*)", "part"),
    ("brand_non_empty", "p_brand", "COUNT(*) FILTER (WHERE p_brand IS NULL OR length(p_brand) = 0)", "COUNT(*)", "part")]))
def q5_non_empty_names(spark, sf_dir):
    return DQ.check(TT.table(spark, sf_dir, "part"), [DQ.NonEmpty("name_non_empty", "p_name"),
                                                      DQ.NonEmpty("brand_non_empty", "p_brand")])


@query("q6_unique_pairs", Q.with_prep(E, """dup AS (SELECT user_id, item_id, COUNT(*) AS c FROM ev GROUP BY 1, 2),
dup2 AS (SELECT user_id, item_id, COUNT(*) AS c FROM inter GROUP BY 1, 2)""", body=_report([
    ("raw_pair_unique", "user_id", "COALESCE(SUM(CASE WHEN c > 1 THEN c END), 0)", "SUM(c)", "dup"),
    ("pair_unique", "user_id", "COALESCE(SUM(CASE WHEN c > 1 THEN c END), 0)", "SUM(c)", "dup2")])))
def q6_unique_pairs(spark, sf_dir):
    """Q-6: raw events repeat (user, item) pairs; aggregated interactions must not."""
    p = flows.prepared(spark, sf_dir, E)
    a = DQ.check(p.events, [DQ.Unique("raw_pair_unique", "user_id", keys=("user_id", "item_id"))])
    b = DQ.check(p.inter, [DQ.Unique("pair_unique", "user_id", keys=("user_id", "item_id"))])
    return a.unionByName(b)


@query("q7_finite_values", "WITH " + _RAW + "\n" + _report([
    ("value_finite", "value", "COUNT(*) FILTER (WHERE value IS NOT NULL AND (isnan(value) OR isinf(value)))", "COUNT(*)", "raw")]))
def q7_finite_values(spark, sf_dir):
    return DQ.check(_raw_events(spark, sf_dir), [DQ.Finite("value_finite", "value")])


@query("q8_index_bijection_e", Q.with_prep(E, """enc AS (
  SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_idx FROM (SELECT DISTINCT item_id FROM pairs))""",
    body=_report([("item_index_bijection", "item_id",
                   "(COUNT(*) - COUNT(DISTINCT item_id)) + (COUNT(*) - COUNT(DISTINCT item_idx))", "COUNT(*)", "enc")])))
def q8_index_bijection_e(spark, sf_dir):
    enc = P.dictionary_encode(flows.prepared(spark, sf_dir, E).pairs, "item_id", name="item_idx")
    return DQ.check(enc, [DQ.Bijection("item_index_bijection", "item_id", other="item_idx")])


@query("q9_row_count_reconciliation_l", Q.with_prep(L, body=_report([
    ("pairs_equal_nnz", "pairs", "ABS((SELECT COUNT(*) FROM pairs) - (SELECT COUNT(*) FROM (SELECT DISTINCT user_id, item_id FROM train UNION ALL SELECT DISTINCT user_id, item_id FROM test)))",
     "(SELECT COUNT(*) FROM pairs)", "(SELECT 1)")])))
def q9_row_count_reconciliation_l(spark, sf_dir):
    """Q-9: split parts together hold exactly the pairs (matrix nnz = #pairs)."""
    p = flows.prepared(spark, sf_dir, L)
    parts = p.train.select("user_id", "item_id").unionByName(p.test.select("user_id", "item_id"))
    return DQ.check(p.pairs, [DQ.SameCount("pairs_equal_nnz", "pairs", other_df=parts)])


_SUITE = [("timestamp_not_null", "timestamp", "timestamp IS NULL"),
          ("visitor_not_null", "visitorid", "visitorid IS NULL"),
          ("event_not_null", "event", "event IS NULL"),
          ("visitor_positive", "visitorid", "visitorid IS NOT NULL AND NOT (visitorid > 0)"),
          ("event_enum", "event", "event IS NOT NULL AND event NOT IN ('view', 'click', 'purchase')"),
          ("item_castable", "itemid", "itemid IS NOT NULL AND TRY_CAST(itemid AS DOUBLE) IS NULL")]


@query("q10_suite_and_quarantine_events", "WITH " + _RAW + ",\nbadrows AS (SELECT *, " + " OR ".join(
    f"({c})" for _, _, c in _SUITE) + " AS bad FROM raw)\n" + _report(
    [(n, col, f"COUNT(*) FILTER (WHERE {c})", "COUNT(*)", "raw") for n, col, c in _SUITE]
    + [("quarantined_rows", "*", "COUNT(*) FILTER (WHERE bad)", "COUNT(*)", "badrows")]))
def q10_suite_and_quarantine_events(spark, sf_dir):
    """Q-10: all event contracts in one scan, plus the quarantine split size."""
    raw = _raw_events(spark, sf_dir)
    rules = DQ.event_rules(E_ENUM)
    rep = DQ.check(raw, rules)
    good, bad = DQ.quarantine(raw, rules)
    q = bad.agg(F.count(F.lit(1)).cast("bigint").alias("violations")).crossJoin(  # one-row sides
        raw.agg(F.count(F.lit(1)).cast("bigint").alias("rows")))
    q = q.select(F.lit("quarantined_rows").alias("rule"), F.lit("*").alias("column"), "violations", "rows",
                 (F.col("violations") == 0).alias("passed"))
    return rep.unionByName(q)
