"""Registered telemetry queries (T-1..T-15) over the request log derived from
``events`` (hourly windows, five minutes for the rules; the reference's PromQL
expressions re-expressed as windowed aggregates)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold.operators import telemetry as T
from rankfold.plans.registry import query
from rankfold.sources import testtables as TT

LOG = """lg AS (
  SELECT ts, event_type AS endpoint,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
         value / 100.0 AS duration_s,
         CASE event_type WHEN 'click' THEN 'content_based' WHEN 'purchase' THEN 'hybrid' ELSE 'collaborative' END
           AS recommendation_type,
         value / 500.0 AS score, 'v' || CAST(weekofyear(ts) AS VARCHAR) AS model_version,
         CAST(user_id AS VARCHAR) AS user_id,
         time_bucket(INTERVAL '1 hour', ts) AS w
  FROM events)"""

LAT = "[" + ", ".join(f"{b}::DOUBLE" for b in T.LATENCY_BUCKETS) + ", 'inf'::DOUBLE]"
SCO = "[" + ", ".join(f"{b}::DOUBLE" for b in T.SCORE_BUCKETS) + ", 'inf'::DOUBLE]"


def _us(c="window_start"):
    return F.unix_micros(F.col(c).cast("timestamp")).alias("window_start_us")


def _log(spark, sf_dir):
    return TT.request_log(spark, sf_dir)


def _with(*ctes, body):
    return "WITH " + ",\n".join([LOG, *ctes]) + "\n" + body


@query("t1_request_counter", _with(body="""
SELECT epoch_us(w) AS window_start_us, endpoint, method, status, COUNT(*) AS n FROM lg GROUP BY ALL"""))
def t1_request_counter(spark, sf_dir):
    """T-1: requests by method / endpoint / status per hour."""
    c = T.counter(_log(spark, sf_dir), ("endpoint", "method", "status"))
    return c.select(_us(), "endpoint", "method", "status", "n")


@query("t1_prediction_counter", _with(body="""
SELECT epoch_us(w) AS window_start_us, recommendation_type,
       CASE WHEN status >= 500 THEN 'error' ELSE 'success' END AS status, COUNT(*) AS n FROM lg GROUP BY ALL"""))
def t1_prediction_counter(spark, sf_dir):
    """T-1: predictions by recommendation type and outcome per hour."""
    lg = _log(spark, sf_dir).withColumn(
        "status", F.when(F.col("status") >= 500, F.lit("error")).otherwise(F.lit("success")))
    c = T.counter(lg, ("recommendation_type", "status"))
    return c.select(_us(), "recommendation_type", "status", "n")


def _hist_sql(value, buckets, labels="endpoint"):
    lab = f"{labels}, " if labels else ""
    return f"""hb AS (SELECT w, {lab}le, COUNT(*) FILTER (WHERE {value} <= le) AS cum
       FROM lg CROSS JOIN (SELECT unnest({buckets}) AS le) GROUP BY ALL)"""


@query("t2_latency_histogram", _with(_hist_sql("duration_s", LAT), body="""
SELECT epoch_us(w) AS window_start_us, endpoint, le, cum FROM hb"""))
def t2_latency_histogram(spark, sf_dir):
    """T-2: cumulative latency buckets (+Inf) per endpoint and hour."""
    h = T.histogram(_log(spark, sf_dir), "duration_s", T.LATENCY_BUCKETS, ("endpoint",))
    return T.histogram_long(h, ("endpoint",)).select(_us(), "endpoint", "le", "cum")


@query("t2_latency_histogram_sum_count", _with(body="""
SELECT epoch_us(w) AS window_start_us, endpoint, COUNT(duration_s) AS count, ROUND(SUM(duration_s), 6) AS sum
FROM lg GROUP BY ALL"""))
def t2_latency_histogram_sum_count(spark, sf_dir):
    h = T.histogram(_log(spark, sf_dir), "duration_s", T.LATENCY_BUCKETS, ("endpoint",))
    return h.select(_us(), "endpoint", "count", F.round("sum", 6).alias("sum"))


_SIZES = "[" + ", ".join(f"{b}::DOUBLE" for b in T.SIZE_BUCKETS) + ", 'inf'::DOUBLE]"
_BATCH = "[" + ", ".join(f"{b}::DOUBLE" for b in T.BATCH_BUCKETS) + ", 'inf'::DOUBLE]"


@query("t2_size_histograms", f"""
WITH ex AS (SELECT time_bucket(INTERVAL '1 hour', e.ts) AS w,
                   CASE WHEN e.event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
                   e.event_type AS endpoint, octet_length(encode(e.props)) AS req, octet_length(encode(p.html)) AS resp
            FROM events e LEFT JOIN pages p ON p.page_id = e.event_id),
m AS (SELECT w, method, endpoint, 'request' AS metric, req AS v FROM ex
      UNION ALL SELECT w, method, endpoint, 'response', resp FROM ex),
b AS (SELECT w, method, endpoint, metric, le, COUNT(*) FILTER (WHERE v <= le) AS cum
      FROM m CROSS JOIN (SELECT unnest({_SIZES}) AS le) GROUP BY ALL),
t AS (SELECT w, method, endpoint, metric, CAST(SUM(v) AS BIGINT) AS sum, COUNT(v) AS count FROM m GROUP BY ALL)
SELECT epoch_us(b.w) AS window_start_us, b.method, b.endpoint, b.metric, b.le, b.cum, t.sum, t.count
FROM b JOIN t ON b.w = t.w AND b.method = t.method AND b.endpoint = t.endpoint AND b.metric = t.metric""")
def t2_size_histograms(spark, sf_dir):
    """T-2: request and response sizes in bytes by method and endpoint: a request's body is
    the event's props, the answer the page of its number (none: not measured)."""
    ev, pages = TT.table(spark, sf_dir, "events"), TT.table(spark, sf_dir, "pages")
    log = ev.select("ts", "event_id", F.col("event_type").alias("endpoint"),
                    F.when(F.col("event_type").isin("purchase", "signup"), F.lit("POST")).otherwise(F.lit("GET")).alias("method"),
                    F.octet_length("props").alias("req"))
    answers = pages.select(F.col("page_id").alias("event_id"), F.octet_length("html").alias("resp"))
    h = T.size_histograms(log.join(answers, "event_id", "left"), {"request": "req", "response": "resp"})
    return h.select(_us(), "method", "endpoint", "metric", F.inline(F.arrays_zip("le", "cum")), "sum", "count")


@query("t2_batch_size_histogram", f"""
WITH c AS (SELECT l_orderkey, date_trunc('day', MIN(o.o_orderdate)) AS w, COUNT(*) AS n
           FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY l_orderkey)
SELECT epoch_us(CAST(w AS TIMESTAMP)) AS window_start_us, le, COUNT(*) FILTER (WHERE n <= le) AS cum, CAST(SUM(n) AS BIGINT) AS sum, COUNT(*) AS count
FROM c CROSS JOIN (SELECT unnest({_BATCH}) AS le) GROUP BY w, le""")
def t2_batch_size_histogram(spark, sf_dir):
    """T-2: sizes of batch calls per day; a call is an order, its requests are the lines."""
    o = TT.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
    lines = TT.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    h = T.histogram(T.batch_sizes(lines.join(o, "o_orderkey"), ["o_orderkey"]), "batch_size", T.BATCH_BUCKETS, (), "1 day")
    return h.select(_us(), F.inline(F.arrays_zip("le", "cum")), "sum", "count")


@query("t3_request_rate_sliding", _with(body="""
SELECT ws AS window_start_us, COUNT(*) AS n, COUNT(*) / 3600.0 AS rate FROM (
  SELECT epoch_us(time_bucket(INTERVAL '15 minutes', ts)) - k * 900000000 AS ws FROM lg CROSS JOIN range(0, 4) t(k))
GROUP BY ws"""))
def t3_request_rate_sliding(spark, sf_dir):
    """T-3: requests per second over 1-hour windows sliding by 15 minutes."""
    r = T.rate(_log(spark, sf_dir), "1 hour", "15 minutes")
    return r.select(_us(), "n", "rate")


@query("t3_counter_rate_with_resets", _with("""hc AS (SELECT endpoint, w, COUNT(*) AS c FROM lg GROUP BY ALL)""",
                                            """smp AS (SELECT endpoint AS series, w AS ts,
        SUM(c) OVER (PARTITION BY endpoint, date_trunc('week', w) ORDER BY w) AS value FROM hc)""",
                                            """d AS (SELECT series, ts, value, LAG(value) OVER (PARTITION BY series ORDER BY ts) AS prev FROM smp)""",
                                            """inc AS (SELECT series, ts, CASE WHEN prev IS NULL THEN 0 WHEN value >= prev THEN value - prev
                            ELSE value END AS i FROM d)""", body="""
SELECT epoch_us(time_bucket(INTERVAL '1 day', ts)) AS window_start_us, series,
       CAST(SUM(i) AS DOUBLE) AS increase, SUM(i) / 86400.0 AS rate FROM inc GROUP BY ALL"""))
def t3_counter_rate_with_resets(spark, sf_dir):
    """T-3 from counter samples: hourly scrapes of per-endpoint counters that
    restart every week (a reset); daily increase and per-second rate."""
    c = T.counter(_log(spark, sf_dir), ("endpoint",))
    from pyspark.sql import Window
    w = Window.partitionBy("endpoint", F.date_trunc("week", "window_start")).orderBy("window_start")
    samples = c.select(F.col("endpoint").alias("series"), F.col("window_start").alias("ts"),
                       F.sum("n").over(w).alias("value"))
    r = T.counter_rate(samples, ("series",), "1 day")
    return r.select(_us(), "series", "increase", "rate")


@query("t4_status_distribution", _with("""sc AS (SELECT w, endpoint, CAST(status // 100 AS VARCHAR) || 'xx' AS status_class,
       COUNT(*) AS n FROM lg WHERE endpoint <> 'signup' GROUP BY ALL)""", body="""
SELECT epoch_us(w) AS window_start_us, endpoint, status_class, n,
       n / SUM(n) OVER (PARTITION BY w, endpoint) AS share FROM sc"""))
def t4_status_distribution(spark, sf_dir):
    """T-4: status-class shares per endpoint, one endpoint label excluded."""
    d = T.status_distribution(_log(spark, sf_dir), exclude_endpoints=("signup",))
    return d.select(_us(), "endpoint", "status_class", "n", "share")


def _quant_sql(q, name, src="hall"):
    return f"""{name} AS (
  SELECT w, CASE WHEN total = 0 THEN NULL WHEN le = 'inf'::DOUBLE THEN maxfin WHEN cum - cb = 0 THEN le
                 ELSE lo + (le - lo) * (({q} * total - cb) / (cum - cb)) END AS v
  FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY le) AS rn FROM (
          SELECT w, le, cum, LAG(le, 1, 0.0) OVER (PARTITION BY w ORDER BY le) AS lo,
                 LAG(cum, 1, 0) OVER (PARTITION BY w ORDER BY le) AS cb,
                 MAX(cum) OVER (PARTITION BY w) AS total,
                 MAX(CASE WHEN le <> 'inf'::DOUBLE THEN le END) OVER (PARTITION BY w) AS maxfin FROM {src})
        WHERE cum >= {q} * total) WHERE rn = 1)"""


_HALL_LAT = _hist_sql("duration_s", LAT, labels="")
_HALL_LAT = _HALL_LAT.replace("hb AS", "hall AS")


@query("t5_latency_quantiles", _with(_HALL_LAT, _quant_sql(0.5, "q50"), _quant_sql(0.95, "q95"), body="""
SELECT epoch_us(q50.w) AS window_start_us, ROUND(q50.v, 6) AS p50, ROUND(q95.v, 6) AS p95
FROM q50 JOIN q95 ON q50.w = q95.w"""))
def t5_latency_quantiles(spark, sf_dir):
    """T-5: p50 / p95 latency per hour from the cumulative buckets."""
    h = T.histogram(_log(spark, sf_dir), "duration_s", T.LATENCY_BUCKETS)
    return h.select(_us(), F.round(T.histogram_quantile(0.5, F.col("le"), F.col("cum")), 6).alias("p50"),
                    F.round(T.histogram_quantile(0.95, F.col("le"), F.col("cum")), 6).alias("p95"))


@query("t6_error_ratio", _with(body="""
SELECT epoch_us(w) AS window_start_us, COUNT(*) FILTER (WHERE status >= 500) AS matching, COUNT(*) AS total,
       COUNT(*) FILTER (WHERE status >= 500) / COUNT(*) AS ratio FROM lg GROUP BY ALL"""))
def t6_error_ratio(spark, sf_dir):
    """T-6: sum of 5xx / sum of all requests per hour."""
    r = T.ratio(_log(spark, sf_dir), F.col("status") >= 500)
    return r.select(_us(), "matching", "total", "ratio")


_GRID = """grid AS (SELECT unnest(generate_series((SELECT MIN(w) FROM lg), (SELECT MAX(w) FROM lg), INTERVAL '1 hour')) AS w)"""


@query("t7_volume_flags", _with(_GRID, """cnt AS (SELECT w, COUNT(*) AS n FROM lg GROUP BY w)""", body="""
SELECT epoch_us(g.w) AS window_start_us, COALESCE(c.n, 0) AS n, COALESCE(c.n, 0) / 3600.0 AS rate,
       COALESCE(c.n, 0) / 3600.0 < 0.003 AS low_volume, COALESCE(c.n, 0) / 3600.0 > 0.006 AS high_volume
FROM grid g LEFT JOIN cnt c ON c.w = g.w"""))
def t7_volume_flags(spark, sf_dir):
    """T-7: hourly request rate on a dense grid (empty hours are 0) with low / high flags."""
    v = T.volume(_log(spark, sf_dir), "1 hour", low=0.003, high=0.006)
    return v.select(_us(), "n", "rate", "low_volume", "high_volume")


_HALL_SCO = _hist_sql("score", SCO, labels="").replace("hb AS", "hall AS")


@query("t8_score_drift", _with(_HALL_SCO, _quant_sql(0.5, "med"), body="""
SELECT epoch_us(a.w) AS window_start_us, ROUND(a.v, 6) AS median, ROUND(b.v, 6) AS median_before,
       ROUND(ABS(a.v - b.v), 6) AS diff, ABS(a.v - b.v) > 0.1 AS drift
FROM med a JOIN med b ON a.w = b.w + INTERVAL '24 hours'"""))
def t8_score_drift(spark, sf_dir):
    """T-8: |median score (this hour) - median score (same hour yesterday)| > 0.1."""
    d = T.drift(_log(spark, sf_dir), "score", T.SCORE_BUCKETS, 0.5, "24 hours", 0.1)
    return d.select(_us(), F.round("median", 6).alias("median"), F.round("median_before", 6).alias("median_before"),
                    F.round("diff", 6).alias("diff"), "drift")


@query("t9_model_staleness", _with(body="""
SELECT model_version, (epoch_us((SELECT MAX(ts) FROM lg)) - epoch_us(MIN(ts))) / 1e6 AS age_seconds,
       (epoch_us((SELECT MAX(ts) FROM lg)) - epoch_us(MIN(ts))) / 1e6 > 604800 AS stale
FROM lg GROUP BY model_version"""))
def t9_model_staleness(spark, sf_dir):
    """T-9: age of each model version's first use at the log's end; stale after 7 days."""
    return T.staleness(_log(spark, sf_dir), "model_version", 604800.0)


@query("t10_endpoint_absence", _with(_GRID, """eps AS (SELECT DISTINCT endpoint FROM lg)""",
                                     """cnt AS (SELECT w, endpoint, COUNT(*) AS n, MAX(ts) AS last FROM lg GROUP BY ALL)""",
                                     """j AS (SELECT g.w, e.endpoint, c.n, c.last FROM grid g CROSS JOIN eps e
          LEFT JOIN cnt c ON c.w = g.w AND c.endpoint = e.endpoint)""", body="""
SELECT epoch_us(w) AS window_start_us, endpoint, COALESCE(n, 0) AS n, COALESCE(n, 0) = 0 AS down,
       (epoch_us(w + INTERVAL '1 hour')
        - epoch_us(last_value(last IGNORE NULLS) OVER (PARTITION BY endpoint ORDER BY w ROWS UNBOUNDED PRECEDING))) / 1e6
         AS seconds_since_seen
FROM j"""))
def t10_endpoint_absence(spark, sf_dir):
    """T-10: per endpoint and hour on a dense grid: down when no request, time since last seen."""
    a = T.absence(_log(spark, sf_dir), "endpoint")
    return a.select(_us(), "endpoint", "n", "down", "seconds_since_seen")


@query("t11_error_rate_hold", _with(_GRID, """r AS (SELECT w, COUNT(*) FILTER (WHERE status >= 500) / COUNT(*) AS ratio
      FROM lg GROUP BY w)""", """c AS (SELECT g.w, COALESCE(r.ratio > 0.25, FALSE) AS cond FROM grid g LEFT JOIN r ON r.w = g.w)""",
                                    """isl AS (SELECT *, row_number() OVER (ORDER BY w) - row_number() OVER (PARTITION BY cond ORDER BY w) AS island
        FROM c)""", body="""
SELECT epoch_us(w) AS window_start_us, cond,
       CASE WHEN cond THEN row_number() OVER (PARTITION BY cond, island ORDER BY w) ELSE 0 END AS held_windows,
       cond AND CASE WHEN cond THEN row_number() OVER (PARTITION BY cond, island ORDER BY w) ELSE 0 END >= 2 AS firing
FROM isl"""))
def t11_error_rate_hold(spark, sf_dir):
    """T-11: error ratio > 0.25 held for 2 consecutive hours -> firing (gaps and islands)."""
    lg = _log(spark, sf_dir)
    r = T.ratio(lg, F.col("status") >= 500)
    grid = T.window_grid(lg, "1 hour")
    c = grid.join(r, "window_start", "left").select(
        "window_start", F.coalesce(F.col("ratio") > 0.25, F.lit(False)).alias("cond"), F.lit("all").alias("series"))
    h = T.hold(c, 2, ("series",))
    return h.select(_us(), "cond", F.col("held_windows").cast("bigint").alias("held_windows"), "firing")


# fixed values: the alert rules (name, metric, op, threshold, hold seconds, severity)
RULES = [
    ("HighErrorRate", "error_rate", ">", 0.1, 120, "critical"),
    ("HighLatency", "p95_latency", ">", 1.0, 300, "warning"),
    ("APIDown", "requests", "==", 0.0, 60, "critical"),
    ("HighRequestRate", "lowest_minute_rate", ">", 1000.0, 300, "warning"),
    ("LowRequestRate", "request_rate", "<", 0.1, 600, "warning"),
    ("ModelNotLoaded", "model_loaded", "==", 0.0, 60, "critical"),
    ("PredictionLatencyHigh", "p95_prediction", ">", 0.1, 300, "warning"),
    ("LowPredictionVolume", "request_rate", "<", 0.1, 900, "warning"),
    ("PredictionDistributionAnomaly", "score_shift", ">", 0.1, 1800, "warning"),
    ("ModelStale", "model_age", ">", 604800.0, 3600, "info"),
    ("HighPredictionErrorRate", "error_rate", ">", 0.01, 300, "warning"),
    ("SlowModelInference", "p95_prediction", ">", 0.5, 300, "warning"),
    ("LowCacheHitRate", "cache_hit_ratio", "<", 0.1, 600, "info"),
]
_RULES_SQL = "rules(name, metric, op, threshold, hold_s, severity) AS (VALUES " + ", ".join(
    f"('{n}', '{m}', '{o}', {float(t)}, {h}, '{s}')" for n, m, o, t, h, s in RULES) + ")"
PRE = "[" + ", ".join(f"{b}::DOUBLE" for b in T.PREDICTION_LATENCY_BUCKETS) + ", 'inf'::DOUBLE]"


def _cum_sql(name, src, value, les):
    return f"""{name} AS (SELECT w, le, COUNT(*) FILTER (WHERE {value} <= le) AS cum
       FROM {src}, (SELECT unnest({les}) AS le) GROUP BY w, le)"""


@query("t12_alert_rules", _with(
    """l5 AS (SELECT * EXCLUDE (w), time_bucket(INTERVAL '5 minutes', ts) AS w FROM lg)""",
    """grid AS (SELECT unnest(generate_series((SELECT MIN(w) FROM l5), (SELECT MAX(w) FROM l5), INTERVAL '5 minutes')) AS w)""",
    """cnt AS (SELECT w, COUNT(*) AS n, COUNT(*) FILTER (WHERE status >= 500) / COUNT(*) AS er, COUNT(model_version) AS named
       FROM l5 GROUP BY w)""",
    """quiet AS (SELECT w, CASE WHEN COUNT(*) < 5 THEN 0 ELSE MIN(n) END / 60.0 AS v
       FROM (SELECT w, date_trunc('minute', ts) AS m, COUNT(*) AS n FROM l5 GROUP BY ALL) GROUP BY w)""",
    _cum_sql("hreq", "l5", "duration_s", LAT), _quant_sql(0.95, "qreq", "hreq"),
    _cum_sql("hpre", "l5", "duration_s", PRE), _quant_sql(0.95, "qpre", "hpre"),
    """l60 AS (SELECT w + to_minutes(CAST(5 * k AS BIGINT)) AS w, score FROM l5, range(12) t(k))""",
    _cum_sql("hsco", "l60", "score", SCO), _quant_sql(0.5, "med", "hsco"),
    """shift AS (SELECT a.w, ABS(a.v - b.v) AS v FROM med a JOIN med b ON a.w = b.w + INTERVAL '24 hours')""",
    """rl AS (SELECT MIN(ts) AS r FROM lg GROUP BY model_version)""",
    """age AS (SELECT g.w, (epoch_us(g.w + INTERVAL '5 minutes') - epoch_us(MAX(rl.r))) / 1e6 AS v
       FROM grid g JOIN rl ON rl.r < g.w + INTERVAL '5 minutes' GROUP BY g.w)""",
    """rq AS (SELECT w, ts, LAG(ts) OVER (PARTITION BY user_id, recommendation_type, endpoint ORDER BY ts) AS prev FROM l5)""",
    """hit AS (SELECT w, COUNT(*) FILTER (WHERE prev IS NOT NULL AND epoch_us(ts) - epoch_us(prev) <= 86400000000) / COUNT(*) AS v
       FROM rq GROUP BY w)""",
    """met AS (
  SELECT g.w, 'requests' AS metric, CAST(COALESCE(c.n, 0) AS DOUBLE) AS value FROM grid g LEFT JOIN cnt c ON c.w = g.w
  UNION ALL SELECT g.w, 'request_rate', COALESCE(c.n, 0) / 300.0 FROM grid g LEFT JOIN cnt c ON c.w = g.w
  UNION ALL SELECT g.w, 'lowest_minute_rate', COALESCE(q.v, 0) FROM grid g LEFT JOIN quiet q ON q.w = g.w
  UNION ALL SELECT g.w, 'error_rate', c.er FROM grid g LEFT JOIN cnt c ON c.w = g.w
  UNION ALL SELECT g.w, 'p95_latency', q.v FROM grid g LEFT JOIN qreq q ON q.w = g.w
  UNION ALL SELECT g.w, 'p95_prediction', q.v FROM grid g LEFT JOIN qpre q ON q.w = g.w
  UNION ALL SELECT g.w, 'score_shift', s.v FROM grid g LEFT JOIN shift s ON s.w = g.w
  UNION ALL SELECT g.w, 'model_loaded', CASE WHEN c.named > 0 THEN 1.0 ELSE 0.0 END FROM grid g LEFT JOIN cnt c ON c.w = g.w
  UNION ALL SELECT g.w, 'model_age', a.v FROM grid g LEFT JOIN age a ON a.w = g.w
  UNION ALL SELECT g.w, 'cache_hit_ratio', h.v FROM grid g LEFT JOIN hit h ON h.w = g.w)""", _RULES_SQL,
    """ev2 AS (SELECT r.name, r.severity, m.w, m.metric, m.value,
       COALESCE(CASE r.op WHEN '>' THEN m.value > r.threshold WHEN '<' THEN m.value < r.threshold
                          WHEN '==' THEN m.value = r.threshold END, FALSE) AS cond,
       GREATEST(1, CEIL(r.hold_s / 300.0)) AS need
  FROM met m JOIN rules r ON r.metric = m.metric)""",
    """isl AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY w)
                  - row_number() OVER (PARTITION BY name, cond ORDER BY w) AS island FROM ev2)""", body="""
SELECT name, severity, epoch_us(w) AS window_start_us, metric, value, cond,
       CASE WHEN cond THEN row_number() OVER (PARTITION BY name, cond, island ORDER BY w) ELSE 0 END AS held_windows,
       cond AND CASE WHEN cond THEN row_number() OVER (PARTITION BY name, cond, island ORDER BY w) ELSE 0 END >= need AS firing
FROM isl"""))
def t12_alert_rules(spark, sf_dir):
    """T-12: all thirteen rules over five-minute metric series (dense grid), with `for:` holds of 1 to 12 windows."""
    rules = spark.createDataFrame(RULES, "name string, metric string, op string, threshold double, hold_s long, severity string")
    a = T.evaluate_rules(T.rule_metrics(_log(spark, sf_dir)), rules, "5 minutes")
    return a.select("name", "severity", _us(), "metric", "value", "cond",
                    F.col("held_windows").cast("bigint").alias("held_windows"), "firing")


@query("t13_repeat_request_ratio", _with("""p AS (SELECT ts, w, LAG(ts) OVER (PARTITION BY user_id, recommendation_type, endpoint ORDER BY ts) AS prev
      FROM lg)""", body="""
SELECT epoch_us(w) AS window_start_us,
       COUNT(*) FILTER (WHERE prev IS NOT NULL AND epoch_us(ts) - epoch_us(prev) <= 86400000000) AS repeats,
       COUNT(*) AS total,
       COUNT(*) FILTER (WHERE prev IS NOT NULL AND epoch_us(ts) - epoch_us(prev) <= 86400000000) / COUNT(*) AS repeat_ratio
FROM p GROUP BY w"""))
def t13_repeat_request_ratio(spark, sf_dir):
    """T-13: share of requests whose (user, type, endpoint) key was seen within 24 h."""
    r = T.repeat_ratio(_log(spark, sf_dir), ttl_s=86400.0)
    return r.select(_us(), "repeats", "total", "repeat_ratio")


@query("t14_gauge_average", _with(body="""
SELECT epoch_us(w) AS window_start_us, endpoint, ROUND(AVG(score), 6) AS avg_value FROM lg GROUP BY ALL"""))
def t14_gauge_average(spark, sf_dir):
    """T-14: avg_over_time of the prediction-score gauge per endpoint and hour."""
    g = T.gauge_average(_log(spark, sf_dir), "score", ("endpoint",))
    return g.select(_us(), "endpoint", F.round("avg_value", 6).alias("avg_value"))


@query("t15_latency_summary", _with("""r AS (SELECT endpoint, duration_s, status, ts,
             row_number() OVER (PARTITION BY endpoint ORDER BY duration_s) - 1 AS i,
             COUNT(*) OVER (PARTITION BY endpoint) AS n FROM lg)""", body="""
SELECT endpoint, COUNT(*) AS n, ROUND(MIN(duration_s), 6) AS min, ROUND(MAX(duration_s), 6) AS max,
       ROUND(AVG(duration_s), 6) AS avg,
       ROUND(MAX(CASE WHEN i = FLOOR(n * 0.5) THEN duration_s END), 6) AS p50,
       ROUND(MAX(CASE WHEN i = FLOOR(n * 0.95) THEN duration_s END), 6) AS p95,
       ROUND(MAX(CASE WHEN i = FLOOR(n * 0.99) THEN duration_s END), 6) AS p99,
       ROUND(COUNT(*) FILTER (WHERE status < 400) / COUNT(*), 6) AS success_rate,
       ROUND(COUNT(*) / ((epoch_us(MAX(ts)) - epoch_us(MIN(ts))) / 1e6), 6) AS throughput
FROM r GROUP BY endpoint"""))
def t15_latency_summary(spark, sf_dir):
    """T-15: load-test style latency summary per endpoint."""
    s = T.latency_summary(_log(spark, sf_dir), ("endpoint",))
    return s.select("endpoint", "n", *[F.round(c, 6).alias(c) for c in
                                       ("min", "max", "avg", "p50", "p95", "p99", "success_rate", "throughput")])
