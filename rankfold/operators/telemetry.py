"""Request / prediction telemetry as windowed Spark aggregates (T-*).

Input: a request log (ts, endpoint, method, status, duration_s,
recommendation_type, score, model_version, user_id). Every metric is a
``groupBy(window(ts), labels)`` aggregate (map-side partial aggregation, so a
hot endpoint is pre-aggregated per task). Histograms are kept as one row of
cumulative bucket arrays per (window, labels) so quantiles are plain array
expressions and the same code runs on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfold.operators.scan import carry_last, run_length
from rankfold.session import materialize

# fixed values: histogram buckets of the reference's metric definitions
LATENCY_BUCKETS = (0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0)
PREDICTION_LATENCY_BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)
SCORE_BUCKETS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
SIZE_BUCKETS = (100, 1000, 10000, 100000, 1000000)
BATCH_BUCKETS = (1, 5, 10, 25, 50, 100)

INF = float("inf")


def _win(ts: str, window: str, slide: str | None = None) -> Column:
    return F.window(F.col(ts), window, slide) if slide else F.window(F.col(ts), window)


def seconds(duration: str) -> float:
    n, unit = duration.split()
    mult = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600,
            "day": 86400, "days": 86400}[unit]
    return float(n) * mult


def counter(log: DataFrame, labels=(), window: str = "1 hour", ts: str = "ts") -> DataFrame:
    """T-1: labelled counter per window."""
    return (log.groupBy(_win(ts, window).start.alias("window_start"), *labels)
               .agg(F.count(F.lit(1)).alias("n")))


def _bucket_counts(value: str, buckets, prefix: str = "_b") -> list[Column]:
    """One aggregate per bucket bound, cumulative, and one of all values."""
    v = F.col(value)
    return [*(F.count_if(v <= F.lit(float(b))).alias(f"{prefix}{i}") for i, b in enumerate(buckets)),
            F.count(v).alias(f"{prefix}{len(buckets)}")]


def histogram(log: DataFrame, value: str, buckets=LATENCY_BUCKETS, labels=(), window: str = "1 hour",
              ts: str = "ts") -> DataFrame:
    """T-2: cumulative histogram per window: arrays ``le`` (with +Inf), ``cum``,
    plus ``sum`` and ``count`` — one aggregate, one count_if per bucket."""
    h = log.groupBy(_win(ts, window).start.alias("window_start"), *labels).agg(*_bucket_counts(value, buckets), F.sum(value).alias("sum"))
    cum = F.array(*[F.col(f"_b{i}") for i in range(len(buckets) + 1)])
    return h.select("window_start", *labels, _bounds(buckets).alias("le"), cum.alias("cum"), "sum", F.col(f"_b{len(buckets)}").alias("count"))


def _bounds(buckets) -> Column:
    return F.array(*[F.lit(float(b)) for b in buckets], F.lit(INF))


def size_histograms(log: DataFrame, sizes: dict[str, str], labels=("method", "endpoint"), buckets=SIZE_BUCKETS,
                    window: str = "1 hour", ts: str = "ts") -> DataFrame:
    """T-2 for message sizes: one cumulative histogram per entry of ``sizes``
    (metric name -> column of bytes), window and labels, as rows with a
    ``metric`` column. The log is read and aggregated once for all of them.
    A size that is null was not measured and counts in no bucket.
    """
    aggs = []
    for m, (name, col) in enumerate(sizes.items()):
        aggs += [*_bucket_counts(col, buckets, f"_m{m}_"), F.sum(col).alias(f"_s{m}")]
    h = log.groupBy(_win(ts, window).start.alias("window_start"), *labels).agg(*aggs)
    n = len(buckets)
    rows = [F.struct(F.lit(name).alias("metric"), _bounds(buckets).alias("le"),
                     F.array(*[F.col(f"_m{m}_{i}") for i in range(n + 1)]).alias("cum"),
                     F.col(f"_s{m}").alias("sum"), F.col(f"_m{m}_{n}").alias("count")) for m, name in enumerate(sizes)]
    return h.select("window_start", *labels, F.inline(F.array(*rows)))


def batch_sizes(requests: DataFrame, batch, ts: str = "ts") -> DataFrame:
    """Size and time (of the first request) of every batch call, the input of a
    ``BATCH_BUCKETS`` histogram. ``batch`` names the columns that requests of one
    call share; a request with a null among them is a call of its own.
    """
    keys = list(batch)
    single = F.lit(False)
    for k in keys:
        single = single | F.col(k).isNull()
    alone = requests.where(single).select(*keys, F.col(ts).alias("ts"), F.lit(1).cast("bigint").alias("batch_size"))
    calls = requests.where(~single).groupBy(*keys).agg(F.min(ts).alias("ts"), F.count(F.lit(1)).alias("batch_size"))
    return calls.unionByName(alone)


def histogram_long(hist: DataFrame, labels=()) -> DataFrame:
    """Histogram arrays -> one row per bucket (le, cumulative count)."""
    return hist.select("window_start", *labels, F.inline(F.arrays_zip(F.col("le").alias("le"), F.col("cum").alias("cum"))))


def histogram_quantile(q: float, le: Column, cum: Column) -> Column:
    """T-5: quantile from cumulative buckets with linear interpolation inside the
    bucket (lower bound 0 for the first); a rank in the +Inf bucket returns the
    highest finite bound; empty histograms give null."""
    total = F.element_at(cum, -1)
    rank = F.lit(q) * total
    idx = F.array_position(F.transform(cum, lambda c: c >= rank), F.lit(True)).cast("int")  # 1-based
    n = F.size(le)
    upper = F.element_at(le, idx)
    lower = F.when(idx > 1, F.element_at(le, F.greatest(idx - 1, F.lit(1)))).otherwise(F.lit(0.0))
    before = F.when(idx > 1, F.element_at(cum, F.greatest(idx - 1, F.lit(1)))).otherwise(F.lit(0))
    inb = F.element_at(cum, idx) - before
    interp = lower + (upper - lower) * ((rank - before) / inb)
    return (F.when((total.isNull()) | (total == 0), F.lit(None).cast("double"))
             .when(idx == n, F.element_at(le, F.greatest(n - 1, F.lit(1))))
             .when(inb == 0, upper)
             .otherwise(interp))


def rate(log: DataFrame, window: str = "5 minutes", slide: str | None = "1 minute", labels=(),
         ts: str = "ts") -> DataFrame:
    """T-3: events per second over sliding windows."""
    secs = seconds(window)
    c = log.groupBy(_win(ts, window, slide).start.alias("window_start"), *labels).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rate", F.col("n") / F.lit(secs))


def counter_rate(samples: DataFrame, series=("series",), window: str = "5 minutes", ts: str = "ts",
                 value: str = "value") -> DataFrame:
    """T-3 from scraped counter samples: per-second increase inside each window.

    Increase = sum of positive deltas between consecutive samples, a drop is a
    counter reset (the new value counts as the increase); no extrapolation.
    The sample before is carried over blocks of time, so a series of very many
    samples is read by many tasks.
    """
    d = carry_last(samples, series, ts, value, "_prev", max(3600.0, seconds(window)), include=False)
    inc = F.when(F.col("_prev").isNull(), F.lit(0.0)).when(F.col(value) >= F.col("_prev"),
                                                             F.col(value) - F.col("_prev")).otherwise(F.col(value))
    d = d.withColumn("_inc", inc.cast("double"))
    return (d.groupBy(_win(ts, window).start.alias("window_start"), *series)
             .agg(F.sum("_inc").alias("increase"))
             .withColumn("rate", F.col("increase") / F.lit(seconds(window))))


def ratio(log: DataFrame, cond: Column, labels=(), window: str = "1 hour", ts: str = "ts") -> DataFrame:
    """T-6: share of rows meeting ``cond`` per window (e.g. 5xx / all)."""
    return (log.groupBy(_win(ts, window).start.alias("window_start"), *labels)
               .agg(F.count_if(cond).alias("matching"), F.count(F.lit(1)).alias("total"))
               .withColumn("ratio", F.try_divide(F.col("matching").cast("double"), F.col("total").cast("double"))))


def status_distribution(log: DataFrame, window: str = "1 hour", exclude_endpoints=(), ts: str = "ts") -> DataFrame:
    """T-4: per endpoint and status class, share of the endpoint's requests."""
    lg = log.where(~F.col("endpoint").isin(*exclude_endpoints)) if exclude_endpoints else log
    lg = lg.withColumn("status_class", F.concat((F.col("status") / 100).cast("int").cast("string"), F.lit("xx")))
    c = lg.groupBy(_win(ts, window).start.alias("window_start"), "endpoint", "status_class").agg(
        F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy("window_start", "endpoint"))
    return c.withColumn("share", F.col("n") / tot)


def window_grid(log: DataFrame, window: str = "1 hour", ts: str = "ts", series: DataFrame | None = None) -> DataFrame:
    """Dense grid of window starts from the first to the last event (one row per
    window: bounded by the time span, not by the data), for every row of
    ``series`` if given.

    Starts are made in two steps, blocks of 1,000 windows and then their
    windows, so no array grows with the span; rows of ``series`` are expanded
    where they lie.
    """
    secs = int(seconds(window))
    span = log.agg(F.min(_win(ts, window).start).alias("_lo"), F.max(_win(ts, window).start).alias("_hi"))
    labels = [] if series is None else series.columns
    g = span if series is None else series.crossJoin(F.broadcast(span))  # one-row side
    after = lambda c, n: F.col(c) + F.expr(f"INTERVAL {n * secs} SECONDS")
    g = g.withColumn("_block", F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {1000 * secs} SECONDS"))))
    starts = F.sequence(F.col("_block"), F.least(F.col("_hi"), after("_block", 999)), F.expr(f"INTERVAL {secs} SECONDS"))
    return g.select(F.explode(starts).alias("window_start"), *labels)


def volume(log: DataFrame, window: str = "1 hour", low: float = 0.1, high: float = 1000.0,
           labels=(), ts: str = "ts") -> DataFrame:
    """T-7: request rate per window on a dense grid (empty windows count 0)."""
    series = log.select(*labels).distinct() if labels else None
    grid = window_grid(log, window, ts, series)
    c = counter(log, labels, window, ts)
    j = grid.join(c, ["window_start", *labels], "left").fillna({"n": 0})
    r = F.col("n") / F.lit(seconds(window))
    return j.select("window_start", *labels, F.col("n").cast("bigint").alias("n"), r.alias("rate"),
                    (r < low).alias("low_volume"), (r > high).alias("high_volume"))


def drift(log: DataFrame, value: str = "score", buckets=SCORE_BUCKETS, q: float = 0.5,
          lag: str = "24 hours", limit: float = 0.1, window: str = "1 hour", ts: str = "ts") -> DataFrame:
    """T-8: |quantile(now) - quantile(now - lag)| > limit, per window."""
    h = histogram(log, value, buckets, (), window, ts)
    m = h.select("window_start", histogram_quantile(q, F.col("le"), F.col("cum")).alias("median"))
    prev = m.select((F.col("window_start") + F.expr(f"INTERVAL {int(seconds(lag))} SECONDS")).alias("window_start"),
                    F.col("median").alias("median_before"))
    j = m.join(prev, "window_start")
    d = F.abs(F.col("median") - F.col("median_before"))
    return j.select("window_start", "median", "median_before", d.alias("diff"), (d > limit).alias("drift"))


def staleness(log: DataFrame, key: str = "model_version", limit_s: float = 604800.0, ts: str = "ts") -> DataFrame:
    """T-9: age of each key's first appearance (its 'reload') at the log's last time."""
    now = log.agg(F.max(ts).alias("_now"))
    r = log.groupBy(key).agg(F.min(ts).alias("_reload")).crossJoin(F.broadcast(now))  # one-row side
    age = (F.unix_micros(F.col("_now").cast("timestamp")) - F.unix_micros(F.col("_reload").cast("timestamp"))) / 1e6
    return r.select(key, age.alias("age_seconds"), (age > limit_s).alias("stale"))


def absence(log: DataFrame, series: str = "endpoint", window: str = "1 hour", ts: str = "ts") -> DataFrame:
    """T-10: per series and window, the request count on a dense grid; down when
    0, with the time since the series was last seen (last non-null)."""
    names = log.select(series).distinct()
    grid = window_grid(log, window, ts, names)
    c = log.groupBy(_win(ts, window).start.alias("window_start"), series).agg(
        F.count(F.lit(1)).alias("n"), F.max(ts).alias("_last"))
    j = grid.join(c, ["window_start", series], "left")
    j = carry_last(j, [series], "window_start", "_last", "_seen", 1000 * seconds(window))
    end = F.col("window_start") + F.expr(f"INTERVAL {int(seconds(window))} SECONDS")
    since = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col("_seen").cast("timestamp"))) / 1e6
    return j.select("window_start", series, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
                    (F.coalesce("n", F.lit(0)) == 0).alias("down"), since.alias("seconds_since_seen"))


def hold(cond: DataFrame, windows_needed: int, series=("series",), order: str = "window_start",
         flag: str = "cond", block: float = 3_600_000.0) -> DataFrame:
    """T-11 (batch): firing once ``flag`` held for ``windows_needed`` consecutive
    windows. The run's length is carried over blocks of time (``block`` seconds,
    or units of a numeric ``order``)."""
    return run_length(cond, series, order, flag, "held_windows", block).withColumn(
        "firing", F.col(flag) & (F.col("held_windows") >= windows_needed))


def repeat_ratio(log: DataFrame, key=("user_id", "recommendation_type", "endpoint"), ttl_s: float = 3600.0,
                 window: str = "1 hour", ts: str = "ts") -> DataFrame:
    """T-13: share of requests whose key was already requested within ``ttl_s``.

    The previous request of the same key is the row one global position
    earlier in (key, ts) order: an equi-join on that position instead of a
    per-key ``lag`` window, so a hot key is not one task.
    """
    from rankfold.operators.ranking import global_rank
    keys = list(key)
    g = global_rank(log.select(*keys, ts), [*[F.asc(k) for k in keys], F.asc(ts)], "_g")
    prev = g.select(*[F.col(k).alias(f"_p_{k}") for k in keys], F.col(ts).alias("_pts"),
                    (F.col("_g") + 1).alias("_g"))
    j = g.join(prev, "_g", "left")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_p_{k}").eqNullSafe(F.col(k))
    dt = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_pts").cast("timestamp"))
    d = j.withColumn("_hit", F.coalesce(same & (dt <= F.lit(int(ttl_s * 1_000_000))), F.lit(False)))
    return (d.groupBy(_win(ts, window).start.alias("window_start"))
             .agg(F.count_if("_hit").alias("repeats"), F.count(F.lit(1)).alias("total"))
             .withColumn("repeat_ratio", F.col("repeats") / F.col("total")))


def gauge_average(log: DataFrame, value: str, labels=(), window: str = "1 hour", ts: str = "ts") -> DataFrame:
    """T-14: avg_over_time of a gauge per window and label set."""
    return log.groupBy(_win(ts, window).start.alias("window_start"), *labels).agg(F.avg(value).alias("avg_value"))


def latency_summary(log: DataFrame, groups=("endpoint",), value: str = "duration_s",
                    ok: Column | None = None, ts: str = "ts") -> DataFrame:
    """T-15: min/max/avg, p50/p95/p99 as the value at sorted index int(n*p),
    success rate and throughput (requests / covered seconds).

    Sorted positions come from ``rank_within`` (range-partitioned), so a hot
    endpoint is not sorted by a single task.
    """
    from rankfold.operators.ranking import rank_within
    ok = (F.col("status") < 400) if ok is None else ok
    r = rank_within(log.withColumn("_ok", ok), list(groups), [F.asc(value)], "_pos", count_col="_n")
    pick = lambda p: F.max(F.when(F.col("_pos") - 1 == F.floor(F.col("_n") * F.lit(p)), F.col(value)))
    agg = r.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.avg(value).alias("avg"), pick(0.5).alias("p50"), pick(0.95).alias("p95"), pick(0.99).alias("p99"),
        F.count_if("_ok").alias("_okn"), F.min(ts).alias("_t0"), F.max(ts).alias("_t1"))
    span = F.unix_micros(F.col("_t1").cast("timestamp")) - F.unix_micros(F.col("_t0").cast("timestamp"))
    return agg.select(*groups, F.col("n").cast("bigint").alias("n"), "min", "max", "avg", "p50", "p95", "p99",
                      (F.col("_okn") / F.col("n")).alias("success_rate"),
                      F.when(span > 0, F.col("n") / (span / F.lit(1e6))).alias("throughput"))


def rule_metrics(log: DataFrame, step: str = "5 minutes", lookback: str = "1 hour", lag: str = "24 hours",
                 ttl_s: float = 86400.0, ts: str = "ts") -> DataFrame:
    """T-12 input: what the alert rules look at, as (series, window_start, metric,
    value) with one row per metric and step of a dense grid; null where there
    was nothing to measure.

    requests, request_rate, error_rate, p95_latency, p95_prediction: over the
    step. lowest_minute_rate: the step's quietest minute (0 if one is empty), so
    it is above a bound if and only if all of its one-minute rates are.
    score_shift: |median score of the last ``lookback`` - the same ``lag``
    earlier|. model_loaded: 1 if a request of the step names a model version.
    model_age: seconds from the latest first use of a version to the step's end.
    cache_hit_ratio: share of requests seen before within ``ttl_s`` (T-13).

    The log is aggregated to minutes once, and written; all but the versions
    and the repeats follow from its few rows.
    """
    secs = int(seconds(step))
    plus = lambda c, s: c + F.expr(f"INTERVAL {int(s)} SECONDS")
    minutes = materialize(log.groupBy(_win(ts, "1 minute").start.alias("minute")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") >= 500).alias("bad"), F.count("model_version").alias("named"),
        *_bucket_counts("duration_s", LATENCY_BUCKETS, "_d"), *_bucket_counts("score", SCORE_BUCKETS, "_s")))

    def quantile(q: float, buckets, counted, prefix: str) -> Column:
        at = [counted.index(b) for b in buckets] + [len(counted)]
        return histogram_quantile(q, _bounds(buckets), F.array(*[F.col(f"{prefix}{i}") for i in at]))

    steps = minutes.groupBy(_win("minute", step).start.alias("window_start")).agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("named").alias("named"), F.min("n").alias("least"),
        F.count(F.lit(1)).alias("minutes"), *[F.sum(f"_d{i}").alias(f"_d{i}") for i in range(len(LATENCY_BUCKETS) + 1)])
    back = minutes.groupBy(_win("minute", lookback, step).end.alias("_end")).agg(
        *[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(SCORE_BUCKETS) + 1)]).select(
        plus(F.col("_end"), -secs).alias("window_start"), quantile(0.5, SCORE_BUCKETS, SCORE_BUCKETS, "_s").alias("median"))
    before = back.select(plus(F.col("window_start"), seconds(lag)).alias("window_start"), F.col("median").alias("median_before"))
    reloads = (log.where(F.col("model_version").isNotNull()).groupBy("model_version").agg(F.min(ts).alias("_first"))
                  .groupBy(_win("_first", step).start.alias("window_start")).agg(F.max("_first").alias("_reload")))
    repeats = repeat_ratio(log, ttl_s=ttl_s, window=step, ts=ts).select("window_start", "repeat_ratio")

    g = window_grid(minutes, step, "minute").join(reloads, "window_start", "left").withColumn("series", F.lit("all"))
    g = carry_last(g, ["series"], "window_start", "_reload", "_reloaded", 1000.0 * secs)
    for t in (steps, back, before, repeats):
        g = g.join(t, "window_start", "left")
    n = F.coalesce("n", F.lit(0)).cast("double")
    end, reload = (F.unix_micros(c.cast("timestamp")) for c in (plus(F.col("window_start"), secs), F.col("_reloaded")))
    quiet = F.when(F.col("minutes") * 60 < secs, 0.0).otherwise(F.col("least") / 60.0)
    metrics = {
        "requests": n, "request_rate": n / float(secs), "lowest_minute_rate": F.coalesce(quiet, F.lit(0.0)),
        "error_rate": F.col("bad") / F.col("n"),
        "p95_latency": quantile(0.95, LATENCY_BUCKETS, LATENCY_BUCKETS, "_d"),
        "p95_prediction": quantile(0.95, PREDICTION_LATENCY_BUCKETS, LATENCY_BUCKETS, "_d"),
        "score_shift": F.abs(F.col("median") - F.col("median_before")),
        "model_loaded": F.when(F.coalesce("named", F.lit(0)) > 0, 1.0).otherwise(0.0),
        "model_age": (end - reload) / 1e6, "cache_hit_ratio": F.col("repeat_ratio"),
    }
    return g.select("series", "window_start", F.inline(F.array(
        *[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in metrics.items()])))


def evaluate_rules(metrics: DataFrame, rules: DataFrame, window: str = "1 hour") -> DataFrame:
    """T-12: rule table (name, metric, op, threshold, hold_s, severity) applied to a
    long metric series (series, window_start, metric, value) -> alert states.

    The hold is counted in windows: max(1, ceil(hold_s / window seconds)); its
    length is carried over blocks of windows.
    """
    secs = seconds(window)
    j = metrics.join(F.broadcast(rules), "metric")  # rule table: a few rows
    cond = (F.when(F.col("op") == ">", F.col("value") > F.col("threshold"))
             .when(F.col("op") == "<", F.col("value") < F.col("threshold"))
             .when(F.col("op") == "==", F.col("value") == F.col("threshold"))
             .otherwise(F.lit(False)))
    j = j.withColumn("cond", F.coalesce(cond, F.lit(False)))
    j = j.withColumn("_need", F.greatest(F.lit(1), F.ceil(F.col("hold_s") / F.lit(secs))).cast("int"))
    # the metrics' long expressions are worked out once; the scan reads their values
    j = materialize(j.select("name", "severity", "series", "window_start", "metric", "value", "cond", "_need"))
    out = run_length(j, ["name", "series"], "window_start", "cond", "held_windows", 1000 * secs)
    return out.select("name", "severity", "series", "window_start", "metric", "value", "cond", "held_windows",
                      (F.col("cond") & (F.col("held_windows") >= F.col("_need"))).alias("firing"))
