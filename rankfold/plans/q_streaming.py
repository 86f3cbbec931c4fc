"""Registered streaming queries (A-9, T-16, streaming Q-10 / T-11).

Each runs a Structured Streaming job to completion (``availableNow``) over the
events table split into time-ordered files in the shared folder, writes to a
file sink / ``foreachBatch``, and returns the sink read back. Because the
stream result must equal the batch result, most have a SQL oracle too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold.operators import quality as DQ
from rankfold.plans.registry import query
from rankfold.session import scratch_path
from rankfold.sources import testtables as TT
from rankfold.streaming import streams as ST

# fixed value: the event enum of table E
E_ENUM = ("view", "click", "purchase")


def _event_files(spark, sf_dir, n_files=8):
    """The E events as time-ordered files (several micro-batches)."""
    path = scratch_path(spark, "event-files")
    ev = TT.events_e(spark, sf_dir).select("event_id", "ts", "user_id", "item_id", "event")
    ev.repartitionByRange(n_files, "ts").write.parquet(path)
    return path, ev.schema


@query("a9_streaming_event_source", """
SELECT event_type AS event, COUNT(*) AS n FROM events GROUP BY event_type""")
def a9_streaming_event_source(spark, sf_dir):
    """A-9: events read as a file stream (2 files per micro-batch) into a parquet sink."""
    src, schema = _event_files(spark, sf_dir)
    out, ck = scratch_path(spark, "a9-out"), scratch_path(spark, "a9-ck")
    ST.run_to_completion(ST.event_stream(spark, src, schema, max_files_per_trigger=2), out, ck)
    return spark.read.parquet(out).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


@query("t16_streaming_interactions", """
WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS item_id, ts,
                   CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'purchase' THEN 5 ELSE 1 END AS DOUBLE) AS weight
            FROM events)
SELECT epoch_us(time_bucket(INTERVAL '1 day', ts)) AS window_start_us, user_id, item_id,
       SUM(weight) AS weight, COUNT(*) AS n_events FROM ev GROUP BY ALL""")
def t16_streaming_interactions(spark, sf_dir):
    """T-16: G-1 per day on the stream, watermark + dedup by event id."""
    src, schema = _event_files(spark, sf_dir)
    s = ST.event_stream(spark, src, schema, max_files_per_trigger=2)
    # the time-sliced files arrive in any order here, so lateness can reach the
    # whole 30-day span; in update mode the watermark only bounds the state
    agg = ST.windowed_interactions(s, TT.E_WEIGHTS, 1.0, "1 day", watermark="31 days")
    out, ck = scratch_path(spark, "t16-out"), scratch_path(spark, "t16-ck")
    ST.run_foreach_batch(agg, ST.latest_batch_writer(out), ck, mode="update")
    r = ST.read_latest(spark, out, ["window_start", "user_id", "item_id"])
    return r.select(F.unix_micros("window_start").alias("window_start_us"), "user_id", "item_id",
                    F.col("weight").cast("double").alias("weight"), F.col("n_events").cast("bigint").alias("n_events"))


@query("t16_streaming_event_counts", """
SELECT epoch_us(time_bucket(INTERVAL '1 day', ts)) AS window_start_us, event_type AS event, COUNT(*) AS n
FROM events GROUP BY ALL""")
def t16_streaming_event_counts(spark, sf_dir):
    """T-16: G-5 per day on the stream."""
    src, schema = _event_files(spark, sf_dir)
    c = ST.windowed_counts(ST.event_stream(spark, src, schema, max_files_per_trigger=2), "event", "1 day", "31 days")
    out, ck = scratch_path(spark, "t16c-out"), scratch_path(spark, "t16c-ck")
    ST.run_foreach_batch(c, ST.latest_batch_writer(out), ck, mode="update")
    return ST.read_latest(spark, out, ["window_start", "event"]).select(F.unix_micros("window_start").alias("window_start_us"), "event",
                                          F.col("n").cast("bigint").alias("n"))


@query("t16_streaming_upsert", """
WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS item_id,
                   CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'purchase' THEN 5 ELSE 1 END AS DOUBLE) AS weight
            FROM events)
SELECT user_id, item_id, SUM(weight) AS weight, COUNT(*) AS n_events FROM ev GROUP BY ALL""")
def t16_streaming_upsert(spark, sf_dir):
    """T-16: interactions maintained by idempotent foreachBatch upserts."""
    from rankfold.functions.exprs import event_weight
    src, schema = _event_files(spark, sf_dir)
    s = ST.event_stream(spark, src, schema, max_files_per_trigger=2).withColumn(
        "weight", event_weight("event", TT.E_WEIGHTS, 1.0))
    out, ck = scratch_path(spark, "ups-out"), scratch_path(spark, "ups-ck")
    ST.run_foreach_batch(s, ST.upsert_batch_writer(out), ck)
    r = ST.read_upserted(spark, out)
    return r.select("user_id", "item_id", F.col("weight").cast("double").alias("weight"),
                    F.col("n_events").cast("bigint").alias("n_events"))


@query("q10_streaming_quality", """
SELECT rule, CAST(SUM(v) AS BIGINT) AS violations, CAST(SUM(n) AS BIGINT) AS rows FROM (
  SELECT 'event_enum' AS rule, COUNT(*) FILTER (WHERE event_type NOT IN ('view', 'click', 'purchase')) AS v, COUNT(*) AS n FROM events
  UNION ALL SELECT 'item_not_null', COUNT(*) FILTER (WHERE json_extract_string(props, '$.k') IS NULL), COUNT(*) FROM events
  UNION ALL SELECT 'user_not_null', COUNT(*) FILTER (WHERE user_id IS NULL), COUNT(*) FROM events) GROUP BY rule""")
def q10_streaming_quality(spark, sf_dir):
    """Q-10 on a stream: rule reports per micro-batch, summed over epochs."""
    src, schema = _event_files(spark, sf_dir)
    rules = [DQ.IsIn("event_enum", "event", E_ENUM), DQ.NotNull("item_not_null", "item_id"),
             DQ.NotNull("user_not_null", "user_id")]
    out, ck = scratch_path(spark, "dq-out"), scratch_path(spark, "dq-ck")
    ST.run_foreach_batch(ST.event_stream(spark, src, schema, max_files_per_trigger=2),
                         ST.quality_batch_writer(rules, out), ck)
    r = spark.read.parquet(out)
    return r.groupBy("rule").agg(F.sum("violations").cast("bigint").alias("violations"),
                                 F.sum("rows").cast("bigint").alias("rows"))


def _in_slices(ev, days: int, src: str, run, late=None):
    """Writes the events in slices of ``days`` days, one file at a time, and
    calls ``run()`` after each: the stream is stopped and restarted from its checkpoint in between.
    ``late`` (event_id, slice): rows that come with another slice than their own."""
    first = ev.agg(F.min("ts").alias("at")).first()["at"]  # one value
    ev = ev.withColumn("slice", F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(first).cast("timestamp")))
                                        / (days * 86_400_000_000)))
    if late is not None:
        ev = late(ev)
    for k in range(ev.agg(F.max("slice").alias("k")).first()["k"] + 1):
        ev.where(F.col("slice") == k).drop("slice").coalesce(1).write.mode("append").parquet(src)
        run()


@query("t11_streaming_error_hold", """
WITH lg AS (SELECT CASE WHEN event_type IN ('view', 'click') THEN 'browse' ELSE event_type END AS series, event_type = 'error' AND event_id % 3 > 0 AS bad,
                   time_bucket(INTERVAL '1 hour', ts) AS w, ts FROM events WHERE event_type <> 'error' OR event_id % 7 > 2),
wm AS (SELECT date_trunc('milliseconds', MAX(ts)) - INTERVAL '2 hours' AS wm FROM lg),
grid AS (SELECT series, unnest(generate_series(lo, (SELECT wm FROM wm), INTERVAL '1 hour')) AS w FROM (SELECT series, MIN(w) AS lo FROM lg GROUP BY series)),
cnt AS (SELECT series, w, COUNT(*) AS total, COUNT(*) FILTER (WHERE bad) AS nbad FROM lg GROUP BY ALL),
c AS (SELECT g.series, g.w, COALESCE(c.total, 0) AS total, COALESCE(c.nbad, 0) AS nbad,
             COALESCE(c.total, 0) > 0 AND COALESCE(c.nbad, 0) / c.total > 0.25 AS cond
      FROM grid g LEFT JOIN cnt c ON c.series = g.series AND c.w = g.w WHERE g.w + INTERVAL '1 hour' <= (SELECT wm FROM wm)),
isl AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY w)
                  - row_number() OVER (PARTITION BY series, cond ORDER BY w) AS island FROM c)
SELECT series, epoch_us(w) AS window_start_us, total, nbad AS bad, cond,
       CASE WHEN cond THEN row_number() OVER (PARTITION BY series, cond, island ORDER BY w) ELSE 0 END AS held_windows,
       cond AND CASE WHEN cond THEN row_number() OVER (PARTITION BY series, cond, island ORDER BY w) ELSE 0 END >= 2 AS firing
FROM isl""")
def t11_streaming_error_hold(spark, sf_dir):
    """T-11 on a stream: what the stream itself gave out, a row for every closed
    window of a series with the `for:` hold so far. Series: browse (view/click) and the other
    event types; hours in which a series has no event end its hold by a timer. The
    stream is stopped after each slice of ten days and restarted from its checkpoint."""
    ev = TT.events_e(spark, sf_dir).select("event_id", "ts", "event").where("event <> 'error' OR event_id % 7 > 2")
    src, out, ck = (scratch_path(spark, f"hold-{x}") for x in ("src", "out", "ck"))

    def run():
        s = ST.event_stream(spark, src, ev.schema).select(
            F.when(F.col("event").isin("view", "click"), F.lit("browse")).otherwise(F.col("event")).alias("series"), "ts",
            ((F.col("event") == "error") & (F.col("event_id") % 3 > 0)).alias("is_error"))
        with ST.rocks_state(spark):
            ST.run_to_completion(ST.error_alerts(s, "series", 3600, 0.25, 2, "2 hours"), out, ck)

    _in_slices(ev, 10, src, run)
    return spark.read.parquet(out)


@query("t16_streaming_late_rows", """
WITH ev AS (SELECT event_id, ts, CAST(date_diff('microsecond', MIN(ts) OVER (), ts) // (8 * 86400000000) AS BIGINT) AS own FROM events),
arrivals AS (
  SELECT event_id, ts, CASE WHEN event_id % 50 = 7 THEN least(own + 1 + event_id % 3, (SELECT max(own) FROM ev)) ELSE own END AS slice FROM ev
  UNION ALL SELECT event_id, ts, own FROM ev WHERE event_id % 20 = 3 AND event_id % 50 <> 7),
top AS (SELECT slice, MAX(MAX(ts)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL '2 days' AS wm FROM arrivals GROUP BY slice),
judged AS (SELECT a.*, COALESCE(ts <= date_trunc('milliseconds', wm), FALSE) AS late FROM arrivals a JOIN top USING (slice)),
last AS (SELECT date_trunc('milliseconds', MAX(ts)) - INTERVAL '2 days' AS wm FROM arrivals),
wins AS (SELECT time_bucket(INTERVAL '1 day', ts) AS w, COUNT(DISTINCT event_id) AS n FROM judged WHERE NOT late GROUP BY 1),
lates AS (SELECT time_bucket(INTERVAL '1 day', ts) AS w, COUNT(*) AS n_late FROM judged WHERE late GROUP BY 1)
SELECT epoch_us(w) AS window_start_us, wins.n AS n_events, COALESCE(n_late, 0) AS n_late FROM wins LEFT JOIN lates USING (w)
WHERE w + INTERVAL '1 day' <= (SELECT wm FROM last)""")
def t16_streaming_late_rows(spark, sf_dir):
    """T-16 with a watermark of two days over a log of thirty, delivered in slices of
    eight days with late rows (1 in 50, one to three slices behind) and repeated
    rows (1 in 20): daily counts of events as their windows close, and beside
    them the rows that came too late, from the side table."""
    ev = TT.events_e(spark, sf_dir).select("event_id", "ts")
    src, out, side, ck, ck2 = (scratch_path(spark, f"late-{x}") for x in ("src", "out", "side", "ck", "ck2"))

    def arrivals(rows):
        last = rows.agg(F.max("slice").alias("k")).first()["k"]
        behind = F.col("event_id") % 50 == 7
        moved = rows.withColumn("slice", F.when(behind, F.least(F.col("slice") + 1 + F.col("event_id") % 3, F.lit(last))).otherwise(F.col("slice")))
        return moved.unionByName(rows.where(~behind & (F.col("event_id") % 20 == 3)))

    def run():
        ST.run_foreach_batch(ST.event_stream(spark, src, ev.schema), ST.late_rows_writer(side, 2 * 86_400), ck2)
        s = ST.with_event_time(ST.event_stream(spark, src, ev.schema), "ts", "2 days").dropDuplicatesWithinWatermark(["event_id"])
        daily = s.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(
            F.unix_micros(F.col("w.start")).alias("window_start_us"), "n_events")
        ST.run_to_completion(daily, out, ck)

    _in_slices(ev, 8, src, run, arrivals)
    day = F.window(F.col("ts").cast("timestamp"), "1 day").start
    late = spark.read.schema(ev.schema).parquet(f"{side}/late").groupBy(F.unix_micros(day).alias("window_start_us")).agg(F.count(F.lit(1)).alias("n_late"))
    return spark.read.parquet(out).join(late, "window_start_us", "left").fillna({"n_late": 0}).select(
        "window_start_us", F.col("n_events").cast("bigint").alias("n_events"), F.col("n_late").cast("bigint").alias("n_late"))


@query("q10_streaming_quarantine", """
WITH ev AS (SELECT event_id, event_type AS event, json_extract_string(props, '$.k') AS item_id, event_type NOT IN ('view', 'click', 'purchase') AS no_enum,
  event_id % 97 = 0 AS no_id FROM events),
r AS (SELECT 'event_enum' AS rule, COUNT(*) FILTER (WHERE no_enum) AS v FROM ev UNION ALL SELECT 'event_id_low', COUNT(*) FILTER (WHERE no_id) FROM ev)
SELECT 'good' AS part, event AS name, COUNT(*) AS n FROM ev WHERE NOT no_enum AND NOT no_id GROUP BY event
UNION ALL SELECT 'bad', CASE WHEN no_enum AND no_id THEN 'event_enum,event_id_low' WHEN no_enum THEN 'event_enum' ELSE 'event_id_low' END, COUNT(*)
  FROM ev WHERE no_enum OR no_id GROUP BY 2
UNION ALL SELECT 'report', rule, v FROM r""")
def q10_streaming_quarantine(spark, sf_dir):
    """Q-10 on a stream: good, bad and report sinks by epoch; the last epoch is written
    a second time, as after a failure, and changes nothing."""
    src, schema = _event_files(spark, sf_dir)
    rules = [DQ.IsIn("event_enum", "event", E_ENUM), DQ.Between("event_id_low", "left_over", low=1)]
    out, ck = scratch_path(spark, "quar-out"), scratch_path(spark, "quar-ck")
    write = ST.quarantine_batch_writer(rules, out)

    def twice(batch, epoch_id):
        write(batch, epoch_id)
        if epoch_id == 3:
            write(batch, epoch_id)

    s = ST.event_stream(spark, src, schema, max_files_per_trigger=2).withColumn("left_over", F.col("event_id") % 97)
    ST.run_foreach_batch(s, twice, ck)
    good, bad, report = (ST.read_finished(spark, out, p) for p in ("good", "bad", "report"))
    parts = [("good", good.select(F.col("event").alias("name"), F.lit(1).alias("n"))),
             ("bad", bad.select(F.array_join("failed_rules", ",").alias("name"), F.lit(1).alias("n"))),
             ("report", report.select(F.col("rule").alias("name"), F.col("violations").alias("n")))]
    out = [d.groupBy("name").agg(F.sum("n").cast("bigint").alias("n")).select(F.lit(p).alias("part"), "name", "n") for p, d in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("t16_streaming_item_popularity", """
SELECT epoch_us(time_bucket(INTERVAL '1 day', ts)) AS window_start_us, json_extract_string(props, '$.k') AS item_id,
       COUNT(DISTINCT CAST(user_id AS VARCHAR)) AS popularity
FROM events GROUP BY ALL""")
def t16_streaming_item_popularity(spark, sf_dir):
    """T-16: G-4 (distinct users per item) per day on the stream, exact, via
    idempotent per-epoch distinct keys."""
    src, schema = _event_files(spark, sf_dir)
    s = ST.event_stream(spark, src, schema, max_files_per_trigger=2).select(
        F.window(F.col("ts").cast("timestamp"), "1 day").start.alias("window_start"), "item_id", "user_id")
    out, ck = scratch_path(spark, "pop-out"), scratch_path(spark, "pop-ck")
    ST.run_foreach_batch(s, ST.distinct_keys_writer(out, ["window_start", "item_id", "user_id"]), ck)
    p = ST.windowed_popularity(spark, out)
    return p.select(F.unix_micros("window_start").alias("window_start_us"), "item_id",
                    F.col("popularity").cast("bigint").alias("popularity"))
