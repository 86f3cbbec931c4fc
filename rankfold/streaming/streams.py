"""Structured Streaming versions of the stream-capable operators.

* ``event_stream``: A-9, a file stream with a fixed schema.
* ``windowed_interactions`` / ``windowed_counts``: T-16 — G-1 / G-5 per event
  time window with a watermark and ``dropDuplicatesWithinWatermark`` on the
  event id (state is bounded by the watermark).
* ``quality_batch_writer``: Q-10 on a stream via ``foreachBatch``.
* ``upsert_batch_writer``: per-epoch partial aggregates written idempotently
  (overwrite of ``epoch=<id>``), so a retried micro-batch never double counts.
* ``error_alerts``: T-11 on the stream: a windowed count with a watermark, then
  the ``for:`` hold in ``transformWithState`` with event-time timers, so it goes on
  and ends as time passes, also without events. ``error_hold`` is the batch form.
* ``late_rows_writer``: T-16, rows behind the watermark to a side table.
* ``quarantine_batch_writer``: Q-10, a micro-batch split into good, bad and report.

All writers target the shared folder; the checkpoint location makes restarts
exactly-once for the file sinks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rankfold.functions.exprs import event_weight
from rankfold.session import session_setting


def event_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A-9: the event log as a stream (new files are new micro-batches)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def with_event_time(stream: DataFrame, ts: str = "ts", watermark: str = "1 day") -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ): cast, then watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)


def windowed_interactions(stream: DataFrame, weights: dict, default: float = 1.0, window: str = "1 day",
                          watermark: str = "1 day", ts: str = "ts", dedup_key: str = "event_id") -> DataFrame:
    """T-16: G-1 per event-time window, deduplicated by event id."""
    s = with_event_time(stream, ts, watermark).dropDuplicatesWithinWatermark([dedup_key])
    s = s.withColumn("weight", event_weight("event", weights, default))
    return (s.groupBy(F.window(ts, window).alias("w"), "user_id", "item_id")
             .agg(F.sum("weight").alias("weight"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_events"))
             .select(F.col("w.start").alias("window_start"), "user_id", "item_id", "weight", "last_ts", "n_events"))


def windowed_counts(stream: DataFrame, key: str, window: str = "1 day", watermark: str = "1 day",
                    ts: str = "ts") -> DataFrame:
    """T-16: G-5 (event type counts) per event-time window."""
    s = with_event_time(stream, ts, watermark)
    return (s.groupBy(F.window(ts, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
             .select(F.col("w.start").alias("window_start"), key, "n"))


def run_to_completion(df: DataFrame, path: str, checkpoint: str, mode: str = "append",
                      fmt: str = "parquet") -> None:
    """Process everything available now into a file sink, then stop."""
    q = (df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).start(path))
    q.awaitTermination()  # raises what the stream raised; however long it takes, the sink is whole


def run_foreach_batch(df: DataFrame, fn, checkpoint: str, mode: str = "append") -> None:
    q = (df.writeStream.foreachBatch(fn).outputMode(mode).option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).start())
    q.awaitTermination()  # raises what the stream raised; however long it takes, the sink is whole


def quality_batch_writer(rules, path: str):
    """Q-10 on a stream: each micro-batch's rule report, tagged with its epoch
    (overwritten per epoch, so a replayed batch is not counted twice)."""
    from rankfold.operators.quality import check

    def write(batch: DataFrame, epoch_id: int):
        rep = check(batch, rules).withColumn("epoch", F.lit(epoch_id))
        rep.write.mode("overwrite").parquet(f"{path}/epoch={epoch_id}")
    return write


def upsert_batch_writer(path: str, keys=("user_id", "item_id")):
    """Idempotent per-epoch partial aggregates of (weight, n_events, last_ts)."""
    def write(batch: DataFrame, epoch_id: int):
        agg = batch.groupBy(*keys).agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n_events"),
                                       F.max("ts").alias("last_ts"))
        agg.write.mode("overwrite").parquet(f"{path}/epoch={epoch_id}")
    return write


def read_upserted(spark: SparkSession, path: str, keys=("user_id", "item_id")) -> DataFrame:
    """Current table = merge of all epoch partials (sum / max)."""
    p = spark.read.parquet(path)
    return p.groupBy(*keys).agg(F.sum("weight").alias("weight"), F.sum("n_events").alias("n_events"),
                                F.max("last_ts").alias("last_ts"))


def error_counts(stream: DataFrame, series: str = "endpoint", window_s: int = 3600, watermark: str = "1 day",
                 ts: str = "ts", bad: str = "is_error") -> DataFrame:
    """T-11 on a stream, first half: total and bad events per series and window.

    A native windowed aggregate (partial counts before the shuffle, so a hot
    series is not one task); state is bounded by the watermark, which alone
    decides which rows are late.
    """
    s = with_event_time(stream, ts, watermark)
    return (s.groupBy(F.window(ts, f"{window_s} seconds").alias("w"), F.col(series).cast("string").alias("series"))
             .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(bad)).alias("bad"))
             .select("series", F.unix_micros(F.col("w.start")).alias("window_start_us"), "total", "bad"))


def error_hold(counts: DataFrame, window_s: int = 3600, threshold: float = 0.25, hold_windows: int = 2,
               now_us: int | None = None) -> DataFrame:
    """T-11, second half, over the counts the stream keeps (one row per series
    and window): cond = bad / total > threshold; firing once cond held
    ``hold_windows`` windows; windows without events are cond = false.

    A window is closed once the clock ``now_us`` is past its end, whether or
    not later events came; without a clock, a series' own last window is open.
    """
    from rankfold.operators.telemetry import hold
    w_us = window_s * 1_000_000
    span = counts.groupBy("series").agg(F.min("window_start_us").alias("lo"), F.max("window_start_us").alias("hi"))
    top = F.col("hi") - w_us if now_us is None else F.lit((now_us // w_us - 1) * w_us)
    grid = span.where(top >= F.col("lo")).select(
        "series", F.explode(F.sequence("lo", top.cast("long"), F.lit(w_us))).alias("window_start_us"))
    c = grid.join(counts, ["series", "window_start_us"], "left").fillna({"total": 0, "bad": 0})
    c = c.withColumn("cond", (F.col("total") > 0) & (F.col("bad") > F.lit(threshold) * F.col("total")))
    return hold(c, hold_windows, order="window_start_us", block=1000.0 * w_us).select(
        "series", "window_start_us", "total", "bad", "cond", F.col("held_windows").cast("long").alias("held_windows"), "firing")


class ErrorHold(StatefulProcessor):
    """The ``for:`` hold of one series over its closed windows: one number pair of
    state. Windows without events have no row; a timer at the end of the window
    that follows the last one known gives them out once the watermark is past it."""

    def __init__(self, window_us: int, threshold: float, hold_windows: int):
        self.window_us, self.threshold, self.hold_windows = window_us, threshold, hold_windows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "start_us long, held long")

    def _row(self, series, start, total, bad, held):
        cond = total > 0 and bad > self.threshold * total
        held = held + 1 if cond else 0
        return held, Row(series=series, window_start_us=start, total=total, bad=bad, cond=cond, held_windows=held,
                         firing=cond and held >= self.hold_windows)

    def _empty_until(self, series, last, held, end):
        """Windows without events after ``last`` that end by ``end``."""
        while last + 2 * self.window_us <= end:
            last += self.window_us
            held, row = self._row(series, last, 0, 0, held)
            yield last, held, row

    def _wait(self, last):
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + 2 * self.window_us) // 1000)

    def handleInputRows(self, key, rows, timerValues):
        series, = key
        last, held = self.last.get() if self.last.exists() else (None, 0)
        for r in sorted(rows, key=lambda r: r.window_start_us):
            if last is not None:
                for last, held, row in self._empty_until(series, last, held, r.window_start_us):
                    yield row
            last = r.window_start_us
            held, row = self._row(series, last, r.total, r.bad, held)
            yield row
        self.last.update((last, held))
        self._wait(last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        series, = key
        last, held = self.last.get()
        for last, held, row in self._empty_until(series, last, held, timerValues.getCurrentWatermarkInMs() * 1000):
            yield row
        self.last.update((last, held))
        self._wait(last)

    def close(self) -> None:
        pass


def error_alerts(stream: DataFrame, series: str = "endpoint", window_s: int = 3600, threshold: float = 0.25, hold_windows: int = 2,
                 watermark: str = "2 hours", ts: str = "ts", bad: str = "is_error") -> DataFrame:
    """T-11 on the stream: a row for every closed window of a series, also those
    without events, with the hold so far; ``firing`` once it is long enough.
    Append mode; the counts are partial aggregates, a series' task sees one row per window.
    Run it with ``rocks_state``."""
    s = with_event_time(stream, ts, watermark)
    counts = s.groupBy(F.window(ts, f"{window_s} seconds").alias("w"), F.col(series).cast("string").alias("series")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(bad)).alias("bad"))
    closed = counts.select("series", F.window_time("w").alias("at"), F.unix_micros(F.col("w.start")).alias("window_start_us"), "total", "bad")
    return closed.groupBy("series").transformWithState(
        ErrorHold(window_s * 1_000_000, threshold, hold_windows),
        "series string, window_start_us long, total long, bad long, cond boolean, held_windows long, firing boolean", "append", "EventTime")


def rocks_state(spark: SparkSession):
    """For the streams started inside: state in RocksDB, which ``transformWithState`` asks for."""
    return session_setting(spark, "spark.sql.streaming.stateStore.providerClass",
                           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def late_rows_writer(path: str, delay_s: int, ts: str = "ts"):
    """T-16: each micro-batch's rows at or behind the watermark (the greatest time of the
    epochs before, less the delay) to ``late/epoch=<id>``, and the batch's own
    greatest time to ``marks/epoch=<id>``. Both are overwritten when an epoch is replayed."""
    def write(batch: DataFrame, epoch_id: int):
        spark = batch.sparkSession
        marks = [r["at"] for r in spark.read.schema("at timestamp, epoch long").parquet(f"{path}/marks").where(F.col("epoch") < epoch_id)
                 .agg(F.max("at").alias("at")).collect()] if epoch_id else [None]  # one value
        rows = batch.withColumn("_at", F.col(ts).cast("timestamp"))
        late = F.lit(False) if marks[0] is None else F.col("_at") <= F.lit(marks[0]) - F.expr(f"INTERVAL {int(delay_s)} SECONDS")
        rows.where(late).drop("_at").write.mode("overwrite").parquet(f"{path}/late/epoch={epoch_id}")
        rows.agg(F.max("_at").alias("at")).write.mode("overwrite").parquet(f"{path}/marks/epoch={epoch_id}")
    return write


def quarantine_batch_writer(rules, path: str):
    """Q-10 on a stream: each micro-batch goes to ``good``, ``bad`` (with the names of
    the failed rules) and ``report`` under its epoch. A replayed epoch is
    overwritten; ``done/epoch=<id>`` is written last, and readers take finished epochs only."""
    from rankfold.operators.quality import check, quarantine

    def write(batch: DataFrame, epoch_id: int):
        good, bad = quarantine(batch, rules)
        good.write.mode("overwrite").parquet(f"{path}/good/epoch={epoch_id}")
        bad.write.mode("overwrite").parquet(f"{path}/bad/epoch={epoch_id}")
        check(batch, rules).write.mode("overwrite").parquet(f"{path}/report/epoch={epoch_id}")
        batch.sparkSession.range(1).select(F.lit(epoch_id).alias("n")).write.mode("overwrite").parquet(f"{path}/done/epoch={epoch_id}")
    return write


def read_finished(spark: SparkSession, path: str, part: str) -> DataFrame:
    """``good``, ``bad`` or ``report`` of the epochs whose three sinks are whole."""
    return spark.read.parquet(f"{path}/{part}").join(spark.read.parquet(f"{path}/done").select("epoch"), "epoch", "left_semi").drop("epoch")


def latest_batch_writer(path: str):
    """Update-mode sink: each epoch's updated aggregate rows, overwritten per epoch."""
    def write(batch: DataFrame, epoch_id: int):
        batch.withColumn("_epoch", F.lit(epoch_id)).write.mode("overwrite").parquet(f"{path}/epoch={epoch_id}")
    return write


def read_latest(spark: SparkSession, path: str, keys) -> DataFrame:
    """Current value per key = the row of the latest epoch that updated it."""
    from pyspark.sql import Window
    p = spark.read.parquet(path)
    w = Window.partitionBy(*keys).orderBy(F.desc("_epoch"))
    return p.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r", "_epoch", "epoch")


def distinct_keys_writer(path: str, keys):
    """Per-epoch distinct keys (overwrite ``epoch=<id>``): exact distinct counts
    on a stream without unbounded operator state — the sink holds the keys."""
    def write(batch: DataFrame, epoch_id: int):
        batch.select(*keys).distinct().write.mode("overwrite").parquet(f"{path}/epoch={epoch_id}")
    return write


def windowed_popularity(spark: SparkSession, path: str, window_col: str = "window_start",
                        item: str = "item_id", user: str = "user_id") -> DataFrame:
    """T-16 / G-4: distinct users per item and window from the per-epoch keys."""
    k = spark.read.parquet(path).select(window_col, item, user).distinct()
    return k.groupBy(window_col, item).agg(F.count(F.lit(1)).alias("popularity"))
