"""FX-4 data-quality rows, streaming = batch, driver contract."""
import pytest
from pyspark.sql import functions as F

from rankfold.operators import quality as DQ
from rankfold.sources.io import EVENTS


def _events(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def test_event_contract_accepts_and_rejects(spark):
    good = [(1695000000000, 12345, "view", 456.0, None), (1695000001000, 67890, "addtocart", 789.0, None),
            (1695000002000, 11111, "transaction", 999.0, 42.0)]
    bad = [(1695000003000, 1, "purchase", 1.0, None), (1695000004000, -1, "view", 1.0, None),
           (1695000005000, 0, "view", 1.0, None)]
    rules = DQ.event_rules()
    rep = {r.rule: r for r in DQ.check(_events(spark, good), rules).collect()}
    assert all(r.passed for r in rep.values())
    g, b = DQ.quarantine(_events(spark, good + bad), rules)
    assert g.count() == 3
    failed = sorted(tuple(r.failed_rules) for r in b.collect())
    assert failed == [("event_enum",), ("visitor_positive",), ("visitor_positive",)]


def test_interaction_and_recommendation_contracts(spark):
    inter = spark.createDataFrame([("u", "a", 1.0), ("u", "b", 5.0), ("u", "c", 3.0), ("v", "a", 50.0),
                                   ("v", "b", 0.0), ("v", "c", -1.0), ("v", "c", 2.0)],
                                  "user_id string, item_id string, weight double")
    rep = {r.rule: r.violations for r in DQ.check(inter, DQ.interaction_rules()).collect()}
    assert rep["weight_range"] == 2 and rep["pair_unique"] == 2
    recs = spark.createDataFrame([("p1", 0.0), ("p2", 0.7), ("p3", 0.9), ("p4", 1.0), ("", 0.5), ("p5", 1.5), ("p6", -0.1)],
                                 "product_id string, score double")
    rep = {r.rule: r.violations for r in DQ.check(recs, DQ.recommendation_rules()).collect()}
    assert rep["score_range"] == 2 and rep["product_non_empty"] == 1


def test_stream_counts_equal_batch(spark, tmp_path):
    from rankfold.streaming import streams as ST
    from rankfold.sources import testtables as TT
    ev = TT.events_e(spark, "/root/testdata/sf0.001").select("event_id", "ts", "user_id", "item_id", "event")
    src = str(tmp_path / "src")
    ev.repartitionByRange(4, "ts").write.parquet(src)
    s = ST.event_stream(spark, src, ev.schema, max_files_per_trigger=1)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    ST.run_foreach_batch(ST.windowed_counts(s, "event", "1 day", "31 days"), ST.latest_batch_writer(out), ck, "update")
    got = {(r.window_start, r.event): r.n for r in ST.read_latest(spark, out, ["window_start", "event"]).collect()}
    b = ev.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day").start.alias("w"), "event").count()
    assert got == {(r.w, r.event): r["count"] for r in b.collect()}


def test_stream_hold_equals_batch_hold(spark, tmp_path):
    from rankfold.operators import telemetry as T
    from rankfold.sources import testtables as TT
    from rankfold.streaming import streams as ST
    lg = TT.request_log(spark, "/root/testdata/sf0.001").select("ts", "status")
    src = str(tmp_path / "log")
    lg.write.parquet(src)
    s = ST.event_stream(spark, src, lg.schema, max_files_per_trigger=1).select(F.lit("all").alias("series"), "ts",
                                                      (F.col("status") >= 500).alias("is_error"))
    out, ck = str(tmp_path / "hold"), str(tmp_path / "hold-ck")
    ST.run_foreach_batch(ST.error_counts(s, "series", 3600, "31 days"), ST.latest_batch_writer(out), ck, mode="update")
    counts = ST.read_latest(spark, out, ["series", "window_start_us"])
    got = {r.window_start_us: (r.cond, r.held_windows, r.firing) for r in ST.error_hold(counts, 3600, 0.25, 2).collect()}
    r = T.ratio(lg, F.col("status") >= 500)
    grid = T.window_grid(lg, "1 hour")
    c = grid.join(r, "window_start", "left").select(
        "window_start", F.coalesce(F.col("ratio") > 0.25, F.lit(False)).alias("cond"), F.lit("all").alias("series"))
    h = T.hold(c, 2).select(F.unix_micros(F.col("window_start").cast("timestamp")).alias("w"), "cond", "held_windows", "firing")
    batch = {x.w: (x.cond, x.held_windows, x.firing) for x in h.collect()}
    last = max(batch)
    del batch[last]  # the stream keeps the last window open
    assert got == batch


def test_histogram_quantile_matches_bucket_interpolation(spark):
    from rankfold.operators import telemetry as T
    df = spark.createDataFrame([([0.1, 0.5, 1.0, float("inf")], [2, 6, 9, 10])], "le array<double>, cum array<long>")
    q = df.select(T.histogram_quantile(0.5, F.col("le"), F.col("cum")).alias("a"),
                  T.histogram_quantile(0.95, F.col("le"), F.col("cum")).alias("b")).first()
    assert q.a == pytest.approx(0.1 + 0.4 * (5 - 2) / 4)
    assert q.b == pytest.approx(1.0)  # rank in the +Inf bucket -> highest finite bound


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() == 1 and "ndcg_at_k" in df.columns
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 140


def test_recommend_cold_start_and_validation(spark):
    from rankfold.operators import recommend as R
    from rankfold.plans import flows
    p, b = flows.bundle(spark, "/root/testdata/sf0.001", "E", ease=False, factors=True)
    users = spark.createDataFrame([(u,) for u in ["user123", "new_user_xyz", "0", "999999999",
                                                  "completely_new_user_12345_not_in_training"]], "user_id string")
    for kind in ("collaborative", "content_based", "hybrid"):
        out = R.recommend(users, b, 5, kind).collect()
        per = {}
        for r in out:
            per.setdefault(r.user_id, []).append(r)
        assert set(per) == {r.user_id for r in users.collect()}
        for lst in per.values():
            assert 0 < len(lst) <= 5 and len({r.product_id for r in lst}) == len(lst)
            assert all(0.0 <= r.score <= 1.0 for r in lst)
    with pytest.raises(ValueError):
        R.recommend(users, b, 5, "unknown")
    with pytest.raises(ValueError):
        R.recommend(users, b, 101, "hybrid")


def test_sources_missing_files_and_bundle(spark, tmp_path):
    from rankfold.sources import io as IO
    with pytest.raises(Exception):
        IO.read_events(spark, str(tmp_path / "no_such_events.csv"), fmt="csv").count()
    p1 = str(tmp_path / "part1")
    spark.createDataFrame([(1, 5, "categoryid", "a")], IO.PROPERTIES).write.option("header", True).csv(p1)
    got = IO.read_properties(spark, [p1, str(tmp_path / "part2_missing")])
    assert got.count() == 1
    assert IO.read_properties(spark, [str(tmp_path / "none")]).count() == 0
    with pytest.raises(RuntimeError, match="not initialised"):
        IO.load_bundle(spark, str(tmp_path / "no_bundle"))


def _small_bundle(spark, k):
    from rankfold.operators.ease import Weights
    from rankfold.operators.model import Bundle
    one = lambda n: spark.range(n).selectExpr("cast(id AS string) AS item_id")
    tiles = spark.createDataFrame([(0, 0, bytearray(8 * k * k))], "i int, j int, a binary")
    return Bundle(train=one(k), pop=one(k), items=one(k), class_vec=one(k), collab_weight=0.5,
                  B=Weights(spark.range(k).selectExpr("cast(id AS string) AS item_id", "id AS idx", "1.0D AS scale"), tiles, k, k))


def test_a_save_that_dies_leaves_the_former_bundle(spark, tmp_path, monkeypatch):
    from rankfold.sources import io as IO
    path = str(tmp_path / "model")
    IO.save_bundle(_small_bundle(spark, 3), path, {"hybrid_collab_weight": 0.5})

    def rows():
        b, meta = IO.load_bundle(spark, path)
        return (b.train.count(), b.pop.count(), b.items.count(), b.class_vec.count(), b.B.items.count(), b.B.n, b.B.tile, b.collab_weight)
    assert rows() == (3, 3, 3, 3, 3, 3, 3, 0.5)
    parts = IO._bundle_parts(_small_bundle(spark, 5))
    for dies in [*parts, "_publish"]:  # after any table, and with all tables but no pointer
        def broken(bundle, dies=dies):
            out = dict(IO_parts(bundle))
            if dies in out:
                def write(df, at):
                    raise OSError(dies)
                out[dies] = (out[dies][0], write)
            return out
        IO_parts = IO._bundle_parts
        with monkeypatch.context() as m:
            m.setattr(IO, "_bundle_parts", broken)
            if dies == "_publish":
                m.setattr(IO, "_publish", lambda *a: (_ for _ in ()).throw(OSError("_publish")))
            with pytest.raises(OSError, match=dies):
                IO.save_bundle(_small_bundle(spark, 5), path, {})
        assert rows() == (3, 3, 3, 3, 3, 3, 3, 0.5)
    IO.save_bundle(_small_bundle(spark, 4), path, {})
    assert rows()[:7] == (4,) * 7
    version = IO.save_bundle(_small_bundle(spark, 6), path, {})
    assert rows()[0] == 6 and len([p for p in (tmp_path / "model" / "versions").iterdir()]) == 2  # older and unfinished ones are gone
    spark.range(2).selectExpr("cast(id AS string) AS item_id").write.mode("overwrite").parquet(f"{path}/versions/{version}/pop")
    with pytest.raises(RuntimeError, match="not initialised"):
        IO.load_bundle(spark, path)


def test_bundle_roundtrip_counts_the_class_pairs(spark, tmp_path):
    from rankfold.plans.q_sources import a5_a6_bundle_roundtrip
    rows = [(10 * u + i, u, f'{{"k": "{i}"}}', "view", 86_400 * i + u) for u in range(4) for i in range(6)]
    (spark.createDataFrame(rows, "event_id long, user_id long, props string, event_type string, s long")
        .selectExpr("event_id", "user_id", "props", "event_type", "timestamp_seconds(s) AS ts").write.parquet(str(tmp_path / "events.parquet")))
    spark.createDataFrame([(i, "abc"[i % 3] * 3) for i in range(6)], "p_partkey long, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["table"]: r.n_rows for r in a5_a6_bundle_roundtrip(spark, str(tmp_path)).collect()}
    assert got["class_sim"] == 9 and got["class_vec"] == 6  # three classes, all with popular_low
    assert got["item_class"] == 6


def test_run_rows_rename_at(spark):
    from rankfold.sources import io as IO
    m = spark.createDataFrame([(0.5, 3)], "`precision@10` double, n long")
    rows = {r.key: r.value for r in IO.run_rows(spark, m, "hybrid", {"k": 10}, run_id="r1").collect()}
    assert rows["precision_at_10"] == "0.5" and rows["k"] == "10" and rows["n"] == "3.0"


def test_histogram_quantile_edges(spark):
    from rankfold.operators import telemetry as T
    df = spark.createDataFrame([([0.5, 1.0, float("inf")], [0, 0, 0]), ([0.5, 1.0, float("inf")], [4, 4, 4])],
                               "le array<double>, cum array<long>")
    got = [r.q for r in df.select(T.histogram_quantile(0.5, F.col("le"), F.col("cum")).alias("q")).collect()]
    assert got[0] is None                    # empty histogram
    assert got[1] == pytest.approx(0.25)     # first bucket interpolates from 0


def test_stream_hold_counts_every_shuffled_row(spark, tmp_path):
    """More rows per series than an Arrow chunk or a micro-batch holds, in no order."""
    from rankfold.streaming import streams as ST
    src = str(tmp_path / "src")
    ev = spark.range(60_000).select(
        F.concat(F.lit("s"), F.col("id") % 2).alias("series"), F.timestamp_seconds(F.col("id") * 7).alias("ts"), (F.col("id") % 3 == 0).alias("is_error"))
    ev.orderBy(F.xxhash64("ts")).repartition(6).write.parquet(src)
    s = ST.event_stream(spark, src, ev.schema, max_files_per_trigger=1)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    ST.run_foreach_batch(ST.error_counts(s, "series", 3600, "31 days"), ST.latest_batch_writer(out), ck, mode="update")
    counts = ST.read_latest(spark, out, ["series", "window_start_us"])
    held = ST.error_hold(counts, 3600, 0.25, 2, now_us=60_000 * 7 * 1_000_000 + 3_600_000_000).collect()
    assert sum(r.total for r in held) == 60_000 and sum(r.bad for r in held) == 20_000  # the clock closes the last window too
    still_open = ST.error_hold(counts, 3600, 0.25, 2).collect()
    assert len(still_open) == len(held) - 2


def test_stream_hold_drops_late_rows_only(spark, tmp_path):
    from rankfold.streaming import streams as ST
    src = str(tmp_path / "src")
    hour = 3600
    # a batch's late rows are told by the watermark before it began; 5 s is 30 hours late, 29 h is within the watermark
    for times in ([0, 10, 2 * hour], [30 * hour], [30 * hour + 10], [5, 29 * hour + 1], [31 * hour]):
        spark.createDataFrame([("a", t, True) for t in times], "series string, t long, is_error boolean").select(
            "series", F.timestamp_seconds("t").alias("ts"), "is_error").coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    c = ST.error_counts(ST.event_stream(spark, src, schema, max_files_per_trigger=1), "series", hour, "2 hours")
    ST.run_foreach_batch(c, ST.latest_batch_writer(out), ck, mode="update")
    got = {r.window_start_us // (hour * 1_000_000): r.total for r in ST.read_latest(spark, out, ["series", "window_start_us"]).collect()}
    assert got == {0: 2, 2: 1, 30: 2, 29: 1, 31: 1}


def _requests(spark, rows):
    """(minute, status, duration, score, version) -> request log of one user and endpoint."""
    from datetime import datetime, timedelta
    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(t0 + timedelta(minutes=m), "e", s, d, "t", x, v, f"u{k}") for k, (m, s, d, x, v) in enumerate(rows)],
        "ts timestamp, endpoint string, status int, duration_s double, recommendation_type string, score double, "
        "model_version string, user_id string")


def test_alert_rules_hold_over_several_windows(spark):
    from rankfold.operators import telemetry as T
    from rankfold.plans.q_telemetry import RULES
    # one request in each of the first four 5-minute windows, none in the next two, then a failing one without a model
    lg = _requests(spark, [(0, 200, 0.2, 0.5, "v1"), (5, 200, 0.2, 0.5, "v1"), (10, 200, 0.2, 0.5, "v1"), (15, 200, 0.2, 0.5, "v1"),
                           (30, 500, 0.2, 0.5, None)])
    rules = spark.createDataFrame(RULES, "name string, metric string, op string, threshold double, hold_s long, severity string")
    rows = T.evaluate_rules(T.rule_metrics(lg), rules, "5 minutes").collect()
    firing = {}
    for r in sorted(rows, key=lambda r: r.window_start):
        firing.setdefault(r.name, []).append(r.firing)
    assert set(firing) == {r[0] for r in RULES} and all(len(v) == 7 for v in firing.values())
    assert firing["LowRequestRate"] == [False] + [True] * 6         # 1 request / 300 s, held two windows
    assert firing["LowPredictionVolume"] == [False] * 2 + [True] * 5  # held three windows
    assert firing["APIDown"] == [False] * 4 + [True, True, False]
    assert firing["ModelNotLoaded"] == [False] * 4 + [True] * 3
    assert firing["HighErrorRate"] == [False] * 6 + [True]
    assert firing["PredictionLatencyHigh"] == [True] * 4 + [False, False, True]
    assert firing["LowCacheHitRate"] == [False, True, True, True, False, False, False]  # a window without requests ends the hold
    assert not any(firing["HighLatency"] + firing["HighRequestRate"] + firing["ModelStale"] + firing["PredictionDistributionAnomaly"])


def test_model_age_and_score_shift_hold(spark):
    from rankfold.operators import telemetry as T
    from rankfold.plans.q_telemetry import RULES
    week = 7 * 24 * 60
    lg = _requests(spark, [(0, 200, 0.05, 0.15, "v1"), (24 * 60, 200, 0.05, 0.95, "v1"), (week + 90, 200, 0.05, 0.95, "v1")])
    rules = spark.createDataFrame(RULES, "name string, metric string, op string, threshold double, hold_s long, severity string")
    a = T.evaluate_rules(T.rule_metrics(lg), rules, "5 minutes").where("firing")
    minute = lambda name: sorted(int(r.m) for r in a.where(F.col("name") == name).select(
        ((F.unix_seconds("window_start") - 1704067200) / 60).alias("m")).collect())
    # older than a week from the window ending 5 minutes past it, held twelve windows
    assert minute("ModelStale") == list(range(week + 55, week + 91, 5))
    # the hour's median moved from 0.15 to 0.95 within a day: twelve windows, six of them to hold
    assert minute("PredictionDistributionAnomaly") == list(range(24 * 60 + 25, 24 * 60 + 56, 5))


def test_window_grid_is_dense_over_many_blocks(spark):
    from rankfold.operators import telemetry as T
    lg = _requests(spark, [(0, 200, 0.1, 0.5, "v"), (5 * 2500 + 1, 200, 0.1, 0.5, "v")])
    g = T.window_grid(lg, "5 minutes")
    assert (g.count(), g.distinct().count()) == (2501, 2501)
    s = spark.createDataFrame([("a",), ("b",)], "endpoint string")
    assert sorted(map(tuple, T.window_grid(lg, "5 minutes", series=s).groupBy("endpoint").count().collect())) == [("a", 2501), ("b", 2501)]
    assert T.window_grid(lg.limit(0), "5 minutes").count() == 0


def _files(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_alerts_go_on_and_end_as_time_passes(spark, tmp_path):
    """A hold over three windows, across a restart; a series that falls silent is
    followed by windows without events while another series moves the clock."""
    import datetime as dt
    from rankfold.streaming import streams as ST
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    day = dt.datetime(2024, 1, 1)
    schema = "endpoint string, ts timestamp, is_error boolean"
    at = lambda h, m=5: day + dt.timedelta(hours=h, minutes=m)
    first = [("a", at(h), True) for h in range(3)] + [("b", at(h), False) for h in range(4)]
    second = [("a", at(4), True)] + [("b", at(h), False) for h in range(4, 13)]

    def run():
        with ST.rocks_state(spark):
            ST.run_to_completion(ST.error_alerts(ST.event_stream(spark, src, spark.createDataFrame([], schema).schema), hold_windows=2), out, ck)
    seen = []
    for rows in (first, second):
        _files(spark, src, rows, schema)
        run()
        seen.append({(r.series, r.window_start_us // 3_600_000_000): (r.total, r.held_windows, r.firing) for r in spark.read.parquet(out).collect()})
    base = int(day.replace(tzinfo=dt.timezone.utc).timestamp()) // 3600
    early = {h - base: v for (s, h), v in seen[0].items() if s == "a"}
    assert early == {0: (1, 1, False)}  # the clock stands at 01:05
    got = {h - base: v for (s, h), v in seen[1].items() if s == "a"}
    assert got == {0: (1, 1, False), 1: (1, 2, True), 2: (1, 3, True), 3: (0, 0, False), 4: (1, 1, False), 5: (0, 0, False),
                   6: (0, 0, False), 7: (0, 0, False), 8: (0, 0, False), 9: (0, 0, False)}  # 10:05 by the end
    assert spark.read.parquet(out).count() == len(seen[1])  # no window twice


def test_state_leaves_behind_the_watermark(spark, tmp_path):
    """Thirty days through a watermark of one: the rows of state stay those of about two days, and late rows are put aside once."""
    import datetime as dt
    from rankfold.streaming import streams as ST
    src, out, ck, side, ck2 = (str(tmp_path / x) for x in ("src", "out", "ck", "side", "ck2"))
    schema = "event_id long, ts timestamp"
    day, most = dt.datetime(2024, 1, 1), 0
    empty = spark.createDataFrame([], schema).schema
    for k in range(6):
        rows = [(k * 1000 + n, day + dt.timedelta(days=5 * k, minutes=72 * n)) for n in range(100)]
        rows += rows[:7] + ([(99, day + dt.timedelta(hours=1))] if k == 4 else [])  # repeats, and one late row
        _files(spark, src, rows, schema)
        s = ST.with_event_time(ST.event_stream(spark, src, empty), "ts", "1 day").dropDuplicatesWithinWatermark(["event_id"])
        q = (s.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("at"), "n")
             .writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out))
        q.awaitTermination()
        most = max([most, *[op["numRowsTotal"] for op in q.lastProgress["stateOperators"]]])
        write = ST.late_rows_writer(side, 86_400)
        ST.run_foreach_batch(ST.event_stream(spark, src, empty), lambda b, e: (write(b, e), write(b, e))[0], ck2)  # each epoch twice
    counts = {r["at"]: r.n for r in spark.read.parquet(out).collect()}
    assert len(counts) == 28 and set(counts.values()) == {20}
    assert most <= 45  # of 600 events: those within the watermark
    late = spark.read.schema(schema).parquet(f"{side}/late").collect()
    assert [r.event_id for r in late] == [99]


def test_a_replayed_epoch_changes_no_sink(spark, tmp_path):
    from rankfold.operators import quality as DQ
    from rankfold.streaming import streams as ST
    path = str(tmp_path / "q")
    rules = [DQ.NotNull("u_not_null", "u"), DQ.Between("w_range", "w", low=0)]
    write = ST.quarantine_batch_writer(rules, path)
    first = spark.createDataFrame([("a", 1.0), (None, -1.0), ("b", -2.0)], "u string, w double")
    second = spark.createDataFrame([("c", 3.0), (None, 1.0)], "u string, w double")
    for epoch, batch in ((0, first), (1, second), (1, second)):
        write(batch, epoch)
    first.write.parquet(f"{path}/good/epoch=2")  # an epoch that died after its first sink

    def state():
        good, bad, rep = (ST.read_finished(spark, path, p) for p in ("good", "bad", "report"))
        return (sorted(r.u for r in good.collect()), sorted(",".join(r.failed_rules) for r in bad.collect()),
                {r.rule: r.v for r in rep.groupBy("rule").agg(F.sum("violations").alias("v")).collect()})
    assert state() == (["a", "c"], ["u_not_null", "u_not_null,w_range", "w_range"], {"u_not_null": 2, "w_range": 2})
    write(first, 0)
    assert state()[0] == ["a", "c"]
