"""Carried scans: the same rows as one pass over a whole series, whatever the blocks."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rankfold.operators import scan
from rankfold.operators import telemetry as T


def _rows(seed=3):
    rng = random.Random(seed)
    rows = []
    for s in ("a", "b", None):
        t = 0
        for _ in range(60):
            t += rng.choice([1, 1, 1, 2, 40])  # gaps longer than a block
            rows.append((s, t, rng.choice([None, rng.randint(0, 9)]), rng.choice([True, True, True, False, None])))
    rows += [("long", t, 5 if t == 0 else None, True) for t in range(50)]  # one run over many blocks
    return rows


@pytest.mark.parametrize("block,fan", [(1, 2), (3, 2), (7, 3), (1000, 1000)])
def test_scans_equal_one_pass(spark, monkeypatch, block, fan):
    monkeypatch.setattr(scan, "FAN", fan)
    rows = _rows()
    df = spark.createDataFrame(rows, "s string, t long, v int, f boolean")
    out = scan.run_length(scan.carry_last(scan.carry_last(df, ["s"], "t", "v", "last", block), ["s"], "t", "v", "prev", block, include=False),
                          ["s"], "t", "f", "run", block)
    got = {(r.s, r.t): (r.last, r.prev, r.run) for r in out.collect()}
    want, last, run = {}, {}, {}
    for s, t, v, f in rows:
        prev = last.get(s)
        last[s] = v if v is not None else prev
        run[s] = run.get(s, 0) + 1 if f else 0
        want[(s, t)] = (last[s], prev, run[s])
    assert got == want


def test_scan_of_an_empty_table(spark):
    df = spark.createDataFrame([], "s string, t timestamp, v int, f boolean")
    assert scan.run_length(df, ["s"], "t", "f", "run", 10).collect() == []
    assert scan.carry_last(df, ["s"], "t", "v", "last", 10).columns == ["s", "t", "v", "f", "last"]


def test_counter_resets_at_block_edges(spark):
    """Samples every half hour, blocks of an hour: the sample before is often in another block."""
    t0 = dt.datetime(2024, 1, 1)
    values = [5.0, 7.0, 2.0, 3.0, 9.0, 1.0, 1.0, 4.0]
    df = spark.createDataFrame([("x", t0 + dt.timedelta(minutes=30 * i), v) for i, v in enumerate(values)], "series string, ts timestamp, value double")
    r = T.counter_rate(df, ("series",), "1 day").collect()
    assert [x.increase for x in r] == [2.0 + 2.0 + 1.0 + 6.0 + 1.0 + 0.0 + 3.0]


def test_plans_have_no_window_over_a_whole_series(spark):
    """Every window but the top level's, which orders one row per million windows, is cut by a block."""
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("x", t0 + dt.timedelta(hours=i), i % 3 > 0) for i in range(30)], "series string, window_start timestamp, cond boolean")
    seen = []
    plain = scan._local
    def watched(d, names, order):
        seen.append((list(names), d.count()))
        return plain(d, names, order)
    scan._local = watched
    try:
        out = T.hold(df, 2, block=4 * 3600.0).collect()
    finally:
        scan._local = plain
    assert [n for n, _ in seen] == [["series", "_block"], ["series", "_block"], ["series"]]
    assert [c for _, c in seen] == [30, 8, 1]
    assert sum(r.firing for r in out) == 10


def test_size_histograms_and_batches(spark):
    t0 = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(t0, "GET", 50, 5000, "b1"), (t0, "GET", 100, None, "b1"), (t0, "GET", 101, 2_000_000, "b2"),
                                 (t0, None, 0, 1, None)], "ts timestamp, method string, req long, resp long, batch string")
    h = {(r.method, r.metric): (r.cum, r["sum"], r["count"]) for r in T.size_histograms(log, {"request": "req", "response": "resp"}, ("method",)).collect()}
    assert h[("GET", "request")] == ([2, 3, 3, 3, 3, 3], 251, 3)
    assert h[("GET", "response")] == ([0, 0, 1, 1, 1, 2], 2_005_000, 2)
    assert h[(None, "request")][0] == [1, 1, 1, 1, 1, 1]
    b = T.batch_sizes(log, ["batch"]).collect()  # rows without a batch are calls of their own
    assert sorted(r.batch_size for r in b) == [1, 1, 2]
    assert T.histogram(T.batch_sizes(log, ["batch"]), "batch_size", T.BATCH_BUCKETS).first().cum[:2] == [2, 3]
