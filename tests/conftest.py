import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from rankfold.session import build_session
    s = build_session("local[*]", shuffle_partitions=8, app_name="rankfold-tests")
    # tests own a private checkpoint folder (on a cluster spark.checkpoint.dir is set)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rankfold-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fx1(spark):
    """FX-1: 3 users x 7 items, 15 pairs (weights as in FIXTURES.md), timestamps in list order."""
    rows = [("u1", "i1", 1), ("u1", "i2", 3), ("u1", "i3", 1), ("u1", "i4", 1), ("u1", "i5", 5),
            ("u2", "i2", 1), ("u2", "i3", 1), ("u2", "i4", 3), ("u2", "i5", 1), ("u2", "i6", 1),
            ("u3", "i1", 1), ("u3", "i3", 1), ("u3", "i5", 3), ("u3", "i6", 1), ("u3", "i7", 1)]
    data = [(u, i, float(w), 1_695_000_000_000 + k * 1000) for k, (u, i, w) in enumerate(rows)]
    from pyspark.sql import functions as F
    df = spark.createDataFrame(data, "user_id string, item_id string, weight double, ms long")
    return df.withColumn("last_ts", F.timestamp_millis("ms")).drop("ms")


@pytest.fixture(scope="session")
def fx2(spark):
    """FX-2: popularity, categories and candidate list of the fairness fixture."""
    pop = spark.createDataFrame([("i1", 10), ("i2", 8), ("i3", 6), ("i4", 3), ("i5", 1)],
                                "item_id string, popularity long")
    cats = spark.createDataFrame([("i1", "electronics"), ("i2", "electronics"), ("i3", "books"),
                                  ("i4", "books"), ("i5", "clothing")], "item_id string, category string")
    cand = spark.createDataFrame([("u1", 1, "i1", 0.9), ("u1", 2, "i2", 0.8), ("u1", 3, "i3", 0.7),
                                  ("u1", 4, "i4", 0.6), ("u1", 5, "i5", 0.5)],
                                 "user_id string, rank int, item_id string, score double")
    return pop, cats, cand
