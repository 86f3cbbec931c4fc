"""A large Gram in several jobs, and tables that go when a query needs only the train part."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import rankfold.operators.ease as EA
from rankfold.plans import flows
from tests.conftest import SF001


@pytest.mark.parametrize("chunk", [100, 6])
def test_gram_in_rounds_equals_the_product(spark, monkeypatch, chunk):
    rng = np.random.default_rng(2)
    rows = [(f"u{u}", f"i{i}", float(rng.integers(1, 6))) for u in range(30) for i in rng.choice(300, 5 + u % 7)]
    rows += [(f"u{u}", "i0", 1.0) for u in range(30)] + [(None, "i1", 1.0), ("u1", None, 1.0)]  # one item of all users
    for name, value in (("ROUND_PAIRS", 100), ("ROUNDS", 4), ("PAIRS", 60), ("HOT_ITEM", 8)):
        monkeypatch.setattr(EA, name, value)
    jobs, one = [], EA._summed_by_item
    monkeypatch.setattr(EA, "_summed_by_item", lambda *a: jobs.append(a[4]) or one(*a))
    x = np.zeros((30, 300))
    for u, i, w in rows:
        if u and i:
            x[int(u[1:]), int(i[1:])] += w
    train = spark.createDataFrame(rows, "user_id string, item_id string, weight double")
    got = {(r.i, r.j): r.g for r in EA.gram(train, mirror=False, chunk=chunk).collect()}
    g = x.T @ x
    assert len(jobs) == 4 and all(abs(v - g[int(i[1:]), int(j[1:])]) < 1e-9 for (i, j), v in got.items())
    assert len(got) == sum(1 for i in range(300) for j in range(300) if g[i, j] and f"i{i}" <= f"i{j}")


def test_tables_before_the_split_go_and_come_again(spark):
    p = flows.prepared(spark, SF001, "L")
    n, pairs = p.train.count(), p.pairs.count()
    before = list(p._at.values())
    train = p.train_alone()
    assert len(before) == 2 and not any(os.path.exists(at.removeprefix("file:")) for at in before)
    assert train.count() == n and p.pairs.count() == pairs
    assert p.pop.agg(F.sum("popularity")).first()[0] == pairs
