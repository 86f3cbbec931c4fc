"""Lists and pairs are made once, however many parts of a report read them;
nearest users are found in single precision and ranked in double."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfold.operators import ease as EA
from rankfold.operators import explain as X
from rankfold.operators import factors as FX
from rankfold.operators import fairness as FA


def counted(df, seen):
    """``df``, adding to ``seen`` the rows that are made of it."""
    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    return df.mapInArrow(run, df.schema)


@pytest.fixture(scope="module")
def train(spark):
    rows = [(f"u{u}", f"i{(u * 3 + j * j) % 11}", float(1 + j % 3)) for u in range(12) for j in range(6)]
    return spark.createDataFrame(rows, "user_id string, item_id string, weight double").dropDuplicates(["user_id", "item_id"])


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(f"u{u}", f"i{(u + k) % 12}") for u in range(14) for k in range(3)], "user_id string, item_id string")


@pytest.fixture(scope="module")
def B(train):
    return EA.ease_fit(train, 2.0)


def test_ease_explanation_makes_pairs_once(spark, train, pairs, B):
    seen = spark.sparkContext.accumulator(0)
    got = X.explain_ease(counted(pairs, seen), train, B, train).collect()
    assert (seen.value, len(got)) == (42, 42)
    assert sorted(map(str, got)) == sorted(map(str, X.explain_ease(pairs, train, B, train).collect()))


def test_weights_looked_up_alike_when_not_broadcast(train, pairs, B, monkeypatch):
    few = sorted(map(str, X.ease_contributions(pairs, train, B).collect()))
    monkeypatch.setattr(EA, "FOUND", 0)
    assert few and sorted(map(str, X.ease_contributions(pairs, train, B).collect())) == few


def test_neighbour_explanation_makes_pairs_once(spark, train, pairs):
    rng, seen = np.random.default_rng(3), spark.sparkContext.accumulator(0)
    uf = spark.createDataFrame([(f"u{u}", rng.normal(size=4).tolist()) for u in range(13)], "id string, factor array<double>")
    got = X.explain_neighbors(counted(pairs, seen), uf, train, 2, 3).collect()
    assert (seen.value, len(got)) == (42, 42)
    assert sorted(map(str, got)) == sorted(map(str, X.explain_neighbors(pairs, uf, train, 2, 3).collect()))


def test_user_fairness_makes_lists_once(spark, pairs):
    seen = spark.sparkContext.accumulator(0)
    pop = spark.createDataFrame([(f"i{i}", i) for i in range(11)], "item_id string, popularity long")
    cats = spark.createDataFrame([(f"i{i}", f"c{i % 4}") for i in range(10)], "item_id string, category string")
    recs = pairs.withColumn("rank", F.lit(1))
    got = FA.user_fairness(counted(recs, seen), pop, cats).collect()
    assert (seen.value, len(got)) == (42, 14)


@pytest.mark.parametrize("scale", [1.0, 1e-150, 1e30])
def test_products_closer_than_single_precision(scale):
    """Equal vectors, and vectors that differ by 1e-9, of long, short and zero users."""
    import pyarrow as pa
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    items = np.repeat(base, 8, axis=0) + np.tile([0, 0, 0, 1e-9, 2e-9, 3e-9, -1e-9, 1e-4], 40)[:, None]
    users = np.vstack([rng.normal(size=(29, 8)), np.zeros((1, 8))]) * rng.choice([1e-3, 1.0, 1e5], 30)[:, None]
    items, users = items * scale, users * scale
    ids = [f"{i:04d}" for i in range(len(items))]
    own = rng.integers(0, len(ids), 30)
    order = np.argsort(own // 64, kind="stable")
    s = FX._Slice({"_users": [f"u{u:02d}" for u in range(30)], "_hi": [9] * 30, "_uv": users.tobytes(), "_row": order.tolist(),
                   "_at": (own[order] // 64).tolist(), "_item": [ids[own[u]] for u in order]}, 5)
    for p in range(5):
        s.meet(p, p, pa.array(ids[64 * p:64 * p + 64]), np.ascontiguousarray(items[64 * p:64 * p + 64]).tobytes())
    got = pa.Table.from_batches(list(s.rows())).to_pylist()
    exact = np.array([np.einsum("ij,ij->i", np.repeat(u[None], len(items), 0), items) for u in users])
    for u in range(30):
        want = sorted((i for i in range(len(ids)) if i != own[u]), key=lambda i: (-exact[u, i], ids[i]))[:5]
        assert [r["item_id"] for r in got if r["user_id"] == f"u{u:02d}"] == [ids[i] for i in want]


def test_few_products_are_made_in_double_precision(monkeypatch):
    """Users without ties go by single precision alone."""
    import pyarrow as pa
    rng, made = np.random.default_rng(6), []
    whole = FX._Slice._products
    monkeypatch.setattr(FX._Slice, "_products", lambda self, r, v: made.append(len(r)) or whole(self, r, v))
    v = rng.normal(size=(3000, 16))
    s = FX._Slice({"_users": [f"{u}" for u in range(500)], "_hi": [9] * 500, "_uv": v[:500].tobytes(), "_row": [], "_at": [], "_item": []}, 5)
    for p in range(3):
        s.meet(p, p, pa.array([str(i) for i in range(1000 * p, 1000 * p + 1000)]), v[1000 * p:1000 * p + 1000].tobytes())
    assert sum(made) == 0
    assert pa.Table.from_batches(list(s.rows())).num_rows == 2500
