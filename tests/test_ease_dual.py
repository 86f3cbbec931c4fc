"""EASE where users are fewer than items, and what a task of the elimination holds."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import rankfold.operators.ease as EA

U, I = "user_id", "item_id"


@pytest.fixture
def small(monkeypatch):
    """Every loop takes several turns: small tiles, blocks, parts and rounds."""
    for name, value in (("DUAL_FROM", 0), ("TILE", 8), ("DUAL_BYTES", 5000), ("DUAL_ENTRIES", 7), ("ROUND_BYTES", 8000),
                        ("PART_BYTES", 500), ("PARTS", 3)):
        monkeypatch.setattr(EA, name, value)
    monkeypatch.setattr(EA, "step_tiles", lambda n, tile: 2)


def _rows(seed=3, users=25, items=60):
    rng = np.random.default_rng(seed)
    rows = [(f"u{u}", f"i{i:02d}", float(rng.integers(1, 6))) for u in range(users) for i in rng.choice(items - 1, 6, replace=False)]
    rows += [(f"u{u}", "i00", 2.0) for u in range(users)]  # an item of every user, for some a pair that comes twice
    return rows + [(None, "i03", 1.0), (None, f"i{items - 1}", 4.0), ("u1", "i05", None)]  # the last item has no user


def _dense(rows, l2):
    rows = [(u, i, w) for u, i, w in rows]
    items = sorted({i for _, i, _ in rows})
    users = sorted({u for u, _, w in rows if u and w})
    x = np.zeros((len(users), len(items)))
    for u, i, w in rows:
        if u and w:
            x[users.index(u), items.index(i)] += w
    p = np.linalg.inv(x.T @ x + l2 * np.eye(len(items)))
    b = -p / np.diag(p)
    np.fill_diagonal(b, 0.0)
    return users, items, x, b, 1 / np.diag(p)


def test_dual_weights_equal_the_dense_solve(spark, small):
    rows = _rows()
    train = spark.createDataFrame(rows, f"{U} string, {I} string, weight double")
    users, items, x, b, scale = _dense(rows, 20.0)
    B = EA.ease_fit(train, 20.0)
    assert isinstance(B, EA.DualWeights) and B._tiles is None and B.inner.n == len(users) < B.n == len(items)
    assert np.allclose([r.scale for r in B.items.orderBy("idx").collect()], scale)

    v = spark.createDataFrame([(i, float(k % 5 + 1)) for k, i in enumerate(items)], f"{I} string, value double")
    got = {r[I]: r.value for r in EA.times(B, v).collect()}
    assert np.allclose([got[i] for i in items], b @ [k % 5 + 1 for k in range(len(items))])

    known = train.where(F.col(U).isNotNull() & F.col("weight").isNotNull())
    total = {r[U]: r.value for r in EA.project_scores(known, B, v, slice_entries=40).collect()}
    assert np.allclose([total[u] for u in users], x @ b @ [k % 5 + 1 for k in range(len(items))])

    score = np.where(x > 0, -np.inf, x @ b)
    best = {}
    for r in EA.score_ease_topk(known, B, 4, slice_entries=40).collect():
        best.setdefault(r[U], []).append(r.raw)
    for u, row in zip(users, score, strict=True):
        assert np.allclose(sorted(best[u]), np.sort(row)[-4:])

    table = {(r.src, r.dst): r.weight for r in B.table().collect()}
    assert len(table) == len(items) * (len(items) - 1)
    assert np.allclose([table[i, j] for i in items for j in items if i != j], b[~np.eye(len(items), dtype=bool)])


@pytest.mark.parametrize("rows, l2", [(_rows(users=80), 20.0), (_rows(), 1e-6)])
def test_dual_only_where_users_are_few_and_the_ridge_is_not_lost(spark, small, rows, l2):
    rows = [r for r in rows if None not in r]
    B = EA.ease_fit(spark.createDataFrame(rows, f"{U} string, {I} string, weight double"), l2)
    assert isinstance(B, EA.Weights)
    if l2 > 1:
        _, items, _, b, _ = _dense(rows, l2)
        table = {(r.src, r.dst): r.weight for r in B.table().collect()}
        assert np.allclose([table[i, j] for i in items for j in items if i != j], b[~np.eye(len(items), dtype=bool)])


@pytest.mark.parametrize("n", [10_000, 20_000, 92_000])
def test_a_cell_of_a_step_holds_a_bounded_share(n):
    wide = EA.step_tiles(n, EA.TILE)
    nb = math.ceil(n / EA.TILE)
    groups = EA._grid(nb, EA.TILE, 6, wide)
    column = 2 * math.ceil(nb / groups) * wide * EA.TILE ** 2 * 8
    assert 1.5 * column + 8 * (wide * EA.TILE) ** 2 <= 144 << 20  # columns, their products and the pivot
