"""SVD products by blocks: a vector is sent once for every block of rows, and whole sums leave the tasks."""
import numpy as np
import pytest

import rankfold.operators.factors as FX

U, I = "user_id", "item_id"


def _rows(seed=5, users=40, items=30):
    rng = np.random.default_rng(seed)
    rows = [(f"u{u}", f"i{i}", float(rng.integers(1, 6))) for u in range(users) for i in rng.choice(items, 9)]  # pairs may come twice
    return rows + [(None, "i3", 2.0), ("u1", None, 2.0), ("u1", "i4", None), ("none", "i4", None)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(FX, "SVD_PACK", 4)
    monkeypatch.setattr(FX._Blocks, "rows_of", staticmethod(lambda n, p, cores: 12))


def _cells(spark, rows):
    return spark.createDataFrame(rows, "u string, i string, w double")


def test_block_products_equal_grouped_sums(spark, small):
    cells = _cells(spark, _rows())
    blocks = FX._Blocks(cells, 3, (41, 31))
    assert blocks._blocks("u") == 4 and blocks._blocks("i") == 3
    q = spark.createDataFrame([(f"i{i}", [float(i), float(i % 7), 1.0]) for i in range(30)], "id string, vec array<double>")
    want = {r.id: r.vec for r in FX._product(cells, q, "i", "u").collect()}
    packs = blocks.product(blocks.packs(q, "i"), "u")
    assert packs.count() == 10  # 40 users in packs of 4: one row each, whatever the number of cells
    got = {r.id: r.vec for r in blocks.rows(packs, "u", 3).collect()}
    assert sorted(got) == sorted(want) and all(np.allclose(got[x], want[x]) for x in want)
    back = {r.id: r.vec for r in FX._product(cells, FX._product(cells, q, "i", "u"), "u", "i").collect()}
    got = {r.id: r.vec for r in blocks.rows(blocks.product(packs, "i"), "i", 3).collect()}
    assert sorted(got) == sorted(back) and all(np.allclose(got[x], back[x]) for x in back)


def test_svd_by_blocks_equals_svd_by_joins(spark, small, monkeypatch):
    train = spark.createDataFrame(_rows(), f"{U} string, {I} string, weight double")
    found = []
    for by_blocks in (True, False):
        monkeypatch.setattr(FX._Blocks, "pays", staticmethod(lambda *a, by_blocks=by_blocks: by_blocks))
        uf, vf, evr = FX.svd_fit(train, k=4)
        found.append([{r.id: r.factor for r in x.collect()} for x in (uf, vf)] + [evr])
    for a, b in zip(found[0][:2], found[1][:2], strict=True):
        assert sorted(a) == sorted(b) and all(np.allclose(a[x], b[x], atol=1e-6) for x in a)
    assert abs(found[0][2] - found[1][2]) < 1e-9


def test_blocks_only_where_they_send_less():
    assert FX._Blocks.pays(36_000_000, (900_000, 1_200_000), 60, 6)
    assert not FX._Blocks.pays(1_000_000, (900_000, 1_200_000), 60, 6)
    assert FX._Blocks.rows_of(10 ** 9, 60, 6) * 60 * 8 <= FX.SVD_BYTES
