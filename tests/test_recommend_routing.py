"""Routing of lists for users the models say little about; classes by token counts; distributed SVD."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfold.operators import ease as EA
from rankfold.operators import recommend as R


def _train(spark, rows):
    return spark.createDataFrame([(u, i, float(w)) for u, i, w in rows], "user_id string, item_id string, weight double")


def test_known_user_without_active_items_gets_a_list(spark):
    train = _train(spark, [("u1", "a", 5), ("u1", "b", 4), ("u2", "a", 3), ("u2", "c", 3), ("u3", "b", 2), ("u3", "c", 2), ("u4", "z", 1)])
    B = EA.ease_fit(train, 1.0, max_items=3)
    pop = train.groupBy("item_id").agg(F.count("*").alias("popularity"))
    out = R.recommend_collaborative(train.select("user_id").distinct(), train, pop, 2, B).collect()
    by = {}
    for r in out:
        by.setdefault(r.user_id, []).append((r.rank, r.item_id, r.score, r.source))
    assert sorted(by["u4"]) == [(1, "a", 0.5, "collaborative"), (2, "b", 0.5, "collaborative")]
    assert set(by) == {"u1", "u2", "u3", "u4"}


@pytest.fixture(scope="module")
def content(spark):
    from rankfold.operators import features as FT
    texts = [("a", "cat_x red"), ("b", "cat_x red red"), ("c", "cat_y"), ("d", "cat_y"), ("e", "cat_z blue"), ("f", "cat_x red")]
    docs = spark.createDataFrame(texts, "item_id string, text string")
    tf = FT.tfidf(docs, "item_id")
    ic, vec = FT.item_classes(tf, docs)
    return ic.cache(), vec.cache(), spark.createDataFrame(
        [("a", "x"), ("b", "x"), ("c", "y"), ("d", "y"), ("e", "z"), ("f", "x")], "item_id string, category string")


def test_classes_tell_token_counts_apart(content):
    from rankfold.operators import features as FT
    ic, vec, _ = content
    sim = FT.class_similarity(vec)
    cls = {r.item_id: r.cls for r in ic.collect()}
    assert cls["a"] == cls["f"] != cls["b"] and cls["c"] == cls["d"]
    s = {(r.cls_a, r.cls_b): r.sim for r in sim.collect()}
    assert 0.9 < s[(cls["a"], cls["b"])] < 0.999 and s[(cls["a"], cls["a"])] == pytest.approx(1.0)
    assert (cls["a"], cls["e"]) not in s  # no common token: no row
    some = FT.similarity_of(sim.where("cls_a <= cls_b").select("cls_a", "cls_b"), vec)
    assert {(r.cls_a, r.cls_b): r.sim for r in some.collect()} == {k: pytest.approx(v) for k, v in s.items() if k[0] <= k[1]}


def test_content_lists_fill_up_with_zero_scores_and_fall_back(spark, content):
    ic, sim, cats = content
    train = _train(spark, [("u1", "a", 1), ("u2", "c", 1), ("u2", "d", 1), ("u3", "c", 1)])
    pop = spark.createDataFrame([("a", 9), ("b", 8), ("c", 7), ("d", 6), ("e", 5), ("f", 4)], "item_id string, popularity long")
    users = spark.createDataFrame([("u1",), ("u2",), ("u3",), ("new",)], "user_id string")

    def lists(n, category=None):
        by = {}
        for r in sorted(R.recommend_content(users, train, pop, ic, sim, n, cats, category).collect()):
            by.setdefault(r.user_id, []).append((r.item_id, round(r.score, 3), r.source))
        return by
    got = lists(4)
    assert [x[0] for x in got["u1"]] == ["f", "b", "c", "d"] and got["u1"][2][1] == 0.0
    assert [x[0] for x in got["u3"]] == ["d", "a", "b", "e"]
    assert {len(v) for v in got.values()} == {4}
    only_y = lists(2, "y")
    assert [x[0] for x in only_y["u2"]] == ["c", "d"] and only_y["u2"][0][2] == "popular"  # all of y is seen
    assert only_y["u3"] == [("d", 1.0, "content")]


def test_subspace_iteration_finds_the_singular_vectors(spark):
    from rankfold.operators.factors import svd_fit
    rng = np.random.default_rng(8)
    x = (rng.random((70, 25)) < 0.3) * rng.integers(1, 6, (70, 25)) + np.outer(np.arange(70) % 7 == 0, np.arange(25) % 4 == 0) * 20.0
    rows = [(f"u{u:02d}", f"i{i:02d}", float(x[u, i])) for u in range(70) for i in range(25) if x[u, i]]
    uf, vf, evr = svd_fit(_train(spark, rows), k=3)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    got = np.array([r.factor for r in vf.orderBy("id").collect()])
    us = x @ vt[:3].T
    want = vt[:3].T / np.linalg.norm(vt[:3].T, axis=1, keepdims=True)
    sign = np.sign([us[np.argmax(np.abs(us[:, c])), c] for c in range(3)])
    assert np.abs(got - want * sign).max() < 1e-3
    assert evr == pytest.approx((us.var(axis=0).sum()) / x.var(axis=0).sum(), abs=1e-4)


def test_whole_catalog_queries_match_a_dense_solve(spark):
    import numpy as np
    from rankfold.plans import flows, q_recommend as QR
    sf = "/root/testdata/sf0.001"
    train = flows.prepared(spark, sf, "L").train.select("user_id", "item_id", "weight").toPandas()
    x = train.pivot_table(index="user_id", columns="item_id", values="weight", fill_value=0.0)
    items, users = list(x.columns), list(x.index)
    p = np.linalg.inv(x.to_numpy().T @ x.to_numpy() + 500.0 * np.eye(len(items)))
    b = -p / np.diag(p)[None, :]
    np.fill_diagonal(b, 0.0)
    raw = np.where(x.to_numpy() > 0, -np.inf, x.to_numpy() @ b)

    v = {r.item_id: r.v for r in QR.c7_ease_weights_l(spark, sf).collect()}
    assert set(v) == set(items) and set(v.values()) <= set(range(1, 12))
    table = EA.ease_fit(flows.prepared(spark, sf, "L").train, 500.0, block=64).table().toPandas()  # several tiles
    mine = table.pivot(index="src", columns="dst", values="weight").reindex(index=items, columns=items).fillna(0.0).to_numpy()
    assert np.abs(mine - b).max() < 1e-9

    for query, n in ((QR.r3_collaborative_ease_l, 10), (QR.r10_batch_collaborative_l, 5)):
        got = {}
        for r in query(spark, sf).collect():
            got.setdefault(r.user_id, []).append((r["rank"], r.product_id, r.score))
        asked = {r.user_id for r in flows.customers(spark, sf).collect()}
        assert set(got) == asked and {len(v) for v in got.values()} == {n}
        for u, row in zip(users, raw, strict=True):
            if u in asked:
                best = np.sort(row[np.isfinite(row)])[::-1][:n]
                want = np.clip(best / best[0], 0, 1) if best[0] > 0 else np.full(n, 0.5)
                mine = sorted(got[u])
                assert [s for _, _, s in mine] == pytest.approx(list(want), abs=2e-4)
                assert [row[items.index(i)] for _, i, _ in mine] == pytest.approx(list(best), abs=1e-8)


def _brute_content(vectors, items, train, n):
    """vectors: class -> {token: value}; items: item -> class."""
    out = {}
    for u in sorted({u for u, _ in train}):
        mine = [i for v, i in train if v == u and i in items]
        q = {}
        for i in mine:
            for t, x in vectors[items[i]].items():
                q[t] = q.get(t, 0.0) + x
        score = {c: round(sum(q.get(t, 0.0) * x for t, x in v.items()) / len(mine), 9) for c, v in vectors.items()}
        rest = sorted((-score[c], i) for i, c in items.items() if i not in set(mine))[:n]
        out[u] = [(i, min(1.0, -s)) for s, i in rest]
    return out


@pytest.mark.parametrize("depth", [2, 7, 64])
def test_content_lists_by_impact_equal_brute_force(spark, depth):
    """Many ties within and across classes, users of one and of several buckets, seen first items."""
    rng = np.random.default_rng(depth)
    vectors, items = {}, {}
    for c in range(60):
        bucket = ("popular_high", "popular_low", "popular_medium")[int(rng.integers(0, 3))]
        x = {bucket: float(rng.choice([0.3, 0.5])), f"cat_{c % 23}": float(rng.choice([0.6, 0.8]))}
        if c % 5 == 0:
            x["brass"] = 0.4
        vectors[f"k{c:02d}"] = x
        for _ in range(int(rng.integers(1, 5))):
            items[f"i{rng.integers(0, 10**6):06d}"] = f"k{c:02d}"
    names = sorted(items)
    train = [(f"u{u}", names[int(k)]) for u in range(25) for k in rng.choice(len(names), int(rng.integers(1, 12)), replace=False)]
    train += [("first", i) for i in names[:9]]
    vec = spark.createDataFrame([(c, t, x) for c, v in vectors.items() for t, x in v.items()], "cls string, token string, value double")
    ic = spark.createDataFrame([*items.items()], "item_id string, cls string")
    pop = spark.createDataFrame([(i, 1) for i in names], "item_id string, popularity long")
    tr = _train(spark, [(u, i, 1) for u, i in train])
    got = {}
    for r in R.recommend_content(tr.select("user_id"), tr, pop, ic, vec, 10, depth=depth).collect():
        got.setdefault(r.user_id, []).append((r["rank"], r.item_id, round(r.score, 9)))
    want = _brute_content(vectors, items, train, 10)
    assert {u: [(i, s) for _, i, s in sorted(v)] for u, v in got.items()} == want


def test_a_hundred_thousand_classes_are_not_paired(spark):
    """Each class shares one of three tokens with a third of all others; the lists read a few entries of them."""
    n = 100_000
    ids = spark.range(n).selectExpr("lpad(id, 6, '0') AS k", "id")
    ic = ids.selectExpr("concat('i', k) AS item_id", "concat('c', k) AS cls")
    vec = ids.selectExpr("concat('c', k) AS cls", "concat('cat_', id div 4) AS token", "0.8D AS value").unionByName(ids.selectExpr(
        "concat('c', k) AS cls", "element_at(array('popular_high', 'popular_medium', 'popular_low'), cast(id % 3 + 1 AS int)) AS token",
        "0.6D - 0.0001D * (id % 7) AS value"))
    train = _train(spark, [(f"u{u}", f"i{(u * 977 + 13 * h) % n:06d}", 1) for u in range(40) for h in range(5)])
    pop = ic.selectExpr("item_id", "1L AS popularity")
    asked = {}
    for r in R.recommend_content(train.select("user_id"), train, pop, ic, vec, 10).collect():
        asked.setdefault(r.user_id, []).append((r["rank"], r.item_id, round(r.score, 9)))
    assert len(asked) == 40 and {len(v) for v in asked.values()} == {10}
    token = np.arange(n) // 4
    bucket, value = np.arange(n) % 3, 0.6 - 0.0001 * (np.arange(n) % 7)
    for u in (0, 7, 39):
        mine = np.array([(u * 977 + 13 * h) % n for h in range(5)])
        score = sum(0.64 * (token == token[i]) + value * value[i] * (bucket == bucket[i]) for i in mine) / 5
        score = np.round(score, 9)
        score[mine] = -1
        best = np.lexsort((np.arange(n), -score))[:10]
        assert [(i, s) for _, i, s in sorted(asked[f"u{u}"])] == [(f"i{i:06d}", pytest.approx(score[i], abs=2e-9)) for i in best]


def test_content_lists_of_a_small_class_table_equal_brute_force(spark, monkeypatch):
    """Users are scored against all classes at once, and no posting list is read."""
    monkeypatch.setattr(R, "best_classes", None)  # before, it was the only way
    rng = np.random.default_rng(31)
    vectors, items = {}, {}
    for c in range(40):
        bucket = ("popular_high", "popular_low", "popular_medium")[int(rng.integers(0, 3))]
        vectors[f"k{c:02d}"] = {bucket: float(rng.choice([0.3, 0.5])), f"cat_{c % 17}": float(rng.choice([0.6, 0.8]))}
        for _ in range(int(rng.integers(1, 5))):
            items[f"i{rng.integers(0, 10**6):06d}"] = f"k{c:02d}"
    items["i0"] = ""  # without a token
    names = sorted(items)
    train = [(f"u{u}", names[int(k)]) for u in range(25) for k in rng.choice(len(names), int(rng.integers(1, 12)), replace=False)]
    train += [("first", i) for i in names[:9]] + [("blank", "i0")]
    vec = spark.createDataFrame([(c, t, x) for c, v in vectors.items() for t, x in v.items()], "cls string, token string, value double")
    ic = spark.createDataFrame([*items.items()], "item_id string, cls string")
    pop = spark.createDataFrame([(i, 1) for i in names], "item_id string, popularity long")
    tr = _train(spark, [(u, i, 1) for u, i in train])
    want = _brute_content({**vectors, "": {}}, items, train, 10)
    for head in (R.HEAD, 1):  # with the heads of the classes broadcast, and without
        monkeypatch.setattr(R, "HEAD", head)
        got = {}
        for r in R.recommend_content(tr.select("user_id"), tr, pop, ic, vec, 10).collect():
            got.setdefault(r.user_id, []).append((r["rank"], r.item_id, round(r.score, 9)))
        assert {u: [(i, s) for _, i, s in sorted(v)] for u, v in got.items()} == want


def test_popular_lists_read_the_head_of_the_ranking_only(spark, monkeypatch):
    """With seen items masked, neither histories nor lists are joined with the whole catalog."""
    read = []
    whole = R.first_unseen
    monkeypatch.setattr(R, "first_unseen", lambda want, seen, keys, n: (read.append(seen.count()), whole(want, seen, keys, n))[1])
    pop = spark.range(5000).selectExpr("concat('i', lpad(id, 4, '0')) AS item_id", "10000 - id AS popularity")
    seen = spark.range(40).selectExpr("concat('u', id % 4) AS user_id", "concat('i', lpad(id * 100, 4, '0')) AS item_id")
    want = {f"u{u}": [j for j in range(7) if not (j == 0 and u == 0)][:5] for u in range(4)}
    for head in (R.HEAD, 3):
        monkeypatch.setattr(R, "HEAD", head)
        got = {}
        for r in R.recommend_popular(seen.select("user_id"), pop, 5, seen=seen).collect():
            got.setdefault(r.user_id, []).append((r["rank"], int(r.item_id[1:])))
        assert {u: [i for _, i in sorted(v)] for u, v in got.items()} == want
    assert read == [1, 1]  # of forty rows, the one among the first 15; all forty before


def test_positions_of_long_and_short_keys(spark, monkeypatch):
    """Short keys are numbered where their rows are, long ones by many tasks; null keys have no position."""
    from rankfold.operators import ranking
    rows = [("long", k, k % 7) for k in range(50)] + [(f"k{i}", j, 1) for i in range(30) for j in range(i % 5 + 1)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "k string, v int, x int").repartition(5)
    monkeypatch.setattr(ranking, "HOT_KEY", 10)
    sorts = []
    whole = ranking.global_rank
    monkeypatch.setattr(ranking, "global_rank", lambda d, *a, **b: (sorts.append(d.count()), whole(d, *a, **b))[1])
    for count in (None, "n"):
        got = [(r.k, r.v, r.rk, *([r.n] if count else [])) for r in ranking.rank_within(df, "k", [F.asc("v")], "rk", count).collect()]
        size = {k: sum(r[0] == k for r in rows) for k, _, _ in rows}
        assert sorted(got) == sorted((k, v, v + 1, *([size[k]] if count else [])) for k, v, _ in rows if k)
    assert sorts == [50, 50]  # only the long key's rows; all rows before
