"""Model invariants: EASE solve, TF-IDF formula, closed-form LIME, SHAP, SVD."""
import numpy as np
import pytest

from rankfold.operators import ease as EA
from rankfold.operators import explain as X
from rankfold.operators import features as FT


def test_ease_matches_dense_inverse(spark):
    rng = np.random.default_rng(0)
    rows = [(f"u{u}", f"i{i:02d}", float(rng.integers(1, 6))) for u in range(80) for i in range(40)
            if rng.random() < 0.3]
    train = spark.createDataFrame(rows, "user_id string, item_id string, weight double")
    B = {(r.src, r.dst): r.weight for r in EA.ease_fit(train, 500.0, block=16).table().collect()}
    pdf = train.toPandas()
    items = sorted(pdf.item_id.unique())
    X_ = pdf.pivot_table(index="user_id", columns="item_id", values="weight", fill_value=0.0)[items].to_numpy()
    P = np.linalg.inv(X_.T @ X_ + 500.0 * np.eye(len(items)))
    Bref = -P / np.diag(P)[None, :]
    err = max(abs(B[(a, b)] - Bref[i, j]) for i, a in enumerate(items) for j, b in enumerate(items) if i != j)
    assert err < 1e-8
    assert all(a != b for a, b in B)  # diagonal excluded (B_jj = 0)


def test_gram_salting_equals_plain(spark):
    rows = [("hot", f"i{k}", 1.0 + k % 3) for k in range(60)] + [(f"u{u}", f"i{k}", 1.0) for u in range(5) for k in range(4)]
    h = spark.createDataFrame(rows, "user_id string, item_id string, weight double")
    a = {(r.i, r.j): r.g for r in EA.gram(h, chunk=7).collect()}
    b = {(r.i, r.j): r.g for r in EA.gram(h, chunk=10_000).collect()}
    assert a == pytest.approx(b)


def test_tfidf_of_few_features_counts_only_their_words(spark):
    rows = [(1, "aa aa bb cc"), (2, "bb dd"), (2, "bb aa"), (None, "aa ee"), (3, None), (4, "ff"), (None, "aa")]
    docs = spark.createDataFrame(rows, "id long, text string")
    few = FT.tfidf(docs, "id", "text", 2)
    got = {(r.doc, r.token): (r.tf, round(r.value, 9)) for r in few.collect()}
    idf = np.log(8 / np.array([4.0, 3.0])) + 1  # of aa (three documents) and bb (two); seven rows
    norm = lambda a, b: np.hypot(a * idf[0], b * idf[1])
    want = {(1, "aa"): (2, 2 * idf[0] / norm(2, 1)), (1, "bb"): (1, idf[1] / norm(2, 1)), (2, "aa"): (1, idf[0] / norm(1, 2)),
            (2, "bb"): (2, 2 * idf[1] / norm(1, 2)), (None, "aa"): (2, 1.0)}
    assert got == {k: (tf, round(v, 9)) for k, (tf, v) in want.items()}
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc" in plan.replace("#", " ") and ", token" not in " ".join(
        x for x in plan.splitlines() if "hashpartitioning(doc" in x).split("hashpartitioning(", 1)[1].split(")")[0]


def test_tfidf_smooth_idf_and_norm(spark):
    docs = spark.createDataFrame([(1, "cat_a popular_low"), (2, "cat_b popular_low"), (3, "cat_a popular_high")],
                                 "id long, text string")
    t = {(r.doc, r.token): r.value for r in FT.tfidf(docs, "id").collect()}
    import math
    idf_a, idf_low = math.log(4 / 3) + 1, math.log(4 / 3) + 1
    n = math.sqrt(idf_a ** 2 + idf_low ** 2)
    assert t[(1, "cat_a")] == pytest.approx(idf_a / n)
    assert sum(v * v for (d, _), v in t.items() if d == 2) == pytest.approx(1.0)


def _ridge_direct(Xm, y, w, alpha):
    xm = (w[:, None] * Xm).sum(0) / w.sum()
    ym = (w * y).sum() / w.sum()
    Xc, yc = Xm - xm, y - ym
    A = Xc.T @ (w[:, None] * Xc) + alpha * np.eye(Xm.shape[1])
    coef = np.linalg.solve(A, Xc.T @ (w * yc))
    pred = Xc @ coef
    r2 = 1 - (w * (yc - pred) ** 2).sum() / (w * yc ** 2).sum()
    return coef, r2


def test_lime_closed_form_equals_direct_ridge(spark):
    d = 8
    rng = np.random.default_rng(5)
    u = rng.normal(size=d); u /= np.linalg.norm(u)
    v = rng.normal(size=d); v /= np.linalg.norm(v)
    noise = np.random.default_rng(42).normal(0, 0.1, (50, d))
    Xm = v + noise
    w = np.exp(-(np.linalg.norm(noise, axis=1) ** 2) / 0.5)
    coef, r2 = _ridge_direct(Xm, Xm @ u, w, 0.01)
    uf = spark.createDataFrame([("u", [float(x) for x in u])], "id string, factor array<double>")
    vf = spark.createDataFrame([("i", [float(x) for x in v])], "id string, factor array<double>")
    pairs = spark.createDataFrame([("u", "i")], "user_id string, item_id string")
    r = X.explain_lime(pairs, uf, vf, d, top_k=d).first()
    got = dict(zip(r.top_dimensions, r.importances))
    assert [got[k] for k in range(d)] == pytest.approx([round(c, 6) for c in coef], abs=2e-6)
    assert r.local_fidelity == pytest.approx(round(r2, 4), abs=1e-4)


def test_shap_sums_to_score(spark):
    rng = np.random.default_rng(1)
    u, v = rng.normal(size=6), rng.normal(size=6)
    uf = spark.createDataFrame([("u", [float(x) for x in u])], "id string, factor array<double>")
    vf = spark.createDataFrame([("i", [float(x) for x in v])], "id string, factor array<double>")
    pairs = spark.createDataFrame([("u", "i"), ("ghost", "i")], "user_id string, item_id string")
    out = {r.user_id: r for r in X.explain_shap(pairs, uf, vf).collect()}
    assert out["u"].total_score == pytest.approx(float(u @ v), abs=1e-5)
    assert out["ghost"].error is not None
    s = X.shap_values(pairs, uf, vf).where("user_id = 'u'").orderBy("pos").collect()
    mags = [abs(r.shap) for r in s]
    assert mags == sorted(mags, reverse=True)


def test_svd_factors_unit_norm_and_evr(spark, fx1):
    from rankfold.operators.factors import svd_fit
    uf, vf, evr = svd_fit(fx1, k=2)
    for r in uf.collect() + vf.collect():
        assert np.linalg.norm(r.factor) == pytest.approx(1.0, abs=1e-6)
    assert 0.0 < evr <= 1.0 + 1e-9


def test_tiles_invert_the_matrix(spark, monkeypatch):
    rng = np.random.default_rng(2)
    n, tile = 30, 7
    A = rng.random((n, n)) * (rng.random((n, n)) < 0.2)
    A = A @ A.T + np.eye(n)
    cells = spark.createDataFrame([(int(r), int(c), float(A[r, c])) for r, c in zip(*np.nonzero(np.tril(A)))], "r long, c long, g double")
    for groups in (1, 3):  # one cell, and a grid of six
        monkeypatch.setattr(EA, "_grid", lambda *a, groups=groups: groups)
        P = np.zeros((n, n))
        for t in spark.read.parquet(EA.inverse_tiles(EA.gram_tiles(cells, n, tile), n, tile)).collect():
            assert t.i >= t.j
            h, w = min(tile, n - t.i * tile), min(tile, n - t.j * tile)
            part = -np.frombuffer(t.a).reshape(h, w)
            P[t.i * tile:t.i * tile + h, t.j * tile:t.j * tile + w] = part
            P[t.j * tile:t.j * tile + w, t.i * tile:t.i * tile + h] = part.T
        assert np.abs(A @ P - np.eye(n)).max() < 1e-8


def test_svd_leaves_no_more_on_disk_with_more_iterations(spark):
    import os
    from rankfold.operators.factors import svd_fit
    from rankfold.session import shared_dir
    rng = np.random.default_rng(2)
    rows = [(f"u{u}", f"i{i}", float(rng.integers(1, 6))) for u in range(12) for i in range(9) if rng.random() < 0.5]
    train = spark.createDataFrame(rows, "user_id string, item_id string, weight double")
    at = shared_dir(spark).removeprefix("file:")
    tables = lambda: sum(d.startswith(("rdd-", "svd-")) for _, folders, _ in os.walk(at) for d in folders)
    left = []
    for iterations in (1, 4):
        before = tables()
        svd_fit(train, k=2, iterations=iterations)
        left.append(tables() - before)
    assert left[0] == left[1]


@pytest.mark.parametrize("n,tile,wide", [(23, 4, 2), (24, 4, 3), (10, 4, 5)])
def test_inverse_takes_several_tile_columns_a_step(spark, n, tile, wide, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, n))
    A = x.T @ x + np.eye(n)
    cells = spark.createDataFrame([(int(r), int(c), float(A[r, c])) for r, c in zip(*np.nonzero(np.tril(A)))], "r long, c long, g double")
    monkeypatch.setattr(EA, "_grid", lambda *a: 3)
    P = np.zeros((n, n))
    for t in spark.read.parquet(EA.inverse_tiles(EA.gram_tiles(cells, n, tile), n, tile, wide)).collect():
        h, w = min(tile, n - t.i * tile), min(tile, n - t.j * tile)
        part = -np.frombuffer(t.a).reshape(h, w)
        P[t.i * tile:t.i * tile + h, t.j * tile:t.j * tile + w] = part
        P[t.j * tile:t.j * tile + w, t.i * tile:t.i * tile + h] = part.T
    assert np.abs(A @ P - np.eye(n)).max() < 1e-8


def test_tiles_lie_in_row_groups_of_a_few(spark, tmp_path):
    import pyarrow.parquet as pq
    tiles = spark.range(40).coalesce(1).selectExpr("cast(id AS int) AS i", "0 AS j", "cast(repeat('x', 800) AS binary) AS a")
    at = EA.write_tiles(tiles, str(tmp_path / "tiles"))
    groups = [m.row_group(g).num_rows for f in (tmp_path / "tiles").glob("part-*") for m in [pq.ParquetFile(f).metadata] for g in range(m.num_row_groups)]
    assert sum(groups) == spark.read.parquet(at).count() == 40 and max(groups) <= EA.ROW_GROUP


def test_a_tile_is_a_small_row_whatever_the_catalog(spark):
    for n in (1, 5_000, 20_000, 200_000):
        assert 8 * EA.TILE ** 2 <= 2 << 20 and EA.step_tiles(n, EA.TILE) * EA.TILE in (1024, 2048)


def test_ease_block_topk_equals_join_form(spark):
    from pyspark.sql import Window, functions as F
    rng = np.random.default_rng(11)
    rows = [(f"u{u:02d}", f"i{i:02d}", float(rng.integers(1, 6))) for u in range(40) for i in range(30)
            if rng.random() < 0.25]
    train = spark.createDataFrame(rows, "user_id string, item_id string, weight double")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    B = EA.ease_fit(train, 50.0, block=8)
    fast = {(r.user_id, r.item_id): r.raw for r in EA.score_ease_topk(train, B, 5, block=7, slice_entries=40, task_bytes=1000).collect()}
    raw = EA.score_ease(train, B).join(train.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    w = Window.partitionBy("user_id").orderBy(F.desc("raw"), F.asc("item_id"))
    ref = {(r.user_id, r.item_id): r.raw for r in raw.withColumn("k", F.row_number().over(w)).where("k <= 5").collect()}
    assert set(fast) == set(ref)
    assert all(abs(fast[k] - ref[k]) < 1e-9 for k in ref)
    allowed = spark.createDataFrame([(f"i{i:02d}",) for i in range(0, 30, 4)], "item_id string")
    some = {(r.user_id, r.item_id) for r in EA.score_ease_topk(train, B, 3, allowed, block=7, slice_entries=40).collect()}
    raw = raw.join(allowed, "item_id", "left_semi")
    assert some == {(r.user_id, r.item_id) for r in raw.withColumn("k", F.row_number().over(w)).where("k <= 3").collect()}
    table = B.table()
    pairs = table.where("substr(src, 2, 2) < substr(dst, 2, 2)").select("src", "dst").unionByName(
        spark.createDataFrame([("i01", "i01"), ("i01", "none")], "src string, dst string"))
    got = {(r.src, r.dst): r.weight for r in B.at(pairs).collect()}
    assert got == {(r.src, r.dst): r.weight for r in table.collect() if r.src < r.dst}
    y = spark.createDataFrame([(f"i{i:02d}", float(i - 9)) for i in range(30)], "item_id string, value double")
    want = {r.user_id: r.s for r in EA.score_ease(train, B).join(y, "item_id").groupBy("user_id").agg(F.sum(F.col("raw") * F.col("value")).alias("s")).collect()}
    got = {r.user_id: r.value for r in EA.project_scores(train, B, y, block=7, slice_entries=40).collect()}
    assert got.keys() == want.keys() and all(abs(got[u] - want[u]) < 1e-8 for u in want)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before


def test_factor_block_topk_equals_brute_force(spark):
    from rankfold.operators.factors import top_k_dot
    rng = np.random.default_rng(4)
    U_ = rng.normal(size=(25, 6))
    V_ = rng.normal(size=(40, 6))
    uf = spark.createDataFrame([(f"u{i}", [float(x) for x in r]) for i, r in enumerate(U_)], "id string, factor array<double>")
    vf = spark.createDataFrame([(f"v{i}", [float(x) for x in r]) for i, r in enumerate(V_)], "id string, factor array<double>")
    seen = spark.createDataFrame([(f"u{i}", f"v{(i * 7) % 40}") for i in range(25)], "user_id string, item_id string")
    got = {(r.user_id, r.rank): r.item_id for r in top_k_dot(uf, vf, 4, seen=seen, block=9).collect()}
    for i in range(25):
        s = U_[i] @ V_.T
        s[(i * 7) % 40] = -np.inf
        best = np.argsort(-s, kind="stable")[:4]
        assert [got[(f"u{i}", k + 1)] for k in range(4)] == [f"v{j}" for j in best]


def test_norm_ordered_topk_prunes_and_stays_exact(spark):
    """Norms fall off as in a trained catalogue (popular items long): most user-block products are never
    made, and the lists equal those of all products, ties, masks and null or zero vectors included."""
    from rankfold.operators.factors import top_k_dot
    rng = np.random.default_rng(8)
    n, m, k = 30, 640, 5
    U_ = rng.normal(size=(n, 6))
    U_[3] = 0.0  # all products are ties at 0: nothing may be skipped
    V_ = rng.normal(size=(m, 6)) * (0.985 ** np.arange(m))[:, None]
    V_[7] = V_[6]  # a tie among long vectors
    ids = [f"v{j:03d}" for j in rng.permutation(m)]
    uf = spark.createDataFrame([(f"u{i}", [float(x) for x in r]) for i, r in enumerate(U_)], "id string, factor array<double>")
    vf = spark.createDataFrame([(ids[j], [float(x) for x in r]) for j, r in enumerate(V_)], "id string, factor array<double>")
    masked = {(i, j) for i in range(n) for j in range(0, 40, 1 + i % 3)}
    seen = spark.createDataFrame([(f"u{i}", ids[j]) for i, j in sorted(masked)], "user_id string, item_id string")
    report = []
    got = {}
    for r in top_k_dot(uf, vf, k, seen=seen, block=16, users=8, report=report).collect():
        got.setdefault(r.user_id, {})[r.rank] = r.item_id
    for i in range(n):
        rows = sorted(((-float(U_[i] @ V_[j]), ids[j]) for j in range(m) if (i, j) not in masked))
        want = [x for _, x in rows[:k]]
        assert [got[f"u{i}"][r + 1] for r in range(k)] == want, i
    visits = sum(v for _, v, _ in report)
    assert visits < 0.5 * n * (m // 16)  # over half of all products are pruned
    assert report[-1][0] < n and visits >= m // 16  # the zero vector went everywhere


def test_equal_norms_read_every_block_in_one_round(spark):
    from rankfold.operators.factors import top_k_dot
    f = spark.createDataFrame([(f"x{i}", [float(np.cos(i)), float(np.sin(i))]) for i in range(60)], "id string, factor array<double>")
    report = []
    assert top_k_dot(f, f, 3, block=10, report=report).count() == 180
    assert report == [(60, 360, 6)]


def test_training_from_files_uses_every_setting(spark, tmp_path):
    """From event and property CSVs to a bundle: weights, threshold, hold-out and blend weights come from the settings."""
    import dataclasses
    from rankfold.config import DEFAULTS
    from rankfold.plans.training import train_files
    from rankfold.sources import io as IO
    lines = ["timestamp,visitorid,event,itemid,transactionid"]
    for u in range(12):
        for k in range(3 + u % 4):
            lines.append(f"{1_600_000_000_000 + 1000 * (u * 50 + k)},{u},{'addtocart' if k == 0 else 'view'},{(u + k) % 7},")
    (tmp_path / "events.csv").write_text("\n".join(lines))
    (tmp_path / "props.csv").write_text("timestamp,itemid,property,value\n" + "\n".join(f"{k},{i},categoryid,c{(i + k) % 3}" for i in range(7) for k in (1, 2)))
    cfg = dataclasses.replace(DEFAULTS, min_user_interactions=4, event_weights=(("view", 2.0), ("addtocart", 7.0)), test_fraction=0.25,
                              hybrid_collab_weight=0.9, hybrid_content_weight=0.1, popularity_from="train", ease_lambda=1.0, eval_k=3)
    out = str(tmp_path / "model")
    m = train_files(spark, str(tmp_path / "events.csv"), [str(tmp_path / "props.csv"), str(tmp_path / "missing.csv")], cfg, svd=False, out_dir=out).first()
    assert m["n_eval_users"] > 0
    b, meta = IO.load_bundle(spark, f"{out}/bundle")
    assert (b.collab_weight, b.content_weight) == (0.9, 0.1)
    users = {r.user_id for r in b.train.select("user_id").distinct().collect()}
    assert users == {str(u) for u in range(12) if 3 + u % 4 >= 4}
    assert {r.weight for r in b.train.collect()} <= {2.0, 7.0}
    pop = {r.item_id: r.popularity for r in b.pop.collect()}
    counts = {r.item_id: r["count"] for r in b.train.groupBy("item_id").count().collect()}
    assert pop == counts
    assert {r.item_id: r.category for r in b.categories.collect()} == {str(i): f"c{(i + 2) % 3}" for i in range(7)}
    assert {r.key: r.value for r in meta.collect()}["popularity_from"] == "train"


@pytest.mark.parametrize("long", [1.0, 3.0])
def test_topk_of_copies_and_repeated_ids(spark, monkeypatch, long):
    """Equal vectors go by item_id across packs, ids that come twice count twice, and masks hold for every row of an id.
    A slice meets packs of several blocks, and several runs of packs. Ids that come twice stopped the scoring before."""
    from rankfold.operators import factors as FX
    monkeypatch.setattr(FX, "PACK", 32)
    monkeypatch.setattr(FX, "PART_BYTES", 32 * 3 * 8 * 2)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(200, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[50:120] = v[50]
    v[:20] *= long  # 3.0: by norm, in rounds
    rows = [(f"v{j:03d}", [float(x) for x in v[j]]) for j in range(200)] + [("v060", [float(x) for x in v[60]])]
    vf = spark.createDataFrame(rows, "id string, factor array<double>")
    users = [(f"u{i}", [float(x) for x in v[i * 9]]) for i in range(20)] + [("u3", [float(x) for x in v[51]]), ("none", None)]
    uf = spark.createDataFrame(users, "id string, factor array<double>")
    seen = [(f"u{i}", f"v{j:03d}") for i in range(20) for j in range(45, 75, 2 + i % 3)]
    got = {}
    for r in FX.top_k_dot(uf, vf, 6, seen=spark.createDataFrame(seen, "user_id string, item_id string"), block=8, users=7).collect():
        got.setdefault(r.user_id, []).append((r["rank"], r.item_id, round(r.raw, 9)))
    for u in {x for x, f in users if f}:
        want = sorted((-round(float(np.dot(f, g)), 9), i) for x, f in users if x == u for i, g in rows if (u, i) not in seen)[:6]
        assert [(i, s) for _, i, s in sorted(got[u])] == [(i, -s) for s, i in want], u
    assert "none" not in got


def test_gram_of_many_items_sends_histories_not_pairs(spark, monkeypatch):
    """The products are made where an item's rows are: users longer than a chunk, items dealt by partner, rows that come
    twice and null keys give the sums of the self join."""
    import itertools
    monkeypatch.setattr(EA, "HOT_ITEM", 4)  # before, there was one exchange of all pairs
    monkeypatch.setattr(EA, "PAIRS", 50)
    rng = np.random.default_rng(2)
    rows = [(f"u{u}", f"i{int(i):03d}", float(rng.integers(1, 6))) for u in range(12) for i in rng.choice(300, 9, replace=False)]
    rows += [("long", f"i{k:03d}", 2.0) for k in range(40)] + [(f"w{u}", "i299", 1.0) for u in range(9)]
    rows += [rows[0], (None, "i001", 1.0), ("u1", None, 3.0)]
    want = {}
    for u in {r[0] for r in rows if r[0]}:
        mine = [r for r in rows if r[0] == u and r[1]]
        for a, b in itertools.product(mine, mine):
            if a[1] <= b[1]:
                want[a[1], b[1]] = want.get((a[1], b[1]), 0.0) + a[2] * b[2]
    h = spark.createDataFrame(rows, "user_id string, item_id string, weight double")
    g = EA.gram(h, mirror=False, chunk=20)
    assert {(r.i, r.j): r.g for r in g.collect()} == pytest.approx(want)


def test_products_are_summed_in_the_tasks(spark):
    """A batch leaves one row an id, and what is held is bounded; before, every cell's vector was a row of its own up to the shuffle."""
    import pyarrow as pa
    from rankfold.operators import factors as FX
    rng = np.random.default_rng(3)
    ids, w, vec = [f"k{x}" for x in rng.integers(0, 30, 400)], rng.normal(size=400), rng.normal(size=(400, 4))
    t = pa.table({"id": ids, "w": w, "vec": vec.tolist()})
    for held in (10, 1000):
        out = pa.Table.from_batches(list(FX._sums(held)(t.to_batches(max_chunksize=50)))).to_pandas()
        assert len(out) == 30 if held == 1000 else 30 <= len(out) < 400
        for k in set(ids):
            mine = np.array(ids) == k
            assert np.allclose(np.sum(list(out[out["id"] == k]["vec"]), axis=0), w[mine] @ vec[mine])
    cells = spark.createDataFrame([*zip(ids, [f"c{j}" for j in range(400)], map(float, w), strict=True)], "u string, i string, w double")
    vectors = spark.createDataFrame([(f"c{j}", [float(x) for x in vec[j]]) for j in range(400)], "id string, vec array<double>")
    got = {r.id: r.vec for r in FX._product(cells, vectors, "i", "u").collect()}
    assert set(got) == set(ids) and all(np.allclose(got[k], w[np.array(ids) == k] @ vec[np.array(ids) == k]) for k in got)
