"""FX-2 fairness / re-ranking fixture (hand-computed values)."""
import math

import numpy as np
import pytest

from rankfold.operators import fairness as FA
from rankfold.operators import recommend as R
from rankfold.operators import rerank as M


def test_thresholds_tiers_gini(fx2):
    pop, cats, _ = fx2
    t = FA.thresholds(pop).first()
    assert (t.p20, t.p50, t.p80, t.p95) == pytest.approx((2.6, 6.0, 8.4, 9.6))
    tiers = {r.item_id: r.tier for r in FA.popularity_tiers(pop, pop).collect()}
    assert tiers == {"i1": "head", "i2": "torso", "i3": "torso", "i4": "torso", "i5": "tail"}
    g = FA.gini(pop, None, "popularity").first().gini
    assert g == pytest.approx(0.3286, abs=1e-4)
    assert FA.gini(pop, None, "popularity", reference_compat=True).first().gini == pytest.approx(-g)


def test_entropy_and_novelty_of_all_five(spark, fx2):
    pop, cats, _ = fx2
    recs = spark.createDataFrame([("u", k + 1, f"i{k + 1}") for k in range(5)], "user_id string, rank int, item_id string")
    d = FA.category_diversity(recs, cats).first()
    assert d.category_diversity_score == pytest.approx(0.9602, abs=1e-4)
    from rankfold.operators.evaluate import novelty
    assert novelty(recs, pop).first().novelty == pytest.approx(2.7090, abs=1e-4)


def test_popularity_fallback_scores(spark, fx2):
    pop, _, _ = fx2
    users = spark.createDataFrame([("cold",)], "user_id string")
    got = [r.score for r in R.recommend_popular(users, pop, 5).orderBy("rank").collect()]
    assert got == pytest.approx([1.0, 0.916314, 0.811508, 0.57813, 0.289065], abs=1e-6)


def test_popularity_penalty(fx2):
    pop, _, cand = fx2
    out = M.penalize_popularity(cand, pop).orderBy("rank").collect()
    assert [r.item_id for r in out] == ["i1", "i2", "i5", "i4", "i3"]
    got = {r.item_id: r.score for r in out}
    assert [got[f"i{k}"] for k in range(1, 6)] == pytest.approx([0.45, 0.433474, 0.415972, 0.426561, 0.427734], abs=1e-6)


def _mmr_reference(scores, vecs, lam=0.7):
    n = len(scores)
    sel = [int(np.argmax(scores))]
    rem = [i for i in range(n) if i != sel[0]]
    while rem:
        vals = [lam * scores[i] - (1 - lam) * max(float(vecs[i] @ vecs[j]) for j in sel) for i in rem]
        b = rem[int(np.argmax(vals))]
        sel.append(b)
        rem.remove(b)
    return sel


def test_mmr_matches_greedy_and_is_permutation(spark):
    rng = np.random.default_rng(3)
    rows, facs, expected = [], [], {}
    for u in range(12):
        n = 8
        sc = np.round(np.sort(rng.random(n))[::-1], 6)
        V = rng.normal(size=(n, 5))
        V /= np.linalg.norm(V, axis=1, keepdims=True)
        for k in range(n):
            rows.append((f"u{u}", k + 1, f"u{u}_i{k}", float(sc[k])))
            facs.append((f"u{u}_i{k}", [float(x) for x in V[k]]))
        expected[f"u{u}"] = [f"u{u}_i{k}" for k in _mmr_reference(sc, V)]
    recs = spark.createDataFrame(rows, "user_id string, rank int, item_id string, score double")
    f = spark.createDataFrame(facs, "id string, factor array<double>")
    out = M.rerank_mmr(recs, f).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.user_id, r.rank)):
        got.setdefault(r.user_id, []).append(r.item_id)
    assert got == expected


def test_mmr_unchanged_without_factors(spark, fx2):
    _, _, cand = fx2
    f = spark.createDataFrame([("i1", [1.0, 0.0])], "id string, factor array<double>")
    out = M.rerank_mmr(cand, f).orderBy("rank").collect()
    assert [r.item_id for r in out] == ["i1", "i2", "i3", "i4", "i5"]


def _calibrated_reference(cands, cats, hist_cats):
    from collections import Counter
    target = {c: n / len(hist_cats) for c, n in Counter(hist_cats).items()}
    sel, rem, counts = [], list(cands), Counter()
    while rem:
        best, best_kl = None, float("inf")
        for it in rem:
            tc = Counter(counts)
            tc[cats[it]] += 1
            tot = sum(tc.values())
            kl = round(sum(p * math.log((p + 1e-12) / (tc[c] / tot + 1e-12)) for c, p in sorted(target.items())), 9)
            if kl < best_kl:
                best, best_kl = it, kl
        sel.append(best)
        rem.remove(best)
        counts[cats[best]] += 1
    return sel


def test_calibrated_matches_greedy(spark, fx2):
    _, cats, cand = fx2
    hist = spark.createDataFrame([("u1", "i1"), ("u1", "i2"), ("u1", "i3")], "user_id string, item_id string")
    out = M.rerank_calibrated(cand, hist, cats).orderBy("rank").collect()
    cmap = {r.item_id: r.category for r in cats.collect()}
    exp = _calibrated_reference([f"i{k}" for k in range(1, 6)], cmap, ["electronics", "electronics", "books"])
    assert [r.item_id for r in out] == exp
    assert sorted(r.item_id for r in out) == [f"i{k}" for k in range(1, 6)]


def test_long_tail_exposure(spark, fx2):
    pop, _, _ = fx2
    recs = spark.createDataFrame([("a", 1, "i1"), ("a", 2, "i3"), ("b", 1, "i2"), ("b", 2, "i5"), ("c", 1, "i4")],
                                 "user_id string, rank int, item_id string")
    e = {r.tier: r.exposure for r in FA.long_tail_exposure(recs, pop, pop).collect()}
    assert e == {"head": 1.0, "torso": 1.0, "tail": 1.0}
    one = spark.createDataFrame([("a", 1, "i1"), ("a", 2, "i2")], "user_id string, rank int, item_id string")
    t = {r.tier: r for r in FA.long_tail_exposure(one, pop, pop).collect()}
    assert t["tail"].exposure == 0.0 and t["tail"].tail_suppression_detected


def test_popularity_bias_flag(spark, fx2):
    pop, _, cand = fx2
    b = FA.popularity_bias(cand, pop).first()
    assert b.popular_items_fraction == pytest.approx(0.2)  # only i1 >= p80 = 8.4
    assert not b.popularity_bias_detected


def test_popular_with_seen_mask_matches_brute_force(spark):
    import random
    rnd = random.Random(5)
    pop_rows = [(f"i{k:03d}", rnd.randint(1, 40)) for k in range(120)]
    pop = spark.createDataFrame(pop_rows, "item_id string, popularity long")
    order = [i for i, _ in sorted(pop_rows, key=lambda r: (-r[1], r[0]))]
    seen_rows = [("heavy", i) for i in order[:90]]  # has seen most of the head of the list
    seen_rows += [(f"u{u}", i) for u in range(20) for i in rnd.sample(order, rnd.randint(0, 15))]
    seen = spark.createDataFrame(seen_rows, "user_id string, item_id string")
    users = spark.createDataFrame([("heavy",), ("cold",)] + [(f"u{u}",) for u in range(20)], "user_id string")
    got = {}
    for r in R.recommend_popular(users, pop, 7, seen=seen).collect():
        got.setdefault(r.user_id, {})[r.rank] = r.item_id
    for u in ["heavy", "cold"] + [f"u{u}" for u in range(20)]:
        s = {i for uu, i in seen_rows if uu == u}
        expect = [i for i in order if i not in s][:7]
        assert [got[u][k] for k in range(1, 8)] == expect
