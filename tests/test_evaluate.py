"""FX-3 ranking formulas and evaluation edge cases."""
import pytest

from rankfold.operators import evaluate as V


def _recs(spark, lists):
    rows = [(u, r + 1, i) for u, items in lists.items() for r, i in enumerate(items)]
    return spark.createDataFrame(rows, "user_id string, rank int, item_id string")


def _truth(spark, t):
    return spark.createDataFrame([(u, i) for u, items in t.items() for i in items], "user_id string, item_id string")


@pytest.mark.parametrize("lst,mrr,hit", [(["i1", "i2", "i3"], 1.0, 1.0), (["i2", "i1", "i3"], 0.5, 1.0),
                                         (["i2", "i3"], 0.0, 0.0)])
def test_mrr_and_hit(spark, lst, mrr, hit):
    per = V.per_user_ranking(_recs(spark, {"u": lst}), _truth(spark, {"u": ["i1"]}), 10).first()
    assert per.mrr == pytest.approx(mrr) and per.hit == hit


def test_precision_recall_ndcg(spark):
    per = V.per_user_ranking(_recs(spark, {"u": ["a", "b", "c"]}), _truth(spark, {"u": ["b", "z"]}), 10).first()
    assert per.precision == pytest.approx(0.1)      # k fixed at 10 even for a shorter list
    assert per.recall == pytest.approx(0.5)
    import math
    assert per.ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))


def test_f1_of_means(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(0.4, 0.6), (0.0, 0.5)], "p double, r double")
    got = [r.f for r in df.select(V.f1(F.col("p"), F.col("r")).alias("f")).collect()]
    assert got == pytest.approx([0.48, 0.0])


def test_unknown_user_gives_zero_report(spark):
    recs = _recs(spark, {"u1": ["i1"]})
    rep = V.ranking_metrics(recs.where("user_id = 'nobody'"), _truth(spark, {"unknown_user": ["i1"]}), 10).first()
    assert rep.n_eval_users == 0 and rep.precision_at_k == 0.0 and rep.ndcg_at_k == 0.0


def test_intra_list_diversity_no_pair_join(spark):
    f = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0])], "id string, factor array<double>")
    d = V.intra_list_diversity(_recs(spark, {"u": ["a", "b", "c"]}), f).first()
    # pairwise cosines: ab 0, ac 1, bc 0 -> mean 1/3
    assert d.ild == pytest.approx(1 - 1 / 3)
