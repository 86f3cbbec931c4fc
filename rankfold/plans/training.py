"""C-12: the training flow as one Spark job sequence.

ingest -> weight -> interactions -> active users -> split (checkpointed) ->
content model -> EASE -> latent factors (SVD) -> evaluation -> bundle + run log.
Every step is a DataFrame operator; model tables are written once to the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.config import DEFAULTS, Settings
from rankfold.operators import ease as EA
from rankfold.operators import evaluate as V
from rankfold.operators import factors as FX
from rankfold.operators import prepare as P
from rankfold.operators import recommend as R
from rankfold.operators.model import build_bundle
from rankfold.plans import flows
from rankfold.session import scratch_path
from rankfold.sources import io as IO
from rankfold.sources import testtables as TT


def train(events: DataFrame, categories: DataFrame | None = None, cfg: Settings = DEFAULTS, svd: bool = True,
          out_dir: str | None = None, name: str = "events") -> DataFrame:
    """Train all models on an event table (user_id, item_id, event, ts), evaluate,
    save; returns the run's metrics row. ``categories``: (item_id, category)."""
    return _train(flows.prepare(events, cfg), categories, cfg, svd, out_dir, name)


def train_files(spark: SparkSession, events: str, properties: list[str] = (), cfg: Settings = DEFAULTS, fmt: str = "csv",
                svd: bool = True, out_dir: str | None = None) -> DataFrame:
    """From event and property files (A-1, A-2) to a saved bundle: the last
    category of each item that has events is its category."""
    ev = P.clean_events(IO.read_events(spark, events, fmt))
    cats = None
    if properties:
        cats = P.latest_property(IO.read_properties(spark, properties, fmt), items=ev.select("item_id").distinct()).withColumnRenamed(
            "value", "category")
    return train(ev, cats, cfg, svd, out_dir, name=events)


def train_table(spark: SparkSession, sf_dir: str, table: str = "E", cfg: Settings = DEFAULTS, svd: bool = True,
                out_dir: str | None = None) -> DataFrame:
    """The same flow on a test table, with that table's event weights."""
    return _train(flows.prepared(spark, sf_dir, table), TT.categories(spark, sf_dir), cfg, svd, out_dir, table)


def _train(p: flows.Prepared, categories: DataFrame | None, cfg: Settings, svd: bool, out_dir: str | None, name: str) -> DataFrame:
    spark = p.events.sparkSession
    B = EA.ease_fit(p.train, cfg.ease_lambda, cfg.ease_max_items)
    uf = vf = None
    evr = None
    if svd:
        uf, vf, evr = FX.svd_fit(p.train, k=cfg.svd_components, iterations=cfg.svd_iterations)
    b = build_bundle(p.train, p.pairs, p.pop, categories, B, uf, vf, cfg=cfg)
    users = p.test.select("user_id").distinct()
    recs = R.recommend_scored(users, EA.score_ease_topk(p.train.join(users, "user_id", "left_semi"), B, cfg.eval_k),
                              p.train, cfg.eval_k)
    rep = V.ranking_metrics(recs, p.test, cfg.eval_k, empty_list="zero")
    cov = V.coverage_metrics(recs, p.pairs, p.pairs, p.pop).select("catalog_coverage")
    metrics = rep.crossJoin(cov)  # one-row sides
    if evr is not None:
        metrics = metrics.withColumn("explained_variance_ratio", F.lit(float(evr)))
    out_dir = out_dir or scratch_path(spark, "model")
    IO.save_bundle(b, f"{out_dir}/bundle", {"model_type": "hybrid", "algorithm": "ease+tfidf+svd" if svd else "ease+tfidf", **{
        k: getattr(cfg, k) for k in ("ease_lambda", "hybrid_collab_weight", "hybrid_content_weight", "min_user_interactions",
                                     "test_fraction", "popularity_from", "eval_k")}, "svd_n_components": cfg.svd_components})
    named = metrics.select(*[F.col(c).alias(c.replace("_at_k", f"@{cfg.eval_k}")) for c in metrics.columns])
    IO.append_run(IO.run_rows(spark, named, "hybrid", {"table": name, "ease_lambda": cfg.ease_lambda}),
                  f"{out_dir}/runs")
    return metrics
