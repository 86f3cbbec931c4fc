"""Model bundle: the DataFrames a recommender needs (replaces a pickled bundle)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from rankfold.config import DEFAULTS, Settings
from rankfold.operators import features as FT
from rankfold.operators.ease import Weights
from rankfold.session import materialize


@dataclass
class Bundle:
    train: DataFrame                      # (user_id, item_id, weight, ...)
    pop: DataFrame                        # (item_id, popularity)
    items: DataFrame                      # catalog (item_id)
    categories: DataFrame | None = None   # (item_id, category)
    tfidf: DataFrame | None = None        # (doc=item_id, token, value)
    item_class: DataFrame | None = None   # (item_id, cls)
    class_vec: DataFrame | None = None    # (cls, token, value)
    class_sim: DataFrame | None = None    # (cls_a, cls_b, sim), none where sim is 0; only where asked for
    B: Weights | None = None              # EASE weights (tile store)
    user_factors: DataFrame | None = None  # (id, factor)
    item_factors: DataFrame | None = None  # (id, factor)
    collab_weight: float | None = None    # weights of the hybrid blend; None: the defaults
    content_weight: float | None = None


def content_model(items: DataFrame, categories: DataFrame | None, pop: DataFrame,
                  high: int | None = None, medium: int | None = None, max_features: int | None = None):
    """C-3 + C-2 + C-4: item texts -> TF-IDF -> classes and their vectors."""
    texts = FT.item_features(items, categories, pop, high, medium)
    tf = materialize(FT.tfidf(texts, "item_id", "text", max_features))
    item_class, class_vec = FT.item_classes(tf, items)
    item_class = materialize(item_class)
    return texts, tf, item_class, materialize(class_vec)


def build_bundle(train: DataFrame, pairs: DataFrame, pop: DataFrame, categories: DataFrame | None,
                 ease_B: Weights | None = None, user_factors: DataFrame | None = None,
                 item_factors: DataFrame | None = None, content: bool = True, cfg: Settings = DEFAULTS) -> Bundle:
    items = pairs.select("item_id").distinct()
    b = Bundle(train=train, pop=pop, items=items, categories=categories, B=ease_B,
               user_factors=user_factors, item_factors=item_factors,
               collab_weight=cfg.hybrid_collab_weight, content_weight=cfg.hybrid_content_weight)
    if content:
        _, b.tfidf, b.item_class, b.class_vec = content_model(
            items, categories, pop, cfg.bucket_high, cfg.bucket_medium, cfg.tfidf_max_features)
    return b
