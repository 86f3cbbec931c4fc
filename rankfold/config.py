"""Frozen defaults of the recommendation system (parameters, not magic numbers)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # fixed values: data preparation
    min_user_interactions: int = 5
    max_training_users: int | None = None  # no cap unless asked for
    test_fraction: float = 0.2
    popularity_from: str = "all"  # or "train": item popularity without the held-out pairs
    # fixed values: implicit-feedback event weights; unknown events weigh 1
    event_weights: tuple = (("view", 1.0), ("addtocart", 3.0), ("transaction", 5.0))
    default_weight: float = 1.0
    # fixed values: models
    hybrid_collab_weight: float = 0.6
    hybrid_content_weight: float = 0.4
    svd_components: int = 50
    svd_iterations: int = 10
    ease_lambda: float = 500.0
    ease_max_items: int | None = None
    tfidf_max_features: int | None = None
    # fixed values: popularity buckets used as item feature tokens
    bucket_high: int = 100
    bucket_medium: int = 20
    # fixed values: fairness / re-ranking
    mmr_lambda: float = 0.7
    popularity_bias_threshold: float = 0.3
    min_category_diversity: float = 0.3
    long_tail_threshold: float = 0.2
    segment_gap_threshold: float = 0.2
    # fixed values: serving limits
    max_recommendations: int = 100
    default_recommendations: int = 5
    eval_k: int = 10
    percentiles: tuple = field(default=(20, 50, 80, 95))

    def weights(self) -> dict:
        return dict(self.event_weights)


DEFAULTS = Settings()
