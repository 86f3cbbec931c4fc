"""Shared lazy plan fragments over the driver's test tables.

Nothing here executes: every function returns a DataFrame plan, so each
registered query is one Catalyst plan from the parquet scans to the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.config import DEFAULTS, Settings
from rankfold.operators import prepare as P
from rankfold.operators import split as S
from rankfold.session import remove_path, scratch_path, stored
from rankfold.sources import testtables as TT

K = 10
MIN_ITEMS = 5
MAX_USERS = None  # every active user
TEST_FRACTION = 0.2
MATERIALIZE_SPLIT = True  # measured: re-deriving the split per use is slower


@dataclass
class Prepared:
    events: DataFrame        # (user_id, item_id, event, ts, event_id, weight)
    inter: DataFrame         # all pairs (user_id, item_id, weight, last_ts, n_events)
    min_items: int = MIN_ITEMS
    max_users: int | None = MAX_USERS
    test_fraction: float = TEST_FRACTION
    popularity_from: str = "all"

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        self._at = {**getattr(self, "_at", {}), name: (at := scratch_path(df.sparkSession, name))}
        return stored(df, name, at)

    def train_alone(self) -> DataFrame:
        """``train`` for a query that reads no other table: those that led to the split are removed (and made again if asked for)."""
        train = self.train
        if MATERIALIZE_SPLIT:
            for at in self.__dict__.pop("_at", {}).values():
                remove_path(train.sparkSession, at)
            for name in ("counted", "active", "pairs"):
                self.__dict__.pop(name, None)
        return train

    @cached_property
    def counted(self) -> DataFrame:
        """``inter``, written once: the active users are counted on it and their pairs taken from it."""
        return self._kept(self.inter, "inter")

    @cached_property
    def active(self) -> DataFrame:  # active users (user_id, n_items), capped
        return P.active_users(self.counted, self.min_items, self.max_users)

    @cached_property
    def pairs(self) -> DataFrame:
        """Pairs of active users: written once to the shared folder, since the
        popularity, the split, the catalog and the models all read them (the
        event scan, G-1 and the semi join run once)."""
        return self._kept(P.filter_active(self.counted, self.active), "pairs")

    @cached_property
    def pop(self) -> DataFrame:  # (item_id, popularity) over active pairs, or over the train part
        if self.popularity_from not in ("all", "train"):
            raise ValueError(f"popularity_from must be 'all' or 'train', not {self.popularity_from!r}")
        return P.item_popularity(self.pairs if self.popularity_from == "all" else self.train)

    @cached_property
    def split(self) -> DataFrame:
        """pairs + is_train, built on first use and written once to the shared
        folder: every model / evaluation step reads it, so its lineage is cut
        here instead of being re-planned per use."""
        sp = S.temporal_holdout(self.pairs, order=("last_ts", "item_id"), test_fraction=self.test_fraction)
        return stored(sp, "split") if MATERIALIZE_SPLIT else sp

    @cached_property
    def train(self) -> DataFrame:
        return self.split.where(F.col("is_train")).drop("is_train")

    @cached_property
    def test(self) -> DataFrame:
        return self.split.where(~F.col("is_train")).drop("is_train")


def prepare(events: DataFrame, cfg: Settings = DEFAULTS) -> Prepared:
    """Plans over any event table (user_id, item_id, event, ts): weights, activity
    threshold, cap, hold-out and popularity as ``cfg`` says."""
    ev = P.weigh(events, cfg.weights(), cfg.default_weight)
    return Prepared(ev, P.interactions(ev), cfg.min_user_interactions, cfg.max_training_users, cfg.test_fraction, cfg.popularity_from)


def prepared(spark: SparkSession, sf_dir: str, table: str = "E") -> Prepared:
    if table == "E":
        ev = P.weigh(TT.events_e(spark, sf_dir), TT.E_WEIGHTS, 1.0)
    else:
        ev = P.weigh(TT.events_l(spark, sf_dir), TT.L_WEIGHTS, 1.0)
    return Prepared(ev, P.interactions(ev))


def test_users(p: Prepared) -> DataFrame:
    return p.test.select("user_id").distinct()


def bundle(spark: SparkSession, sf_dir: str, table: str = "E", ease: bool = True,
           factors: bool = False, max_items: int | None = None):
    """Model bundle over a test table: content model always, EASE on request."""
    from rankfold.operators import ease as EA
    from rankfold.operators.model import build_bundle
    p = prepared(spark, sf_dir, table)
    cats = TT.categories(spark, sf_dir)
    B = EA.ease_fit(p.train, 500.0, max_items) if ease else None
    uf = vf = None
    if factors:
        vf = uf = TT.factors(spark, sf_dir)
    return p, build_bundle(p.train, p.pairs, p.pop, cats, B, uf, vf)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request users: every customer id (most are cold for table E)."""
    return TT.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("user_id"))
