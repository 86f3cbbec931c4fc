"""Event cleaning, weighting and aggregation (B-*, G-*, J-1..J-3).

Every operator is DataFrame -> DataFrame; nothing is collected. Aggregations
are plain ``groupBy`` so Spark runs a partial (map-side) hash aggregate before
the shuffle — a hot user or item is pre-aggregated per task before it moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.config import DEFAULTS
from rankfold.functions.exprs import event_weight, id_string, popularity_bucket

U, I = "user_id", "item_id"


def clean_events(ev: DataFrame, user="visitorid", item="itemid", event="event",
                 ts="timestamp", ts_unit: str | None = "ms", keep=()) -> DataFrame:
    """B-1..B-3: drop null items, epoch-ms -> timestamp, ids -> canonical strings."""
    t = F.col(ts)
    if ts_unit == "ms":
        t = F.timestamp_millis(F.col(ts).cast("bigint"))
    return (ev.where(F.col(item).isNotNull())
              .select(id_string(user).alias(U) if user != U else F.col(U).cast("string").alias(U),
                      id_string(item).alias(I) if item != I else F.col(I).cast("string").alias(I),
                      F.col(event).alias("event"), t.alias("ts"), *keep))


def weigh(ev: DataFrame, weights: dict | None = None, default: float | None = None,
          event: str = "event") -> DataFrame:
    """B-5: attach implicit-feedback weight per event."""
    weights = DEFAULTS.weights() if weights is None else weights
    default = DEFAULTS.default_weight if default is None else default
    return ev.withColumn("weight", event_weight(event, weights, default))


def interactions(ev: DataFrame) -> DataFrame:
    """G-1 + G-8 (+J-1 folded in): sum(weight) and last timestamp per (user, item)."""
    return (ev.groupBy(U, I)
              .agg(F.sum("weight").cast("double").alias("weight"),
                   F.max("ts").alias("last_ts"),
                   F.count(F.lit(1)).alias("n_events")))


def user_pair_counts(inter: DataFrame) -> DataFrame:
    return inter.groupBy(U).agg(F.count(F.lit(1)).alias("n_items"))


def active_users(inter: DataFrame, min_items: int | None = None,
                 max_users: int | None = None) -> DataFrame:
    """G-2 + G-3: users with >= min distinct items; with ``max_users``, the most active.

    Cap ties: pair count desc, then user_id asc. A cap may be large, so it is applied on distributed global ranks (``ranking.top_n``), not by a
    single-task merge of per-partition top-N lists.
    """
    min_items = DEFAULTS.min_user_interactions if min_items is None else min_items
    max_users = DEFAULTS.max_training_users if max_users is None else max_users
    users = user_pair_counts(inter).where(F.col("n_items") >= min_items)
    if max_users is not None:
        from rankfold.operators.ranking import top_n
        users = top_n(users, max_users, [F.desc("n_items"), F.asc(U)])
    return users


def filter_active(inter: DataFrame, users: DataFrame) -> DataFrame:
    """B-7 / J-2: semi join pairs to the active users."""
    return inter.join(users.select(U), U, "left_semi")


def item_popularity(inter: DataFrame) -> DataFrame:
    """G-4: number of interacting users per item."""
    return inter.groupBy(I).agg(F.count(F.lit(1)).alias("popularity"))


def event_type_counts(ev: DataFrame, event: str = "event") -> DataFrame:
    """G-5."""
    return ev.groupBy(event).agg(F.count(F.lit(1)).alias("n"))


def dataset_stats(inter: DataFrame) -> DataFrame:
    """G-6: #users, #items, #pairs, sparsity (one aggregate, one pass)."""
    s = inter.agg(F.countDistinct(U).alias("num_users"),
                  F.countDistinct(I).alias("num_items"),
                  F.count(F.lit(1)).alias("num_interactions"))
    return s.withColumn(
        "sparsity",
        F.lit(1.0) - F.try_divide(F.col("num_interactions").cast("double"),
                                  (F.col("num_users") * F.col("num_items")).cast("double")))


def latest_property(props: DataFrame, name: str = "categoryid", item: str = "itemid",
                    prop: str = "property", value: str = "value", ts: str = "timestamp",
                    items: DataFrame | None = None) -> DataFrame:
    """B-6 + G-7: last non-null value of one property per item.

    Filter is pushed to the scan; optional semi join to the active items first.
    ``max_by`` keeps the aggregation a single partial+final hash aggregate.
    """
    p = props.where((F.col(prop) == name) & F.col(value).isNotNull())
    p = p.select(id_string(item).alias(I), F.col(value).cast("string").alias("value"),
                 F.col(ts).alias("ts"))
    if items is not None:
        p = p.join(items.select(I), I, "left_semi")
    return p.groupBy(I).agg(F.max_by("value", F.struct("ts", "value")).alias("value"))


def popularity_percentiles(pop: DataFrame, pcts=(20, 50, 80, 95),
                           col: str = "popularity") -> DataFrame:
    """G-10 / F-1: exact linear-interpolated percentiles (not approx)."""
    arr = F.percentile(F.col(col).cast("double"), [p / 100.0 for p in pcts])
    row = pop.agg(arr.alias("p"))
    return row.select(*[F.col("p")[i].alias(f"p{p}") for i, p in enumerate(pcts)])


def with_bucket(pop: DataFrame, high: int | None = None, medium: int | None = None) -> DataFrame:
    """B-8."""
    high = DEFAULTS.bucket_high if high is None else high
    medium = DEFAULTS.bucket_medium if medium is None else medium
    return pop.withColumn("bucket", popularity_bucket("popularity", high, medium))


def dictionary_encode(df: DataFrame, key: str, order=None, name: str | None = None) -> DataFrame:
    """J-3: dense 0-based index over the distinct keys, ordered by ``order``.

    No global single-partition window: keys are range-partitioned and numbered
    per partition, then offset by the running partition sizes (``global_rank``).
    """
    from rankfold.operators.ranking import global_rank
    name = name or f"{key}_idx"
    keys = df.select(key).distinct()
    order = order or [F.asc(key)]
    g = global_rank(keys, order, "_g")
    return g.select(key, (F.col("_g") - 1).alias(name))


def first_appearance_order(inter: DataFrame) -> DataFrame:
    """Users/items in first-appearance order of the (user, item)-sorted pairs."""
    return inter.orderBy(U, I)
