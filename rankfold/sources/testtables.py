"""Adapters from the driver's test tables to the recommendation data model.

Table E: ``events`` -> (user_id, item_id, event, ts, event_id); item = props.k.
Table L: ``lineitem JOIN orders`` -> user = o_custkey, item = l_partkey,
          event by l_returnflag, ts = l_shipdate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: event weights of the two test interaction tables
E_WEIGHTS = {"view": 1.0, "click": 3.0, "purchase": 5.0}
L_WEIGHTS = {"N": 1.0, "A": 3.0, "R": 5.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").alias("item_id"),
        F.col("event_type").alias("event"),
        F.col("ts"),
        F.col("event_id"),
    )


def events_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber",
                                                  "l_returnflag", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # orders is the smaller side but grows with the data: let AQE pick the join
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_partkey").cast("string").alias("item_id"),
        F.col("l_returnflag").alias("event"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("event_id"),
    )


def categories(spark: SparkSession, sf_dir: str, attr: str = "p_type") -> DataFrame:
    """Item categories from ``part`` (item_id = p_partkey)."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("item_id"),
        F.col(attr).alias("category"))


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as (id, factor array<double>)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("factor"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request / prediction log derived from ``events`` (one row per request):
    endpoint = event type, 5xx for 'error' events, latency = value / 100 s,
    prediction score = value / 500, weekly model versions."""
    ev = table(spark, sf_dir, "events")
    et = F.col("event_type")
    return ev.select(
        F.col("ts"), et.alias("endpoint"),
        F.when(et.isin("purchase", "signup"), F.lit("POST")).otherwise(F.lit("GET")).alias("method"),
        F.when(et == "error", F.lit(500)).otherwise(F.lit(200)).alias("status"),
        (F.col("value") / 100.0).alias("duration_s"),
        F.when(et == "click", F.lit("content_based")).when(et == "purchase", F.lit("hybrid"))
         .otherwise(F.lit("collaborative")).alias("recommendation_type"),
        (F.col("value") / 500.0).alias("score"),
        F.concat(F.lit("v"), F.weekofyear("ts").cast("string")).alias("model_version"),
        F.col("user_id").cast("string").alias("user_id"))
