"""Sources and sinks (A-*): event / property readers, bundle store, reports, run log.

Readers use fixed schemas (no inference) so column pruning and predicate
pushdown reach the files. Writers go to the cluster's shared storage.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: raw event and item-property schemas of the reference's CSV inputs
EVENTS = T.StructType([
    T.StructField("timestamp", T.LongType()), T.StructField("visitorid", T.LongType()),
    T.StructField("event", T.StringType()), T.StructField("itemid", T.DoubleType()),
    T.StructField("transactionid", T.DoubleType())])
PROPERTIES = T.StructType([
    T.StructField("timestamp", T.LongType()), T.StructField("itemid", T.LongType()),
    T.StructField("property", T.StringType()), T.StructField("value", T.StringType())])

BUNDLE_TABLES = ("train", "pop", "items", "categories", "tfidf", "item_class", "class_vec", "class_sim",
                 "user_factors", "item_factors")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def read_events(spark: SparkSession, path: str, fmt: str = "parquet", stream: bool = False,
                schema: T.StructType | None = None) -> DataFrame:
    """A-1 / A-9: event log with header; a missing path fails (batch)."""
    schema = schema or EVENTS
    r = spark.readStream if stream else spark.read
    r = r.schema(schema)
    if fmt == "csv":
        return r.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return r.format(fmt).load(path)


def read_properties(spark: SparkSession, paths, fmt: str = "csv",
                    schema: T.StructType | None = None) -> DataFrame:
    """A-2: several property files read as one; missing parts are skipped and
    no part at all gives an empty DataFrame with the schema."""
    schema = schema or PROPERTIES
    present = [p for p in paths if _exists(spark, p)]
    if not present:
        return spark.createDataFrame([], schema)
    r = spark.read.schema(schema)
    if fmt == "csv":
        return r.option("header", True).csv(present)
    return r.format(fmt).load(present)


def _fs(spark: SparkSession, path: str):
    """The path and its file system, for names that are not tables."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _publish(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all: written beside, then renamed over."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    beside, fs = _fs(spark, f"{path}.{uuid.uuid4().hex[:8]}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    files.rename(files.makeQualified(beside), files.makeQualified(_fs(spark, path)[0]), over)


def _published(spark: SparkSession, path: str) -> str | None:
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode().strip()
    finally:
        stream.close()


def _bundle_parts(bundle) -> dict:
    """Table name -> (DataFrame, how to write it)."""
    from rankfold.operators.ease import write_tiles
    plain = lambda df, at: df.write.parquet(at)
    parts = {name: (df, plain) for name in BUNDLE_TABLES if (df := getattr(bundle, name, None)) is not None}
    if bundle.B is not None:
        parts["ease_items"], parts["ease_tiles"] = (bundle.B.items, plain), (bundle.B.tiles, write_tiles)
    return parts


def save_bundle(bundle, path: str, metadata: dict | None = None, keep: int = 2) -> str:
    """A-5: one version folder ``path/versions/<name>`` with every model table, a
    metadata table and the row counts, then the name in ``path/CURRENT``.

    The pointer is written last and at once, so a reader finds the former
    version until the new one is whole, however far a save that dies has come.
    Versions beyond the last ``keep`` published ones go afterwards. Returns the name.
    """
    parts = _bundle_parts(bundle)
    spark = bundle.train.sparkSession
    version = f"{_dt.datetime.now(_dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:6]}"
    at = f"{path}/versions/{version}"
    counts = []
    for name, (df, write) in parts.items():
        write(df, f"{at}/{name}")
        counts.append((name, spark.read.parquet(f"{at}/{name}").count()))  # from the files' footers
    meta = dict(metadata or {})
    meta.setdefault("created_at", _dt.datetime.now(_dt.timezone.utc).isoformat())
    if bundle.B is not None:
        meta["ease_tile"] = bundle.B.tile
    rows = [(str(k), str(v)) for k, v in sorted(meta.items())]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.parquet(f"{at}/_metadata")
    spark.createDataFrame([*counts, ("_metadata", len(rows))], "name string, n long").coalesce(1).write.parquet(f"{at}/_counts")
    _publish(spark, f"{path}/CURRENT", version)
    _drop_versions(spark, path, version, keep)
    return version


def _drop_versions(spark: SparkSession, path: str, current: str, keep: int) -> None:
    """Removes whole versions older than the last ``keep``; unfinished ones, which may be another save at work, only if older."""
    root, fs = _fs(spark, f"{path}/versions")
    names = sorted(s.getPath().getName() for s in fs.listStatus(root))
    whole = [n for n in names if n <= current and _exists(spark, f"{path}/versions/{n}/_counts")]
    for name in names:
        if len(whole) > keep and name < whole[-keep]:
            fs.delete(_fs(spark, f"{path}/versions/{name}")[0], True)


def load_bundle(spark: SparkSession, path: str):
    """A-6: the version that ``path/CURRENT`` names, each table with the rows that were
    counted when it was saved; a bundle that is missing, unreadable or of
    other counts raises ``RuntimeError('model not initialised')``."""
    from rankfold.operators.ease import Weights
    from rankfold.operators.model import Bundle
    try:
        version = _published(spark, f"{path}/CURRENT")
        if not version:
            raise FileNotFoundError(path)
        at = f"{path}/versions/{version}"
        counts = {r["name"]: r["n"] for r in spark.read.parquet(f"{at}/_counts").collect()}  # one row per table
        tables = {name: spark.read.parquet(f"{at}/{name}") for name in counts}
        wrong = [name for name, n in counts.items() if tables[name].count() != n]
    except Exception as e:  # noqa: BLE001 - broken files mean "not initialised"
        raise RuntimeError("model not initialised") from e
    if wrong:
        raise RuntimeError("model not initialised") from ValueError(f"rows are missing from {', '.join(sorted(wrong))}")
    meta = tables["_metadata"]
    known = {r["key"]: r["value"] for r in meta.where(F.col("key").isin("hybrid_collab_weight", "hybrid_content_weight", "ease_tile")).collect()}
    weights = {k: float(v) for k, v in known.items() if k != "ease_tile"}  # the hybrid weights are part of the model
    B = None
    if "ease_tiles" in tables:
        B = Weights(tables["ease_items"], tables["ease_tiles"], counts["ease_items"], int(known["ease_tile"]))
    return Bundle(**{name: tables.get(name) for name in BUNDLE_TABLES}, B=B, collab_weight=weights.get("hybrid_collab_weight"),
                  content_weight=weights.get("hybrid_content_weight")), meta


def model_info(meta: DataFrame) -> DataFrame:
    """A-6 model-info row: metadata as one map row."""
    return meta.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("info"))


def write_report(df: DataFrame, path: str) -> None:
    """A-7: a (small) report as JSON; one file since the report is one row / a few rows."""
    df.coalesce(1).write.mode("overwrite").json(path)


def run_rows(spark: SparkSession, metrics: DataFrame, kind: str, params: dict | None = None,
             run_id: str | None = None) -> DataFrame:
    """A-8: a run as long rows (run_id, kind, key_type, key, value) — params as
    strings, float metrics with '@' in names replaced by '_at_'."""
    run_id = run_id or f"{kind}_{_dt.datetime.now(_dt.timezone.utc).strftime('%Y%m%d_%H%M%S')}"
    cols = [c for c, t in metrics.dtypes if t in ("double", "float", "int", "bigint")]
    stack = F.inline(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in cols]))
    m = metrics.select(stack).select(F.lit("metric").alias("key_type"),
                                     F.regexp_replace("key", "@", "_at_").alias("key"),
                                     F.col("value").cast("string").alias("value"))
    if params:
        p = spark.createDataFrame([("param", str(k), str(v)) for k, v in sorted(params.items())],
                                  "key_type string, key string, value string")
        m = m.unionByName(p)
    return m.select(F.lit(run_id).alias("run_id"), F.lit(kind).alias("kind"), "key_type", "key", "value")


def append_run(rows: DataFrame, path: str) -> None:
    """A-8 sink: append the run rows to the run log table."""
    rows.write.mode("append").parquet(path)
