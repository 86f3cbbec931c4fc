"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Quality classifier, near-duplicate removal, benchmark decontamination, masking
of personal data, packing. All but the last return the columns of their input.

Defined cases, in every stage: a null or empty text is judged as an empty one
and stays null or empty; columns that the stage does not use pass through,
whatever their names; rows that repeat with one id share one verdict; rows
without an id have no copies; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.llm import classifier, decontaminate, minhash, pack, pii
from rankfold.llm.queries import quality_model, table, tokenizer_paths
from rankfold.llm.text import free_name, rows_of
from rankfold.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.7) go."""
    out = free_name(docs, "_score")
    scored = classifier.add_score(docs, quality_model(spark, docs, sf_dir), out=out)
    return rows_of(scored.where(F.col(out) >= 0.7), *docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    found = minhash.near_duplicates(docs, percent=80, size=5)
    return rows_of(docs.join(found.where("component_id <> doc_id").select("doc_id").distinct(), "doc_id", "left_anti"), *docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    out = free_name(docs, "_hits")
    found = decontaminate.mark_contamination(docs, table(spark, sf_dir, "benchmark"), words=10, out=out)
    return rows_of(found.where(F.col(out)["n_hit"] == 0), *docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are masked by their kind; n_chars follows (a null text keeps it)."""
    out = free_name(docs, "_pii")
    found = pii.mark_personal(docs, pii.fit(docs), out=out, mask=True)
    length = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return rows_of(found.withColumn("text", F.col(out)["masked"]).withColumn("n_chars", length), *docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, sequences of at most 1024 tokens."""
    path, ranks = tokenizer_paths()
    return pack.pack(docs, path, ranks, length=1024).select(
        F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_classifier", quality), ("minhash_near_dedup", near_dedup), ("benchmark_decontamination", decontamination),
          ("pii", personal_data), ("packing", packing)]

#: The classifier's training has no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            out.write.parquet(at := scratch_path(spark, f"stage-{name}"))
            out = spark.read.parquet(at)
        docs = out
    return docs
