"""Documents made ready for training, in stages that are each stored before the next reads them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscale.llm import catalog, contamination, jaccard_join, quality_kernel, unit_dedup
from cohortscale.llm.rows import table
from cohortscale.session import scratch_path, small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    small_batches(spark)
    scored = quality_kernel.score_verdicts(docs, catalog.quality_model(spark, sf_dir))
    return scored.filter(F.col("score") >= catalog.GOOD_AT).drop("score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one of least id stays."""
    small_batches(spark)
    return jaccard_join.first_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut; every document stays."""
    small_batches(spark)
    return unit_dedup.remove_repeated_units(docs).drop("removed")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go."""
    return contamination.decontaminate(docs, catalog.sealed_statements(spark, sf_dir))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and digests of the ids and of the text they decode to."""
    small_batches(spark)
    return catalog.encoded_digests(spark, docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: No SQL: learned scores and ranked merges are beyond it; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
