"""Masks saved as a voxel table, with a content checksum per sample and a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def checksums(voxels: DataFrame, sample: str = "sample_id") -> DataFrame:
    """SHA-256 of the content of every sample, independent of files and compression.

    Sorted voxels are hashed per slice and the slice hashes per sample, so no task ever holds
    more than one slice of a sample, or one hash per slice.
    """
    voxel = F.concat_ws(":", "cls", F.col("y").cast("string"), F.col("x").cast("string"))
    slices = voxels.groupBy(sample, "z").agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list(voxel)), ","), 256).alias("_h"),
        F.count("*").alias("_n"),
    )
    listed = F.sort_array(F.collect_list(F.struct("z", "_h")))
    text = F.transform(listed, lambda s: F.concat_ws("=", s["z"].cast("string"), s["_h"]))
    return slices.groupBy(sample).agg(
        F.sha2(F.array_join(text, ","), 256).alias("sha256"), F.sum("_n").alias("voxels")
    )


def save(voxels: DataFrame, path: str, sample: str = "sample_id") -> None:
    """Write the voxel table and its manifest. A path that exists is an error, never overwritten."""
    voxels.repartition(sample, "z").write.mode("errorifexists").parquet(f"{path}/voxels")
    checksums(voxels.sparkSession.read.parquet(f"{path}/voxels"), sample).write.mode(
        "errorifexists"
    ).parquet(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/voxels")


def verify(spark: SparkSession, path: str, sample: str = "sample_id") -> DataFrame:
    """Samples whose voxels do not give the checksum of the manifest, or are on one side only."""
    recorded = spark.read.parquet(f"{path}/manifest").select(sample, F.col("sha256").alias("recorded"))
    found = checksums(load(spark, path), sample).select(sample, F.col("sha256").alias("found"))
    return recorded.join(found, sample, "full").filter(~F.col("recorded").eqNullSafe(F.col("found")))
