"""Long and wide per-volume rows, presence flags and views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ID = ("sample_id", "patient_id", "vendor", "cls")
# The metrics pivoted into a per-volume row.
METRICS = ("dice", "predicted_voxels", "reference_voxels")


def long_rows(per_volume: DataFrame) -> DataFrame:
    """One row per sample, class and metric."""
    return per_volume.select(
        *ID, *[F.col(m).cast("double").alias(m) for m in METRICS]
    ).unpivot(list(ID), list(METRICS), "metric", "value")


def detection_rows(per_volume: DataFrame, threshold: int) -> DataFrame:
    """Presence by configuration: more predicted voxels than the threshold; any reference voxel."""
    return per_volume.withColumn(
        "predicted_present", F.col("predicted_voxels") > threshold
    ).withColumn("reference_present", F.col("reference_voxels") > 0).withColumn(
        "threshold", F.lit(threshold)
    )


def per_volume_rows(long: DataFrame, detection: DataFrame) -> DataFrame:
    """Long rows to one row per sample and class, with the score of the detection row."""
    wide = long.groupBy(*ID).pivot("metric", list(METRICS)).agg(F.first("value"))
    scores = detection.select("sample_id", "cls", "score")
    return wide.join(scores, ["sample_id", "cls"], "left").select(
        *ID,
        "dice",
        F.col("predicted_voxels").cast("bigint").alias("predicted_voxels"),
        F.col("reference_voxels").cast("bigint").alias("reference_voxels"),
        (F.col("reference_voxels") > 0).alias("reference_present"),
        "score",
    )


def views_of(rows: DataFrame) -> DataFrame:
    """Each row in the all-volume view, and in the class-present view if the class is there."""
    both = F.array(F.lit("all-volume"), F.lit("class-present"))
    one = F.array(F.lit("all-volume"))
    return rows.withColumn("view", F.explode(F.when(F.col("reference_present"), both).otherwise(one)))
