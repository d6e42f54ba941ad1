"""Aggregation over stochastic passes: class probabilities, labels, scores, confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def softmax_passes(logits: DataFrame, voxel: Sequence[str]) -> DataFrame:
    """Softmax within each pass, from (voxel, pass, logits ARRAY<DOUBLE>), one row per class."""
    exps = logits.withColumn("_e", F.transform("logits", lambda v: F.exp(v - F.array_max("logits"))))
    total = F.aggregate("_e", F.lit(0.0), lambda a, v: a + v)
    probs = exps.withColumn("_p", F.transform("_e", lambda v: v / total))
    return probs.select(*voxel, "pass", F.posexplode("_p").alias("cls", "p"))


def aggregate_passes(probabilities: DataFrame, voxel: Sequence[str]) -> DataFrame:
    """Mean and population spread over passes; a voxel with one pass has no spread to report."""
    return (
        probabilities.groupBy(*voxel, "cls")
        .agg(F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"), F.count("*").alias("passes"))
        .filter("passes >= 2")
    )


def label_of(means: DataFrame, voxel: Sequence[str]) -> DataFrame:
    """Class of the highest mean probability; the lowest class on a tie."""
    best = F.max(F.struct("mean", (-F.col("cls")).alias("_neg"))).alias("b")
    return means.groupBy(*voxel).agg(best).select(
        *voxel, (-F.col("b._neg")).alias("label"), F.col("b.mean").alias("probability")
    )


def class_scores(means: DataFrame, sample: Sequence[str]) -> DataFrame:
    """Detection score: the highest mean probability of a class anywhere in the sample."""
    return means.groupBy(*sample, "cls").agg(F.max("mean").alias("score"))


def class_scores_in_box(means: DataFrame, boxes: DataFrame, sample: Sequence[str]) -> DataFrame:
    """The detection score from the content of each frame alone: what padding holds was never acquired.

    ``means`` has ``y`` and ``x``; ``boxes`` (sample, y_from, y_to, x_from, x_to) gives the rows and columns of the content,
    the ends left out. A sample without a box, or with nothing in it, has no score.
    """
    inside = F.col("y").between(F.col("y_from"), F.col("y_to") - 1) & F.col("x").between(F.col("x_from"), F.col("x_to") - 1)
    return class_scores(means.join(boxes, list(sample)).filter(inside), sample)


def scan_confidence(means: DataFrame, sample: Sequence[str]) -> DataFrame:
    """``1 - 2 * mean(std)`` over the map: 1 for no disagreement, 0 for the most possible."""
    return means.groupBy(*sample).agg((1 - 2 * F.avg(F.col("std"))).alias("confidence"))
