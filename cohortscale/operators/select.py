"""Picks and orders that depend on values only, never on row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscale.plans.ordered import range_bucket, ranked, running
from cohortscale.session import cut_lineage

ROLES = ("worst", "median", "best")


def sample_scores(rows: DataFrame) -> DataFrame:
    """Mean Dice over the classes present in a sample; samples without any are not eligible."""
    present = rows.filter("reference_present")
    return present.groupBy("run", "sample_id").agg(F.avg("dice").alias("score"))


def worst_median_best(rows: DataFrame) -> DataFrame:
    """Worst, lower median and best sample; ties by run, then id. Empty below three samples.

    The ends are a minimum and a maximum. Of the median first the score is found, from counts per distinct score, then
    its place among the samples that have this score; only those are ranked.
    """
    scores = cut_lineage(sample_scores(rows))
    ends = scores.agg(F.min(F.struct("score", "run", "sample_id")).alias("low"), F.max(F.struct("score", "run", "sample_id")).alias("high"), F.count("*").alias("n"))
    counts = range_bucket(scores.groupBy("score").agg(F.count("*").alias("_n")), ["score"])
    below = running(counts, [], "_part", ["score"], {"_from": ("sum", "_n", False)})
    # ``ends`` is a single row.
    middle = F.floor((F.col("n") - 1) / 2)
    at = below.join(F.broadcast(ends.select("n"))).filter((F.col("_from") <= middle) & (middle < F.col("_from") + F.col("_n")))
    tied = scores.join(F.broadcast(at.select("score", (middle - F.col("_from") + 1).alias("_at"))), "score")
    median = ranked(tied, [], ["run", "sample_id"]).filter(F.col("rank") == F.col("_at"))
    kept = ends.filter("n >= 3")
    none = F.lit(None).cast("string").alias("cls")
    outer = [kept.select(F.lit(role).alias("role"), f"{end}.run", f"{end}.sample_id", none) for role, end in (("worst", "low"), ("best", "high"))]
    inner = median.join(F.broadcast(kept.select("n"))).select(F.lit("median").alias("role"), "run", "sample_id", none)
    return outer[0].unionByName(inner).unionByName(outer[1])


def largest_false_positives(
    rows: DataFrame, picks: DataFrame, classes: Sequence[str], threshold: int
) -> DataFrame:
    """Per class in order: the largest false positive on a sample not picked before.

    Sequential over the few classes; each step is a minimum, not a sort.
    """
    wrong = rows.filter(~F.col("reference_present") & (F.col("predicted_voxels") > threshold))
    chosen = picks.select("role", "run", "sample_id", "cls")
    for cls in classes:
        open_rows = wrong.filter(F.col("cls") == cls).join(
            chosen.select("run", "sample_id"), ["run", "sample_id"], "left_anti"
        )
        best = open_rows.agg(
            F.min(F.struct((-F.col("predicted_voxels")).alias("neg"), "run", "sample_id")).alias("b")
        ).filter("b IS NOT NULL")
        chosen = chosen.unionByName(
            best.select(
                F.lit(f"fp_{cls.lower()}").alias("role"), "b.run", "b.sample_id", F.lit(cls).alias("cls")
            )
        )
    return chosen


def publication_order(
    rows: DataFrame, groups: Sequence[str], values: Sequence[str | Column]
) -> DataFrame:
    """Position within a group by value alone, NULLs last; identity never enters the order."""
    order = [c if isinstance(c, Column) else F.col(c).asc_nulls_last() for c in values]
    return ranked(rows, groups, order, "position")


def sorted_listing(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return ranked(rows, [], list(by), "position")


def first_samples(samples: DataFrame, n: int, key: str = "sample_id") -> DataFrame:
    """The first ``n`` samples by id, for a smoke run."""
    return samples.orderBy(key).limit(n)


def first_and_last_means(epochs: DataFrame, run: Sequence[str], value: str, k: int) -> DataFrame:
    """Mean of the first and of the last ``k`` epochs of each run. Epochs count from 0."""
    last = epochs.groupBy(*run).agg(F.max("epoch").alias("last_epoch"))
    e = F.col("epoch")
    return (
        epochs.join(last, list(run))
        .groupBy(*run)
        .agg(
            F.count("*").alias("epochs"),
            F.avg(F.when(e < k, F.col(value))).alias("first_mean"),
            F.avg(F.when(e > F.col("last_epoch") - k, F.col(value))).alias("last_mean"),
        )
    )
