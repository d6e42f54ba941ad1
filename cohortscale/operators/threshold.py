"""Presence threshold by Youden's J, in exact integers, and specificity at a threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscale.operators import bootstrap
from cohortscale.operators.bootstrap import Boot

# The predicted-voxel thresholds that may be selected.
GRID = (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000)


def select_threshold(
    rows: DataFrame, cell: Sequence[str], fixed: int, grid: Sequence[int] = GRID
) -> DataFrame:
    """Per cell: the threshold of highest J, the smallest on a tie, the fixed one if degenerate.

    J times (positives x negatives) is tp*N + tn*P - P*N, a whole number, so ties are exact. The
    grid is a list of constants: its counts are one aggregate per threshold, not a join.
    """
    cell = list(cell)
    present, voxels = F.col("reference_present"), F.col("predicted_voxels")
    counts = rows.groupBy(*cell).agg(
        F.count_if(present).alias("positives"),
        F.count_if(~present).alias("negatives"),
        F.array(
            *[
                F.struct(
                    F.lit(t).alias("t"),
                    F.count_if(present & (voxels > t)).alias("tp"),
                    F.count_if(~present & (voxels <= t)).alias("tn"),
                )
                for t in grid
            ]
        ).alias("at"),
    )
    p, n = (F.col(c).cast("decimal(18, 0)") for c in ("positives", "negatives"))
    scored = counts.withColumn(
        "_j", F.transform("at", lambda a: (a["tp"] * n + a["tn"] * p - p * n).cast("decimal(38, 0)"))
    ).withColumn("_best", F.array_max("_j"))
    tied = F.filter(
        F.arrays_zip("at", "_j"), lambda z: z["_j"] == F.col("_best")
    )
    degenerate = (p == 0) | (n == 0)
    return scored.withColumn("_tied", tied).select(
        *cell,
        F.when(degenerate, F.lit(fixed))
        .otherwise(F.array_min(F.transform("_tied", lambda z: z["at"]["t"])))
        .alias("threshold"),
        F.when(~degenerate, F.try_divide(F.col("_best").cast("double"), (p * n).cast("double"))).alias("j"),
        F.when(degenerate, F.lit(0)).otherwise(F.size("_tied")).alias("ties"),
        "positives",
        "negatives",
        F.when(n == 0, F.lit("no negative")).when(p == 0, F.lit("no positive")).alias("degenerate"),
    )


def specificity_at(rows: DataFrame, thresholds: DataFrame, cell: Sequence[str], on: Sequence[str], boot: Boot) -> DataFrame:
    """Specificity over class-absent rows at the threshold of their cell, with its interval.

    ``thresholds`` has one row per ``on``, some of the columns of ``cell``.
    """
    joined = rows.filter(~F.col("reference_present")).join(
        thresholds.select(*on, "threshold"), list(on)
    )
    value = (F.col("predicted_voxels") <= F.col("threshold")).cast("double")
    return bootstrap.estimate(joined.withColumn("value", value), cell, boot)


def selection_report(
    validation: DataFrame, arms: DataFrame, fixed: int, grid: Sequence[int], boot: Boot
) -> DataFrame:
    """Specificity of each arm at the fixed and at the selected threshold, per run and class."""
    on = ["run", "cls"]
    selected = select_threshold(validation, on, fixed, grid)
    constant = selected.select(*on, F.lit(fixed).alias("threshold"))
    cell = [*on, "arm"]
    keep = [*cell, "value", "ci_low", "ci_high", "n"]

    def named(df, prefix):
        return df.select(*cell, *[F.col(c).alias(f"{prefix}_{c}") for c in keep[3:]])

    at_fixed = named(specificity_at(arms, constant, cell, on, boot).select(*keep), "fixed")
    at_selected = named(specificity_at(arms, selected, cell, on, boot).select(*keep), "selected")
    return at_fixed.join(at_selected, cell).join(selected, on)


def stored_findings(recomputed: DataFrame, stored: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Cells whose recomputed value or n differs from the stored one; NULL equals NULL."""
    s = stored.select(*cell, F.col("value").alias("stored_value"), F.col("n").alias("stored_n"))
    r = recomputed.select(*cell, "value", "n")
    same = F.col("value").eqNullSafe(F.col("stored_value")) & F.col("n").eqNullSafe(F.col("stored_n"))
    return r.join(s, list(cell), "full").filter(~same)
