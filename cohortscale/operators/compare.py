"""Detection rates, generalisation gaps and the comparison of held-out with in-domain arms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscale.operators import auroc as roc
from cohortscale.operators import bootstrap
from cohortscale.operators.bootstrap import Boot
from cohortscale.operators.rows import views_of
from cohortscale.session import cut_lineage

HELD, REF = "test", "in_domain_ref"


def rate(rows: DataFrame, cells: DataFrame, cell: Sequence[str], boot: Boot, positive: bool) -> DataFrame:
    """Agreement over the rows that define the denominator, on the whole grid of cells.

    Sensitivity over rows with the class present, specificity over the others. An empty
    denominator keeps its cell, with NULL and n = 0.
    """
    subset = rows.filter(F.col("reference_present") == positive).withColumn(
        "value", (F.col("predicted_present") == positive).cast("double")
    )
    est = bootstrap.estimate(subset, cell, boot)
    return cells.join(est, list(cell), "left").fillna(0, ["n", "n_measurements"])


def detection(rows: DataFrame, boot: Boot) -> DataFrame:
    """Sensitivity, specificity and AUROC per vendor and class, and over all vendors.

    AUROC carries no interval here: a bootstrap of a rank statistic is another estimator.
    """
    cell = ["vendor", "cls"]
    both = cut_lineage(
        bootstrap.with_all_vendors(rows).select(
            *cell, "patient_id", "predicted_present", "reference_present", "score"
        )
    )
    cells = both.groupBy(*cell).agg(
        F.count("*").alias("volumes"),
        F.count_if("reference_present").alias("positives"),
        F.count_if(~F.col("reference_present")).alias("negatives"),
    )
    grid = cells.select(*cell)
    out = cells
    for name, positive in (("sensitivity", True), ("specificity", False)):
        est = rate(both, grid, cell, boot, positive)
        out = out.join(
            est.select(
                *cell,
                F.col("value").alias(name),
                F.col("ci_low").alias(f"{name}_low"),
                F.col("ci_high").alias(f"{name}_high"),
                F.col("n").alias(f"{name}_n"),
            ),
            cell,
        )
    area = roc.auroc(both, cell, "score", "reference_present").select(*cell, "auroc")
    return out.join(area, cell, "left")


def overlaps(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Closed intervals meet."""
    return (low_a <= high_b) & (low_b <= high_a)


def excludes_zero(low: Column, high: Column) -> Column:
    return (low > 0) | (high < 0)


def generalisation_gap(in_domain: DataFrame, held_out: DataFrame, on: Sequence[str]) -> DataFrame:
    """In-domain minus held-out value: positive means worse on the unseen vendor.

    No interval on the gap: two separate intervals do not make one for their difference.
    """
    parts = ("value", "ci_low", "ci_high", "n")
    a = in_domain.select(*on, *[F.col(c).alias(f"in_{c}") for c in parts])
    b = held_out.select(*on, *[F.col(c).alias(f"out_{c}") for c in parts])
    return a.join(b, list(on)).withColumn("gap", F.col("in_value") - F.col("out_value")).withColumn(
        "intervals_overlap",
        overlaps(F.col("in_ci_low"), F.col("in_ci_high"), F.col("out_ci_low"), F.col("out_ci_high")),
    )


def per_patient(rows: DataFrame, keys: Sequence[str], value: str = "dice") -> DataFrame:
    """One value per patient: the mean over the folds and volumes that hold it."""
    return rows.groupBy(*keys, "patient_id").agg(F.avg(value).alias("value"))


def comparison_rows(arms: DataFrame) -> DataFrame:
    """One value per (view, comparison, class, arm, patient): every fold, and all folds pooled."""
    both = arms.filter(F.col("arm").isin(HELD, REF)).withColumn(
        "comparison", F.explode(F.array(F.col("run"), F.lit("pooled")))
    )
    return per_patient(views_of(both), ["view", "comparison", "cls", "arm"])


def comparison_cube(arms: DataFrame, boot: Boot) -> DataFrame:
    """Both arms and their difference for every view, comparison and class."""
    cell = ["view", "comparison", "cls"]
    rows = cut_lineage(comparison_rows(arms))
    est = bootstrap.estimate(rows, [*cell, "arm"], boot)
    sides = []
    for arm, name in ((HELD, "held"), (REF, "ref")):
        sides.append(
            est.filter(F.col("arm") == arm).select(
                *cell, *[F.col(c).alias(f"{name}_{c}") for c in ("value", "ci_low", "ci_high", "n")]
            )
        )
    held = rows.filter(F.col("arm") == HELD).drop("arm")
    ref = rows.filter(F.col("arm") == REF).drop("arm")
    diff = bootstrap.joint_difference(held, ref, cell, boot).drop("n_held", "n_ref")
    diff = diff.withColumnRenamed("ci_low", "diff_low").withColumnRenamed("ci_high", "diff_high")
    return sides[0].join(sides[1], cell).join(diff, cell)


def half_widths(cube: DataFrame) -> DataFrame:
    """Smallest and largest half-width of a difference per view, per fold and pooled."""
    half = (F.col("diff_high") - F.col("diff_low")) / 2
    return (
        cube.withColumn("pooled", F.col("comparison") == "pooled")
        .groupBy("view", "pooled")
        .agg(F.min(half).alias("smallest"), F.max(half).alias("largest"), F.count("*").alias("cells"))
    )


def detection_limit(widths: DataFrame) -> DataFrame:
    """The smallest difference the all-volume view can detect, per fold or pooled."""
    return widths.filter(F.col("view") == "all-volume").agg(F.min("smallest").alias("limit"))


def counts_of_cube(cube: DataFrame) -> DataFrame:
    """How many comparisons overlap, are worse on the unseen vendor, or exclude zero."""
    meet = overlaps(*[F.col(c) for c in ("held_ci_low", "held_ci_high", "ref_ci_low", "ref_ci_high")])
    out = excludes_zero(F.col("diff_low"), F.col("diff_high"))
    return (
        cube.withColumn("pooled", F.col("comparison") == "pooled")
        .groupBy("view", "pooled")
        .agg(
            F.count("*").alias("comparisons"),
            F.count_if(meet).alias("overlapping"),
            F.count_if(F.col("difference") < 0).alias("worse"),
            F.count_if(F.col("difference") >= 0).alias("better"),
            F.count_if(out).alias("excluding_zero"),
            F.count_if(out & (F.col("difference") < 0)).alias("excluding_zero_lower"),
        )
    )
