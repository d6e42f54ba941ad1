"""Counts and extremes a report states about a set of per-volume rows or estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscale.functions.text import half_up_percent, range_text


def absent_counts(rows: DataFrame, order: str = "run") -> DataFrame:
    """Class-absent patients and all patients per arm and class, a patient counted once.

    A patient met in several folds keeps the presence of its first fold and volume.
    """
    first = F.min_by("reference_present", F.struct(order, "sample_id"))
    return (
        rows.groupBy("arm", "cls", "patient_id")
        .agg(first.alias("present"))
        .groupBy("arm", "cls")
        .agg(F.count_if(~F.col("present")).alias("absent"), F.count("*").alias("patients"))
        .withColumn("percent", half_up_percent(F.col("absent"), F.col("patients")))
    )


def absent_shares(rows: DataFrame) -> DataFrame:
    """Class-absent volumes per run, arm and class, with a whole percent rounded half up."""
    return (
        rows.groupBy("run", "arm", "cls")
        .agg(F.count_if(~F.col("reference_present")).alias("absent"), F.count("*").alias("volumes"))
        .withColumn("percent", half_up_percent(F.col("absent"), F.col("volumes")))
    )


def absent_split(rows: DataFrame) -> DataFrame:
    """Class-absent volumes with Dice 0 and with Dice 1; whether all of a cell are 0."""
    absent = ~F.col("reference_present")
    return rows.groupBy("run", "arm", "cls").agg(
        F.count_if(absent & (F.col("dice") == 0.0)).alias("zero"),
        F.count_if(absent & (F.col("dice") == 1.0)).alias("one"),
    ).withColumn("all_zero", (F.col("zero") > 0) & (F.col("one") == 0))


def present_beats_all(rows: DataFrame) -> DataFrame:
    """Class-present mean against the overall mean of a cell; cells without the class are out."""
    present = F.avg(F.when(F.col("reference_present"), F.col("dice")))
    return (
        rows.groupBy("run", "arm", "cls")
        .agg(present.alias("present_mean"), F.avg("dice").alias("mean"))
        .filter("present_mean IS NOT NULL")
        .withColumn("beats", F.col("present_mean") > F.col("mean"))
    )


def absent_share_of_mean(rows: DataFrame) -> DataFrame:
    """How much of the overall mean Dice is owed to class-absent volumes."""
    owed = F.sum(F.when(~F.col("reference_present"), F.col("dice")).otherwise(F.lit(0.0)))
    return rows.groupBy("run", "arm", "cls").agg(
        F.try_divide(owed, F.sum("dice")).alias("absent_share")
    )


def lowest_fold(estimates: DataFrame, arm: str = "test") -> DataFrame:
    """The fold of the lowest held-out value per class; the first name on a tie."""
    low = F.min(F.struct("value", "run")).alias("m")
    return (
        estimates.filter(F.col("arm") == arm).groupBy("cls").agg(low)
        .select("cls", F.col("m.run").alias("run"), F.col("m.value").alias("value"))
    )


def widest_interval(estimates: DataFrame, arm: str = "in_domain_ref") -> DataFrame:
    """The widest interval of an arm, and the narrowest width beside it."""
    w = estimates.filter(F.col("arm") == arm).withColumn("w", F.col("ci_high") - F.col("ci_low"))
    return w.agg(
        F.max(F.struct("w", "run", "cls")).alias("m"), F.min("w").alias("narrowest")
    ).select("m.run", "m.cls", F.col("m.w").alias("width"), "narrowest")


def largest_movement(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """The largest change of a value between two record sets, and where."""
    j = a.select(*on, F.col("value").alias("a")).join(b.select(*on, F.col("value").alias("b")), list(on))
    moved = j.withColumn("moved", F.abs(F.col("a") - F.col("b")))
    return moved.agg(F.max(F.struct("moved", *on)).alias("m")).select("m.*")


def zero_specificity(detection: DataFrame) -> DataFrame:
    """Cells with a specificity of exactly zero, of all cells that have one."""
    return detection.agg(
        F.count_if(F.col("specificity") == 0.0).alias("zero"), F.count("specificity").alias("cells")
    )


def draw_fragility(first: DataFrame, second: DataFrame, on: Sequence[str]) -> DataFrame:
    """Shift of a value between two draws against the step one subject makes, 1/n."""
    j = first.select(*on, F.col("value").alias("first"), "n").join(
        second.select(*on, F.col("value").alias("second")), list(on)
    )
    shift = F.col("second") - F.col("first")
    step = F.try_divide(F.lit(1.0), F.col("n").cast("double"))
    return j.select(
        *on, "first", "second", shift.alias("shift"), step.alias("one_subject"),
        (F.abs(shift) >= step).alias("at_least_one_subject"),
    )


def dataset_table(manifest: DataFrame, presence: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Per vendor: patients, sizes, spacing ranges as text, and samples with each class."""
    s = [F.get("spacing_mm", F.lit(i)) for i in range(3)]
    base = manifest.groupBy("vendor").agg(
        F.count_distinct("patient_id").alias("patients"),
        F.array_join(
            F.array_sort(F.collect_set(F.concat_ws(" x ", F.col("shape")[2], F.col("shape")[1]))), "; "
        ).alias("slice_size"),
        *[F.min(c).alias(f"_lo{i}") for i, c in enumerate(s)],
        *[F.max(c).alias(f"_hi{i}") for i, c in enumerate(s)],
    )
    with_class = presence.groupBy("vendor").agg(
        *[
            F.count_if((F.col("cls") == c) & F.col("reference_present")).alias(f"samples_with_{c}")
            for c in classes
        ]
    )
    names = ("axial_mm", "lateral_mm", "separation_mm")
    return base.join(with_class, "vendor", "left").select(
        "vendor",
        "patients",
        "slice_size",
        *[
            range_text(F.col(f"_lo{i}"), F.col(f"_hi{i}"), 6).alias(n)
            for i, n in enumerate(names)
        ],
        *[f"samples_with_{c}" for c in classes],
    )


def geometries(manifest: DataFrame) -> DataFrame:
    """Every distinct shape of a vendor with its count: a mean could name a shape none has."""
    return manifest.groupBy("vendor", "shape").agg(F.count("*").alias("samples"))
