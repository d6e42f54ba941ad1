"""Validation predicates. Each returns the violations as rows; ``assert_empty`` raises on them."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("axial", "lateral", "separation")
MAX_SPACING_MM = 0.5
# Measured spacing per vendor in mm, halved at the low end and doubled at the high.
MEASURED_RANGES = {
    "cirrus": ((0.000978, 0.003910), (0.005871, 0.023484), (0.023439, 0.094488)),
    "spectralis": ((0.001936, 0.007744), (0.005428, 0.023900), (0.058190, 0.257248)),
    "topcon": ((0.001300, 0.007000), (0.005860, 0.023440), (0.023440, 0.093760)),
}
EXPECTED_LABELS = (0, 1, 2, 3)


class ValidationError(ValueError):
    pass


def assert_empty(violations: DataFrame, what: str, show: int = 5) -> None:
    """Raise, naming the first few, if there is any violation."""
    first = violations.take(show)
    if first:
        raise ValidationError(f"{what}: {[r.asDict() for r in first]}")


def missing_fields(rows: DataFrame, fields: Sequence[str], key: str) -> DataFrame:
    """(key, field) for every required field that is NULL; an absent column is an error."""
    absent = [f for f in fields if f not in rows.columns]
    if absent:
        raise ValidationError(f"columns {absent} are required")
    empty = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]))
    return rows.select(F.col(key), F.explode(empty).alias("field"))


def range_table(
    spark: SparkSession, ranges: Mapping[str, Sequence[tuple[float, float]]]
) -> DataFrame:
    """(vendor, lo, hi): one configured row per vendor, arrays in axis order."""
    rows = [
        (v, [float(lo) for lo, _ in axes], [float(hi) for _, hi in axes])
        for v, axes in ranges.items()
    ]
    return spark.createDataFrame(rows, "vendor STRING, lo ARRAY<DOUBLE>, hi ARRAY<DOUBLE>")


def _verdict(rule: str, axis: str | None = None, lo: Column | None = None, hi: Column | None = None):
    null = F.lit(None)
    return F.struct(
        F.lit(rule).alias("rule"),
        (F.lit(axis) if axis else null.cast("string")).alias("axis"),
        (lo if lo is not None else null.cast("double")).alias("lo"),
        (hi if hi is not None else null.cast("double")).alias("hi"),
    )


def spacing_verdict(spacing: Column, lo: Column, hi: Column, limit: float = MAX_SPACING_MM) -> Column:
    """The first rule a spacing breaks, NULL if none; a vendor without a range passes that rule."""
    part = [F.get(spacing, F.lit(i)) for i in range(3)]
    out = F.when(spacing.isNull(), _verdict("absent")).when(
        F.size(spacing) != 3, _verdict("components")
    )
    for axis, p in zip(AXES, part, strict=True):
        out = (
            out.when(p.isNull(), _verdict("not_numeric", axis))
            .when(F.isnan(p) | (F.abs(p) == F.lit(math.inf)), _verdict("not_finite", axis))
            .when(p <= 0, _verdict("not_positive", axis))
            .when(p > limit, _verdict("above_limit", axis, hi=F.lit(limit)))
        )
    out = out.when((part[0] == part[1]) & (part[1] == part[2]), _verdict("isotropic"))
    for i, axis in enumerate(AXES):
        low, high = F.get(lo, F.lit(i)), F.get(hi, F.lit(i))
        out = out.when(~part[i].between(low, high), _verdict("outside_range", axis, low, high))
    return out


def spacing_violations(manifest: DataFrame, ranges: DataFrame) -> DataFrame:
    """Manifest rows whose spacing is implausible, with the rule, the axis and the range."""
    # The range table is configuration: one row per vendor named there.
    joined = manifest.join(F.broadcast(ranges), "vendor", "left")
    verdict = spacing_verdict(F.col("spacing_mm"), F.col("lo"), F.col("hi"))
    return (
        joined.withColumn("_v", verdict)
        .filter("_v IS NOT NULL")
        .select("sample_id", "vendor", "_v.rule", "_v.axis", "_v.lo", "_v.hi")
    )


def planted_defects(spacing: Column) -> Column:
    """The six realistic ways a spacing goes wrong, as an array of (defect, spacing)."""
    a, b, c = (F.get(spacing, F.lit(i)) for i in range(3))
    cases = {
        "x1000": (a * 1000.0, b * 1000.0, c * 1000.0),
        "x10": (a * 10.0, b * 10.0, c * 10.0),
        "axial_lateral": (b, a, c),
        "lateral_separation": (a, c, b),
        "header_order": (c, b, a),
        "isotropic": (a, a, a),
    }
    return F.array(
        *[F.struct(F.lit(k).alias("defect"), F.array(*v).alias("spacing")) for k, v in cases.items()]
    )


def defect_sensitivity(manifest: DataFrame, ranges: DataFrame) -> DataFrame:
    """Which bound catches each defect when planted in every spacing."""
    rows = manifest.select(
        "sample_id", "vendor", F.explode(planted_defects(F.col("spacing_mm"))).alias("d")
    ).select("sample_id", "vendor", "d.defect", F.col("d.spacing").alias("spacing_mm"))
    joined = rows.join(F.broadcast(ranges), "vendor", "left")
    rule = spacing_verdict(F.col("spacing_mm"), F.col("lo"), F.col("hi"))["rule"]
    bound = (
        F.when(rule.isNull(), "missed")
        .when(rule == "above_limit", "outer_limit")
        .when(rule == "outside_range", "vendor_range")
        .otherwise("structural")
    )
    return (
        joined.select("defect", bound.alias("bound"))
        .groupBy("defect")
        .pivot("bound", ["outer_limit", "vendor_range", "structural", "missed"])
        .agg(F.count(F.lit(1)))
        .fillna(0)
    )


def measured_ranges(manifest: DataFrame) -> DataFrame:
    """Smallest and largest spacing per vendor and axis."""
    return (
        manifest.select("vendor", F.posexplode("spacing_mm").alias("pos", "mm"))
        .groupBy("vendor", "pos")
        .agg(F.min("mm").alias("lo"), F.max("mm").alias("hi"), F.count("*").alias("samples"))
        .withColumn("axis", F.get(F.array(*[F.lit(a) for a in AXES]), F.col("pos")))
    )


def margin_acceptance(manifest: DataFrame, margins: Sequence[float]) -> DataFrame:
    """Per vendor and margin: spacings accepted, and axial/lateral swaps rejected."""
    wide = manifest.groupBy("vendor").agg(
        F.array(*[F.min(F.get("spacing_mm", F.lit(i))) for i in range(3)]).alias("lo"),
        F.array(*[F.max(F.get("spacing_mm", F.lit(i))) for i in range(3)]).alias("hi"),
    )
    bounds = wide.withColumn("margin", F.explode(F.array(*[F.lit(float(m)) for m in margins])))
    s = [F.get("spacing_mm", F.lit(i)) for i in range(3)]

    def inside(parts):
        ok = F.lit(True)
        for i, p in enumerate(parts):
            ok = ok & p.between(F.col("lo")[i] / F.col("margin"), F.col("hi")[i] * F.col("margin"))
        return ok

    # Per-vendor bounds are a handful of rows, but their number is data: Spark picks the join.
    return (
        manifest.join(bounds, "vendor")
        .groupBy("vendor", "margin")
        .agg(
            F.count_if(inside(s)).alias("accepted"),
            F.count_if(~inside([s[1], s[0], s[2]])).alias("swaps_rejected"),
            F.count("*").alias("samples"),
        )
    )


def header_mismatches(image: DataFrame, reference: DataFrame) -> DataFrame:
    """Patients whose image and reference headers disagree on size or spacing.

    A patient with only one of the two differs in both.
    """
    r = reference.select(
        "patient_id", F.col("shape").alias("r_shape"), F.col("spacing_mm").alias("r_spacing")
    )
    joined = image.join(r, "patient_id", "full")
    return joined.select(
        "patient_id",
        (~F.col("shape").eqNullSafe(F.col("r_shape"))).alias("size_differs"),
        (~F.col("spacing_mm").eqNullSafe(F.col("r_spacing"))).alias("spacing_differs"),
    ).filter("size_differs OR spacing_differs")


def unexpected_labels(voxels: DataFrame, allowed: Sequence[int] = EXPECTED_LABELS) -> DataFrame:
    return (
        voxels.filter(~F.col("label").isin(*allowed))
        .groupBy("sample_id", "label")
        .agg(F.count("*").alias("voxels"))
    )


def payload_mismatches(files: DataFrame, key: str) -> DataFrame:
    """Files whose byte count is not the header's element count times the element width."""
    expected = F.aggregate("dims", F.lit(1).cast("bigint"), lambda a, v: a * v)
    return (
        files.select(key, expected.alias("expected"), (F.col("n_bytes") / F.col("width")).alias("found"))
        .filter("expected <> found")
    )


def spacing_changes(used: DataFrame, recorded: DataFrame) -> DataFrame:
    """Samples whose spacing at measurement is not bit-identical to the recorded one."""
    r = recorded.select("sample_id", F.col("spacing_mm").alias("recorded"))
    u = used.select("sample_id", F.col("spacing_mm").alias("used"))
    return r.join(u, "sample_id").filter(~F.col("used").eqNullSafe(F.col("recorded")))


def window_changes(frames: DataFrame, manifest: DataFrame) -> DataFrame:
    """Frames that do not carry the intensity window of their volume."""
    m = manifest.select("patient_id", F.col("intensity_window").alias("volume_window"))
    return frames.join(m, "patient_id", "left").filter(
        ~F.col("intensity_window").eqNullSafe(F.col("volume_window"))
    )


def repeated_volumes(manifest: DataFrame) -> DataFrame:
    """Subjects with more than one volume."""
    return (
        manifest.groupBy("patient_id").agg(F.count("*").alias("volumes")).filter("volumes > 1")
    )


def not_three_dimensional(manifest: DataFrame) -> DataFrame:
    return manifest.filter(F.size("shape") != 3).select("sample_id", F.size("shape").alias("dims"))


def patients_under_two_vendors(samples: DataFrame) -> DataFrame:
    return (
        samples.groupBy("patient_id")
        .agg(
            F.count_distinct("vendor").alias("vendors"),
            F.min("vendor").alias("first_vendor"),
            F.max("vendor").alias("last_vendor"),
        )
        .filter("vendors > 1")
    )


def mixed_settings(rows: DataFrame, settings: Sequence[str]) -> DataFrame:
    """The settings in use with their row counts; empty when there is only one."""
    used = rows.groupBy(*settings).agg(F.count("*").alias("rows"))
    several = used.agg(F.count("*").alias("_n")).filter("_n > 1")
    return used.join(F.broadcast(several)).drop("_n")


def pseudonym_collisions(pairs: DataFrame) -> DataFrame:
    return (
        pairs.groupBy("pseudonym")
        .agg(F.count_distinct("patient_id").alias("patients"))
        .filter("patients > 1")
    )


def mask_problems(voxels: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per sample: mask values that are not 0/1, voxels outside the shape, unusable spacing."""
    shape = manifest.select("sample_id", "shape")
    inside = F.lit(True)
    for i, c in enumerate(("z", "y", "x")):
        inside = inside & (F.col(c) >= 0) & (F.col(c) < F.get("shape", F.lit(i)))
    per_voxel = voxels.join(shape, "sample_id", "left").select(
        "sample_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(~F.col("value").isin(0, 1), F.lit("not_binary")),
                    F.when(F.col("shape").isNull() | ~F.coalesce(inside, F.lit(False)), F.lit("outside_shape")),
                )
            )
        ).alias("problem"),
    )
    bad = F.exists(
        "spacing_mm", lambda v: F.isnan(v) | (F.abs(v) == F.lit(math.inf)) | (v <= 0)
    )
    spacing = manifest.filter(F.col("spacing_mm").isNull() | bad).select(
        "sample_id", F.lit("spacing").alias("problem")
    )
    return per_voxel.unionByName(spacing).groupBy("sample_id", "problem").agg(F.count("*").alias("n"))


def bad_intervals(estimates: DataFrame) -> DataFrame:
    return estimates.filter("ci_low > ci_high OR n < 0")


def degenerate_windows(windows: DataFrame) -> DataFrame:
    """Volumes without an intensity range: rescaling them would amplify noise."""
    return windows.filter(~(F.col("high") > F.col("low")))
