"""Overlap, volume, surface and shape measures on sparse voxel tables.

A voxel table holds foreground only: keys, ``cls`` and the coordinates ``z, y, x``. A *paired*
table holds one row per voxel that is set on either side, with ``predicted`` and ``reference``
flags. The dense extent comes from the manifest, so background is counted and never stored.
Groups are shuffled by voxel first and by sample only after partial aggregation, so a sample
holding a third of all voxels does not land in one task. Voxels are dealt to a number of tasks that
adaptive execution leaves alone: few compressed bytes are very many voxels, and it would merge them. Who knows
how many voxels there are says so (``tasks``), as a task's memory follows the voxels it is dealt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortscale.session import width

COORDS = ("z", "y", "x")


def class_grid(samples: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Every sample with every class of the frozen list, present or not."""
    return samples.withColumn("cls", F.explode(F.array(*[F.lit(c) for c in classes])))


def pair(predicted: DataFrame, reference: DataFrame, keys: Sequence[str], tasks: int | None = None) -> DataFrame:
    """One row per voxel of either side, with a flag for each side; a side may hold a voxel more than once."""
    cols = [*keys, *COORDS]
    both = predicted.select(*cols, F.lit(True).alias("p"), F.lit(False).alias("r")).unionByName(
        reference.select(*cols, F.lit(False).alias("p"), F.lit(True).alias("r"))
    )
    return both.repartition(tasks or width(both.sparkSession), *cols).groupBy(*cols).agg(
        F.bool_or("p").alias("predicted"), F.bool_or("r").alias("reference")
    )


def overlap_counts(paired: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """Voxels of each side and of both; ``more`` aggregates are taken in the same pass."""
    p, r = F.col("predicted"), F.col("reference")
    return paired.groupBy(*keys).agg(
        F.count_if(p).alias("predicted_voxels"),
        F.count_if(r).alias("reference_voxels"),
        F.count_if(p & r).alias("both_voxels"),
        *more,
    )


def on_grid(counts: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts for every cell of the grid; cells without voxels get zeros."""
    return grid.join(counts, list(keys), "left").fillna(
        0, ["predicted_voxels", "reference_voxels", "both_voxels"]
    )


def dice(predicted: Column, reference: Column, both: Column) -> Column:
    """1 when both masks are empty: they agree that the class is absent."""
    total = predicted + reference
    return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(2.0) * both / total)


def frame_dice(predicted: Column, reference: Column, both: Column) -> Column:
    """The frame rule: NULL, that is skipped, when both masks are empty."""
    return F.try_divide(F.lit(2.0) * both, predicted + reference)


def with_dice(counts: DataFrame) -> DataFrame:
    args = [F.col(c) for c in ("predicted_voxels", "reference_voxels", "both_voxels")]
    return counts.withColumn("dice", dice(*args))


def rates(counts: DataFrame, extent: str = "extent_voxels") -> DataFrame:
    """Sensitivity and specificity; true negatives are the extent less the union. NULL on 0/0."""
    p, r, b, n = (F.col(c) for c in ("predicted_voxels", "reference_voxels", "both_voxels", extent))
    return counts.withColumn(
        "sensitivity", F.try_divide(b.cast("double"), r.cast("double"))
    ).withColumn(
        "specificity",
        F.try_divide((n - (p + r - b)).cast("double"), (n - r).cast("double")),
    )


def extent(shape: str = "shape") -> Column:
    return F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, v: a * v)


def voxel_volume(spacing: str = "spacing_mm") -> Column:
    return F.aggregate(spacing, F.lit(1.0), lambda a, v: a * v)


def array_axis_spacing(spacing: str = "spacing_mm") -> Column:
    """(axial, lateral, separation) reordered to the (z, y, x) axes of a volume."""
    s = F.col(spacing)
    return F.array(s[2], s[0], s[1])


def volumes(counts: DataFrame, spacing: str = "spacing_mm") -> DataFrame:
    """Volume with the terms it came from: voxel count and volume of one voxel."""
    out = counts.withColumn("voxel_mm3", voxel_volume(spacing))
    return out.withColumn(
        "predicted_mm3", F.col("predicted_voxels") * F.col("voxel_mm3")
    ).withColumn("reference_mm3", F.col("reference_voxels") * F.col("voxel_mm3"))


def surface(voxels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Voxels with a face neighbour outside the mask; the array edge counts as outside.

    A voxel is interior when the previous and the next voxel of its line are adjacent, along
    all three axes. Lines are short (one array axis), so no window grows with a sample. The two
    axes inside a slice share one shuffle by (keys, z).
    """
    keys = list(keys)
    tasks = width(voxels.sparkSession)
    out = voxels.repartition(tasks, *keys, "z")
    inside = F.lit(True)
    for axis in ("x", "y", "z"):
        if axis == "z":
            out = out.repartition(tasks, *keys, "y", "x")
        line = Window.partitionBy(*keys, *[c for c in COORDS if c != axis]).orderBy(axis)
        here = F.col(axis)
        out = out.withColumn(
            f"_in_{axis}",
            F.coalesce(
                (here - F.lag(axis).over(line) == 1) & (F.lead(axis).over(line) - here == 1),
                F.lit(False),
            ),
        )
        inside = inside & F.col(f"_in_{axis}")
    return out.filter(~inside).drop("_in_x", "_in_y", "_in_z")


def edge_shift(paired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean signed offset of the top and bottom rows over columns where both sides are set."""
    per_column = paired.groupBy(*keys, "z", "x").agg(
        F.min(F.when(F.col("predicted"), F.col("y"))).alias("pt"),
        F.max(F.when(F.col("predicted"), F.col("y"))).alias("pb"),
        F.min(F.when(F.col("reference"), F.col("y"))).alias("rt"),
        F.max(F.when(F.col("reference"), F.col("y"))).alias("rb"),
    )
    return (
        per_column.filter(F.col("pt").isNotNull() & F.col("rt").isNotNull())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("columns"),
            F.avg(F.col("pt") - F.col("rt")).alias("top_shift"),
            F.avg(F.col("pb") - F.col("rb")).alias("bottom_shift"),
        )
    )


def densest_slice(voxels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The slice with the most voxels; the lowest index on a tie. A maximum, so no sort."""
    counts = voxels.groupBy(*keys, "z").agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("z")).alias("neg"))).alias("b"))
    return best.select(*keys, (-F.col("b.neg")).alias("z"), F.col("b.n").alias("voxels"))


def crop_rows(
    paired: DataFrame, brightness: DataFrame, heights: DataFrame, keys: Sequence[str], margin: int
) -> DataFrame:
    """Rows kept of a slice: outlined rows and the brightest row, with a margin, clipped.

    ``brightness`` holds the mean intensity per row; on a tie the lowest row wins.
    """
    keys = list(keys)
    bright = brightness.groupBy(*keys).agg(
        F.max(F.struct("brightness", (-F.col("y")).alias("neg"))).alias("b")
    ).select(*keys, (-F.col("b.neg")).alias("y"))
    outlined = paired.filter(F.col("predicted") | F.col("reference")).select(*keys, "y")
    rows = outlined.unionByName(bright).groupBy(*keys).agg(
        F.min("y").alias("lo"), F.max("y").alias("hi")
    )
    return rows.join(heights, keys).select(
        *keys,
        F.greatest(F.lit(0), F.col("lo") - margin).alias("top"),
        F.least(F.col("height"), F.col("hi") + margin + 1).alias("bottom"),
    )


def prevalence(reference: DataFrame, grid: DataFrame) -> DataFrame:
    """Percent of voxels per vendor and class: pooled, and as a mean of per-sample percents.

    ``grid`` has (sample_id, vendor, cls, extent_voxels) for every sample and class.
    """
    counts = reference.groupBy("sample_id", "cls").agg(F.count("*").alias("voxels"))
    full = grid.join(counts, ["sample_id", "cls"], "left").fillna(0, ["voxels"])
    return full.groupBy("vendor", "cls").agg(
        (F.sum("voxels") * 100.0 / F.sum("extent_voxels")).alias("pooled_percent"),
        F.avg(F.col("voxels") * 100.0 / F.col("extent_voxels")).alias("mean_percent"),
        F.count("*").alias("samples"),
    )


def prevalence_shift(by_vendor: DataFrame) -> DataFrame:
    """Lowest and highest vendor per class, and their ratio (NULL over a zero)."""
    low = F.min(F.struct("pooled_percent", "vendor")).alias("low")
    high = F.max(F.struct("pooled_percent", "vendor")).alias("high")
    return by_vendor.groupBy("cls").agg(low, high).select(
        "cls",
        F.col("low.vendor").alias("lowest_vendor"),
        F.col("low.pooled_percent").alias("lowest_percent"),
        F.col("high.vendor").alias("highest_vendor"),
        F.col("high.pooled_percent").alias("highest_percent"),
        F.try_divide(F.col("high.pooled_percent"), F.col("low.pooled_percent")).alias("ratio"),
    )


def presence_combinations(per_volume: DataFrame, classes: Sequence[str]) -> DataFrame:
    """How many samples hold each class, all of them, and none."""
    flags = per_volume.groupBy("sample_id").agg(
        *[
            F.bool_or((F.col("cls") == c) & F.col("reference_present")).alias(f"has_{i}")
            for i, c in enumerate(classes)
        ]
    )
    has = [F.col(f"has_{i}") for i in range(len(classes))]
    every, some = has[0], has[0]
    for h in has[1:]:
        every, some = every & h, some | h
    totals = flags.agg(
        F.count("*").alias("samples"),
        *[F.count_if(h).alias(f"n_{i}") for i, h in enumerate(has)],
        F.count_if(every).alias("n_all"),
        F.count_if(~some).alias("n_none"),
    )
    rows = [(c, f"n_{i}") for i, c in enumerate(classes)] + [("all", "n_all"), ("none", "n_none")]
    pairs = F.array(
        *[F.struct(F.lit(k).alias("what"), F.col(c).alias("n")) for k, c in rows]
    )
    return totals.select("samples", F.explode(pairs).alias("r")).select("r.what", "r.n", "samples")


def mean_foreground(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean over classes; a class absent everywhere (NULL) is left out, not counted as zero."""
    return rows.groupBy(*keys).agg(
        F.avg(value).alias("mean_foreground"), F.count(value).alias("classes")
    )


def frame_scores(frames: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per class: mean frame Dice over scored frames, collapse counts and baseline flags.

    ``frames`` has (cls, predicted_voxels, reference_voxels, both_voxels), one row per frame.
    ``baseline`` has (cls, baseline_dice), one row per class.
    """
    p, r, b = (F.col(c) for c in ("predicted_voxels", "reference_voxels", "both_voxels"))
    scored = frames.withColumn("frame_dice", frame_dice(p, r, b))
    per_class = scored.groupBy("cls").agg(
        F.coalesce(F.avg("frame_dice"), F.lit(0.0)).alias("measured_dice"),
        F.count("frame_dice").alias("frames_scored"),
        F.count_if(p > 0).alias("frames_predicted"),
        F.count_if(r > 0).alias("frames_with_class"),
        F.count("*").alias("frames"),
        F.sum(p).alias("predicted_voxels"),
    )
    m = F.col("measured_dice")
    return per_class.join(baseline, "cls").select(
        *per_class.columns,
        "baseline_dice",
        (m > 0).alias("beats_empty"),
        (m > F.col("baseline_dice")).alias("beats_baseline"),
        (F.col("frames_predicted") > 0).alias("not_collapsed"),
    )
