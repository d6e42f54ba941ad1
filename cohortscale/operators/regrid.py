"""Intensity windows and axial regridding, as arithmetic on voxel indices.

Which target rows a source row feeds follows from its index alone, so a regrid is an explode of
every voxel, or a join on the few distinct height pairs; volumes are never assembled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscale.plans.ordered import percentiles

WINDOW_PERCENTILES = (0.01, 0.99)


def intensity_window(pixels: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """p1 and p99 of each volume, linear between ranks, from raw values.

    Equal values are counted first, so the state per volume is its distinct values: at most
    65,536 for 16-bit pixels, however large the volume.
    """
    counts = pixels.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    tails = F.array(*[F.lit(p) for p in WINDOW_PERCENTILES])
    return (
        counts.groupBy(*keys)
        .agg(F.percentile(value, tails, F.col("_n")).alias("_w"))
        .select(*keys, F.col("_w")[0].alias("low"), F.col("_w")[1].alias("high"))
    )


def ranked_intensity_window(pixels: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """The same window, exact, for float volumes whose distinct values are too many for one task."""
    low, high = WINDOW_PERCENTILES
    return percentiles(pixels, keys, value, {"low": low, "high": high})


def sketched_intensity_window(pixels: DataFrame, keys: Sequence[str], value: str = "value", k: int = 2000) -> DataFrame:
    """The window of very large volumes in one pass, from mergeable KLL sketches of some kilobytes each.

    Opt-in: ``low`` and ``high`` are pixels whose rank is off by at most about 1.7 / ``k`` of the volume's pixels with a
    probability of 99 %, which is 0.09 % at 2000. Sketches are merged as they meet, so no volume meets in one task. NaN and NULL
    pixels are left out; a volume of fewer than ``k`` pixels is exact, but for ranks between pixels.
    """
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    sketch = pixels.withColumn("_v", v).filter("_v IS NOT NULL").groupBy(*keys).agg(F.kll_sketch_agg_double("_v", F.lit(k)).alias("_s"))
    low, high = (F.kll_sketch_get_quantile_double("_s", F.lit(q)) for q in WINDOW_PERCENTILES)
    return sketch.select(*keys, low.alias("low"), high.alias("high"), F.kll_sketch_get_n_double("_s").alias("pixels"))


def windowed(value: Column, low: Column, high: Column) -> Column:
    """The window mapped onto [0, 1], clipped outside it."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


def apply_window(pixels: DataFrame, windows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    out = pixels.join(windows, list(keys))
    return out.withColumn("scaled", windowed(F.col(value), F.col("low"), F.col("high")))


def resampled_height(height: Column, native_mm: Column, target_mm: float) -> Column:
    """Rows after resampling to the target spacing; unchanged when the factor is close to 1."""
    factor = native_mm / F.lit(target_mm)
    same = F.abs(factor - 1.0) <= 1e-8 + 1e-5
    return F.when(same, height).otherwise(
        F.greatest(F.lit(1), F.bround(height * factor).cast("int"))
    )


def _ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b).cast("int")


def forward_labels(voxels: DataFrame, heights: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Nearest regrid of labels: target row i takes source row floor(i * h / h2).

    Source row y therefore feeds the rows from ceil(y * h2 / h) to just before those of y + 1.
    """
    h, h2, y = F.col("h"), F.col("h2"), F.col("y")
    first, past = _ceil_div(y * h2, h), _ceil_div((y + 1) * h2, h)
    out = voxels.join(heights, sample).filter(past > first)
    rows = F.explode(F.sequence(first, past - 1))
    return out.withColumn("y", rows).drop("h", "h2")


def forward_intensities(
    pixels: DataFrame, heights: DataFrame, sample: str = "sample_id", value: str = "value"
) -> DataFrame:
    """Linear regrid of intensities along the rows, half-pixel centres; absent pixels are zero.

    Row y feeds the target rows whose centre lies less than a row away from it, an interval that
    follows from the heights, so pixels are not joined by row.
    """
    h, h2, y, row = (F.col(c) for c in ("h", "h2", "y", "_row"))
    first = F.greatest(F.floor((y - 0.5) * h2 / h - 0.5).cast("int") - 1, F.lit(0))
    last = F.least(F.ceil((y + 1.5) * h2 / h - 0.5).cast("int") + 1, h2 - 1)
    at = F.greatest(F.lit(0.0), (row + 0.5) * h / h2 - 0.5)
    low = F.floor(at).cast("int")
    high = F.least(low + 1, h - 1)
    share = at - low
    weight = F.when(low == y, 1 - share).otherwise(F.lit(0.0)) + F.when(high == y, share).otherwise(F.lit(0.0))
    return (
        pixels.join(heights, sample)
        .filter(last >= first)
        .withColumn("_row", F.explode(F.sequence(first, last)))
        .filter((low == y) | (high == y))
        .groupBy(sample, "z", F.col("_row").alias("y"), "x")
        .agg(F.sum(F.col(value) * weight).alias(value))
    )


def content_box(padded: Column, content: Column) -> Column:
    """First row (or column) of the content inside symmetric padding."""
    return F.floor((padded - content) / 2).cast("int")


def crop_to_content(voxels: DataFrame, boxes: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Voxels inside the content box, moved to its origin.

    ``boxes`` has (sample, padded_h, padded_w, content_h, content_w).
    """
    top = content_box(F.col("padded_h"), F.col("content_h"))
    left = content_box(F.col("padded_w"), F.col("content_w"))
    y, x = F.col("y") - top, F.col("x") - left
    inside = (y >= 0) & (y < F.col("content_h")) & (x >= 0) & (x < F.col("content_w"))
    out = voxels.join(boxes, sample).filter(inside).withColumn("y", y).withColumn("x", x)
    return out.select(*voxels.columns)


def _stand_in(y: Column, h: Column, h2: Column) -> Column:
    """The resampled row that stands for native row ``y``.

    The candidates are the first resampled row whose source row is not above ``y`` and the one
    before it; the nearer source wins, and on a tie the even row.
    """
    after = F.least(_ceil_div(y * h2, h), h2 - 1)
    before = F.greatest(after - 1, F.lit(0))
    d_before, d_after = y - F.floor(before * h / h2).cast("int"), F.floor(after * h / h2).cast("int") - y
    even = F.when(before % 2 == 0, before).otherwise(after)
    return F.when(d_before < d_after, before).when(d_after < d_before, after).otherwise(even)


def inverse_labels(voxels: DataFrame, heights: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Labels on resampled rows back on the native rows they stand for.

    The native rows of a resampled row lie between the sources of the rows around it, so they are
    an interval to try and voxels are not joined by row.
    """
    h, h2, row = F.col("h"), F.col("h2"), F.col("_row")
    first = F.greatest(F.floor((row - 1) * h / h2).cast("int"), F.lit(0))
    last = F.when(row >= h2 - 2, h - 1).otherwise(F.least(F.ceil((row + 1) * h / h2).cast("int"), h - 1))
    resampled = voxels.withColumnRenamed("y", "_row").join(heights, sample).filter((row >= 0) & (row < h2))
    tried = resampled.withColumn("y", F.explode(F.sequence(first, last)))
    return tried.filter(_stand_in(F.col("y"), h, h2) == row).select(*voxels.columns)
