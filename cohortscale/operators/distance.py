"""Surface distance: the exact nearest neighbour of every surface voxel, and HD95.

Groups of few pairs are compared as they are. In the others the search goes down a tree of
boxes over the voxel indices. A box is known by its bounding corners, so a box can be dropped for a query point once another box is sure to hold something
nearer. Only boxes that may still hold the nearest voxel are opened. No cap is set: boxes at
equal distance all stay, so the result is exact whatever the shape.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortscale.operators.masks import COORDS, surface
from cohortscale.session import cut_lineage, width

BITS_PER_LEVEL = 2
#: Pairs of a query and a target up to which a group is compared as it is, without a tree.
FEW_PAIRS = 1 << 14


def _cell(axis: str, shift: int) -> Column:
    return F.shiftright(F.col(axis), shift)


def _boxes(points: DataFrame, keys: list[str], shift: int, parent: int | None) -> DataFrame:
    """Occupied boxes of one level with their bounding corners and their parent box.

    Without a parent level all boxes are in the root, box 0.
    """
    out = points.groupBy(*keys, *[_cell(a, shift).alias(f"c_{a}") for a in COORDS]).agg(
        *[F.min(a).alias(f"lo_{a}") for a in COORDS], *[F.max(a).alias(f"hi_{a}") for a in COORDS]
    )
    above = [F.lit(0) if parent is None else F.shiftright(F.col(f"c_{a}"), parent - shift) for a in COORDS]
    return out.select("*", *[b.alias(f"in_{a}") for a, b in zip(COORDS, above)])


def extent_bits(points: DataFrame) -> int:
    """Bits that hold the largest index of the points, of either sign."""
    largest = points.agg(F.max(F.greatest(*[F.abs(F.col(a).cast("bigint")) for a in COORDS]))).first()[0]
    return max(int(largest or 0).bit_length(), 1)


def nearest(
    queries: DataFrame,
    targets: DataFrame,
    spacing: DataFrame,
    keys: Sequence[str],
    sample: str,
) -> DataFrame:
    """Squared distance in mm from each query voxel to the nearest target of its group.

    ``spacing`` has (``sample``, sz, sy, sx) in mm. The levels follow from the largest index of
    the targets, so give them stored. A group without targets gives no rows: that case is the caller's, not a distance.
    """
    keys = list(keys)
    large = _large_groups(queries, targets, keys)
    if large is None:
        return _compared(queries, targets, spacing, keys, sample)
    few, many = ([df.join(large, keys, how) for df in (queries, targets)] for how in ("left_anti", "left_semi"))
    return _compared(*few, spacing, keys, sample).unionByName(_searched(*many, spacing, keys, sample))


def _large_groups(queries: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys of groups with more than few pairs, None where there is none."""
    sizes = [df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((queries, "_q"), (targets, "_t"))]
    large = cut_lineage(sizes[0].join(sizes[1], keys).filter(F.col("_q") * F.col("_t") > FEW_PAIRS).select(*keys))
    return None if large.isEmpty() else large


def _compared(queries: DataFrame, targets: DataFrame, spacing: DataFrame, keys: list[str], sample: str) -> DataFrame:
    """``nearest`` of small groups: every query beside every target of its group, in tasks the groups are dealt to.

    Nothing is shuffled but the points themselves, however far apart they are.
    """
    point = [*keys, *COORDS]
    tasks = width(queries.sparkSession)
    placed = targets.select(*keys, *[F.col(a).alias(f"t_{a}") for a in COORDS]).repartition(tasks, *keys)
    pairs = queries.select(*point).join(spacing, sample, "left").repartition(tasks, *keys).join(placed, keys)
    same, d2 = F.lit(True), F.lit(0.0)
    for a in COORDS:
        gap = F.abs(F.col(a) - F.col(f"t_{a}"))
        same, d2 = same & (gap == 0), d2 + (gap * F.col(f"s{a}")) * (gap * F.col(f"s{a}"))
    # A query that is itself a target is at 0, whatever the spacing.
    return pairs.groupBy(*point).agg(F.min(F.when(same, F.lit(0.0)).otherwise(d2)).alias("d2")).filter("d2 IS NOT NULL")


def _searched(queries: DataFrame, targets: DataFrame, spacing: DataFrame, keys: list[str], sample: str) -> DataFrame:
    """``nearest`` of large groups, down the tree of boxes."""
    point = [*keys, *COORDS]
    # A query that is itself a target needs no search.
    hits = targets.select(*point, F.lit(True).alias("_hit"))
    first = queries.select(*point).join(hits, point, "left")
    exact = first.filter("_hit").select(*point, F.lit(0.0).alias("d2"))
    todo = first.filter("_hit IS NULL").drop("_hit").join(spacing, sample)

    shifts = list(range(extent_bits(targets), 0, -BITS_PER_LEVEL)) + [0]
    # Every query starts at the root box of its group. A group holding much of the table makes
    # that join skewed on the query side only (a group has at most 64 boxes here), which is the
    # case the skew join of adaptive execution splits.
    cand = todo.select("*", *[F.lit(0).cast("int").alias(f"at_{a}") for a in COORDS])
    one_query = Window.partitionBy(*point)
    for level, shift in enumerate(shifts[1:]):
        boxes = _boxes(targets, keys, shift, shifts[level] if level else None).select(
            *keys,
            *[F.col(f"in_{a}").alias(f"at_{a}") for a in COORDS],
            *[F.col(f"c_{a}") for a in COORDS],
            *[F.col(f"{s}_{a}") for a in COORDS for s in ("lo", "hi")],
        )
        joined = cand.join(boxes, [*keys, *[f"at_{a}" for a in COORDS]])
        near, far = F.lit(0.0), F.lit(0.0)
        for a in COORDS:
            q, lo, hi, s = F.col(a), F.col(f"lo_{a}"), F.col(f"hi_{a}"), F.col(f"s{a}")
            gap = F.greatest(lo - q, q - hi, F.lit(0)) * s
            reach = F.greatest(F.abs(q - lo), F.abs(q - hi)) * s
            near, far = near + gap * gap, far + reach * reach
        cand = (
            joined.withColumn("_near", near)
            .withColumn("_far", far)
            .withColumn("_best", F.min("_far").over(one_query))
            .filter("_near <= _best")
            .select(
                *point,
                *[f"s{a}" for a in COORDS],
                "_near",
                *[F.col(f"c_{a}").alias(f"at_{a}") for a in COORDS],
            )
        )
    found = cand.groupBy(*point).agg(F.min("_near").alias("d2"))
    return exact.unionByName(found)


def directed_percentile(distances: DataFrame, keys: Sequence[str], q: float, name: str) -> DataFrame:
    """Percentile with linear interpolation over distinct distances and their counts."""
    counts = distances.groupBy(*keys, "d2").agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(
        F.percentile(F.sqrt("d2"), F.lit(q), F.col("n")).alias(name)
    )


def hd95(
    predicted: DataFrame,
    reference: DataFrame,
    spacing: DataFrame,
    grid: DataFrame,
    keys: Sequence[str],
    sample: str = "sample_id",
    q: float = 0.95,
) -> DataFrame:
    """Larger of the two directed 95th percentiles of surface distance, in mm.

    0 where both masks are empty and NULL (NaN in a record) where exactly one is.
    """
    keys = list(keys)
    cols = [*keys, *COORDS]
    masks = (
        predicted.select(*cols, F.lit("p").alias("side"))
        .unionByName(reference.select(*cols, F.lit("r").alias("side")))
        .repartition(width(predicted.sparkSession), *cols, "side")
        .distinct()
    )
    # Every level of the search reads the surfaces, and they are far smaller than the masks.
    surfaces = cut_lineage(surface(masks, [*keys, "side"]))
    # Both directions are one search: a target serves the queries of the other side.
    other = F.when(F.col("side") == "p", F.lit("r")).otherwise(F.lit("p"))
    found = nearest(
        surfaces, surfaces.withColumn("side", other), spacing, [*keys, "side"], sample
    )
    directed = directed_percentile(found, [*keys, "side"], q, "mm")
    worst = directed.groupBy(*keys).agg(F.max("mm").alias("mm"))
    # A mask has a surface voxel exactly when it is not empty.
    sides = surfaces.groupBy(*keys).agg(F.count_distinct("side").alias("sides"))
    out = grid.join(sides, keys, "left").join(worst, keys, "left")
    return out.select(
        *grid.columns,
        F.when(F.col("sides").isNull(), F.lit(0.0))
        .when(F.col("sides") == 2, F.col("mm"))
        .alias("hd95"),
    )
