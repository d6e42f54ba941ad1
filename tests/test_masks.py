import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortscale.operators import distance, masks, regrid

VOXEL = "sample_id STRING, cls STRING, z INT, y INT, x INT"


def voxels(spark, volumes):
    rows = [
        (s, c, *map(int, at)) for (s, c), mask in volumes.items() for at in np.argwhere(mask)
    ]
    return spark.createDataFrame(rows, VOXEL)


def surface_points(mask):
    padded = np.pad(mask, 1)
    inside = mask.copy()
    for axis in range(3):
        for step in (-1, 1):
            inside &= np.roll(padded, step, axis)[1:-1, 1:-1, 1:-1]
    return np.argwhere(mask & ~inside)


def brute_hd95(p, r, spacing):
    if not p.any() and not r.any():
        return 0.0
    if not p.any() or not r.any():
        return None
    a, b = surface_points(p) * np.array(spacing), surface_points(r) * np.array(spacing)
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    return max(np.percentile(d.min(1), 95), np.percentile(d.min(0), 95))


@pytest.fixture(scope="module")
def random_pairs():
    rng = np.random.default_rng(5)
    pred, ref = {}, {}
    for i in range(8):
        shape = (6, 20, 18)
        noise = rng.random(shape)
        core = np.zeros(shape, bool)
        core[1:5, 3 + i : 12, 2:15] = True
        pred[f"s{i}", "a"] = core & (noise > 0.1) | (noise > 0.995)
        ref[f"s{i}", "a"] = np.roll(core, i, axis=1)
    pred["empty", "a"] = np.zeros((6, 20, 18), bool)
    ref["empty", "a"] = np.zeros((6, 20, 18), bool)
    pred["only_pred", "a"], ref["only_pred", "a"] = pred["s0", "a"], ref["empty", "a"]
    return pred, ref


def test_dice_and_counts(spark, random_pairs):
    pred, ref = random_pairs
    keys = ["sample_id", "cls"]
    grid = spark.createDataFrame(list(pred), "sample_id STRING, cls STRING")
    paired = masks.pair(voxels(spark, pred), voxels(spark, ref), keys)
    out = masks.with_dice(masks.on_grid(masks.overlap_counts(paired, keys), grid, keys)).collect()
    assert len(out) == len(pred)
    for row in out:
        p, r = pred[row.sample_id, "a"], ref[row.sample_id, "a"]
        total = p.sum() + r.sum()
        assert row.dice == (1.0 if total == 0 else 2.0 * (p & r).sum() / total)


def test_surface_is_mask_less_erosion(spark, random_pairs):
    pred, _ = random_pairs
    got = {tuple(r) for r in masks.surface(voxels(spark, pred), ["sample_id", "cls"]).collect()}
    want = {(s, c, *map(int, at)) for (s, c), m in pred.items() for at in surface_points(m)}
    assert got == want


@pytest.mark.parametrize("shift", [0, 1000, 1 << 20])
def test_hd95_equals_brute_force(spark, random_pairs, shift):
    pred, ref = random_pairs
    mm = (0.0469, 0.0039, 0.0117)
    grid = spark.createDataFrame(list(pred), "sample_id STRING, cls STRING")
    spacing = grid.select(
        "sample_id", *[F.lit(s).alias(n) for s, n in zip(mm, ("sz", "sy", "sx"), strict=True)]
    )
    out = distance.hd95(
        *[voxels(spark, m).withColumn("y", F.col("y") + shift).withColumn("x", F.col("x") - shift) for m in (pred, ref)],
        spacing, grid, ["sample_id", "cls"],
    )
    for row in out.collect():
        want = brute_hd95(pred[row.sample_id, "a"], ref[row.sample_id, "a"], mm)
        assert (row.hd95 is None) == (want is None)
        if want is not None:
            assert math.isclose(row.hd95, want, rel_tol=1e-12, abs_tol=1e-12)


@pytest.mark.parametrize("axis,expected", [(0, 7.0), (1, 0.5), (2, 3.0)])
def test_one_voxel_shift_costs_the_spacing_of_its_axis(spark, axis, expected):
    mask = np.zeros((8, 8, 8), bool)
    mask[3, 3, 3] = True
    pred = {("s", "a"): np.roll(mask, 1, axis=axis)}
    grid = spark.createDataFrame([("s", "a")], "sample_id STRING, cls STRING")
    spacing = spark.createDataFrame([("s", [0.5, 3.0, 7.0])], "sample_id STRING, spacing_mm ARRAY<DOUBLE>")
    zyx = masks.array_axis_spacing()
    spacing = spacing.select("sample_id", zyx[0].alias("sz"), zyx[1].alias("sy"), zyx[2].alias("sx"))
    out = distance.hd95(
        voxels(spark, pred), voxels(spark, {("s", "a"): mask}), spacing, grid, ["sample_id", "cls"]
    )
    assert out.first().hd95 == expected


@pytest.mark.parametrize("h,h2", [(10, 25), (25, 10), (16, 16), (9, 13), (13, 4)])
def test_regrid_round_trip_against_indices(spark, h, h2):
    heights = spark.createDataFrame([("s", h, h2)], "sample_id STRING, h INT, h2 INT")
    column = spark.createDataFrame([("s", "a", 0, y, 0) for y in range(h)], VOXEL)
    forward = regrid.forward_labels(column.withColumn("src", F.col("y")), heights)
    source = {r.y: r.src for r in forward.collect()}
    assert source == {i: i * h // h2 for i in range(h2)}
    resampled = spark.createDataFrame([("s", "a", 0, y, 0) for y in range(h2)], VOXEL).withColumn("row", F.col("y"))
    found = regrid.inverse_labels(resampled, heights).collect()
    back = {r.y: r.row for r in found}
    assert len(found) == h == len(back)
    src = np.array([i * h // h2 for i in range(h2)])
    for y in range(h):
        best = np.abs(src - y).min()
        after = min(int(np.searchsorted(src, y)), h2 - 1)
        options = [i for i in {max(after - 1, 0), after} if abs(src[i] - y) == min(abs(src[max(after - 1, 0)] - y), abs(src[after] - y))]
        want = options[0] if len(options) == 1 else next(i for i in options if i % 2 == 0)
        assert back[y] == want and abs(src[back[y]] - y) == best


def test_window_percentiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 300, 5000)
    px = spark.createDataFrame([("s", int(v)) for v in values], "sample_id STRING, value INT")
    row = regrid.intensity_window(px, ["sample_id"]).first()
    low, high = np.percentile(values, [1, 99])
    assert (row.low, row.high) == (low, high)
    spread = regrid.ranked_intensity_window(px.repartition(6), ["sample_id"]).first()
    assert (spread.low, spread.high) == pytest.approx((low, high), abs=1e-9)


def test_small_groups_far_apart_are_compared_without_a_search(spark, random_pairs, monkeypatch):
    """One search for every group, for none, and for some give the same; small groups are never searched."""
    pred, ref = random_pairs
    grid = spark.createDataFrame(list(pred), "sample_id STRING, cls STRING")
    spacing = grid.select("sample_id", F.lit(0.5).alias("sz"), F.lit(3.0).alias("sy"), F.lit(7.0).alias("sx"))
    sides = [voxels(spark, m).withColumn("x", F.col("x") * 70001) for m in (pred, ref)]
    searched, found = [], []
    search = distance._searched
    monkeypatch.setattr(distance, "_searched", lambda *a: searched.append(a[0].select("sample_id", "cls").distinct().count()) or search(*a))
    for few in (0, 1500, 1 << 30):
        monkeypatch.setattr(distance, "FEW_PAIRS", few)
        found.append({tuple(r) for r in distance.hd95(*sides, spacing, grid, ["sample_id", "cls"]).collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) == len(pred)
    assert searched and len(searched) < 3


def test_pairs_merge_repeated_voxels_in_as_many_tasks_as_the_session_has(spark):
    rows = voxels(spark, {("s", "a"): np.ones((2, 3, 4), bool)})
    paired = masks.pair(rows.unionAll(rows), rows, ["sample_id", "cls"])
    assert paired.count() == 24 and paired.filter("NOT (predicted AND reference)").isEmpty()
    assert paired.rdd.getNumPartitions() == 8


def test_order_lines_are_dealt_to_more_tasks_where_there_are_many(spark, tmp_path, monkeypatch):
    from cohortscale import session
    from cohortscale.plans.views import Views

    lines = spark.range(240).select(
        (F.col("id") % 40).alias("l_orderkey"), F.lit("A").alias("l_returnflag"), (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"),
        (F.col("id") * 7).alias("l_partkey"), (F.col("id") * 3).alias("l_suppkey"), F.lit(0.05).alias("l_discount"),
        F.when(F.col("id") % 2 == 0, 0.08).otherwise(0.0).alias("l_tax"), F.lit(1.0).alias("l_extendedprice"),
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(40).select(F.col("id").alias("o_orderkey"), (F.col("id") % 9).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    few = Views(spark, str(tmp_path)).lattice_paired
    monkeypatch.setattr(session, "ROWS_PER_TASK", 10)
    many = Views(spark, str(tmp_path)).lattice_paired
    assert few.rdd.getNumPartitions() == 8 and many.rdd.getNumPartitions() == 24
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in many.collect()} and many.count() > 100
