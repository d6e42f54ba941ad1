"""Picks, boxes, sketches and cells against plain computations."""

import random

import pytest
from pyspark.sql import functions as F

from cohortscale import catalog
from cohortscale.functions import text
from cohortscale.operators import bootstrap, passes, reconcile, regrid, select
from cohortscale.operators.bootstrap import Boot
from cohortscale.sources import manifest, records
from cohortscale.schemas import RECORD


def test_picks_with_many_ties(spark):
    rng = random.Random(4)
    for n, values in ((40, (0.1, 0.2, 0.3)), (7, (0.5,)), (3, (0.1, 0.9)), (2, (0.1,)), (0, ())):
        rows = [(f"r{k % 3}", k, "A", True, rng.choice(values)) for k in range(n)] + [("r0", 900 + k, "A", False, 0.0) for k in range(3)]
        df = spark.createDataFrame(rows, "run string, sample_id int, cls string, reference_present boolean, dice double")
        order = sorted((d, r, s) for r, s, _, present, d in rows if present)
        want = [("worst", *order[0][1:]), ("median", *order[(n - 1) // 2][1:]), ("best", *order[-1][1:])] if n > 2 else []
        got = [(r.role, r.run, r.sample_id) for r in select.worst_median_best(df).collect()]
        assert sorted(got) == sorted(want)


def test_scores_read_the_content_box(spark):
    means = spark.createDataFrame([("s", y, x, 1, y * 10.0 + x) for y in range(6) for x in range(6)] + [("t", 0, 0, 1, 5.0)], "sample string, y int, x int, cls int, mean double")
    boxes = spark.createDataFrame([("s", 1, 4, 2, 5), ("t", 1, 4, 0, 4)], "sample string, y_from int, y_to int, x_from int, x_to int")
    assert [tuple(r) for r in passes.class_scores_in_box(means, boxes, ["sample"]).collect()] == [("s", 1, 34.0)]
    assert passes.class_scores(means, ["sample"]).count() == 2


@pytest.mark.parametrize("kind", ["uint16", "float"])
def test_sketched_windows_keep_their_ranks(spark, kind):
    n = 200_000
    value = F.floor(F.rand(3) * 65536) if kind == "uint16" else F.randn(5)
    pixels = spark.range(0, n, 1, 8).select(F.lit("v").alias("volume"), value.cast("double").alias("value"))
    pixels = pixels.unionAll(spark.createDataFrame([("v", float("nan")), ("v", None), ("w", 7.0)], "volume string, value double"))
    got = {r.volume: r for r in regrid.sketched_intensity_window(pixels, ["volume"]).collect()}
    assert (got["w"].low, got["w"].high, got["w"].pixels, got["v"].pixels) == (7.0, 7.0, 1, n)
    for q, at in ((0.01, got["v"].low), (0.99, got["v"].high)):
        below, up_to = pixels.filter(~F.isnan("value")).agg(F.count_if(F.col("value") < at), F.count_if(F.col("value") <= at)).first()
        assert below - 0.001 * n <= q * n <= up_to + 0.001 * n


def test_page_cells(spark):
    cells = ["**24** vols", "0.01 – 0.02", "1–2 mm, 3 – 4", "vols", "plain"]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, cell string")
    got = [r.c for r in df.select("k", text.page_cell(F.col("cell")).alias("c")).orderBy("k").collect()]
    assert got == ["24 scans", "0.01 to 0.02", "1 to 2 mm, 3 to 4", "vols", "plain"]
    assert df.select(text.unbold(F.lit("**a** b")).alias("x")).first().x == "a b"


def test_lists_that_are_none_are_named(spark, tmp_path):
    (tmp_path / "a.json").write_text("  [1]")
    (tmp_path / "b.json").write_text('{"x": 1}')
    bad = manifest.refused_lists(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.head) for r in bad] == [("b.json", '{"x": 1}')]


def test_stored_intervals_are_made_again(spark, tmp_path):
    rng = random.Random(8)
    boot = Boot(seed=3, n_resamples=200)
    volumes = [(f"s{k}", f"p{k % 9}", "ab"[k % 2], "IRF", rng.random()) for k in range(30)]
    rows = spark.createDataFrame(volumes, "sample_id string, patient_id string, vendor string, fluid_class string, dice double")
    named = rows.select(F.lit("f").alias("run"), "vendor", F.col("fluid_class").alias("cls"), F.lit("dice").alias("metric"), "patient_id", F.col("dice").alias("value"))
    est = bootstrap.by_vendor(named, boot, ["run", "cls", "metric"])

    def stored(df, name):
        held = rows.agg(F.collect_list(F.struct(*rows.columns)).alias("per_volume"))
        records.write_records(records.nested_estimates(df, ["run"], boot).join(F.broadcast(held)), str(tmp_path / name))
        return records.read_record_lines(spark, str(tmp_path / name), f"run STRING, {RECORD}")

    assert reconcile.recomputed_differences(stored(est, "same"), ["run"], boot).count() == 0
    moved = est.withColumn("ci_high", F.when(F.col("vendor") == "a", F.col("ci_high") + 1e-6).otherwise(F.col("ci_high")))
    found = reconcile.recomputed_differences(stored(moved, "moved"), ["run"], boot).collect()
    assert [(r.vendor, r.leaf) for r in found] == [("a", "ci_high")] and found[0].recomputed != found[0].stored


def test_records_of_many_volumes_span_documents(spark, monkeypatch):
    monkeypatch.setattr(records, "VOLUMES", 50)
    rows = spark.range(1000).selectExpr("CASE WHEN id < 900 THEN 'a' WHEN id < 910 THEN 'b' END AS run", "id AS sample_id", "id / 7 AS dice")
    sizes = rows.groupBy("run").agg(F.count("*").alias("n"))
    docs = records.volume_documents(rows, ["run"], F.struct("sample_id", "dice"), sizes).collect()
    assert max(len(d.per_volume) for d in docs) < 120 and [d.part for d in docs if d.run == "b"] == [0]
    got = sorted((v.sample_id, d.run, v.dice) for d in docs for v in d.per_volume)
    assert got == sorted((r.sample_id, r.run, r.dice) for r in rows.collect())


def test_queries_read_records_of_several_documents(spark, monkeypatch):
    found = {}
    for most in (20_000, 300):
        monkeypatch.setattr(records, "VOLUMES", most)
        for name in ("A4_tagged_per_volume", "G12_intervals_recomputed"):
            found.setdefault(name, []).append(sorted(map(str, catalog.queries()[name](spark, "/root/testdata/sf0.001").collect())))
    assert all(a == b and a for a, b in found.values())
