import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortscale.operators import splits, validate

VENDORS = ("cirrus", "spectralis", "topcon")


def manifest(spark, patients=8, samples=3):
    rows = [
        (f"{v}-P{p}-S{s}", f"{v}-P{p}", v) for v in VENDORS for p in range(patients) for s in range(samples)
    ]
    return spark.createDataFrame(rows, "sample_id STRING, patient_id STRING, vendor STRING")


@pytest.mark.parametrize("patients", [1, 2, 3, 8, 40])
def test_every_fold_partitions_the_patients(spark, patients):
    m = manifest(spark, patients)
    split = splits.leave_one_vendor_out(m, VENDORS, 0.15, seed=3)
    assert splits.overlap_violations(split, m).isEmpty()
    counts = {(r.held_out_vendor, r.bucket): r["count"] for r in split.groupBy("held_out_vendor", "bucket").count().collect()}
    for v in VENDORS:
        assert counts[v, "test"] == patients
        assert counts[v, "train"] >= 1
        assert sum(counts.get((v, b), 0) for b in splits.BUCKETS) == 3 * patients


def test_split_is_the_same_for_any_row_order_and_differs_by_seed(spark):
    m = manifest(spark, 20)
    a = splits.leave_one_vendor_out(m, VENDORS, 0.15, seed=3)
    b = splits.leave_one_vendor_out(m.orderBy(F.desc("sample_id")).repartition(5), VENDORS, 0.15, seed=3)
    c = splits.leave_one_vendor_out(m, VENDORS, 0.15, seed=4)
    assert a.exceptAll(b).isEmpty() and not a.drop("seed").exceptAll(c.drop("seed")).isEmpty()


@settings(max_examples=200, deadline=None)
@given(n=st.integers(1, 60), val=st.floats(0, 0.6), ref=st.floats(0, 0.39))
def test_two_shrink_steps_always_leave_a_training_patient(n, val, ref):
    n_ref, n_val = round(n * ref), round(n * val)
    for _ in range(2):
        if n_ref + n_val >= n and (n_ref or n_val):
            if n_val >= n_ref:
                n_val -= 1
            else:
                n_ref -= 1
    assert n_ref + n_val < n or not (n_ref or n_val)


@pytest.mark.parametrize("val,ref", [(-0.1, 0.1), (1.0, 0.0), (0.5, 0.5), (0.1, 1.0)])
def test_bad_fractions_are_refused(spark, val, ref):
    with pytest.raises(ValueError):
        splits.leave_one_vendor_out(manifest(spark), VENDORS, val, seed=1, ref_fraction=ref)


def test_frames_inherit_and_missing_counts_are_named(spark):
    m = manifest(spark, 4)
    split = splits.leave_one_vendor_out(m, VENDORS, 0.15, seed=3)
    counts = m.select("patient_id").distinct().withColumn(
        "frames", F.when(F.col("patient_id") == "topcon-P1", F.lit(0)).when(F.col("patient_id") != "cirrus-P0", F.lit(3))
    ).filter("frames IS NOT NULL")
    bad = {r.patient_id: r.problem for r in splits.frame_count_violations(split, counts).collect()}
    assert bad == {"topcon-P1": "empty", "cirrus-P0": "missing"}
    frames = splits.expand_to_frames(split, counts)
    assert splits.frame_overlap_violations(frames, m).isEmpty()
    assert frames.filter("frame_id = 'topcon-P2#0002'").count() == 3
    leaked = frames.withColumn("bucket", F.when(F.col("frame_index") == 1, F.lit("val")).otherwise(F.col("bucket")))
    assert not splits.frame_overlap_violations(leaked, m).isEmpty()
    assert not splits.frame_overlap_violations(frames.unionByName(frames), m).filter("problem = 'repeated_frame'").isEmpty()


REAL = {"cirrus": (0.001955, 0.011742, 0.047), "spectralis": (0.003872, 0.0114, 0.12), "topcon": (0.0026, 0.01172, 0.04688)}


def test_measured_ranges_accept_real_spacing_and_catch_every_defect(spark):
    m = spark.createDataFrame(
        [(v, v, list(s)) for v, s in REAL.items()] + [("other", "unknown", [0.3, 0.2, 0.1])],
        "sample_id STRING, vendor STRING, spacing_mm ARRAY<DOUBLE>",
    )
    ranges = validate.range_table(spark, validate.MEASURED_RANGES)
    assert validate.spacing_violations(m, ranges).isEmpty()
    known = m.filter("vendor <> 'unknown'")
    got = {r.defect: r.asDict() for r in validate.defect_sensitivity(known, ranges).collect()}
    assert all(r["missed"] == 0 for r in got.values())
    assert got["x1000"]["outer_limit"] == 3 and got["isotropic"]["structural"] == 3
    assert got["axial_lateral"]["vendor_range"] == 3


def test_assert_empty_names_the_violation(spark):
    rows = spark.createDataFrame([("s1", None), ("s2", 1)], "sample_id STRING, shape INT")
    with pytest.raises(validate.ValidationError, match="s1"):
        validate.assert_empty(validate.missing_fields(rows, ["shape"], "sample_id"), "manifest")
    with pytest.raises(validate.ValidationError, match="spacing"):
        validate.missing_fields(rows, ["spacing"], "sample_id")


def test_split_documents_come_in_the_parts_asked_for(spark, tmp_path):
    from cohortscale.sources import manifest as files

    m = manifest(spark, 20)
    split = splits.leave_one_vendor_out(m, VENDORS, 0.15, seed=3)
    for parts, documents in ((1, 3), (4, None)):
        path = str(tmp_path / f"splits-{parts}")
        files.save_split(split, path, parts)
        n = spark.read.text(path).count()
        assert n == documents if documents else n > 3
        back = files.load_split(spark, path)
        want = split.select("fold_id", "bucket", "patient_id", "held_out_vendor", "seed")
        assert back.exceptAll(want).isEmpty() and back.count() == want.count()
