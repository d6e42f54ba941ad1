"""Splits, frames, seeded order and per-volume rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortscale.catalog.base import CLASSES, SEED, query
from cohortscale.catalog.sql import ARMS, MANIFEST, PER_VOLUME, SPLIT, with_ctes
from cohortscale.functions.hashing import derived_seed
from cohortscale.operators import rows, splits
from cohortscale.plans.views import VENDORS

_PLANTED = """planted AS (
  SELECT fold_id, unnest(CASE WHEN bucket = 'train' AND patient_id % 40 = 1 THEN ['train', 'val']
      WHEN bucket = 'train' AND patient_id % 43 = 3 THEN ['test'] ELSE [bucket] END) AS bucket,
    CASE WHEN patient_id % 41 = 2 THEN -patient_id ELSE patient_id END AS patient_id,
    vendor, held_out_vendor, seed FROM split)"""


def planted_leaks(split):
    """A split with patients shared, moved into test, and replaced by unknown ids."""
    p, train = F.col("patient_id"), F.col("bucket") == "train"
    moved = (
        F.when(train & (p % 40 == 1), F.array(F.lit("train"), F.lit("val")))
        .when(train & (p % 43 == 3), F.array(F.lit("test")))
        .otherwise(F.array("bucket"))
    )
    return split.withColumn("bucket", F.explode(moved)).withColumn(
        "patient_id", F.when(p % 41 == 2, -p).otherwise(p)
    )


@query("C1_leave_one_vendor_out", with_ctes(SPLIT) + "SELECT * FROM split")
def c1(v):
    return v.split


@query(
    "C2_patient_overlap",
    with_ctes(SPLIT, _PLANTED)
    + """, seen AS (SELECT p.fold_id, p.patient_id, count(DISTINCT p.bucket) AS b,
      bool_or(p.bucket = 'test') AS t, min(p.held_out_vendor) AS h, min(c.c_mktsegment) AS v
      FROM planted p LEFT JOIN customer c ON c.c_custkey = p.patient_id GROUP BY ALL)
    SELECT fold_id, patient_id, 'unknown' AS problem FROM seen WHERE v IS NULL
    UNION ALL SELECT fold_id, patient_id, 'shared' FROM seen WHERE b > 1
    UNION ALL SELECT fold_id, patient_id, 'wrong_vendor' FROM seen WHERE t AND v <> h
    UNION ALL SELECT f.fold_id, c.c_custkey, 'unassigned' FROM customer c, (SELECT DISTINCT fold_id FROM planted) f
      WHERE NOT EXISTS (SELECT 1 FROM planted p WHERE p.fold_id = f.fold_id AND p.patient_id = c.c_custkey)""",
)
def c2(v):
    return splits.overlap_violations(planted_leaks(v.split), v.patients)


_COUNTS = "counts AS (SELECT c_custkey AS patient_id, 1 + c_custkey % 5 AS frames FROM customer)"


def frame_counts(v):
    return v.patients.select("patient_id", (1 + F.col("patient_id") % 5).cast("int").alias("frames"))


@query(
    "C3_expand_to_frames",
    with_ctes(SPLIT, _COUNTS)
    + """SELECT fold_id, bucket, s.patient_id, frame_index,
      s.patient_id::VARCHAR || '#' || lpad(frame_index::VARCHAR, 4, '0') AS frame_id
      FROM split s JOIN counts c ON s.patient_id = c.patient_id, LATERAL (SELECT unnest(range(frames)) AS frame_index)""",
)
def c3(v):
    return splits.expand_to_frames(v.split, frame_counts(v))


@query(
    "C3_frame_count_refusals",
    with_ctes(SPLIT)
    + """SELECT DISTINCT s.patient_id, f.frames, CASE WHEN f.frames IS NULL THEN 'missing' ELSE 'empty' END AS problem
      FROM split s LEFT JOIN (SELECT o_custkey AS patient_id, (count(*) - 5)::INTEGER AS frames FROM orders GROUP BY 1) f
      ON s.patient_id = f.patient_id WHERE f.frames IS NULL OR f.frames <= 0""",
)
def c3_refusals(v):
    counts = v.table("orders").groupBy(F.col("o_custkey").alias("patient_id")).agg(
        (F.count("*") - 5).cast("int").alias("frames")
    )
    return splits.frame_count_violations(v.split, counts)


@query(
    "C4_frame_overlap",
    with_ctes(SPLIT, _PLANTED)
    + """SELECT DISTINCT fold_id, patient_id, 'unknown' AS problem FROM planted
      WHERE patient_id NOT IN (SELECT c_custkey FROM customer)
      UNION ALL SELECT fold_id, patient_id, 'shared' FROM planted GROUP BY fold_id, patient_id HAVING count(DISTINCT bucket) > 1
      UNION ALL SELECT fold_id, patient_id, 'repeated_frame' FROM planted GROUP BY fold_id, patient_id HAVING count(*) > 1""",
)
def c4(v):
    counts = frame_counts(v)
    both = counts.unionByName(counts.withColumn("patient_id", -F.col("patient_id")).filter("patient_id <> 0"))
    frames = splits.expand_to_frames(planted_leaks(v.split), both)
    return splits.frame_overlap_violations(frames, v.patients)


@query(
    "C5_frame_records",
    with_ctes(SPLIT, _COUNTS, MANIFEST)
    + """SELECT fold_id, bucket, s.patient_id, frame_index, s.patient_id::VARCHAR || '#' || lpad(frame_index::VARCHAR, 4, '0') AS frame_id,
      m.sample_id, m.vendor, m.source_path, m.spacing_mm, m.intensity_window, m.sample_id IS NOT NULL AS matched, frame_index AS parsed_index
      FROM split s JOIN counts c ON s.patient_id = c.patient_id
      LEFT JOIN (SELECT * FROM manifest WHERE intensity_window[1] > 0) m ON m.sample_id = s.patient_id,
      LATERAL (SELECT unnest(range(frames)) AS frame_index)""",
)
def c5(v):
    # Volumes with a window below zero are left out, so that unmatched frames exist.
    volumes = v.manifest.filter(F.col("intensity_window")[0] > 0).withColumn("patient_id", F.col("sample_id"))
    return splits.frame_records(splits.expand_to_frames(v.split, frame_counts(v)), volumes)


@query(
    "C6_split_flow",
    with_ctes(SPLIT)
    + "SELECT fold_id, bucket, "
    + ", ".join(f'count(*) FILTER (vendor = \'{x}\') AS "{x}"' for x in VENDORS)
    + ", count(*) AS patients FROM split GROUP BY fold_id, bucket",
)
def c6(v):
    return splits.split_flow(v.split, VENDORS)


@query(
    "C7_derived_seed",
    f"""SELECT c_name AS patient_id, (('0x' || substr(sha256('mc_dropout:{SEED}:' || c_name), 1, 16))::UBIGINT
        % 9223372036854775807::UBIGINT)::BIGINT AS seed FROM customer""",
)
def c7(v):
    return v.table("customer").select(
        F.col("c_name").alias("patient_id"), derived_seed("mc_dropout", SEED, F.col("c_name")).alias("seed")
    )


@query(
    "C8_epoch_order",
    f"""SELECT epoch, o_orderkey AS sample_id, row_number() OVER (PARTITION BY epoch
        ORDER BY md5(concat_ws('|', '{SEED}', epoch::VARCHAR, o_orderkey::VARCHAR)), o_orderkey) AS position
        FROM orders, (VALUES (0), (1), (7)) e(epoch)""",
)
def c8(v):
    items = v.table("orders").select(F.col("o_orderkey").alias("sample_id"))
    return splits.epoch_order(items, SEED, (0, 1, 7), "sample_id")


@query(
    "C9_view_selection",
    with_ctes(ARMS)
    + """SELECT run, arm, 'class-present' AS view, cls, count(*) AS n, round(avg(dice), 9) AS dice
      FROM arms WHERE reference_present GROUP BY ALL
      UNION ALL SELECT run, arm, 'all-volume', cls, count(*), round(avg(dice), 9) FROM arms GROUP BY ALL""",
)
def c9(v):
    return (
        rows.views_of(v.arms)
        .groupBy("run", "arm", "view", "cls")
        .agg(F.count("*").alias("n"), F.round(F.avg("dice"), 9).alias("dice"))
    )


@query(
    "C10_presence_flags",
    with_ctes(PER_VOLUME)
    + """SELECT sample_id, cls, predicted_voxels > 1 AS predicted_present, reference_present, score,
      predicted_voxels, 1 AS threshold FROM per_volume""",
)
def c10(v):
    return rows.detection_rows(v.per_volume, threshold=1).select(
        "sample_id", "cls", "predicted_present", "reference_present", "score", "predicted_voxels", "threshold"
    )


@query(
    "C11_per_volume_rows",
    with_ctes(PER_VOLUME)
    + """SELECT sample_id, patient_id, vendor, cls, round(dice, 9) AS dice, predicted_voxels, reference_voxels,
      reference_present, score FROM per_volume""",
)
def c11(v):
    long = rows.long_rows(v.per_volume)
    scores = rows.detection_rows(v.per_volume, threshold=1)
    wide = rows.per_volume_rows(long, scores)
    return wide.withColumn("dice", F.round("dice", 9))
