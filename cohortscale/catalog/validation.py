"""Validation predicates on the manifest, the voxel tables and estimate tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortscale.catalog.base import query
from cohortscale.catalog.sql import CASE_VOXELS, DIRTY, LATTICE, MANIFEST, SAMPLES, SPLIT, with_ctes
from cohortscale.functions.hashing import pseudonym
from cohortscale.operators import regrid, splits, validate
from cohortscale.plans.views import SPACING
from cohortscale.schemas import REQUIRED_VOLUME_FIELDS

# Configured ranges of the stand-in vendors: their spacing, halved and doubled. One vendor is
# left without a range on purpose.
RANGES = {
    v: tuple((p / 2, p * 2) for p in parts) for v, parts in SPACING.items() if v != "MACHINERY"
}
_RANGE_ROWS = ", ".join(
    "('{}', [{}], [{}])".format(
        v,
        ", ".join(f"{lo!r}::DOUBLE" for lo, _ in axes),
        ", ".join(f"{hi!r}::DOUBLE" for _, hi in axes),
    )
    for v, axes in RANGES.items()
)
_RANGES_SQL = f"ranges(vendor, lo, hi) AS (VALUES {_RANGE_ROWS})"


def _verdict_sql(s: str) -> str:
    """CASE giving '<rule>|<axis>' of the first broken rule."""
    out = [f"WHEN {s} IS NULL THEN 'absent|'", f"WHEN len({s}) <> 3 THEN 'components|'"]
    for i, axis in enumerate(validate.AXES, start=1):
        out += [
            f"WHEN {s}[{i}] IS NULL THEN 'not_numeric|{axis}'",
            f"WHEN isnan({s}[{i}]) OR isinf({s}[{i}]) THEN 'not_finite|{axis}'",
            f"WHEN {s}[{i}] <= 0 THEN 'not_positive|{axis}'",
            f"WHEN {s}[{i}] > 0.5::DOUBLE THEN 'above_limit|{axis}'",
        ]
    out.append(f"WHEN {s}[1] = {s}[2] AND {s}[2] = {s}[3] THEN 'isotropic|'")
    for i, axis in enumerate(validate.AXES, start=1):
        out.append(f"WHEN NOT ({s}[{i}] BETWEEN lo[{i}] AND hi[{i}]) THEN 'outside_range|{axis}'")
    return "CASE " + " ".join(out) + " END"


@query(
    "B1_required_fields",
    with_ctes(DIRTY)
    + """SELECT sample_id, 'spacing_mm' AS field FROM dirty WHERE spacing_mm IS NULL
      UNION ALL SELECT sample_id, 'intensity_window' FROM dirty WHERE intensity_window IS NULL""",
)
def b1(v):
    return validate.missing_fields(v.dirty_manifest, REQUIRED_VOLUME_FIELDS, "sample_id")


@query(
    "B2_spacing_plausibility",
    with_ctes(DIRTY, _RANGES_SQL)
    + f"""SELECT sample_id, vendor, split_part(v, '|', 1) AS rule, nullif(split_part(v, '|', 2), '') AS axis,
      CASE WHEN v LIKE 'outside%' THEN lo[i] END AS lo,
      CASE WHEN v LIKE 'above%' THEN 0.5::DOUBLE WHEN v LIKE 'outside%' THEN hi[i] END AS hi
      FROM (SELECT *, CASE split_part(v, '|', 2) WHEN 'axial' THEN 1 WHEN 'lateral' THEN 2
              WHEN 'separation' THEN 3 END AS i
            FROM (SELECT d.*, lo, hi, {_verdict_sql('spacing_mm')} AS v
                  FROM dirty d LEFT JOIN ranges r ON d.vendor = r.vendor))
      WHERE v IS NOT NULL""",
)
def b2(v):
    return validate.spacing_violations(v.dirty_manifest, validate.range_table(v.spark, RANGES))


@query(
    "B3_defect_sensitivity",
    with_ctes(MANIFEST, _RANGES_SQL)
    + f"""SELECT defect, count(*) FILTER (v LIKE 'above%') AS outer_limit,
      count(*) FILTER (v LIKE 'outside%') AS vendor_range,
      count(*) FILTER (v IS NOT NULL AND v NOT LIKE 'above%' AND v NOT LIKE 'outside%') AS structural,
      count(*) FILTER (v IS NULL) AS missed
      FROM (SELECT defect, {_verdict_sql('sp')} AS v FROM (
        SELECT m.vendor, unnest(['x1000', 'x10', 'axial_lateral', 'lateral_separation', 'header_order', 'isotropic']) AS defect,
          unnest([[a * 1000.0::DOUBLE, b * 1000.0::DOUBLE, c * 1000.0::DOUBLE],
                  [a * 10.0::DOUBLE, b * 10.0::DOUBLE, c * 10.0::DOUBLE],
                  [b, a, c], [a, c, b], [c, b, a], [a, a, a]]) AS sp
        FROM (SELECT vendor, spacing_mm[1] AS a, spacing_mm[2] AS b, spacing_mm[3] AS c FROM manifest) m) q
        LEFT JOIN ranges r ON q.vendor = r.vendor) GROUP BY defect""",
)
def b3(v):
    return validate.defect_sensitivity(v.manifest, validate.range_table(v.spark, RANGES))


@query(
    "B4_range_learning",
    with_ctes(MANIFEST)
    + """, wide AS (SELECT vendor, [min(spacing_mm[1]), min(spacing_mm[2]), min(spacing_mm[3])] AS lo,
      [max(spacing_mm[1]), max(spacing_mm[2]), max(spacing_mm[3])] AS hi FROM manifest GROUP BY vendor),
    tested AS (SELECT m.vendor, k AS margin, m.spacing_mm AS s, lo, hi
      FROM manifest m JOIN wide w ON m.vendor = w.vendor, (VALUES (1.5::DOUBLE), (2.0::DOUBLE), (3.0::DOUBLE)) t(k))
    SELECT vendor, margin, count(*) FILTER (s[1] BETWEEN lo[1] / margin AND hi[1] * margin
        AND s[2] BETWEEN lo[2] / margin AND hi[2] * margin
        AND s[3] BETWEEN lo[3] / margin AND hi[3] * margin) AS accepted,
      count(*) FILTER (NOT (s[2] BETWEEN lo[1] / margin AND hi[1] * margin
        AND s[1] BETWEEN lo[2] / margin AND hi[2] * margin
        AND s[3] BETWEEN lo[3] / margin AND hi[3] * margin)) AS swaps_rejected,
      count(*) AS samples FROM tested GROUP BY ALL""",
)
def b4(v):
    return validate.margin_acceptance(v.manifest, (1.5, 2.0, 3.0))


@query(
    "B4_measured_ranges",
    with_ctes(MANIFEST)
    + """SELECT vendor, pos, min(mm) AS lo, max(mm) AS hi, count(*) AS samples,
      (['axial', 'lateral', 'separation'])[pos + 1] AS axis
      FROM (SELECT vendor, unnest([0, 1, 2]) AS pos, unnest(spacing_mm) AS mm FROM manifest)
      GROUP BY vendor, pos""",
)
def b4_ranges(v):
    return validate.measured_ranges(v.manifest)


@query(
    "B5_header_agreement",
    with_ctes(DIRTY)
    + """SELECT coalesce(m.patient_id, d.patient_id) AS patient_id, m.shape IS DISTINCT FROM d.shape AS size_differs,
      m.spacing_mm IS DISTINCT FROM d.spacing_mm AS spacing_differs
      FROM manifest m FULL JOIN dirty d ON m.patient_id = d.patient_id
      WHERE m.shape IS DISTINCT FROM d.shape OR m.spacing_mm IS DISTINCT FROM d.spacing_mm""",
)
def b5(v):
    return validate.header_mismatches(v.manifest, v.dirty_manifest)


@query(
    "B6_label_values",
    """SELECT l_orderkey AS sample_id, l_linenumber % 6 AS label, count(*) AS voxels
       FROM lineitem WHERE l_linenumber % 6 NOT IN (0, 1, 2, 3) GROUP BY ALL""",
)
def b6(v):
    voxels = v.table("lineitem").select(
        F.col("l_orderkey").alias("sample_id"), (F.col("l_linenumber") % 6).alias("label")
    )
    return validate.unexpected_labels(voxels)


@query(
    "B7_element_count",
    """SELECT doc_id, n_chars AS expected, strlen(text)::DOUBLE AS found
       FROM documents WHERE n_chars <> strlen(text)""",
)
def b7(v):
    files = v.table("documents").select(
        "doc_id",
        F.array("n_chars", F.lit(1).cast("bigint"), F.lit(1).cast("bigint")).alias("dims"),
        F.octet_length("text").alias("n_bytes"),
        F.lit(1).alias("width"),
    )
    return validate.payload_mismatches(files, "doc_id")


@query(
    "B8_spacing_unchanged",
    with_ctes(MANIFEST)
    + """SELECT sample_id, spacing_mm AS recorded, used FROM (
      SELECT sample_id, spacing_mm, [spacing_mm[1] * 1.1::DOUBLE / 1.1::DOUBLE, spacing_mm[2], spacing_mm[3]] AS used
      FROM manifest) WHERE used IS DISTINCT FROM spacing_mm""",
)
def b8(v):
    s = F.col("spacing_mm")
    used = v.manifest.withColumn("spacing_mm", F.array(s[0] * 1.1 / 1.1, s[1], s[2]))
    return validate.spacing_changes(used, v.manifest)


@query(
    "B9_window_inheritance",
    with_ctes(MANIFEST)
    + """SELECT patient_id, frame_index, w AS intensity_window, intensity_window AS volume_window FROM (
      SELECT patient_id, frame_index, intensity_window,
        CASE WHEN frame_index = sample_id % 29 THEN [0.0::DOUBLE, 1.0::DOUBLE] ELSE intensity_window END AS w
      FROM manifest, range(7) t(frame_index)) WHERE w IS DISTINCT FROM intensity_window""",
)
def b9(v):
    frames = v.manifest.withColumn(
        "frame_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shape")[0].cast("bigint") - 1))
    ).select(
        "patient_id",
        "frame_index",
        F.when(
            F.col("frame_index") == F.col("sample_id") % 29, F.array(F.lit(0.0), F.lit(1.0))
        ).otherwise(F.col("intensity_window")).alias("intensity_window"),
    )
    return validate.window_changes(frames, v.manifest)


@query(
    "B10_one_volume_per_subject",
    with_ctes(SAMPLES)
    + "SELECT patient_id, count(*) AS volumes FROM samples GROUP BY patient_id HAVING count(*) > 1",
)
def b10(v):
    return validate.repeated_volumes(v.samples)


@query(
    "B10_three_dimensional",
    with_ctes(DIRTY) + "SELECT sample_id, len(shape) AS dims FROM dirty WHERE len(shape) <> 3",
)
def b10_dims(v):
    return validate.not_three_dimensional(v.dirty_manifest)


@query(
    "B11_one_vendor_per_patient",
    """SELECT o_custkey AS patient_id, count(DISTINCT o_orderpriority) AS vendors,
       min(o_orderpriority) AS first_vendor, max(o_orderpriority) AS last_vendor
       FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1""",
)
def b11(v):
    rows = v.table("orders").select(
        F.col("o_custkey").alias("patient_id"), F.col("o_orderpriority").alias("vendor")
    )
    return validate.patients_under_two_vendors(rows)


@query(
    "B12_one_bootstrap_setting",
    """SELECT p_size AS seed, 2000 AS n_resamples, count(*) AS rows FROM part
       WHERE (SELECT count(DISTINCT p_size) FROM part) > 1 GROUP BY p_size""",
)
def b12(v):
    rows = v.table("part").select(F.col("p_size").alias("seed"), F.lit(2000).alias("n_resamples"))
    return validate.mixed_settings(rows, ["seed", "n_resamples"])


@query(
    "B13_pseudonym_collisions",
    """SELECT 'P-' || upper(substr(sha256('s:' || c_name), 1, 2)) AS pseudonym, count(DISTINCT c_custkey) AS patients
       FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey) > 1""",
)
def b13(v):
    short = F.substring(pseudonym(F.col("c_name"), "s", "P-"), 1, 4)
    pairs = v.table("customer").select(short.alias("pseudonym"), F.col("c_custkey").alias("patient_id"))
    return validate.pseudonym_collisions(pairs)


@query(
    "B14_mask_problems",
    with_ctes(LATTICE, DIRTY)
    + """SELECT sample_id, problem, count(*) AS n FROM (
      SELECT l.sample_id, 'not_binary' AS problem FROM lattice_lines l WHERE l.z % 4 NOT IN (0, 1)
      UNION ALL
      SELECT l.sample_id, 'outside_shape' FROM lattice_lines l LEFT JOIN dirty d ON d.sample_id = l.sample_id
      WHERE NOT coalesce(l.z < d.shape[1] AND l.y < d.shape[2] AND l.x < d.shape[3], false)
      UNION ALL
      SELECT sample_id, 'spacing' FROM dirty WHERE spacing_mm IS NULL
        OR coalesce(isnan(spacing_mm[1]) OR spacing_mm[1] <= 0, false)
        OR coalesce(isnan(spacing_mm[2]) OR spacing_mm[2] <= 0, false)
        OR coalesce(isnan(spacing_mm[3]) OR spacing_mm[3] <= 0, false)) GROUP BY ALL""",
)
def b14(v):
    voxels = v.lattice_lines.select("sample_id", "z", "y", "x", (F.col("z") % 4).alias("value"))
    return validate.mask_problems(voxels, v.dirty_manifest)


@query(
    "B15_interval_order",
    """SELECT p_partkey, p_retailprice AS ci_low, p_retailprice + (p_size - 25) AS ci_high,
       p_size - 2 AS n FROM part WHERE p_size < 25""",
)
def b15(v):
    rows = v.table("part").select(
        "p_partkey",
        F.col("p_retailprice").alias("ci_low"),
        (F.col("p_retailprice") + (F.col("p_size") - 25)).alias("ci_high"),
        (F.col("p_size") - 2).alias("n"),
    )
    return validate.bad_intervals(rows)


@query(
    "B16_degenerate_window",
    """SELECT l_orderkey AS sample_id, quantile_cont(l_extendedprice, 0.01::DOUBLE) AS low,
       quantile_cont(l_extendedprice, 0.99::DOUBLE) AS high FROM lineitem GROUP BY 1
       HAVING NOT (quantile_cont(l_extendedprice, 0.99::DOUBLE) > quantile_cont(l_extendedprice, 0.01::DOUBLE))""",
)
def b16(v):
    pixels = v.table("lineitem").select(
        F.col("l_orderkey").alias("sample_id"), F.col("l_extendedprice").alias("value")
    )
    return validate.degenerate_windows(regrid.intensity_window(pixels, ["sample_id"]))
