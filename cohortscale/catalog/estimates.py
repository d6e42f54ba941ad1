"""Grouped estimates with intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortscale.catalog.base import BOOT, CLASSES, query
from cohortscale.catalog.grids import HD95_CTES, counts_on_grid, hd95_rows
from cohortscale.catalog.sql import ARMS, PER_VOLUME, SCORED, boot_sql, draw_index, draws_sql, with_ctes
from cohortscale.operators import auroc as roc
from cohortscale.operators import bootstrap, compare
from cohortscale.operators.rows import detection_rows
from cohortscale.session import cut_lineage

PLACES = 9
EST = ("value", "ci_low", "ci_high")
EST_SQL = "round(value, 9) AS value, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high"


def rounded(df, cols=EST, places=PLACES):
    return df.select(*[F.round(c, places).alias(c) if c in cols else c for c in df.columns])


_POOLED = """pooled AS (
  SELECT vendor, cls, 'dice' AS metric, patient_id, dice AS value FROM per_volume
  UNION ALL SELECT 'all_vendors', cls, 'dice', patient_id, dice FROM per_volume)"""


@query(
    "E1_by_vendor",
    with_ctes(PER_VOLUME, _POOLED, boot_sql("est", "pooled", "vendor, cls, metric", "patient_id", "value"))
    + f"SELECT vendor, cls, metric, {EST_SQL}, n, n_measurements FROM est",
)
def e1(v):
    rows = v.per_volume.select("vendor", "cls", F.lit("dice").alias("metric"), "patient_id", F.col("dice").alias("value"))
    return rounded(bootstrap.by_vendor(rows, BOOT))


CUBE_BOOT = bootstrap.Boot(seed=BOOT.seed, n_resamples=BOOT.n_resamples)
_CELL = "vendor, cls"


@query(
    "E2_cluster_bootstrap",
    with_ctes(PER_VOLUME, boot_sql("est", "per_volume", "cls", "patient_id", "dice"))
    + f"SELECT cls, {EST_SQL}, n, n_measurements FROM est",
)
def e2(v):
    return rounded(bootstrap.estimate(v.per_volume, ["cls"], BOOT, value="dice"))


@query(
    "E2_undefined_values",
    with_ctes(
        PER_VOLUME,
        "scored_rows AS (SELECT cls, vendor, patient_id, CASE WHEN cls = 'N' AND vendor = 'BUILDING' THEN NULL"
        " WHEN cls = 'R' AND patient_id > 0 THEN NULL ELSE score END AS score FROM per_volume)",
        boot_sql("est", "scored_rows", "vendor, cls", "patient_id", "score"),
    )
    + """SELECT vendor, cls, round(value, 7) AS value, round(ci_low, 7) AS ci_low, round(ci_high, 7) AS ci_high,
      n, n_measurements FROM est""",
)
def e2_undefined(v):
    """Undefined values are dropped; a cell of them alone stays with n = 0, one patient is degenerate."""
    gone = ((F.col("cls") == "N") & (F.col("vendor") == "BUILDING")) | (
        (F.col("cls") == "R") & (F.col("patient_id") > 0)
    )
    rows = v.per_volume.withColumn(
        "score", F.when(gone, F.lit(float("nan"))).otherwise(F.col("score"))
    )
    return rounded(bootstrap.estimate(rows, ["vendor", "cls"], BOOT, value="score"), places=7)


def _poisson_sql() -> str:
    term, below, above = 0.36787944117144233, 0.0, []
    for k in range(1, 18):
        below += term
        above.append(f"(u > {below!r}::DOUBLE)::INT")
        term /= k
    place = draw_index("'poisson'", str(1 << 40), s="patient")
    return f"""sums AS (SELECT cls, patient_id AS patient, sum(dice) AS t, count(*) AS c FROM per_volume
      WHERE dice IS NOT NULL AND NOT isnan(dice::DOUBLE) GROUP BY ALL),
    placed AS (SELECT cls, r, t, c, ({place} + 0.5::DOUBLE) / {1 << 40}::DOUBLE AS u FROM sums, range({BOOT.n_resamples}) rr(r)),
    weighed AS (SELECT *, {' + '.join(above)} AS k FROM placed),
    reps AS (SELECT cls, r, sum(t * k) / sum(c * k) AS mean FROM weighed GROUP BY ALL HAVING sum(c * k) > 0),
    tails AS (SELECT cls, quantile_cont(mean, 0.025::DOUBLE) AS lo, quantile_cont(mean, 0.975::DOUBLE) AS hi FROM reps GROUP BY cls),
    cells AS (SELECT cls, count(*) AS n, sum(t) / sum(c) AS value FROM sums GROUP BY cls),
    est AS (SELECT cls, value, CASE WHEN n = 1 THEN value ELSE lo END AS ci_low, CASE WHEN n = 1 THEN value ELSE hi END AS ci_high, n,
      (SELECT count(*) FROM per_volume p WHERE p.cls = c.cls) AS n_measurements FROM cells c LEFT JOIN tails USING (cls))"""


@query(
    "E2_poisson_bootstrap",
    with_ctes(PER_VOLUME, _poisson_sql()) + f"SELECT cls, {EST_SQL}, n, n_measurements FROM est",
)
def e2_poisson(v):
    out = bootstrap.estimate(v.per_volume, ["cls"], BOOT, value="dice", method="poisson")
    return rounded(out)


@query(
    "E3_element_bootstrap",
    with_ctes(PER_VOLUME, boot_sql("est", "per_volume", "cls", "sample_id", "dice"))
    + f"SELECT cls, {EST_SQL}, n, n_measurements FROM est",
)
def e3(v):
    boot = bootstrap.Boot(seed=BOOT.seed, n_resamples=BOOT.n_resamples)
    return rounded(bootstrap.element_estimate(v.counted_volumes.withColumn("value", F.col("dice")), ["cls"], boot, "sample_id"))


NUMPY_BOOT = bootstrap.Boot(seed=BOOT.seed, method="numpy")


@query("E2_numpy_bootstrap")
def e2_numpy(v):
    """The draws of numpy's generator, which SQL has not; tests hold them against numpy."""
    return rounded(bootstrap.estimate(v.per_volume, ["vendor", "cls"], NUMPY_BOOT, value="dice"))


_DET = """det AS (SELECT vendor, cls, patient_id, predicted_voxels > 1 AS guess, reference_present AS truth, score FROM per_volume
  UNION ALL SELECT 'all_vendors', cls, patient_id, predicted_voxels > 1, reference_present, score FROM per_volume),
det_pos AS (SELECT vendor, cls, patient_id, guess::INT AS value FROM det WHERE truth),
det_neg AS (SELECT vendor, cls, patient_id, (NOT guess)::INT AS value FROM det WHERE NOT truth)"""


def auroc_sql(name: str, source: str, cell: str, score: str, label: str) -> str:
    """CTEs ending in ``{name}``: cell, auroc, positives, negatives."""
    return f"""{name}_ranked AS (
  SELECT {cell}, {label} AS y, rank() OVER (PARTITION BY {cell} ORDER BY {score})
     + (count(*) OVER (PARTITION BY {cell}, {score}) - 1) / 2.0::DOUBLE AS rk FROM {source} WHERE {score} IS NOT NULL),
{name} AS (SELECT {cell}, (sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0::DOUBLE)
     / nullif(count(*) FILTER (y) * count(*) FILTER (NOT y), 0) AS auroc,
     count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives FROM {name}_ranked GROUP BY ALL)"""


@query(
    "E4_detection",
    with_ctes(
        PER_VOLUME, _DET,
        boot_sql("sens", "det_pos", _CELL, "patient_id", "value"),
        boot_sql("spec", "det_neg", _CELL, "patient_id", "value"),
        auroc_sql("area", "det", _CELL, "score", "truth"),
    )
    + """, cells AS (SELECT vendor, cls, count(*) AS volumes, count(*) FILTER (truth) AS positives,
      count(*) FILTER (NOT truth) AS negatives FROM det GROUP BY ALL)
    SELECT c.vendor, c.cls, volumes, c.positives, c.negatives,
      round(s.value, 9) AS sensitivity, round(s.ci_low, 9) AS sensitivity_low, round(s.ci_high, 9) AS sensitivity_high, coalesce(s.n, 0) AS sensitivity_n,
      round(p.value, 9) AS specificity, round(p.ci_low, 9) AS specificity_low, round(p.ci_high, 9) AS specificity_high, coalesce(p.n, 0) AS specificity_n,
      round(a.auroc, 9) AS auroc
    FROM cells c LEFT JOIN sens s ON s.vendor = c.vendor AND s.cls = c.cls LEFT JOIN spec p ON p.vendor = c.vendor AND p.cls = c.cls
    LEFT JOIN area a ON a.vendor = c.vendor AND a.cls = c.cls""",
)
def e4(v):
    rows = detection_rows(v.per_volume, threshold=1)
    out = compare.detection(rows, BOOT)
    doubles = [c for c, t in out.dtypes if t == "double"]
    return rounded(out, doubles)


@query(
    "E5_rate_with_interval",
    with_ctes(
        PER_VOLUME, _DET.replace("reference_present AS truth", "reference_present AND patient_id % 2 = 0 AND cls <> 'R' AS truth"),
        boot_sql("sens", "det_pos", _CELL, "patient_id", "value"),
    )
    + f"""SELECT c.vendor, c.cls, {EST_SQL}, coalesce(n, 0) AS n, coalesce(n_measurements, 0) AS n_measurements
      FROM (SELECT DISTINCT vendor, cls FROM per_volume) c LEFT JOIN sens s ON s.vendor = c.vendor AND s.cls = c.cls""",
)
def e5(v):
    """Class R has no positive here: its empty denominator keeps a row."""
    truth = F.col("reference_present") & (F.col("patient_id") % 2 == 0) & (F.col("cls") != "R")
    rows = detection_rows(v.per_volume, threshold=1).withColumn("reference_present", truth)
    cells = rows.select("vendor", "cls").distinct()
    return rounded(compare.rate(rows, cells, ["vendor", "cls"], BOOT, True))


@query(
    "E6_auroc",
    with_ctes(SCORED, auroc_sql("area", "scored", "cell", "score", "label"))
    + "SELECT cell, round(auroc, 9) AS auroc, positives, negatives FROM area",
)
def e6(v):
    return rounded(roc.auroc(v.scored, ["cell"]), ["auroc"])


@query(
    "E6_auroc_tied_scores",
    with_ctes(PER_VOLUME, auroc_sql("area", "per_volume", "vendor, cls", "predicted_voxels", "reference_present"))
    + "SELECT vendor, cls, round(auroc, 9) AS auroc, positives, negatives FROM area",
)
def e6_ties(v):
    return rounded(roc.auroc(v.per_volume, ["vendor", "cls"], "predicted_voxels", "reference_present"), ["auroc"])


def _roc_boot_sql(stratum: str, idx_partition: str, idx_order: str) -> str:
    part = f"cell, {idx_partition}" if idx_partition else "cell"
    return f"""mem AS (SELECT cell, label, score, {stratum} AS st,
    row_number() OVER (PARTITION BY {part} ORDER BY {idx_order}) - 1 AS idx FROM scored),
  sz AS (SELECT cell, st, count(*) AS g FROM mem GROUP BY ALL),
  dr AS ({draws_sql('sz', 'cell, st', 'st')}),
  pk AS (SELECT d.cell, d.r, m.label, m.score FROM dr d JOIN mem m ON m.cell = d.cell AND m.st = d.st AND m.idx = d.idx),
  rk AS (SELECT cell, r, label, rank() OVER (PARTITION BY cell, r ORDER BY score)
     + (count(*) OVER (PARTITION BY cell, r, score) - 1) / 2.0::DOUBLE AS k FROM pk),
  au AS (SELECT cell, r, count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS n,
     (sum(k) FILTER (label) - count(*) FILTER (label) * (count(*) FILTER (label) + 1) / 2.0::DOUBLE)
       / nullif(count(*) FILTER (label) * count(*) FILTER (NOT label), 0) AS a FROM rk GROUP BY ALL)"""


@query(
    "E7_auroc_interval_stratified",
    with_ctes(SCORED, auroc_sql("area", "scored", "cell", "score", "label"),
              _roc_boot_sql("CASE WHEN label THEN 'pos' ELSE 'neg' END", "label", "score"))
    + """SELECT area.cell, round(auroc, 9) AS auroc, positives, negatives,
      round(CASE WHEN NOT perfect THEN lo END, 9) AS ci_low, round(CASE WHEN NOT perfect THEN hi END, 9) AS ci_high
      FROM area LEFT JOIN (SELECT cell, quantile_cont(a, 0.025::DOUBLE) AS lo, quantile_cont(a, 0.975::DOUBLE) AS hi, bool_and(a = 1.0) AS perfect
        FROM au WHERE p > 0 AND n > 0 GROUP BY cell) t ON t.cell = area.cell""",
)
def e7(v):
    return rounded(roc.stratified_interval(v.scored, ["cell"], CUBE_BOOT), ["auroc", "ci_low", "ci_high"])


@query(
    "E8_auroc_interval_unstratified",
    with_ctes(SCORED, _roc_boot_sql("'joint'", "", "score, label DESC"))
    + """SELECT cell, round(quantile_cont(a, 0.025::DOUBLE) FILTER (p > 0 AND n > 0), 9) AS ci_low,
      round(quantile_cont(a, 0.975::DOUBLE) FILTER (p > 0 AND n > 0), 9) AS ci_high,
      count(*) FILTER (NOT (p > 0 AND n > 0)) AS dropped FROM au GROUP BY cell""",
)
def e8(v):
    return rounded(roc.unstratified_interval(v.scored, ["cell"], CUBE_BOOT), ["ci_low", "ci_high"])


@query(
    "E9_auroc_table",
    with_ctes(SCORED, auroc_sql("area", "scored", "cell", "score", "label"))
    + """SELECT cell, round(auroc, 9) AS auroc, positives, negatives, 0 AS repeated_patients,
      round(auroc + CASE WHEN cell = 'de' THEN 0.125::DOUBLE ELSE 0.0::DOUBLE END, 9) AS stored, cell <> 'de' AS matches FROM area""",
)
def e9(v):
    moved = F.when(F.col("cell") == "de", F.lit(0.125)).otherwise(F.lit(0.0))
    stored = roc.auroc(v.scored, ["cell"]).withColumn("auroc", F.col("auroc") + moved)
    return rounded(roc.auroc_table(v.scored, stored, ["cell"], "case_id"), ["auroc", "stored"])


@query(
    "E10_secondary_hd95",
    HD95_CTES
    + """, hd_rows AS (SELECT m.vendor, hd.cls, hd.sample_id AS patient_id, hd95 AS value FROM hd
      JOIN manifest m ON m.sample_id = hd.sample_id WHERE NOT (p = 0 AND r = 0)),
    both_rows AS (SELECT * FROM hd_rows UNION ALL SELECT 'all_vendors', cls, patient_id, value FROM hd_rows), """
    + boot_sql("est", "both_rows", _CELL, "patient_id", "value")
    + f" SELECT vendor, cls, 'hd95_excluding_both_empty' AS metric, {EST_SQL}, n, n_measurements FROM est",
)
def e10(v):
    counts = counts_on_grid(v).select("sample_id", "cls", "predicted_voxels", "reference_voxels")
    rows = hd95_rows(v).join(counts, ["sample_id", "cls"]).filter(
        "NOT (predicted_voxels = 0 AND reference_voxels = 0)"
    )
    vendors = v.manifest.select("sample_id", "vendor")
    rows = rows.join(vendors, "sample_id").select(
        "vendor", "cls", F.lit("hd95_excluding_both_empty").alias("metric"),
        F.col("sample_id").alias("patient_id"), F.col("hd95").alias("value"),
    )
    return rounded(bootstrap.by_vendor(rows, BOOT))


_ARM_EST = boot_sql("est", "arms", "run, arm, cls", "patient_id", "dice")


def arm_estimates(v):
    """Per fold, arm and class; a patient's volumes are summed before the patient goes to its folds."""
    sums = bootstrap.member_sums(v.per_volume, ["cls"], "patient_id", "dice", v.arm_patients, ["run", "arm"])
    return bootstrap.estimate_sums(sums, ["run", "arm", "cls"], CUBE_BOOT)


@query(
    "E11_generalisation_gap",
    with_ctes(ARMS, _ARM_EST)
    + """SELECT a.run, a.cls, round(a.value, 9) AS in_value, round(a.ci_low, 9) AS in_ci_low, round(a.ci_high, 9) AS in_ci_high, a.n AS in_n,
      round(b.value, 9) AS out_value, round(b.ci_low, 9) AS out_ci_low, round(b.ci_high, 9) AS out_ci_high, b.n AS out_n,
      round(a.value - b.value, 9) AS gap, a.ci_low <= b.ci_high AND b.ci_low <= a.ci_high AS intervals_overlap
      FROM est a JOIN est b ON a.run = b.run AND a.cls = b.cls WHERE a.arm = 'in_domain_ref' AND b.arm = 'test'""",
)
def e11(v):
    est = cut_lineage(arm_estimates(v))
    held, ref = (est.filter(F.col("arm") == a) for a in (compare.HELD, compare.REF))
    out = compare.generalisation_gap(ref, held, ["run", "cls"])
    return rounded(out, [c for c, t in out.dtypes if t == "double"])


@query(
    "E12_interval_predicates",
    """SELECT a.p_partkey AS k, a.p_retailprice <= b.p_retailprice + b.p_size AND b.p_retailprice <= a.p_retailprice + a.p_size AS meet,
       a.p_size - 25 > 0 OR a.p_size - 5 < 0 AS apart_from_zero
       FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""",
)
def e12(v):
    a = v.table("part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("lo"), F.col("p_size").alias("w"))
    b = a.select((F.col("k") - 1).alias("k"), F.col("lo").alias("lo_b"), F.col("w").alias("w_b"))
    j = a.join(b, "k")
    return j.select(
        "k",
        compare.overlaps(F.col("lo"), F.col("lo") + F.col("w"), F.col("lo_b"), F.col("lo_b") + F.col("w_b")).alias("meet"),
        compare.excludes_zero(F.col("w") - 25, F.col("w") - 5).alias("apart_from_zero"),
    )


@query(
    "E13_patient_as_unit",
    with_ctes(ARMS) + "SELECT arm, cls, patient_id, round(avg(dice), 9) AS value FROM arms GROUP BY ALL",
)
def e13(v):
    return rounded(compare.per_patient(v.arms, ["arm", "cls"]), ["value"])


def joint_sql(name: str, held: str, ref: str, cell: str) -> str:
    cs = [c.strip() for c in cell.split(",")]
    on = " AND ".join(f"a.{c} = b.{c}" for c in cs)
    using = ", ".join(cs)
    return f"""{name}_m AS (SELECT {using}, patient_id, h.value AS held, f.value AS ref,
    CASE WHEN f.value IS NULL THEN 'held_only' WHEN h.value IS NULL THEN 'ref_only' ELSE 'both' END AS st
    FROM {held} h FULL JOIN {ref} f USING ({using}, patient_id)),
  {name}_i AS (SELECT *, row_number() OVER (PARTITION BY {using}, st ORDER BY substr(md5(patient_id::VARCHAR), 1, 3), patient_id) - 1 AS idx FROM {name}_m),
  {name}_z AS (SELECT {using}, st, count(*) AS g FROM {name}_m GROUP BY ALL),
  {name}_d AS ({draws_sql(f"{name}_z", f"{using}, st", "st")}),
  {name}_r AS (SELECT {', '.join('a.' + c for c in cs)}, r, coalesce(sum(held), 0) AS h, coalesce(sum(ref), 0) AS f FROM {name}_d a JOIN {name}_i b ON {on} AND a.st = b.st AND a.idx = b.idx GROUP BY ALL),
  {name}_t AS (SELECT {using}, count(held) AS n_held, count(ref) AS n_ref, avg(held) - avg(ref) AS difference FROM {name}_m GROUP BY ALL),
  {name} AS (SELECT {', '.join('b.' + c for c in cs)}, difference, n_held, n_ref,
    quantile_cont(h / n_held - f / n_ref, 0.025::DOUBLE) AS ci_low, quantile_cont(h / n_held - f / n_ref, 0.975::DOUBLE) AS ci_high
    FROM {name}_t b JOIN {name}_r a ON {on} GROUP BY ALL)"""


_POOL = """held AS (SELECT cls, patient_id, avg(dice) AS value FROM arms WHERE arm = 'test' GROUP BY ALL),
ref AS (SELECT cls, patient_id, avg(dice) AS value FROM arms WHERE arm = 'in_domain_ref' GROUP BY ALL)"""
_DIFF = "round(difference, 9) AS difference, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high"


def pooled_arms(v):
    rows = cut_lineage(compare.per_patient(v.arms, ["arm", "cls"]))
    return tuple(rows.filter(F.col("arm") == a).drop("arm") for a in (compare.HELD, compare.REF))


@query(
    "E14_joint_difference",
    with_ctes(ARMS, _POOL, joint_sql("j", "held", "ref", "cls")) + f"SELECT cls, {_DIFF}, n_held, n_ref FROM j",
)
def e14(v):
    out = bootstrap.joint_difference(*pooled_arms(v), ["cls"], CUBE_BOOT)
    return rounded(out, ["difference", "ci_low", "ci_high"])


@query("E14_numpy_difference")
def e14_numpy(v):
    out = bootstrap.joint_difference(*pooled_arms(v), ["cls"], NUMPY_BOOT)
    return rounded(out, ["difference", "ci_low", "ci_high"])


@query(
    "E15_independent_difference",
    with_ctes(
        ARMS, _POOL,
        boot_sql("h", "held", "cls", "patient_id", "value", stratum="'held'"),
        boot_sql("f", "ref", "cls", "patient_id", "value", stratum="'ref'"),
    )
    + """SELECT a.cls, round(any_value(h.value - f.value), 9) AS difference, round(quantile_cont(a.mean - b.mean, 0.025::DOUBLE), 9) AS ci_low,
      round(quantile_cont(a.mean - b.mean, 0.975::DOUBLE), 9) AS ci_high FROM h_reps a JOIN f_reps b ON a.cls = b.cls AND a.r = b.r
      JOIN h ON h.cls = a.cls JOIN f ON f.cls = a.cls GROUP BY a.cls""",
)
def e15(v):
    out = bootstrap.independent_difference(*pooled_arms(v), ["cls"], CUBE_BOOT)
    return rounded(out, ["difference", "ci_low", "ci_high"])


_CUBE_CELL = "view, comparison, cls"
_CUBE = with_ctes(
    ARMS,
    """both_arms AS (SELECT cls, arm, patient_id, dice, reference_present, unnest([run, 'pooled']) AS comparison FROM arms WHERE arm <> 'val'),
    viewed AS (SELECT *, 'all-volume' AS view FROM both_arms UNION ALL SELECT *, 'class-present' FROM both_arms WHERE reference_present),
    unit AS (SELECT view, comparison, cls, arm, patient_id, avg(dice) AS value FROM viewed GROUP BY ALL),
    held AS (SELECT view, comparison, cls, patient_id, value FROM unit WHERE arm = 'test'),
    ref AS (SELECT view, comparison, cls, patient_id, value FROM unit WHERE arm = 'in_domain_ref')""",
    boot_sql("est", "unit", _CUBE_CELL + ", arm", "patient_id", "value"),
    joint_sql("j", "held", "ref", _CUBE_CELL),
    """cube AS (SELECT j.view, j.comparison, j.cls, h.value AS held_value, h.ci_low AS held_ci_low, h.ci_high AS held_ci_high, h.n AS held_n,
      f.value AS ref_value, f.ci_low AS ref_ci_low, f.ci_high AS ref_ci_high, f.n AS ref_n, difference, j.ci_low AS diff_low, j.ci_high AS diff_high
      FROM j JOIN est h ON h.view = j.view AND h.comparison = j.comparison AND h.cls = j.cls AND h.arm = 'test'
      JOIN est f ON f.view = j.view AND f.comparison = j.comparison AND f.cls = j.cls AND f.arm = 'in_domain_ref')""",
)


@query(
    "E16_comparison_cube",
    _CUBE
    + "SELECT view, comparison, cls, held_n, ref_n, "
    + ", ".join(
        f"round({c}, 9) AS {c}"
        for c in "held_value held_ci_low held_ci_high ref_value ref_ci_low ref_ci_high difference diff_low diff_high".split()
    )
    + " FROM cube",
)
def e16(v):
    cube = compare.comparison_cube(v.arms, CUBE_BOOT)
    return rounded(cube, [c for c, t in cube.dtypes if t == "double"])


@query(
    "E17_half_widths",
    _CUBE
    + """SELECT view, comparison = 'pooled' AS pooled, round(min((diff_high - diff_low) / 2), 9) AS smallest,
      round(max((diff_high - diff_low) / 2), 9) AS largest, count(*) AS cells FROM cube GROUP BY ALL""",
)
def e17(v):
    return rounded(compare.half_widths(compare.comparison_cube(v.arms, CUBE_BOOT)), ["smallest", "largest"])


@query(
    "E17_detectable_difference",
    _CUBE
    + """SELECT round(min((diff_high - diff_low) / 2), 9) AS detectable FROM cube WHERE view = 'all-volume'""",
)
def e17_limit(v):
    limit = compare.detection_limit(compare.half_widths(compare.comparison_cube(v.arms, CUBE_BOOT)))
    return limit.select(F.round("limit", 9).alias("detectable"))


@query(
    "E27_comparison_counts",
    _CUBE
    + """SELECT view, comparison = 'pooled' AS pooled, count(*) AS comparisons,
      count(*) FILTER (held_ci_low <= ref_ci_high AND ref_ci_low <= held_ci_high) AS overlapping,
      count(*) FILTER (difference < 0) AS worse, count(*) FILTER (difference >= 0) AS better,
      count(*) FILTER (diff_low > 0 OR diff_high < 0) AS excluding_zero,
      count(*) FILTER ((diff_low > 0 OR diff_high < 0) AND difference < 0) AS excluding_zero_lower FROM cube GROUP BY ALL""",
)
def e27(v):
    return compare.counts_of_cube(compare.comparison_cube(v.arms, CUBE_BOOT))
