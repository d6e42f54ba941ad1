"""Thresholds, and the counts and extremes a report states."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortscale.catalog.base import CLASSES, query
from cohortscale.catalog.estimates import CUBE_BOOT, _ARM_EST, _CELL, _DET, arm_estimates, rounded
from cohortscale.catalog.sql import ARMS, MANIFEST, PER_VOLUME, boot_sql, with_ctes
from cohortscale.functions import text
from cohortscale.operators import bootstrap, compare, summaries, threshold
from cohortscale.operators.rows import detection_rows
from cohortscale.session import cut_lineage

GRID = (0, 1, 2, 3, 4, 5)
FIXED = 1
_GRID_ROWS = ", ".join(f"({t})" for t in GRID)


def _select_sql(source: str, cell: str) -> str:
    """CTEs ending in ``sel``: cell, threshold, j, ties, positives, negatives, degenerate."""
    using = cell
    return f"""yc AS (SELECT {cell}, t, count(*) FILTER (reference_present) AS p, count(*) FILTER (NOT reference_present) AS n,
    count(*) FILTER (reference_present AND predicted_voxels > t) AS tp, count(*) FILTER (NOT reference_present AND predicted_voxels <= t) AS tn
    FROM {source}, (VALUES {_GRID_ROWS}) g(t) GROUP BY ALL),
  yj AS (SELECT *, tp * n + tn * p - p * n AS j FROM yc),
  yb AS (SELECT *, max(j) OVER (PARTITION BY {cell}) AS best FROM yj),
  sel AS (SELECT {using}, CASE WHEN p = 0 OR n = 0 THEN {FIXED} ELSE min(t) END AS threshold,
    CASE WHEN p > 0 AND n > 0 THEN best::DOUBLE / (p * n) END AS j, CASE WHEN p = 0 OR n = 0 THEN 0 ELSE count(*) END AS ties,
    p AS positives, n AS negatives, CASE WHEN n = 0 THEN 'no negative' WHEN p = 0 THEN 'no positive' END AS degenerate
    FROM yb WHERE j = best GROUP BY {cell}, p, n, best)"""


_EDGE = """edge AS (SELECT *, CASE WHEN cls = 'R' AND run = 'BUILDING' THEN false WHEN cls = 'A' AND run = 'FURNITURE' THEN true
  ELSE rp END AS reference_present FROM (SELECT run, cls, predicted_voxels, reference_present AS rp FROM arms WHERE arm = 'val'))"""


@query(
    "E18_threshold_selection",
    with_ctes(ARMS, _EDGE, _select_sql("edge", "run, cls"))
    + "SELECT run, cls, threshold, round(j, 9) AS j, ties, positives, negatives, degenerate FROM sel",
)
def e18(v):
    """Two cells are made single-class, so that the fixed threshold shows."""
    present = (
        F.when((F.col("cls") == "R") & (F.col("run") == "BUILDING"), F.lit(False))
        .when((F.col("cls") == "A") & (F.col("run") == "FURNITURE"), F.lit(True))
        .otherwise(F.col("reference_present"))
    )
    rows = v.arms.filter("arm = 'val'").withColumn("reference_present", present)
    return rounded(threshold.select_threshold(rows, ["run", "cls"], FIXED, GRID), ["j"])


_VAL = "val_rows AS (SELECT * FROM arms WHERE arm = 'val')"
_SPEC = """spec_rows AS (SELECT a.run, a.cls, a.arm, a.patient_id, (a.predicted_voxels <= s.threshold)::INT AS value
  FROM arms a JOIN sel s ON s.run = a.run AND s.cls = a.cls WHERE a.arm <> 'val' AND NOT a.reference_present),
fixed_rows AS (SELECT run, cls, arm, patient_id, (predicted_voxels <= 1)::INT AS value FROM arms WHERE arm <> 'val' AND NOT reference_present)"""
_RCA = "run, cls, arm"


def threshold_arms(v):
    """What thresholds ask of ``v.arms``. A volume is stored once, before it goes to the folds of its patient."""
    rows = cut_lineage(v.per_volume.select("patient_id", "cls", "predicted_voxels", "reference_present"))
    return rows.join(cut_lineage(v.arm_patients), "patient_id")


@query(
    "E19_specificity_at_threshold",
    with_ctes(ARMS, _VAL, _select_sql("val_rows", "run, cls"), _SPEC, boot_sql("est", "spec_rows", _RCA, "patient_id", "value"))
    + """SELECT run, cls, arm, round(value, 9) AS value, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, n, n_measurements FROM est""",
)
def e19(v):
    arms = threshold_arms(v)
    selected = threshold.select_threshold(arms.filter("arm = 'val'"), ["run", "cls"], FIXED, GRID)
    out = threshold.specificity_at(arms.filter("arm <> 'val'"), selected, ["run", "cls", "arm"], ["run", "cls"], CUBE_BOOT)
    return rounded(out)


@query(
    "E20_selection_report",
    with_ctes(
        ARMS, _VAL, _select_sql("val_rows", "run, cls"), _SPEC,
        boot_sql("est", "spec_rows", _RCA, "patient_id", "value"),
        boot_sql("fix", "fixed_rows", _RCA, "patient_id", "value"),
    )
    + """SELECT e.run, e.cls, e.arm, round(f.value, 9) AS fixed_value, round(f.ci_low, 9) AS fixed_ci_low, round(f.ci_high, 9) AS fixed_ci_high, f.n AS fixed_n,
      round(e.value, 9) AS selected_value, round(e.ci_low, 9) AS selected_ci_low, round(e.ci_high, 9) AS selected_ci_high, e.n AS selected_n,
      threshold, round(j, 9) AS j, ties, positives, negatives, degenerate
      FROM est e JOIN fix f ON f.run = e.run AND f.cls = e.cls AND f.arm = e.arm JOIN sel s ON s.run = e.run AND s.cls = e.cls""",
)
def e20(v):
    arms = threshold_arms(v)
    out = threshold.selection_report(arms.filter("arm = 'val'"), arms.filter("arm <> 'val'"), FIXED, GRID, CUBE_BOOT)
    return rounded(out, [c for c, t in out.dtypes if t == "double"])


@query(
    "E20_stored_findings",
    with_ctes(ARMS)
    + """, rec AS (SELECT run, cls, round(avg(dice), 9) AS value, count(*) AS n FROM arms GROUP BY ALL),
    sto AS (SELECT run, cls, CASE WHEN run = 'BUILDING' THEN value + 1 ELSE value END AS value, CASE WHEN cls = 'N' THEN n + 1 ELSE n END AS n FROM rec)
    SELECT r.run, r.cls, r.value, r.n, s.value AS stored_value, s.n AS stored_n FROM rec r JOIN sto s ON r.run = s.run AND r.cls = s.cls
    WHERE r.run = 'BUILDING' OR r.cls = 'N'""",
)
def e20_findings(v):
    rec = v.arms.groupBy("run", "cls").agg(F.round(F.avg("dice"), 9).alias("value"), F.count("*").alias("n"))
    stored = rec.withColumn("value", F.when(F.col("run") == "BUILDING", F.col("value") + 1).otherwise(F.col("value"))).withColumn(
        "n", F.when(F.col("cls") == "N", F.col("n") + 1).otherwise(F.col("n"))
    )
    return threshold.stored_findings(rec, stored, ["run", "cls"])


_PCT = "(200 * {k} + {n}) // (2 * {n})"


@query(
    "E21_absent_counts",
    with_ctes(ARMS)
    + """, f AS (SELECT arm, cls, patient_id, arg_min(reference_present, (run, sample_id)) AS present FROM arms GROUP BY ALL),
    g AS (SELECT arm, cls, count(*) FILTER (NOT present) AS absent, count(*) AS patients FROM f GROUP BY ALL)
    SELECT *, (200 * absent + patients) // (2 * patients) AS percent FROM g""",
)
def e21(v):
    return summaries.absent_counts(v.arms)


@query(
    "E22_absent_shares",
    with_ctes(ARMS)
    + """, g AS (SELECT run, arm, cls, count(*) FILTER (NOT reference_present) AS absent, count(*) AS volumes FROM arms GROUP BY ALL)
    SELECT *, (200 * absent + volumes) // (2 * volumes) AS percent FROM g""",
)
def e22(v):
    return summaries.absent_shares(v.arms)


@query(
    "E23_absent_split",
    with_ctes(ARMS)
    + """, g AS (SELECT run, arm, cls, count(*) FILTER (NOT reference_present AND dice = 0) AS zero,
      count(*) FILTER (NOT reference_present AND dice = 1) AS one FROM arms GROUP BY ALL)
    SELECT *, zero > 0 AND one = 0 AS all_zero FROM g""",
)
def e23(v):
    return summaries.absent_split(v.arms)


@query(
    "E24_present_beats_all",
    with_ctes(ARMS)
    + """, g AS (SELECT run, arm, cls, avg(dice) FILTER (reference_present) AS pm, avg(dice) AS m FROM arms GROUP BY ALL)
    SELECT run, arm, cls, round(pm, 9) AS present_mean, round(m, 9) AS mean, pm > m AS beats FROM g WHERE pm IS NOT NULL""",
)
def e24(v):
    return rounded(summaries.present_beats_all(v.arms), ["present_mean", "mean"])


@query(
    "E25_absent_share_of_mean",
    with_ctes(ARMS)
    + """SELECT run, arm, cls, round(sum(CASE WHEN NOT reference_present THEN dice ELSE 0 END) / nullif(sum(dice), 0), 9) AS absent_share
      FROM arms GROUP BY ALL""",
)
def e25(v):
    return rounded(summaries.absent_share_of_mean(v.arms), ["absent_share"])


@query(
    "E26_lowest_fold",
    with_ctes(ARMS, _ARM_EST)
    + """SELECT cls, arg_min(run, (value, run)) AS run, round(min(value), 9) AS value FROM est WHERE arm = 'test' GROUP BY cls""",
)
def e26(v):
    return rounded(summaries.lowest_fold(arm_estimates(v)), ["value"])


@query(
    "E26_widest_interval",
    with_ctes(ARMS, _ARM_EST)
    + """SELECT arg_max(run, ci_high - ci_low) AS run, arg_max(cls, ci_high - ci_low) AS cls, round(max(ci_high - ci_low), 9) AS width,
      round(min(ci_high - ci_low), 9) AS narrowest FROM est WHERE arm = 'in_domain_ref'""",
)
def e26_widest(v):
    return rounded(summaries.widest_interval(arm_estimates(v)), ["width", "narrowest"])


_SETS = """a AS (SELECT run, cls, avg(dice) AS value, count(*) AS n FROM arms WHERE arm = 'test' GROUP BY ALL),
b AS (SELECT run, cls, avg(CASE WHEN predicted_voxels = 1 THEN 0 ELSE dice END) AS value FROM arms WHERE arm = 'test' GROUP BY ALL)"""


def two_sets(v):
    rows = v.arms.filter("arm = 'test'")
    first = rows.groupBy("run", "cls").agg(F.avg("dice").alias("value"), F.count("*").alias("n"))
    second = rows.groupBy("run", "cls").agg(
        F.avg(F.when(F.col("predicted_voxels") == 1, F.lit(0.0)).otherwise(F.col("dice"))).alias("value")
    )
    return first, second


@query(
    "E26_largest_movement",
    with_ctes(ARMS, _SETS)
    + """SELECT round(max(abs(a.value - b.value)), 9) AS moved, arg_max(a.run, abs(a.value - b.value)) AS run,
      arg_max(a.cls, abs(a.value - b.value)) AS cls FROM a JOIN b ON a.run = b.run AND a.cls = b.cls""",
)
def e26_movement(v):
    return rounded(summaries.largest_movement(*two_sets(v), ["run", "cls"]), ["moved"])


@query(
    "E27_zero_specificity",
    with_ctes(PER_VOLUME)
    + """, s AS (SELECT vendor, cls, (count(*) FILTER (NOT reference_present AND predicted_voxels <= 0))::DOUBLE
        / nullif(count(*) FILTER (NOT reference_present), 0) AS specificity
      FROM (SELECT * REPLACE (CASE WHEN cls = 'A' THEN 1 ELSE predicted_voxels END AS predicted_voxels) FROM per_volume) GROUP BY ALL)
    SELECT count(*) FILTER (specificity = 0) AS zero, count(specificity) AS cells FROM s""",
)
def e27_zero(v):
    rows = v.per_volume.withColumn(
        "predicted_voxels", F.when(F.col("cls") == "A", F.lit(1)).otherwise(F.col("predicted_voxels"))
    )
    absent = ~F.col("reference_present")
    spec = rows.groupBy("vendor", "cls").agg(
        F.try_divide(F.count_if(absent & (F.col("predicted_voxels") <= 0)).cast("double"), F.count_if(absent)).alias("specificity")
    )
    return summaries.zero_specificity(spec)


@query(
    "E28_draw_fragility",
    with_ctes(ARMS, _SETS)
    + """SELECT a.run, a.cls, round(a.value, 9) AS first, round(b.value, 9) AS second, round(b.value - a.value, 9) AS shift,
      round(1.0::DOUBLE / n, 9) AS one_subject, abs(b.value - a.value) >= 1.0::DOUBLE / n AS at_least_one_subject
      FROM a JOIN b ON a.run = b.run AND a.cls = b.cls""",
)
def e28(v):
    out = summaries.draw_fragility(*two_sets(v), ["run", "cls"])
    return rounded(out, ["first", "second", "shift", "one_subject"])


def _range_sql(i: int) -> str:
    lo, hi = f"printf('%.6f', min(spacing_mm[{i}]))", f"printf('%.6f', max(spacing_mm[{i}]))"
    return f"CASE WHEN {lo} = {hi} THEN {lo} || ' (constant)' ELSE {lo} || ' to ' || {hi} END"


@query(
    "E29_dataset_table",
    with_ctes(MANIFEST, PER_VOLUME)
    + f"""SELECT m.vendor, count(DISTINCT m.patient_id) AS patients, '16 x 16' AS slice_size,
      {_range_sql(1)} AS axial_mm, {_range_sql(2)} AS lateral_mm, {_range_sql(3)} AS separation_mm,
      any_value(a) AS "samples_with_A", any_value(n) AS "samples_with_N", any_value(r) AS "samples_with_R"
      FROM manifest m JOIN (SELECT vendor, count(*) FILTER (cls = 'A' AND reference_present) AS a, count(*) FILTER (cls = 'N' AND reference_present) AS n,
        count(*) FILTER (cls = 'R' AND reference_present) AS r FROM per_volume GROUP BY vendor) p ON p.vendor = m.vendor GROUP BY m.vendor""",
)
def e29(v):
    return summaries.dataset_table(v.manifest, v.per_volume, CLASSES)


@query(
    "E30_geometries",
    """SELECT c_mktsegment AS vendor, [n::INTEGER, 16, 16] AS shape, count(*) AS samples FROM customer JOIN (
       SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY ALL""",
)
def e30(v):
    slices = v.table("orders").groupBy(F.col("o_custkey").alias("sample_id")).agg(F.count("*").cast("int").alias("n"))
    shapes = v.manifest.select("sample_id", "vendor").join(slices, "sample_id")
    return summaries.geometries(shapes.withColumn("shape", F.array("n", F.lit(16), F.lit(16))))


@query(
    "T1_formatted_estimates",
    with_ctes(ARMS)
    + """, e AS (SELECT run, cls, arm, round(avg(dice), 6) AS value, round(min(dice), 6) AS lo, round(max(dice), 6) AS hi, count(*) AS n,
      CASE WHEN cls = 'A' THEN 1 ELSE count(*) END AS k FROM arms GROUP BY run, cls, arm)
    SELECT run, cls, arm, CASE WHEN k = 1 THEN printf('%.4f', value) || ' (single patient, no spread) n=1'
      ELSE printf('%.4f [%.4f, %.4f] n=', value, lo, hi) || k END AS estimate,
      printf('%+.4f [%+.4f, %+.4f]', value - 0.5::DOUBLE, lo - 0.5::DOUBLE, hi - 0.5::DOUBLE) AS difference,
      replace(printf('%+.4f', value - 1), '-', '−') AS prose, '**' || printf('%.4f', value) || '**' AS bold,
      CASE n % 21 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' WHEN 4 THEN 'four' WHEN 5 THEN 'five'
        WHEN 6 THEN 'six' WHEN 7 THEN 'seven' WHEN 8 THEN 'eight' WHEN 9 THEN 'nine' WHEN 10 THEN 'ten' WHEN 11 THEN 'eleven'
        WHEN 12 THEN 'twelve' WHEN 13 THEN 'thirteen' WHEN 14 THEN 'fourteen' WHEN 15 THEN 'fifteen' WHEN 16 THEN 'sixteen'
        WHEN 17 THEN 'seventeen' WHEN 18 THEN 'eighteen' ELSE (n % 21)::VARCHAR END AS word,
      printf('%.2f–%.2f', lo, hi) AS span FROM e""",
)
def t1(v):
    e = v.arms.groupBy("run", "cls", "arm").agg(
        F.round(F.avg("dice"), 6).alias("value"), F.round(F.min("dice"), 6).alias("lo"),
        F.round(F.max("dice"), 6).alias("hi"), F.count("*").alias("n"),
    )
    val, lo, hi, n = (F.col(c) for c in ("value", "lo", "hi", "n"))
    k = F.when(F.col("cls") == "A", F.lit(1)).otherwise(n)
    return e.select(
        "run", "cls", "arm",
        text.estimate_text(val, lo, hi, k).alias("estimate"),
        text.difference_text(val - 0.5, lo - 0.5, hi - 0.5).alias("difference"),
        text.minus_sign(text.signed(val - 1)).alias("prose"),
        text.bold(text.four(val)).alias("bold"),
        text.number_word(n % 21).alias("word"),
        text.span(lo, hi).alias("span"),
    )


@query(
    "T2_listing_and_spaces",
    """SELECT c_nationkey, CASE len(l) WHEN 0 THEN 'none' WHEN 1 THEN l[1] ELSE array_to_string(l[1:len(l)-1], ', ') || ' and ' || l[len(l)] END AS names
       FROM (SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment) FILTER (c_acctbal < 0)) AS l0, coalesce(l0, []) AS l FROM customer GROUP BY 1)""",
)
def t2(v):
    names = F.array_sort(F.collect_set(F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment"))))
    return v.table("customer").groupBy("c_nationkey").agg(text.listing(names).alias("names"))


@query(
    "T5_page_cells",
    with_ctes(PER_VOLUME)
    + """SELECT vendor, cls, count(*) || ' scans, ' || min(predicted_voxels) || ' to ' || max(predicted_voxels) || ' voxels, '
      || min(reference_voxels) || ' to ' || max(reference_voxels) AS cell FROM per_volume GROUP BY vendor, cls""",
)
def t5(v):
    """Cells as a report writes them, with bold counts, and dashes with and without blanks, as a page shows them."""
    n, low, high = (F.col(c).cast("string") for c in ("n", "low", "high"))
    r_low, r_high = (F.col(c).cast("string") for c in ("r_low", "r_high"))
    cell = F.concat(
        F.lit("**"), n, F.lit("** vols, "), low, F.lit("\u2013"), high, F.lit(" voxels, **"), r_low, F.lit(" \u2013 "), r_high, F.lit("**")
    )
    counts = v.per_volume.groupBy("vendor", "cls").agg(
        F.count("*").alias("n"), F.min("predicted_voxels").alias("low"), F.max("predicted_voxels").alias("high"),
        F.min("reference_voxels").alias("r_low"), F.max("reference_voxels").alias("r_high"),
    )
    return counts.select("vendor", "cls", text.page_cell(cell).alias("cell"))


@query(
    "T3_times",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS utc, ts AS back,
       (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 1000000 AS seconds FROM events""",
)
def t3(v):
    """Times as ISO text and back, and seconds since a user's first."""
    events = v.table("events").select("event_id", "user_id", text.iso_text(F.col("ts")).alias("utc"))
    back = events.withColumn("back", text.from_iso(F.col("utc")))
    first = back.groupBy("user_id").agg(F.min("back").alias("first"))
    return back.join(first, "user_id").select("event_id", "utc", "back", text.elapsed_seconds(F.col("first"), F.col("back")).alias("seconds"))


@query(
    "T4_sorted_json",
    """SELECT o_orderkey, '{"cust":"' || o_custkey || '","order":"' || o_orderkey || '"}' AS doc,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey::VARCHAR END AS found FROM orders""",
)
def t4(v):
    """A map as JSON with sorted keys, and a nested field that is not always there."""
    order, cust = (F.col(c).cast("string") for c in ("o_orderkey", "o_custkey"))
    flat = F.create_map(F.lit("order"), order, F.lit("cust"), cust)
    outer = F.when(F.col("o_orderkey") % 3 == 0, F.lit("other")).otherwise(F.lit("run"))
    nested = F.create_map(outer, F.create_map(F.lit("id"), cust))
    return v.table("orders").select("o_orderkey", text.sorted_json(flat).alias("doc"), text.nested_get(nested, "run", "id").alias("found"))
