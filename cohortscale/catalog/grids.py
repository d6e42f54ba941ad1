"""Voxel, grid and pass operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortscale.catalog.base import CLASSES, query
from cohortscale.catalog.sql import CASE_VOXELS, LATTICE, MANIFEST, PER_VOLUME, SAMPLES, with_ctes
from cohortscale.operators import distance, masks, passes, regrid
from cohortscale.session import width

KEYS = ["sample_id", "cls"]
TARGET_MM = 0.0030
PADDED = (40, 24)
GRID_SQL = """grid AS (SELECT c_custkey AS sample_id, g.cls FROM customer CROSS JOIN (VALUES ('A'), ('N'), ('R')) g(cls))"""
COUNTS_SQL = """counts AS (SELECT g.sample_id, g.cls, count(*) FILTER (predicted) AS p, count(*) FILTER (reference) AS r,
  count(*) FILTER (predicted AND reference) AS b
  FROM grid g LEFT JOIN paired v ON v.sample_id = g.sample_id AND v.cls = g.cls GROUP BY ALL)"""
HEIGHTS_SQL = f"""heights AS (SELECT sample_id, 16 AS h,
  CASE WHEN abs(spacing_mm[1] / {TARGET_MM}::DOUBLE - 1.0::DOUBLE) <= 1.001e-5::DOUBLE THEN 16
  ELSE greatest(1, round_even(16 * (spacing_mm[1] / {TARGET_MM}::DOUBLE), 0)::INTEGER) END AS h2 FROM manifest)"""


def volume_grid(v):
    return masks.class_grid(v.manifest.select("sample_id"), CLASSES)


def heights(v):
    h = F.col("shape")[1]
    return v.manifest.select(
        "sample_id", h.alias("h"), regrid.resampled_height(h, F.col("spacing_mm")[0], TARGET_MM).alias("h2")
    )


def counts_on_grid(v):
    return masks.on_grid(masks.overlap_counts(v.lattice_paired, KEYS), volume_grid(v), KEYS)


@query(
    "D1_intensity_window",
    """SELECT o_custkey AS sample_id, round(quantile_cont(l_extendedprice, 0.01::DOUBLE), 6) AS low,
       round(quantile_cont(l_extendedprice, 0.99::DOUBLE), 6) AS high
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def d1(v):
    pixels = v.lattice_lines.select("sample_id", F.col("price").alias("value"))
    w = regrid.intensity_window(pixels, ["sample_id"])
    return w.select("sample_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(
    "D1_intensity_window_ranked",
    """SELECT l_returnflag AS sample_id, round(quantile_cont(l_extendedprice, 0.01::DOUBLE), 6) AS low,
       round(quantile_cont(l_extendedprice, 0.99::DOUBLE), 6) AS high FROM lineitem GROUP BY 1""",
)
def d1_ranked(v):
    """Three volumes hold everything: each is spread over tasks."""
    pixels = v.table("lineitem").select(F.col("l_returnflag").alias("sample_id"), F.col("l_extendedprice").alias("value"))
    w = regrid.ranked_intensity_window(pixels, ["sample_id"])
    return w.select("sample_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(
    "D1_intensity_window_sketched",
    "SELECT l_returnflag AS sample_id, count(*) AS pixels, true AS low_within, true AS high_within FROM lineitem GROUP BY 1",
)
def d1_sketched(v):
    """Sketched windows, held against the ranks their ends have: within a thousandth of the pixels."""
    pixels = v.table("lineitem").select(F.col("l_returnflag").alias("sample_id"), F.col("l_extendedprice").alias("value"))
    w = regrid.sketched_intensity_window(pixels, ["sample_id"])
    at = pixels.join(w, "sample_id").groupBy("sample_id", "pixels").agg(
        *[F.count_if(F.col("value") < F.col(c)).alias(f"{c}_from") for c in ("low", "high")],
        *[F.count_if(F.col("value") <= F.col(c)).alias(f"{c}_to") for c in ("low", "high")],
    )
    room = F.lit(0.001) * F.col("pixels") + 1

    def within(c, q):
        return ((F.col(f"{c}_from") - room <= F.lit(q) * F.col("pixels")) & (F.lit(q) * F.col("pixels") <= F.col(f"{c}_to") + room)).alias(f"{c}_within")

    return at.select("sample_id", "pixels", within("low", 0.01), within("high", 0.99))


@query(
    "D2_apply_window",
    with_ctes(LATTICE)
    + """, w AS (SELECT sample_id, quantile_cont(price, 0.01::DOUBLE) AS low, quantile_cont(price, 0.99::DOUBLE) AS high
      FROM lattice_lines GROUP BY 1)
    SELECT l.sample_id, cls, z, y, x, price AS value,
      round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (price - low) / (high - low))), 9) AS scaled
    FROM lattice_lines l JOIN w ON w.sample_id = l.sample_id WHERE high > low""",
)
def d2(v):
    pixels = v.lattice_lines.select("sample_id", "cls", "z", "y", "x", F.col("price").alias("value"))
    usable = regrid.intensity_window(pixels, ["sample_id"]).filter("high > low")
    out = regrid.apply_window(pixels, usable, ["sample_id"])
    return out.withColumn("scaled", F.round("scaled", 9)).drop("low", "high")


@query("D3_resampled_height", with_ctes(MANIFEST, HEIGHTS_SQL) + "SELECT sample_id, h, h2 FROM heights")
def d3(v):
    return heights(v)


@query(
    "D4_forward_labels",
    with_ctes(LATTICE, MANIFEST, HEIGHTS_SQL)
    + """SELECT p.sample_id, cls, z, i AS y, x FROM heights t, LATERAL (SELECT unnest(range(h2))::INTEGER AS i) q,
      pred p WHERE p.sample_id = t.sample_id AND p.y = (i * h) // h2""",
)
def d4(v):
    return regrid.forward_labels(v.lattice("pred"), heights(v))


@query(
    "D5_forward_intensities",
    with_ctes(LATTICE, MANIFEST, HEIGHTS_SQL)
    + """, px AS (SELECT sample_id, z, y, x, max(price) AS value FROM lattice_lines GROUP BY ALL),
    pos AS (SELECT sample_id, h, i, greatest(0.0::DOUBLE, (i + 0.5::DOUBLE) * h / h2 - 0.5::DOUBLE) AS src
      FROM heights, LATERAL (SELECT unnest(range(h2))::INTEGER AS i) q),
    taps AS (SELECT sample_id, i, floor(src)::INTEGER AS y, 1 - (src - floor(src)) AS w FROM pos
      UNION ALL SELECT sample_id, i, least(floor(src)::INTEGER + 1, h - 1), src - floor(src) FROM pos)
    SELECT px.sample_id, z, i AS y, x, round(sum(value * w), 4) AS value
    FROM px JOIN taps t ON t.sample_id = px.sample_id AND t.y = px.y GROUP BY ALL""",
)
def d5(v):
    pixels = v.lattice_lines.groupBy("sample_id", "z", "y", "x").agg(F.max("price").alias("value"))
    out = regrid.forward_intensities(pixels, heights(v))
    return out.withColumn("value", F.round("value", 4))


_BOX_SQL = f"""box AS (SELECT sample_id, h2, ({PADDED[0]} - h2) // 2 AS top, ({PADDED[1]} - 16) // 2 AS lft FROM heights)"""


@query(
    "D6_content_box",
    with_ctes(LATTICE, MANIFEST, HEIGHTS_SQL, _BOX_SQL)
    + """SELECT r.sample_id, cls, z, y - top AS y, x - lft AS x FROM ref r JOIN box b ON b.sample_id = r.sample_id
      WHERE y - top >= 0 AND y - top < h2 AND x - lft >= 0 AND x - lft < 16""",
)
def d6(v):
    boxes = heights(v).select(
        "sample_id",
        F.lit(PADDED[0]).alias("padded_h"), F.lit(PADDED[1]).alias("padded_w"),
        F.col("h2").alias("content_h"), F.lit(16).alias("content_w"),
    )
    return regrid.crop_to_content(v.lattice("ref"), boxes)


@query(
    "D7_inverse_regrid",
    with_ctes(LATTICE, MANIFEST, HEIGHTS_SQL)
    + """, rows AS (SELECT sample_id, n::INTEGER AS y, h, h2 FROM heights, range(16) t(n)),
    cand AS (SELECT sample_id, r.y, i, abs((i * h) // h2 - r.y) AS d,
        row_number() OVER (PARTITION BY sample_id, r.y ORDER BY abs((i * h) // h2 - r.y), i % 2) AS k
      FROM rows r, LATERAL (SELECT unnest(range(h2))::INTEGER AS i) q
      WHERE i = least((r.y * h2 + h - 1) // h, h2 - 1) OR i = greatest(least((r.y * h2 + h - 1) // h, h2 - 1) - 1, 0)),
    fwd AS (SELECT p.sample_id, cls, z, i AS row, x FROM heights t, LATERAL (SELECT unnest(range(h2))::INTEGER AS i) q,
      pred p WHERE p.sample_id = t.sample_id AND p.y = (i * h) // h2)
    SELECT f.sample_id, cls, z, c.y, x FROM fwd f JOIN cand c ON c.sample_id = f.sample_id AND c.i = f.row AND k = 1""",
)
def d7(v):
    h = heights(v)
    return regrid.inverse_labels(regrid.forward_labels(v.lattice("pred"), h), h).select(
        "sample_id", "cls", "z", "y", "x"
    )


@query(
    "D8_axis_order",
    with_ctes(MANIFEST) + "SELECT sample_id, [spacing_mm[3], spacing_mm[1], spacing_mm[2]] AS zyx FROM manifest",
)
def d8(v):
    return v.manifest.select("sample_id", masks.array_axis_spacing().alias("zyx"))


@query(
    "D9_dice",
    with_ctes(LATTICE, GRID_SQL, COUNTS_SQL)
    + """SELECT sample_id, cls, p AS predicted_voxels, r AS reference_voxels, b AS both_voxels,
      round(CASE WHEN p + r = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * b / (p + r) END, 9) AS dice FROM counts""",
)
def d9(v):
    return masks.with_dice(counts_on_grid(v)).withColumn("dice", F.round("dice", 9))


@query(
    "D10_sensitivity_specificity",
    with_ctes(LATTICE, GRID_SQL, COUNTS_SQL)
    + """SELECT sample_id, cls, round(b::DOUBLE / nullif(r, 0), 9) AS sensitivity,
      round((1792 - (p + r - b))::DOUBLE / nullif(1792 - r, 0), 9) AS specificity FROM counts""",
)
def d10(v):
    extents = v.manifest.select("sample_id", masks.extent().alias("extent_voxels"))
    out = masks.rates(counts_on_grid(v).join(extents, "sample_id"))
    return out.select(
        "sample_id", "cls", F.round("sensitivity", 9).alias("sensitivity"), F.round("specificity", 9).alias("specificity")
    )


@query(
    "D11_volume",
    with_ctes(LATTICE, GRID_SQL, COUNTS_SQL, MANIFEST)
    + """SELECT c.sample_id, cls, p AS predicted_voxels, r AS reference_voxels, round(vx, 12) AS voxel_mm3,
      round(p * vx, 9) AS predicted_mm3, round(r * vx, 9) AS reference_mm3
      FROM counts c JOIN (SELECT sample_id, spacing_mm[1] * spacing_mm[2] * spacing_mm[3] AS vx FROM manifest) m
      ON m.sample_id = c.sample_id""",
)
def d11(v):
    spacing = v.manifest.select("sample_id", "spacing_mm")
    out = masks.volumes(counts_on_grid(v).join(spacing, "sample_id"))
    return out.select(
        *KEYS, "predicted_voxels", "reference_voxels", F.round("voxel_mm3", 12).alias("voxel_mm3"),
        F.round("predicted_mm3", 9).alias("predicted_mm3"), F.round("reference_mm3", 9).alias("reference_mm3"),
    )


_DENSE = """solid AS (SELECT DISTINCT vendor_id AS sample_id, z, y, x FROM (
  SELECT c_nationkey AS vendor_id, l_linenumber - 1 AS z, (l_partkey % 12)::INTEGER AS y, (l_suppkey % 12)::INTEGER AS x
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_tax >= 0.04::DOUBLE))"""


def solid_masks(v):
    """A denser mask per nation: nearly full, so that interior voxels are common."""
    owner = v.table("customer").select(F.col("c_custkey").alias("sample_id"), "c_nationkey")
    raw = v.table("lineitem").filter("l_tax >= 0.04D").join(
        v.table("orders").join(owner, F.col("o_custkey") == F.col("sample_id")),
        F.col("l_orderkey") == F.col("o_orderkey"),
    )
    return raw.select(
        F.col("c_nationkey").alias("sample_id"),
        (F.col("l_linenumber") - 1).alias("z"),
        (F.col("l_partkey") % 12).cast("int").alias("y"),
        (F.col("l_suppkey") % 12).cast("int").alias("x"),
    ).distinct()


@query(
    "D12_surface",
    with_ctes(_DENSE)
    + """SELECT s.* FROM solid s WHERE (SELECT count(*) FROM solid t WHERE t.sample_id = s.sample_id
      AND abs(t.z - s.z) + abs(t.y - s.y) + abs(t.x - s.x) = 1) < 6""",
)
def d12(v):
    return masks.surface(solid_masks(v), ["sample_id"])


_HD_SQL = """sp AS (SELECT sample_id, spacing_mm[3] AS sz, spacing_mm[1] AS sy, spacing_mm[2] AS sx FROM manifest),
ps AS (SELECT s.* FROM pred s WHERE (SELECT count(*) FROM pred t WHERE t.sample_id = s.sample_id AND t.cls = s.cls
  AND abs(t.z - s.z) + abs(t.y - s.y) + abs(t.x - s.x) = 1) < 6),
rs AS (SELECT s.* FROM ref s WHERE (SELECT count(*) FROM ref t WHERE t.sample_id = s.sample_id AND t.cls = s.cls
  AND abs(t.z - s.z) + abs(t.y - s.y) + abs(t.x - s.x) = 1) < 6),
pairs AS (SELECT a.sample_id, a.cls, a.z, a.y, a.x, b.z AS tz, b.y AS ty, b.x AS tx,
  sqrt(power((a.z - b.z) * sz, 2) + power((a.y - b.y) * sy, 2) + power((a.x - b.x) * sx, 2)) AS d
  FROM ps a JOIN rs b ON a.sample_id = b.sample_id AND a.cls = b.cls JOIN sp ON sp.sample_id = a.sample_id),
fwd AS (SELECT sample_id, cls, quantile_cont(d, 0.95::DOUBLE) AS f FROM (
  SELECT sample_id, cls, z, y, x, min(d) AS d FROM pairs GROUP BY ALL) GROUP BY ALL),
bwd AS (SELECT sample_id, cls, quantile_cont(d, 0.95::DOUBLE) AS b FROM (
  SELECT sample_id, cls, tz, ty, tx, min(d) AS d FROM pairs GROUP BY ALL) GROUP BY ALL),
hd AS (SELECT c.sample_id, c.cls, c.p, c.r,
  CASE WHEN c.p = 0 AND c.r = 0 THEN 0.0::DOUBLE ELSE greatest(fwd.f, bwd.b) END AS hd95
  FROM counts c LEFT JOIN fwd ON fwd.sample_id = c.sample_id AND fwd.cls = c.cls
  LEFT JOIN bwd ON bwd.sample_id = c.sample_id AND bwd.cls = c.cls)"""
HD95_CTES = with_ctes(LATTICE, GRID_SQL, COUNTS_SQL, MANIFEST, _HD_SQL)


def hd95_rows(v):
    return distance.hd95(
        v.lattice_rows("pred"), v.lattice_rows("ref"), v.lattice_spacing, volume_grid(v), KEYS
    )


@query("D13_hd95", HD95_CTES + "SELECT sample_id, cls, round(hd95, 9) AS hd95 FROM hd")
def d13(v):
    return hd95_rows(v).withColumn("hd95", F.round("hd95", 9))


# The same masks pulled apart, so that indices pass 1024 and a million.
_WIDE = ["z", "y * 131 AS y", "x * 70001 AS x"]
_WIDE_SQL = """wide_pred AS (SELECT sample_id, cls, {0} FROM pred), wide_ref AS (SELECT sample_id, cls, {0} FROM ref)""".format(", ".join(_WIDE))


@query(
    "D13_hd95_wide",
    with_ctes(LATTICE, GRID_SQL, COUNTS_SQL, MANIFEST, _WIDE_SQL, _HD_SQL.replace("FROM pred ", "FROM wide_pred ").replace("FROM ref ", "FROM wide_ref "))
    + "SELECT sample_id, cls, round(hd95, 6) AS hd95 FROM hd",
)
def d13_wide(v):
    wide = [v.lattice_rows(side).selectExpr("sample_id", "cls", *_WIDE) for side in ("pred", "ref")]
    return distance.hd95(*wide, v.lattice_spacing, volume_grid(v), KEYS).withColumn("hd95", F.round("hd95", 6))


@query(
    "D14_edge_shift",
    with_ctes(LATTICE)
    + """SELECT sample_id, cls, count(*) AS columns, round(avg(pt - rt), 9) AS top_shift, round(avg(pb - rb), 9) AS bottom_shift
      FROM (SELECT sample_id, cls, z, x, min(y) FILTER (predicted) AS pt, max(y) FILTER (predicted) AS pb,
        min(y) FILTER (reference) AS rt, max(y) FILTER (reference) AS rb FROM paired GROUP BY ALL)
      WHERE pt IS NOT NULL AND rt IS NOT NULL GROUP BY ALL""",
)
def d14(v):
    out = masks.edge_shift(v.lattice_paired, KEYS)
    return out.withColumn("top_shift", F.round("top_shift", 9)).withColumn("bottom_shift", F.round("bottom_shift", 9))


@query(
    "D15_densest_slice",
    with_ctes(LATTICE)
    + """SELECT sample_id, z, voxels FROM (SELECT sample_id, z, count(*) AS voxels,
      row_number() OVER (PARTITION BY sample_id ORDER BY count(*) DESC, z) AS k FROM ref GROUP BY sample_id, z) WHERE k = 1""",
)
def d15(v):
    return masks.densest_slice(v.lattice("ref"), ["sample_id"])


@query(
    "D16_crop_rows",
    with_ctes(LATTICE)
    + """, bright AS (SELECT sample_id, z, y FROM (SELECT sample_id, z, y, row_number() OVER (PARTITION BY sample_id, z
        ORDER BY round(avg(price), 6) DESC, y) AS k FROM lattice_lines GROUP BY sample_id, z, y) WHERE k = 1),
    r AS (SELECT sample_id, z, y FROM paired UNION ALL SELECT sample_id, z, y FROM bright)
    SELECT sample_id, z, greatest(0, min(y) - 2) AS top, least(16, max(y) + 3) AS bottom FROM r GROUP BY ALL""",
)
def d16(v):
    lines = v.lattice_lines.repartition(width(v.spark), "sample_id", "z", "y")
    brightness = lines.groupBy("sample_id", "z", "y").agg(F.round(F.avg("price"), 6).alias("brightness"))
    heights_ = v.manifest.select("sample_id", F.col("shape")[1].alias("height"), F.explode(F.sequence(F.lit(0), F.col("shape")[0] - 1)).alias("z"))
    return masks.crop_rows(v.lattice_paired, brightness, heights_, ["sample_id", "z"], margin=2)


_PREV_SQL = """prev AS (SELECT m.vendor, g.cls, sum(n) * 100.0::DOUBLE / sum(1792) AS pooled, avg(n * 100.0::DOUBLE / 1792) AS mean, count(*) AS samples
  FROM (SELECT g.sample_id, g.cls, count(r.z) AS n FROM grid g LEFT JOIN ref r ON r.sample_id = g.sample_id AND r.cls = g.cls GROUP BY ALL) g
  JOIN manifest m ON m.sample_id = g.sample_id GROUP BY ALL)"""


def prevalence(v):
    grid = masks.class_grid(v.manifest.select("sample_id", "vendor", masks.extent().alias("extent_voxels")), CLASSES)
    return masks.prevalence(v.lattice("ref"), grid)


@query(
    "D17_prevalence",
    with_ctes(LATTICE, GRID_SQL, MANIFEST, _PREV_SQL)
    + "SELECT vendor, cls, round(pooled, 9) AS pooled_percent, round(mean, 9) AS mean_percent, samples FROM prev",
)
def d17(v):
    return prevalence(v).withColumn("pooled_percent", F.round("pooled_percent", 9)).withColumn("mean_percent", F.round("mean_percent", 9))


@query(
    "D18_presence_combinations",
    with_ctes(PER_VOLUME)
    + """, f AS (SELECT sample_id, bool_or(cls = 'A' AND reference_present) AS a, bool_or(cls = 'N' AND reference_present) AS n,
      bool_or(cls = 'R' AND reference_present) AS r FROM per_volume GROUP BY 1)
    SELECT what, n, samples FROM (SELECT count(*) AS samples, unnest(['A', 'N', 'R', 'all', 'none']) AS what,
      unnest([count(*) FILTER (a), count(*) FILTER (n), count(*) FILTER (r), count(*) FILTER (a AND n AND r),
        count(*) FILTER (NOT (a OR n OR r))]) AS n FROM f)""",
)
def d18(v):
    return masks.presence_combinations(v.per_volume, CLASSES)


@query(
    "D19_prevalence_shift",
    with_ctes(LATTICE, GRID_SQL, MANIFEST, _PREV_SQL)
    + """SELECT cls, arg_min(vendor, pooled) AS lowest_vendor, round(min(pooled), 9) AS lowest_percent,
      arg_max(vendor, pooled) AS highest_vendor, round(max(pooled), 9) AS highest_percent,
      round(max(pooled) / nullif(min(pooled), 0), 9) AS ratio FROM prev GROUP BY cls""",
)
def d19(v):
    out = masks.prevalence_shift(prevalence(v))
    return out.select(
        "cls", "lowest_vendor", F.round("lowest_percent", 9).alias("lowest_percent"),
        "highest_vendor", F.round("highest_percent", 9).alias("highest_percent"), F.round("ratio", 9).alias("ratio"),
    )


# Element i of an embedding is class i % 4 of pass i / 4: sixteen passes of four classes.
_PASSES = """raw AS (SELECT vec_id AS voxel, label AS sample, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings),
sm AS (SELECT voxel, sample, i // 4 AS pass, i % 4 AS cls,
  exp(v - max(v) OVER w) / sum(exp(v - mx)) OVER w AS p
  FROM (SELECT *, max(v) OVER (PARTITION BY voxel, i // 4) AS mx FROM raw) WINDOW w AS (PARTITION BY voxel, i // 4)),
agg AS (SELECT voxel, sample, cls, avg(p) AS mean, stddev_pop(p) AS std, count(*) AS passes FROM sm GROUP BY ALL)"""
VOXEL = ["voxel", "sample"]


def pass_means(v):
    e = v.table("embeddings").select(
        F.col("vec_id").alias("voxel"), F.col("label").alias("sample"), F.col("embedding").cast("array<double>").alias("e")
    )
    n_passes = F.floor(F.size("e") / 4).cast("int")
    logits = e.withColumn("pass", F.explode(F.sequence(F.lit(0), n_passes - 1))).select(
        *VOXEL, "pass", F.slice("e", F.col("pass") * 4 + 1, 4).alias("logits")
    )
    return passes.aggregate_passes(passes.softmax_passes(logits, VOXEL), VOXEL)


@query(
    "D20_pass_aggregation",
    with_ctes(_PASSES) + "SELECT voxel, sample, cls, round(mean, 9) AS mean, round(std, 9) AS std, passes FROM agg",
)
def d20(v):
    return pass_means(v).withColumn("mean", F.round("mean", 9)).withColumn("std", F.round("std", 9))


@query(
    "D21_label",
    with_ctes(_PASSES)
    + """SELECT voxel, sample, cls AS label, round(mean, 9) AS probability FROM (
      SELECT *, row_number() OVER (PARTITION BY voxel ORDER BY mean DESC, cls) AS k FROM agg) WHERE k = 1""",
)
def d21(v):
    return passes.label_of(pass_means(v), VOXEL).withColumn("probability", F.round("probability", 9))


@query(
    "D21_class_score",
    with_ctes(_PASSES) + "SELECT sample, cls, round(max(mean), 9) AS score FROM agg GROUP BY ALL",
)
def d21_score(v):
    return passes.class_scores(pass_means(v), ["sample"]).withColumn("score", F.round("score", 9))


@query(
    "D21_class_score_in_box",
    with_ctes(_PASSES)
    + """SELECT sample, cls, round(max(mean), 9) AS score FROM agg WHERE (voxel // 16) % 16 >= sample % 5 AND (voxel // 16) % 16 < 12
      AND voxel % 16 >= 2 AND voxel % 16 < 16 - sample % 3 GROUP BY ALL""",
)
def d21_box(v):
    """Voxels stand on a frame of 16 by 16; every sample has a content box of its own."""
    placed = pass_means(v).withColumns({"y": F.floor(F.col("voxel") / 16) % 16, "x": F.col("voxel") % 16})
    k = F.col("sample")
    boxes = v.table("embeddings").select(F.col("label").alias("sample")).distinct().select(
        "sample", (k % 5).alias("y_from"), F.lit(12).alias("y_to"), F.lit(2).alias("x_from"), (16 - k % 3).alias("x_to")
    )
    return passes.class_scores_in_box(placed, boxes, ["sample"]).withColumn("score", F.round("score", 9))


@query(
    "D22_scan_confidence",
    with_ctes(_PASSES) + "SELECT sample, round(1 - 2 * avg(std), 9) AS confidence FROM agg GROUP BY ALL",
)
def d22(v):
    return passes.scan_confidence(pass_means(v), ["sample"]).withColumn("confidence", F.round("confidence", 9))


@query(
    "D23_frame_scores",
    with_ctes(LATTICE)
    + """, f AS (SELECT m.sample_id, m.z, g.cls, count(*) FILTER (predicted) AS p, count(*) FILTER (reference) AS r,
        count(*) FILTER (predicted AND reference) AS b
      FROM (SELECT c_custkey AS sample_id, t.z::INTEGER AS z FROM customer, range(7) t(z)) m CROSS JOIN (VALUES ('A'), ('N'), ('R')) g(cls)
      LEFT JOIN paired v ON v.sample_id = m.sample_id AND v.z = m.z AND v.cls = g.cls GROUP BY ALL),
    s AS (SELECT cls, coalesce(avg(2.0::DOUBLE * b / nullif(p + r, 0)), 0.0::DOUBLE) AS measured_dice, count(nullif(p + r, 0)) AS frames_scored,
      count(*) FILTER (p > 0) AS frames_predicted, count(*) FILTER (r > 0) AS frames_with_class, count(*) AS frames,
      sum(p)::BIGINT AS predicted_voxels FROM f GROUP BY cls),
    base AS (SELECT p_b AS cls, d AS baseline_dice FROM (VALUES ('A', 0.3::DOUBLE), ('N', 0.5::DOUBLE), ('R', 0.1::DOUBLE)) t(p_b, d))
    SELECT s.cls, round(measured_dice, 9) AS measured_dice, frames_scored, frames_predicted, frames_with_class, frames, predicted_voxels,
      baseline_dice, measured_dice > 0 AS beats_empty, measured_dice > baseline_dice AS beats_baseline, frames_predicted > 0 AS not_collapsed
    FROM s JOIN base ON base.cls = s.cls""",
)
def d23(v):
    frames = v.manifest.select("sample_id", F.explode(F.sequence(F.lit(0), F.col("shape")[0] - 1)).alias("z"))
    keys = ["sample_id", "z", "cls"]
    counts = masks.on_grid(masks.overlap_counts(v.lattice_paired, keys), masks.class_grid(frames, CLASSES), keys)
    baseline = v.spark.createDataFrame([("A", 0.3), ("N", 0.5), ("R", 0.1)], "cls STRING, baseline_dice DOUBLE")
    return masks.frame_scores(counts, baseline).withColumn("measured_dice", F.round("measured_dice", 9))


@query(
    "D24_mean_foreground",
    with_ctes(LATTICE, GRID_SQL, COUNTS_SQL)
    + """SELECT sample_id, round(avg(2.0::DOUBLE * b / nullif(p + r, 0)), 9) AS mean_foreground, count(nullif(p + r, 0)) AS classes
      FROM counts GROUP BY 1""",
)
def d24(v):
    p, r, b = (F.col(c) for c in ("predicted_voxels", "reference_voxels", "both_voxels"))
    rows = counts_on_grid(v).withColumn("frame_dice", masks.frame_dice(p, r, b))
    return masks.mean_foreground(rows, ["sample_id"], "frame_dice").withColumn("mean_foreground", F.round("mean_foreground", 9))
