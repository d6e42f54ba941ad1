"""The views of ``plans.views`` and the bootstrap draw, as SQL for the comparison engine."""

from __future__ import annotations

from cohortscale.operators.multiplicities import PRIME, STEP_A, STEP_B, STEP_C
from cohortscale.plans.views import SEED, SPACING, VENDORS

RESAMPLES = 2000

SAMPLES = """samples AS (
  SELECT o_orderkey AS sample_id, o_custkey AS patient_id, c_mktsegment AS vendor
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

CASE_VOXELS = """case_voxels AS (
  SELECT l_orderkey AS sample_id, l_returnflag AS cls, l_linenumber AS z, l_partkey AS y,
         l_suppkey AS x, bool_or(l_discount >= 0.05::DOUBLE) AS predicted,
         bool_or(l_tax >= 0.04::DOUBLE) AS reference, max(l_extendedprice) AS price
  FROM lineitem GROUP BY ALL)"""

PER_VOLUME = (
    SAMPLES
    + ", "
    + CASE_VOXELS
    + """, case_counts AS (
  SELECT sample_id, cls, count(*) FILTER (predicted) AS p, count(*) FILTER (reference) AS r,
         count(*) FILTER (predicted AND reference) AS b, max(price) FILTER (predicted) AS score
  FROM case_voxels GROUP BY ALL),
per_volume AS (
  SELECT s.sample_id, s.patient_id, s.vendor, g.cls, coalesce(p, 0) AS predicted_voxels,
         coalesce(r, 0) AS reference_voxels, coalesce(b, 0) AS both_voxels,
         CASE WHEN coalesce(p, 0) + coalesce(r, 0) = 0 THEN 1.0::DOUBLE
              ELSE 2.0::DOUBLE * b / (p + r) END AS dice,
         score, coalesce(r, 0) > 0 AS reference_present
  FROM samples s CROSS JOIN (VALUES ('A'), ('N'), ('R')) g(cls)
  LEFT JOIN case_counts c ON c.sample_id = s.sample_id AND c.cls = g.cls)"""
)

_VENDOR_ROWS = ", ".join(f"('{v}')" for v in VENDORS)


def split_sql(val: float = 0.15, ref: float = 0.15, seed: int = SEED) -> str:
    """``split``: (fold_id, bucket, patient_id, vendor, held_out_vendor, seed)."""
    return f"""folds AS (
  SELECT c_custkey AS patient_id, c_mktsegment AS vendor, f.v AS held_out_vendor
  FROM customer CROSS JOIN (VALUES {_VENDOR_ROWS}) f(v)),
fold_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY held_out_vendor
    ORDER BY md5(concat_ws('|', '{seed}', held_out_vendor, patient_id::VARCHAR)), patient_id) AS rank,
    count(*) OVER (PARTITION BY held_out_vendor) AS n
  FROM folds WHERE vendor <> held_out_vendor),
split AS (
  SELECT held_out_vendor || '_holdout' AS fold_id,
    CASE WHEN rank <= round_even(n * {ref}::DOUBLE, 0) THEN 'in_domain_ref'
         WHEN rank <= round_even(n * {ref}::DOUBLE, 0) + round_even(n * {val}::DOUBLE, 0) THEN 'val'
         ELSE 'train' END AS bucket, patient_id, vendor, held_out_vendor, {seed}::BIGINT AS seed
  FROM fold_ranked
  UNION ALL
  SELECT held_out_vendor || '_holdout', 'test', patient_id, vendor, held_out_vendor, {seed}::BIGINT
  FROM folds WHERE vendor = held_out_vendor)"""


SPLIT = split_sql()
ARMS = (
    PER_VOLUME
    + ", "
    + SPLIT
    + """, arms AS (
  SELECT p.*, s.held_out_vendor AS run, s.bucket AS arm
  FROM per_volume p JOIN split s ON p.patient_id = s.patient_id WHERE s.bucket <> 'train')"""
)

LATTICE = """lattice_lines AS (
  SELECT o_custkey AS sample_id, l_returnflag AS cls, l_linenumber - 1 AS z,
         (l_partkey % 16)::INTEGER AS y, (l_suppkey % 16)::INTEGER AS x,
         l_discount >= 0.05::DOUBLE AS p, l_tax >= 0.04::DOUBLE AS r, l_extendedprice AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
pred AS (SELECT DISTINCT sample_id, cls, z, y, x FROM lattice_lines WHERE p),
ref AS (SELECT DISTINCT sample_id, cls, z, y, x FROM lattice_lines WHERE r),
paired AS (
  SELECT sample_id, cls, z, y, x, bool_or(p) AS predicted, bool_or(r) AS reference FROM (
    SELECT *, true AS p, false AS r FROM pred UNION ALL SELECT *, false, true FROM ref)
  GROUP BY ALL)"""

_SPACING_ROWS = ", ".join(
    "('{}', {}::DOUBLE, {}::DOUBLE, {}::DOUBLE)".format(v, *s) for v, s in SPACING.items()
)
MANIFEST = f"""spacing_base(vendor, a, l, s) AS (VALUES {_SPACING_ROWS}),
manifest AS (
  SELECT c_custkey AS sample_id, c_name AS patient_id, c_mktsegment AS vendor,
    [7, 16, 16] AS shape, 'uint16' AS dtype,
    [a * (1.0::DOUBLE + 0.01::DOUBLE * (c_custkey % 5)),
     l * (1.0::DOUBLE + 0.01::DOUBLE * (c_custkey % 5)),
     s * (1.0::DOUBLE + 0.01::DOUBLE * (c_custkey % 5))] AS spacing_mm,
    [c_acctbal, c_acctbal + 1000.0::DOUBLE] AS intensity_window,
    'vol/' || c_name AS source_path, 'obj/' || c_name AS path
  FROM customer JOIN spacing_base ON vendor = c_mktsegment)"""

DIRTY = (
    MANIFEST
    + """, dirty AS (
  SELECT sample_id, patient_id, vendor, dtype, source_path, path,
    CASE WHEN sample_id % 17 = 1 THEN [7, 16] ELSE shape END AS shape,
    CASE sample_id % 11
      WHEN 1 THEN [spacing_mm[1] * 1000.0::DOUBLE, spacing_mm[2], spacing_mm[3]]
      WHEN 2 THEN [spacing_mm[2], spacing_mm[1], spacing_mm[3]]
      WHEN 3 THEN [spacing_mm[2], spacing_mm[2], spacing_mm[2]]
      WHEN 4 THEN [spacing_mm[1], spacing_mm[2]]
      WHEN 5 THEN [0.0::DOUBLE, spacing_mm[2], spacing_mm[3]]
      WHEN 6 THEN [spacing_mm[1], 'NaN'::DOUBLE, spacing_mm[3]]
      WHEN 7 THEN NULL ELSE spacing_mm END AS spacing_mm,
    CASE sample_id % 13 WHEN 1 THEN [5.0::DOUBLE, 5.0::DOUBLE] WHEN 2 THEN NULL
      ELSE intensity_window END AS intensity_window
  FROM manifest)"""
)

SCORED = """scored AS (
  SELECT d.doc_id AS case_id, lang AS cell, quality = 1 AS label, n_chars::DOUBLE AS score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def draw_index(stratum: str, g: str, r: str = "r", s: str = "s", seed: int = SEED) -> str:
    text = f"concat_ws('|', '{seed}', {stratum}, {r}::VARCHAR, {s}::VARCHAR)"
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT % {g}"


def draws_sql(source: str, columns: str, stratum: str, resamples: int = RESAMPLES, seed: int = SEED) -> str:
    """A query over ``source``, with its size ``g``: ``columns``, replicate ``r`` and the member ``idx`` of every draw."""
    cube = f"((x * x) % {PRIME} * x) % {PRIME}"
    key = f"(('0x' || substr(md5(concat_ws('|', '{seed}', {stratum})), 1, 7))::BIGINT + r) % {PRIME}"
    q = f"SELECT {columns}, g, r, {key} AS x FROM {source}, range({resamples}) rr(r)"
    q = f"SELECT {columns}, g, r, ({cube} + {STEP_A}) % {PRIME} AS x FROM ({q})"
    q = f"SELECT {columns}, g, r, {cube} AS one FROM ({q})"
    q = f"SELECT *, (one + {STEP_B}) % {PRIME} AS x FROM ({q})"
    q = f"SELECT {columns}, g, r, one, {cube} AS two FROM ({q})"
    q = f"SELECT {columns}, g, r, two, (s + one) % {PRIME} AS x FROM ({q}), LATERAL (SELECT unnest(range(g)) AS s)"
    q = f"SELECT {columns}, g, r, ({cube} + two) % {PRIME} AS x FROM ({q})"
    q = f"SELECT {columns}, g, r, ({cube} + {STEP_C}) % {PRIME} AS x FROM ({q})"
    return f"SELECT {columns}, r, ({cube}) % g AS idx FROM ({q})"


def boot_sql(
    name: str, source: str, cell: str, patient: str, value: str, resamples: int = RESAMPLES,
    alpha: float = 0.05, stratum: str = "'all'",
) -> str:
    """CTEs ending in ``{name}``: cell, value, ci_low, ci_high, n, n_measurements."""
    on = " AND ".join(f"a.{c.strip()} IS NOT DISTINCT FROM b.{c.strip()}" for c in cell.split(","))
    on_t = on.replace("b.", "t.")
    a_cell = ", ".join(f"a.{c.strip()}" for c in cell.split(","))
    lo, hi = alpha / 2, 1 - alpha / 2
    return f"""{name}_sums AS (
  SELECT {cell}, {patient} AS patient, sum({value}) AS t, count(*) AS c FROM {source}
  WHERE {value} IS NOT NULL AND NOT isnan({value}::DOUBLE) GROUP BY ALL),
{name}_members AS (
  SELECT *, row_number() OVER (PARTITION BY {cell}
     ORDER BY substr(md5(patient::VARCHAR), 1, 3), patient) - 1 AS idx FROM {name}_sums),
{name}_cells AS (SELECT {cell}, count(*) AS g, sum(t) / sum(c) AS value FROM {name}_sums GROUP BY ALL),
{name}_draws AS ({draws_sql(f"{name}_cells", cell, stratum, resamples)}),
{name}_reps AS (
  SELECT {a_cell}, r, sum(b.t) / sum(b.c) AS mean FROM {name}_draws a
  JOIN {name}_members b ON {on} AND a.idx = b.idx GROUP BY ALL),
{name}_tails AS (
  SELECT {cell}, quantile_cont(mean, {lo}::DOUBLE) AS lo, quantile_cont(mean, {hi}::DOUBLE) AS hi
  FROM {name}_reps GROUP BY ALL),
{name}_all AS (SELECT {cell}, count(*) AS n_measurements FROM {source} GROUP BY ALL),
{name} AS (
  SELECT {a_cell}, b.value, CASE WHEN b.g = 1 THEN b.value ELSE t.lo END AS ci_low,
    CASE WHEN b.g = 1 THEN b.value ELSE t.hi END AS ci_high, coalesce(b.g, 0) AS n,
    a.n_measurements
  FROM {name}_all a LEFT JOIN {name}_cells b ON {on} LEFT JOIN {name}_tails t ON {on_t})"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "
