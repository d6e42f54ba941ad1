"""Picks and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortscale.catalog.base import CLASSES, query
from cohortscale.catalog.sql import ARMS, PER_VOLUME, SAMPLES, with_ctes
from cohortscale.operators import select
from cohortscale.session import cut_lineage

_ELIGIBLE = """test_rows AS (SELECT * FROM arms WHERE arm = 'test'),
el AS (SELECT run, sample_id, round(avg(dice), 9) AS score FROM test_rows WHERE reference_present GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (ORDER BY score, run, sample_id) AS r, count(*) OVER () AS n FROM el),
picks AS (SELECT CASE WHEN r = 1 THEN 'worst' WHEN r = (n - 1) // 2 + 1 THEN 'median' ELSE 'best' END AS role, run, sample_id
  FROM rk WHERE n >= 3 AND (r = 1 OR r = (n - 1) // 2 + 1 OR r = n))"""


def test_rows(v):
    return v.arms.filter("arm = 'test'")


@query(
    "F1_worst_median_best",
    with_ctes(ARMS, _ELIGIBLE) + "SELECT role, run, sample_id, NULL::VARCHAR AS cls FROM picks",
)
def f1(v):
    return select.worst_median_best(test_rows(v).withColumn("dice", F.round("dice", 9)))


def _fp(cls: str, seen: str) -> str:
    return f"""fp_{cls} AS (SELECT run, sample_id FROM test_rows t WHERE cls = '{cls}' AND NOT reference_present AND predicted_voxels > 1
      AND NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.run = t.run AND s.sample_id = t.sample_id)
      ORDER BY predicted_voxels DESC, run, sample_id LIMIT 1)"""


_P = "SELECT run, sample_id FROM picks"
_PA, _PN = _P + " UNION ALL SELECT * FROM fp_A", _P + " UNION ALL SELECT * FROM fp_A UNION ALL SELECT * FROM fp_N"


@query(
    "F2_largest_false_positive",
    with_ctes(ARMS, _ELIGIBLE, _fp("A", _P), _fp("N", _PA), _fp("R", _PN))
    + """SELECT role, run, sample_id, NULL::VARCHAR AS cls FROM picks UNION ALL SELECT 'fp_a', run, sample_id, 'A' FROM fp_A
      UNION ALL SELECT 'fp_n', run, sample_id, 'N' FROM fp_N UNION ALL SELECT 'fp_r', run, sample_id, 'R' FROM fp_R""",
)
def f2(v):
    rows = cut_lineage(test_rows(v).withColumn("dice", F.round("dice", 9)))
    picks = cut_lineage(select.worst_median_best(rows))
    return select.largest_false_positives(rows, picks, CLASSES, threshold=1)


_PUB = "cls, vendor, dice, score NULLS LAST, predicted_voxels"


@query(
    "F3_publication_order",
    with_ctes(ARMS)
    + f"""SELECT run, arm, cls, vendor, round(dice, 9) AS dice, score, predicted_voxels,
      row_number() OVER (PARTITION BY run, arm ORDER BY {_PUB}) AS position FROM arms""",
)
def f3(v):
    rows = v.arms.select("run", "arm", "cls", "vendor", "dice", "score", "predicted_voxels")
    out = select.publication_order(rows, ["run", "arm"], ["cls", "vendor", "dice", "score", "predicted_voxels"])
    return out.withColumn("dice", F.round("dice", 9))


@query(
    "F4_sorted_listing",
    """SELECT p_name || '#' || p_partkey AS name, row_number() OVER (ORDER BY p_name || '#' || p_partkey) AS position FROM part""",
)
def f4(v):
    return select.sorted_listing(
        v.table("part").select(F.concat_ws("#", "p_name", F.col("p_partkey").cast("string")).alias("name")), ["name"]
    )


@query("F5_first_samples", with_ctes(SAMPLES) + "SELECT * FROM samples ORDER BY sample_id LIMIT 25")
def f5(v):
    return select.first_samples(v.samples, 25)


EPOCHS = """epochs AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch, event_id, ts, event_type, value FROM events)"""


@query(
    "F6_first_and_last_means",
    with_ctes(EPOCHS)
    + """, m AS (SELECT *, max(epoch) OVER (PARTITION BY run) AS last FROM epochs)
    SELECT run, count(*) AS epochs, round(avg(value) FILTER (epoch < 3), 9) AS first_mean,
      round(avg(value) FILTER (epoch > last - 3), 9) AS last_mean FROM m GROUP BY run""",
)
def f6(v):
    out = select.first_and_last_means(v.epochs, ["run"], "value", 3)
    return out.withColumn("first_mean", F.round("first_mean", 9)).withColumn("last_mean", F.round("last_mean", 9))
