"""Rows without a group key are a group of their own, in everything that runs over groups."""

import pytest
from pyspark.sql import functions as F

from cohortscale.operators import logs, privacy, reconcile, select
from cohortscale.plans.ordered import hash_ranked, join_same, percentiles, ranked, running


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_running_and_ranks(spark):
    df = spark.createDataFrame([(None, 0, 1), (None, 0, 2), (None, 1, 3), ("a", None, 4), ("a", 0, 5), (None, None, 6)], "g string, b int, v int")
    specs = {"before": ("sum", "v", False), "most": ("max", "v", True), "least": ("min", "v", True)}
    got = rows_of(running(df, ["g"], "b", ["v"], specs), "g", "v", "before", "most", "least")
    assert got == sorted(
        [(None, 6, 0, 6, 6), (None, 1, 6, 6, 1), (None, 2, 7, 6, 1), (None, 3, 9, 6, 1), ("a", 4, 0, 4, 4), ("a", 5, 4, 5, 4)], key=repr
    )
    assert rows_of(ranked(df, ["g"], ["v"]), "g", "v", "rank") == sorted(
        [(None, 1, 1), (None, 2, 2), (None, 3, 3), (None, 6, 4), ("a", 4, 1), ("a", 5, 2)], key=repr
    )
    assert hash_ranked(df, ["g"], F.md5(F.col("v").cast("string")), ["v"]).count() == 6
    none = running(df.filter("v > 9"), ["g"], "b", ["v"], specs)
    assert none.count() == 0 and none.columns == ["g", "b", "v", "before", "most", "least"]


def test_percentiles(spark):
    df = spark.createDataFrame([(None, float(k)) for k in range(5)] + [("a", 1.0)], "g string, v double")
    assert rows_of(percentiles(df, ["g"], "v", {"mid": 0.5}), "g", "mid") == [("a", 1.0), (None, 2.0)]


def test_join_same(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2), ("y", 3)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("x", 20), ("z", 30)], "k string, b int")
    assert rows_of(join_same(a, b, ["k"]), "k", "a", "b") == [("x", 2, 20), (None, 1, 10)]
    assert rows_of(join_same(a, b, ["k"], "full"), "k", "a", "b") == [("x", 2, 20), ("y", 3, None), ("z", None, 30), (None, 1, 10)]
    assert rows_of(join_same(a, b, ["k"], "left_anti"), "k", "a") == [("y", 3)]


@pytest.fixture(scope="module")
def access(spark):
    rows = [(None, 1, k, k, k % 2, 0) for k in range(4)] + [("test", None, k, 10 + k, None, k) for k in range(3)]
    df = spark.createDataFrame(rows, "bucket string, fold_id int, ts bigint, entry bigint, run_id bigint, prior_accesses bigint")
    return df.withColumn("ts", F.timestamp_seconds("ts"))


def test_audit_counts_keyless_entries(access):
    got = rows_of(logs.prior_accesses(access), "entry", "prior")
    assert got == [(0, 0), (1, 1), (10, 0), (11, 1), (12, 2), (2, 2), (3, 2)]
    assert rows_of(logs.audit_findings(access), "entry") == [(1,), (2,), (3,)]


def test_patience_and_sessions(spark):
    df = spark.createDataFrame([(None, k, v) for k, v in enumerate((0.1, 0.3, 0.2))] + [("a", 0, 0.5)], "run string, epoch bigint, val_dice double")
    got = rows_of(logs.best_and_patience(df, ["run"]), "run", "epoch", "best_metric", "since_improvement")
    assert got == [("a", 0, 0.5, 0), (None, 0, 0.1, 0), (None, 1, 0.3, 0), (None, 2, 0.3, 1)]
    events = df.select("run", "epoch", (F.col("epoch") % 2 == 0).alias("starts"))
    got = rows_of(logs.sessions(events, ["run"], F.col("starts"), ~F.col("starts"), ["epoch"]), "run", "session", "events")
    assert got == [("a", 1, 1), (None, 1, 2), (None, 2, 1)]


def test_publication_order_and_checks(spark):
    df = spark.createDataFrame([(None, 3, "p"), (None, 1, "q"), ("a", 2, "r"), ("a", None, "s")], "g string, v int, id string")
    placed = select.publication_order(df, ["g"], ["v"])
    assert rows_of(placed, "id", "position") == [("p", 2), ("q", 1), ("r", 1), ("s", 2)]
    assert privacy.unsorted_positions(placed, ["g"], ["v"]).count() == 0
    swapped = placed.withColumn("position", F.when(F.col("g").isNull(), 3 - F.col("position")).otherwise(F.col("position")))
    assert rows_of(privacy.unsorted_positions(swapped, ["g"], ["v"]), "g", "position") == [(None, 1), (None, 2)]
    lines = placed.select(F.col("g").alias("doc"), "position", F.col("id").alias("line"))
    assert reconcile.table_differences(lines, lines, ["doc"]).count() == 0
    assert rows_of(reconcile.table_differences(lines, lines.filter("line <> 'p'"), ["doc"]), "doc", "position", "problem") == [(None, 2, "missing")]
