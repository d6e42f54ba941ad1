import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortscale.operators import auroc as roc
from cohortscale.operators import bootstrap, compare, multiplicities, threshold
from cohortscale.operators.bootstrap import Boot
from cohortscale.plans.ordered import ranked, running

BOOT = Boot(seed=7, n_resamples=400)


def clustered(spark, patients=20, per=10):
    rng = np.random.default_rng(3)
    rows = []
    for p in range(patients):
        centre = rng.random()
        rows += [("c", f"p{p}", float(centre + rng.normal(0, 1e-3)), i + p * per) for i in range(per)]
    return spark.createDataFrame(rows, "cell STRING, patient_id STRING, value DOUBLE, element INT")


def test_cluster_interval_is_wider_than_the_element_interval(spark):
    rows = clustered(spark)
    cluster = bootstrap.estimate(rows, ["cell"], BOOT).first()
    element = bootstrap.element_estimate(rows, ["cell"], BOOT, "element").first()
    assert cluster.n == 20 and cluster.n_measurements == 200 and element.n == 200
    assert cluster.value == pytest.approx(element.value, abs=1e-12)
    assert cluster.ci_high - cluster.ci_low > 2 * (element.ci_high - element.ci_low)


def test_interval_agrees_with_numpy_resampling(spark):
    rows = clustered(spark, patients=60, per=3)
    means = [r.m for r in rows.groupBy("patient_id").agg(F.avg("value").alias("m")).collect()]
    rng = np.random.default_rng(0)
    reps = rng.choice(means, (4000, 60)).mean(1)
    for method in ("exact", "poisson"):
        est = bootstrap.estimate(rows, ["cell"], Boot(seed=7, n_resamples=2000), method=method).first()
        assert est.ci_low == pytest.approx(np.percentile(reps, 2.5), abs=0.01)
        assert est.ci_high == pytest.approx(np.percentile(reps, 97.5), abs=0.01)


def test_undefined_single_and_repartitioned(spark):
    nan = float("nan")
    rows = spark.createDataFrame(
        [("none", "a", nan), ("one", "a", 0.25), ("one", "a", 0.75), ("one", "b", nan)]
        + [("many", f"p{i}", i / 10) for i in range(9)],
        "cell STRING, patient_id STRING, value DOUBLE",
    )
    got = {r.cell: r for r in bootstrap.estimate(rows, ["cell"], BOOT).collect()}
    assert (got["none"].value, got["none"].ci_low, got["none"].n, got["none"].n_measurements) == (None, None, 0, 1)
    assert (got["one"].value, got["one"].ci_low, got["one"].ci_high, got["one"].n) == (0.5, 0.5, 0.5, 1)
    again = bootstrap.estimate(rows.repartition(5), ["cell"], BOOT).collect()
    assert {r.cell: r for r in again}["many"].ci_low == pytest.approx(got["many"].ci_low, abs=1e-12)


def arm(spark, values):
    return spark.createDataFrame([("c", p, float(v)) for p, v in values.items()], "cell STRING, patient_id STRING, value DOUBLE")


def test_shared_patients_are_drawn_once_for_both_arms(spark):
    ref = {f"p{i}": (i * 37 % 11) / 11 for i in range(12)}
    held = {p: v + 0.1 for p, v in ref.items()}
    out = bootstrap.joint_difference(arm(spark, held), arm(spark, ref), ["cell"], BOOT).first()
    for value in (out.difference, out.ci_low, out.ci_high):
        assert value == pytest.approx(0.1, abs=1e-12)
    apart = bootstrap.independent_difference(arm(spark, held), arm(spark, ref), ["cell"], BOOT).first()
    assert apart.ci_high - apart.ci_low > 0.1


def test_patient_in_two_folds_counts_once_with_its_mean(spark):
    rows = spark.createDataFrame(
        [("a", "test", "x", "p", 0.2), ("b", "test", "x", "p", 0.6), ("b", "test", "x", "q", 1.0)],
        "run STRING, arm STRING, cls STRING, patient_id STRING, dice DOUBLE",
    )
    got = {r.patient_id: r.value for r in compare.per_patient(rows, ["arm", "cls"]).collect()}
    assert got == {"p": pytest.approx(0.4), "q": 1.0}


def cases(spark, pairs):
    return spark.createDataFrame(
        [("c", i, float(s), bool(y)) for i, (s, y) in enumerate(pairs)],
        "cell STRING, case_id INT, score DOUBLE, label BOOLEAN",
    )


def test_auroc_equals_pair_counting_with_ties(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(rng.integers(0, 6)), bool(rng.integers(0, 2))) for _ in range(80)] + [(float("nan"), True)]
    pos = [s for s, y in pairs if y and s == s]
    neg = [s for s, y in pairs if not y]
    want = np.mean([[1.0 if p > n else 0.5 if p == n else 0.0 for n in neg] for p in pos])
    got = roc.auroc(cases(spark, pairs), ["cell"]).first()
    assert got.auroc == pytest.approx(want, abs=1e-12)
    assert (got.positives, got.negatives) == (len(pos), len(neg))


def test_auroc_of_one_class_is_undefined_and_perfect_separation_not_estimable(spark):
    assert roc.auroc(cases(spark, [(1, True), (2, True)]), ["cell"]).first().auroc is None
    perfect = roc.stratified_interval(cases(spark, [(i, i >= 5) for i in range(10)]), ["cell"], BOOT).first()
    assert (perfect.auroc, perfect.ci_low, perfect.ci_high) == (1.0, None, None)
    mixed = roc.stratified_interval(cases(spark, [(i, i % 3 > 0) for i in range(30)]), ["cell"], BOOT).first()
    assert mixed.ci_low < mixed.auroc < mixed.ci_high
    few = roc.unstratified_interval(cases(spark, [(1, True), (2, False), (3, False)]), ["cell"], BOOT).first()
    assert few.dropped > 0


def volumes(spark, pairs):
    return spark.createDataFrame(
        [("c", bool(y), int(v)) for y, v in pairs], "cell STRING, reference_present BOOLEAN, predicted_voxels INT"
    )


@pytest.mark.parametrize(
    "pairs,expected",
    [
        ([(True, 25), (True, 60), (False, 20), (False, 3)], (20, 1.0, 1, None)),
        ([(True, 2000), (False, 0)], (1, 1.0, 10, None)),
        ([(True, 5), (True, 9)], (10, None, 0, "no negative")),
        ([(False, 5)], (10, None, 0, "no positive")),
    ],
)
def test_threshold_selection(spark, pairs, expected):
    r = threshold.select_threshold(volumes(spark, pairs), ["cell"], fixed=10).first()
    assert (r.threshold, r.j, r.ties, r.degenerate) == expected


def test_running_over_a_hot_key_equals_a_plain_window(spark):
    n = 6000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
        F.col("id"),
        (F.col("id") * 7919 % 1009).alias("v"),
    ).withColumn("b", F.floor(F.col("id") / 100))
    out = running(rows, ["k"], "b", ["id"], {"s": ("sum", "v", True), "m": ("max", "v", False)})
    rows.createOrReplaceTempView("running_rows")
    want = spark.sql(
        "SELECT k, id, sum(v) OVER (PARTITION BY k ORDER BY id) AS s, max(v) OVER (PARTITION BY k ORDER BY id "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM running_rows"
    )
    assert out.select("k", "id", "s", "m").exceptAll(want).isEmpty()
    assert out.count() == n


def test_ranks_with_a_value_held_by_most_rows(spark):
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 4 > 0, F.lit(1.0)).otherwise(F.col("id") / 100).alias("v"))
    got = ranked(rows.repartition(7), [], ["v", "id"])
    rows.createOrReplaceTempView("ranked_rows")
    want = spark.sql("SELECT id, v, row_number() OVER (ORDER BY v, id) AS rank FROM ranked_rows")
    assert got.select("id", "v", "rank").exceptAll(want.select("id", "v", F.col("rank").cast("bigint"))).isEmpty()


def test_sums_that_go_to_groups_are_those_of_the_rows_in_them(spark):
    rows = spark.createDataFrame(
        [(c, None if p == 6 else f"p{p}", None if i == 2 and p == 3 else float(p + i), p) for c in "ab" for p in range(7) for i in range(3)],
        "cls STRING, patient_id STRING, value DOUBLE, n INT",
    )
    # One patient twice in a group, one in two, one unknown, one in none, one without a name.
    members = [("r", "p0"), ("r", "p1"), ("r", "p1"), ("s", "p1"), ("s", "p3"), ("s", "p9"), ("s", None), (None, "p4")]
    groups = spark.createDataFrame(members, "run STRING, patient_id STRING")
    cell = ["run", "cls"]
    want = bootstrap.cluster_sums(rows.join(groups, "patient_id"), cell, "patient_id", "value")
    got = bootstrap.member_sums(rows, ["cls"], "patient_id", "value", groups, ["run"])
    assert got.columns == want.columns
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() == want.count() == 10


def test_thresholds_store_a_volume_once_for_all_its_folds(spark, monkeypatch):
    from cohortscale.catalog import reports

    stored, cut = [], reports.cut_lineage
    monkeypatch.setattr(reports, "cut_lineage", lambda df: stored.append((df.columns, df.count())) or cut(df))
    volumes = spark.createDataFrame(
        [(s, s % 3, "a", s, s % 2 == 0, 0.5) for s in range(12)], "sample_id INT, patient_id INT, cls STRING, predicted_voxels INT, reference_present BOOLEAN, dice DOUBLE"
    )
    patients = spark.createDataFrame([(f"r{r}", "test", p) for r in range(4) for p in range(3)], "run STRING, arm STRING, patient_id INT")
    rows = reports.threshold_arms(type("V", (), {"per_volume": volumes, "arm_patients": patients}))
    assert stored == [(["patient_id", "cls", "predicted_voxels", "reference_present"], 12), (["run", "arm", "patient_id"], 12)]
    assert rows.count() == 48 and rows.filter("reference_present").count() == 24


def test_replicates_come_back_as_one_row_each_and_cases_are_not_dealt(spark):
    """Of 30,000 cases with 12 scores only the counts go to the tasks; every replicate equals counting its draws case by case."""
    rng = np.random.default_rng(5)
    scores, labels = rng.integers(0, 12, 30_000), rng.random(30_000) < 0.3
    counts = roc.score_counts(cases(spark, list(zip(scores, labels))), ["cell"], "score", "label")
    boot = Boot(seed=7, n_resamples=30)
    joint = np.lexsort((~labels, scores))
    orders = {("joint",): [joint], ("pos", "neg"): [joint[labels[joint]], joint[~labels[joint]]]}
    for strata, order in orders.items():
        found = roc._replicates(counts, ["cell"], strata, boot)
        assert "replicate" in found.columns and "_weights" not in found._jdf.queryExecution().analyzed().toString()
        got = {r.replicate: (r.two_u, r.positives, r.negatives) for r in found.collect()}
        assert sorted(got) == list(range(30)) and found.count() == 30
        draws = [multiplicities.hash_draws(7, s, len(o), 0, 30) for s, o in zip(strata, order)]
        for k in range(30):
            drawn = np.concatenate([o[d[k]] for o, d in zip(order, draws)])
            pos, neg = (np.bincount(scores[drawn][labels[drawn] == y], minlength=12) for y in (True, False))
            below = np.cumsum(neg) - neg
            assert got[k] == (int((pos * (2 * below + neg)).sum()), int(pos.sum()), int(neg.sum()))


def test_runs_of_members_are_drawn_as_often_as_their_members():
    runs = [np.array([3, 0, 5]), np.array([40_000, 1])]
    blocks = list(multiplicities.drawn_runs(7, ("a", "b"), runs, 40_009, range(0, 3, 2), 260))
    assert [first for first, _ in blocks] == [0, 2 * multiplicities.replicates_of_block(40_009)]
    for first, found in blocks:
        for stratum, run, times in zip(("a", "b"), runs, found):
            draws = multiplicities.hash_draws(7, stratum, int(run.sum()), first, len(times))
            edges = np.concatenate([[0], np.cumsum(run)])
            want = [[int(((row >= a) & (row < b)).sum()) for a, b in zip(edges, edges[1:])] for row in draws]
            assert (times == np.array(want)).all()
