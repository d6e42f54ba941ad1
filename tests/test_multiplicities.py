"""Draws made once for all cells of a size, against numpy and against drawing slot by slot."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortscale.operators import bootstrap, multiplicities
from cohortscale.operators.bootstrap import Boot
from cohortscale.operators.multiplicities import bounded

SEED = 20260916


def tables(df, n_resamples):
    """{(stratum, size, start): replicates x members}."""
    out = {}
    for r in df.collect():
        table = out.setdefault((r.stratum, r.size, r.start), np.zeros((n_resamples + 600, r.size), np.int64))
        first = r.block * multiplicities.replicates_of_block(r.size)
        table[first : first + len(r.weights), r.idx] += r.weights
    assert all(not t[n_resamples:].any() for t in out.values())
    return {k: t[:n_resamples] for k, t in out.items()}


def counted(draws, size):
    return np.stack([np.bincount(row, minlength=size) for row in draws])


def test_numpy_draws_one_by_one(spark):
    sizes = [1, 2, 7, 24, 70, 1000]
    streams = spark.createDataFrame([("numpy", n, 0) for n in sizes if n > 1], "stratum string, size long, start long")
    before = {}
    for r in multiplicities._taken(streams, SEED, 300).orderBy("block").collect():
        before.setdefault(r["size"], []).append(r.before)
    for n in sizes:
        blocks = range(-(-300 // multiplicities.replicates_of_block(n)))
        got = [multiplicities.block_draws(SEED, "numpy", "numpy", n, 0, b, 300, before.get(n)) for b in blocks]
        assert (np.concatenate(got) == np.random.default_rng(SEED).integers(0, n, size=(300, n))).all()


def test_rejected_words_move_what_follows(spark):
    """A size that rejects a third of all words, as no cohort does."""
    n = 3_000_000_000
    words = multiplicities.raw_words(SEED, 0, 4001)
    members, taken = multiplicities.bounded(words, n)
    want = np.random.default_rng(SEED).integers(0, n, size=2500)
    assert (members[taken][:2500] == want).all() and 0.5 < taken.mean() < 0.8
    assert (multiplicities.raw_words(SEED, 1001, 50) == words[1001:1051]).all()


def test_blocks_find_their_draws_past_rejections(monkeypatch):
    """Blocks of words of a size that rejects many, so that draws lie blocks away from their own words."""
    monkeypatch.setattr(multiplicities, "bounded", lambda w, n: (lambda m, t: (m, t & (w % 3 > 0)))(*bounded(w, n)))
    n, per = 40, multiplicities.replicates_of_block(40)
    words = multiplicities.raw_words(SEED, 6, 3 * 600 * n)
    members, taken = multiplicities.bounded(words, n)
    want = members[taken][: 600 * n].reshape(600, n)
    ends = np.cumsum([int(taken[k : k + per * n].sum()) for k in range(0, len(words), per * n)])
    before = [0, *ends[:-1].tolist()]
    got = [multiplicities.block_draws(SEED, "numpy", "numpy", n, 6, b, 600, before) for b in range(3)]
    assert (np.concatenate(got) == want).all()


def test_streams_go_on_where_the_last_one_stopped(spark):
    rng = np.random.default_rng(5)
    want = [rng.integers(0, n, size=(200, n)) for n in (7, 1, 9)]
    streams = spark.createDataFrame([("numpy", 7, 0), ("numpy", 1, 3)], "stratum string, size long, start long")
    used = {r["size"]: r.used for r in multiplicities.words_used(streams, 5, 200).collect()}
    assert used == {7: 1400, 1: 0}
    taken = multiplicities._taken(spark.createDataFrame([("numpy", 9, used[7])], "stratum string, size long, start long"), 5, 200)
    before = [r.before for r in taken.orderBy("block").collect()]
    assert (multiplicities.block_draws(5, "numpy", "numpy", 9, used[7], 0, 200, before) == want[2]).all()


def test_hash_draws_are_those_of_each_slot(spark):
    def slot(stratum, size, r, s):
        p = multiplicities.PRIME
        one = pow(multiplicities.stratum_key(7, stratum) + r, 3, p)
        one = pow(one + multiplicities.STEP_A, 3, p)
        two = pow(one + multiplicities.STEP_B, 3, p)
        x = pow(pow(s + one, 3, p) + two, 3, p)
        return pow(x + multiplicities.STEP_C, 3, p) % size

    streams = spark.createDataFrame([("all", 40, 0), ("held", 40, 0), ("all", 1, 0)], "stratum string, size long, start long")
    got = tables(multiplicities.multiplicities(streams, 7, 260), 260)
    for stratum, size, _ in got:
        want = [[slot(stratum, size, r, s) for s in range(size)] for r in range(260)]
        assert (got[stratum, size, 0] == counted(np.array(want), size)).all()
    many = multiplicities.hash_draws(7, "all", 50, 0, 4000)
    share = np.bincount(many.ravel(), minlength=50) / many.size
    assert abs(share - 0.02).max() < 0.002
    # Means of replicates spread as those of independent draws do.
    assert abs(many.mean(axis=1).std() / (np.arange(50).std() / 50**0.5) - 1) < 0.05
    assert abs(np.corrcoef(many[:-1].mean(axis=1), many[1:].mean(axis=1))[0, 1]) < 0.05


def grouped(values, groups, n_resamples):
    keep = ~np.isnan(values)
    labels, inverse = np.unique(groups[keep], return_inverse=True)
    sums, counts = np.bincount(inverse, values[keep]), np.bincount(inverse)
    draws = np.random.default_rng(SEED).integers(0, len(labels), size=(n_resamples, len(labels)))
    return np.percentile(sums[draws].sum(axis=1) / counts[draws].sum(axis=1), [2.5, 97.5])


def test_interval_is_numpys(spark):
    rng = np.random.default_rng(1)
    groups = rng.integers(100, 124, 90)
    values = np.where(rng.random(90) < 0.1, np.nan, rng.random(90))
    rows = [(c, f"p{g}", float(v) + k) for k, c in enumerate(("IRF", None)) for g, v in zip(groups, values)]
    df = spark.createDataFrame(rows, "cls string, patient_id string, value double")
    got = {r.cls: r for r in bootstrap.estimate(df, ["cls"], Boot(SEED, 2000, method="numpy")).collect()}
    for k, cls in enumerate(("IRF", None)):
        low, high = grouped(values + k, groups, 2000)
        assert (got[cls].ci_low, got[cls].ci_high) == (pytest.approx(low, abs=1e-12), pytest.approx(high, abs=1e-12))


def test_differences_are_numpys(spark):
    rng = np.random.default_rng(2)
    held = {f"p{k:02d}": float(rng.random()) for k in range(17)}
    ref = {f"p{k:02d}": float(rng.random()) for k in range(9, 23)}
    only, also, both = ([p for p in sorted(held) if p not in ref], [p for p in sorted(ref) if p not in held], [p for p in sorted(held) if p in ref])
    r = np.random.default_rng(SEED)
    a, b, c = (r.integers(0, len(x), size=(500, len(x))) for x in (only, also, both))
    pick = lambda side, names, d: np.array([side[p] for p in names])[d].sum(axis=1)
    d = (pick(held, only, a) + pick(held, both, c)) / len(held) - (pick(ref, also, b) + pick(ref, both, c)) / len(ref)
    frames = [spark.createDataFrame([("x", p, v) for p, v in side.items()], "cls string, patient_id string, value double") for side in (held, ref)]
    boot = Boot(SEED, 500, method="numpy")
    got = bootstrap.joint_difference(*frames, ["cls"], boot).first()
    assert [got.ci_low, got.ci_high] == pytest.approx(np.percentile(d, [2.5, 97.5]), abs=1e-12)
    r = np.random.default_rng(SEED)
    h, f = (np.array([side[p] for p in sorted(side)]) for side in (held, ref))
    d = h[r.integers(0, len(h), size=(500, len(h)))].mean(axis=1) - f[r.integers(0, len(f), size=(500, len(f)))].mean(axis=1)
    got = bootstrap.independent_difference(*frames, ["cls"], boot).first()
    assert [got.ci_low, got.ci_high] == pytest.approx(np.percentile(d, [2.5, 97.5]), abs=1e-12)
    assert got.difference == pytest.approx(h.mean() - f.mean())


def test_unknown_method_and_no_rows(spark):
    none = spark.createDataFrame([], "cls string, patient_id string, value double")
    assert bootstrap.estimate(none, ["cls"], Boot(SEED)).count() == 0
    with pytest.raises(ValueError):
        Boot(SEED, method="md5")


def test_slices_and_shares_add_up(spark, monkeypatch):
    """Cells larger than a slice, and more cells of one size than share a task."""
    rows = [(f"c{k}", f"p{i:03d}", float(i * (k + 1) % 17)) for k in range(9) for i in range(50)]
    df = spark.createDataFrame(rows, "cls string, patient_id string, value double")
    whole = sorted(map(tuple, bootstrap.estimate(df, ["cls"], Boot(SEED, 120)).collect()))
    monkeypatch.setattr(multiplicities, "SLICE", 16)
    monkeypatch.setattr(multiplicities, "SHARED", 2)
    cut = sorted(map(tuple, bootstrap.estimate(df, ["cls"], Boot(SEED, 120)).collect()))
    assert [c[0] for c in cut] == [c[0] for c in whole]
    assert np.allclose([c[1:] for c in cut], [c[1:] for c in whole], rtol=1e-12)


def test_cells_of_many_members_are_sums_of_draws(spark, monkeypatch):
    """More members than are hashed, counted or packed at a time: rows stay small, and every draw is summed."""
    n = 40_000
    monkeypatch.setattr(multiplicities, "RANGE", 1 << 14)
    members = spark.range(2 * n).selectExpr("id % 2 AS cls", "CAST(id DIV 2 AS INT) AS idx", "CAST(id % 97 AS DOUBLE) AS total", "1.0D AS values")
    streams = spark.createDataFrame([(c, n, "all", 0) for c in (0, 1)], "cls long, size long, _stratum string, _start long")
    rows = multiplicities.weighted_sums(members, ["cls"], streams, ["total", "values"], SEED, 3).collect()
    draws = multiplicities.hash_draws(SEED, "all", n, 0, 3)
    want = {(c, r): float(((2 * draws[r] + c) % 97).sum()) for c in (0, 1) for r in range(3)}
    assert {(r.cls, r.replicate): r.total for r in rows} == want and all(r["values"] == n for r in rows)

def test_wide_cells_give_the_sums_of_narrow_ones(spark, monkeypatch):
    """Values of cells of many members are stored once and read by each task, not sent to all: same sums, whatever the method."""
    rng = np.random.default_rng(4)
    rows = [(c, i, float(x), 1 + i % 3) for c, n in (("a", 700), ("b", 700), ("c", 300), ("d", 90), (None, 700)) for i, x in enumerate(rng.normal(size=n).round(1 if c == "a" else 9))]
    members = spark.createDataFrame(rows, "cell string, idx long, total double, values long")
    streams = members.groupBy("cell").agg(F.count("*").alias("size")).withColumns({"_stratum": F.lit("all"), "_start": F.lit(0).cast("long")})
    monkeypatch.setattr(multiplicities, "WORK", 700 * 20)
    monkeypatch.setattr(multiplicities, "BLOCK", 10)  # several tasks a stream

    def sums(method):
        out = multiplicities.weighted_sums(members, ["cell"], streams, ["total", "values"], 7, 60, method)
        return {(r.cell, r.replicate): (r.total, r["values"]) for r in out.collect()}, out

    for method in ("hash", "numpy"):
        monkeypatch.setattr(multiplicities, "WIDE", 1 << 18)
        want, _ = sums(method)
        monkeypatch.setattr(multiplicities, "WIDE", 200)
        monkeypatch.setattr(multiplicities, "CHUNK", 128)
        got, out = sums(method)
        assert got.keys() == want.keys() and len(got) == 5 * 60
        assert all(got[k][0] == pytest.approx(want[k][0], abs=1e-9) and got[k][1] == want[k][1] for k in want)
        # Its values go through no exchange of a copy a task.
        assert out._jdf.queryExecution().executedPlan().toString().count("Coalesce 1\n") == 8 + 2


def test_numbers_by_code_are_the_numbers():
    x = np.random.default_rng(1).normal(size=1 << 17)
    ones = np.arange(1 << 17) % 3
    for numbers, coded in ((np.round(x, 2), True), (x, False), (np.zeros(1 << 17), True)):
        column = multiplicities.Coded(len(numbers))
        for a in range(0, len(numbers), 256):
            column.put(np.arange(a, a + 256), [numbers[a : a + 256], ones[a : a + 256]])
        drawn = np.random.default_rng(2).integers(0, len(numbers), 5000)
        assert list(column.sums_of(drawn)) == pytest.approx([numbers[drawn].sum(), ones[drawn].sum()], abs=1e-9)
        assert (column.numbers is None) == coded
