"""Percentile bootstrap over patients (clusters).

Per cell: measurements are summed per patient, patients get an index, every replicate draws as many
indices as the cell has patients, and a replicate mean is a sum over a sum. Draws do not depend on the
values, so ``multiplicities`` makes them once for all cells of a size, in the tasks that the sums go to.
They are functions of their place: they do not depend on partitioning, and a lost executor makes the same again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscale.functions.text import defined
from cohortscale.operators.multiplicities import weighted_sums, words_used
from cohortscale.plans.ordered import hash_bucket, join_same, ranked, running
from cohortscale.session import cut_lineage, freed_shuffles, width


@dataclass(frozen=True)
class Boot:
    """One bootstrap setting. The seed has no default: an interval is never unseeded."""

    seed: int
    n_resamples: int = 2000
    alpha: float = 0.05
    unit: str = "patients"
    #: ``hash`` draws by a hash of each slot's place, ``numpy`` what numpy's default generator draws.
    method: str = "hash"

    def __post_init__(self):
        if self.method not in ("hash", "numpy"):
            raise ValueError(f"draws by {self.method!r}: hash or numpy")

    def tails(self) -> Column:
        return F.array(F.lit(self.alpha / 2), F.lit(1 - self.alpha / 2))


def cluster_sums(rows: DataFrame, cell: Sequence[str], patient: str, value: str) -> DataFrame:
    """Per patient of a cell: sum and count of its defined values, and all its measurements.

    NaN and NULL values are not counted. Everything after this reads the sums, several times
    over, so they are fixed here: the measurements themselves are read once.
    """
    v = defined(F.col(value).cast("double"))
    sums = rows.groupBy(*cell, patient).agg(
        F.sum(v).alias("total"), F.count(v).alias("values"), F.count("*").alias("measured")
    )
    with freed_shuffles(rows.sparkSession):
        return cut_lineage(sums)


def member_sums(
    rows: DataFrame, cell: Sequence[str], patient: str, value: str, members: DataFrame, groups: Sequence[str]
) -> DataFrame:
    """``cluster_sums`` of ``rows`` joined with ``members`` (groups, patient), per groups and cell.

    A patient is in several groups: its measurements are summed once, and the sums go to its groups, a
    group that has a patient twice counting it twice.
    """
    v = defined(F.col(value).cast("double"))
    sums = rows.groupBy(*cell, patient).agg(
        F.sum(v).alias("total"), F.count(v).alias("values"), F.count("*").alias("measured")
    )
    each = sums.join(members, patient).groupBy(*groups, *cell, patient)
    return cut_lineage(each.agg(*[F.sum(c).alias(c) for c in ("total", "values", "measured")]))


def counted(sums: DataFrame) -> DataFrame:
    """Patients with at least one defined value: the population that is resampled."""
    return sums.filter("values > 0")


def indexed(members: DataFrame, cell: Sequence[str], member: str, boot: Boot) -> DataFrame:
    """Add ``idx`` from 0 per cell: in (hash prefix, member) order, for ``numpy`` in the order of the members."""
    if boot.method == "numpy":
        return ranked(members, cell, [member], "idx").withColumn("idx", F.col("idx") - 1)
    tagged = members.withColumn("_part", hash_bucket(member))
    return running(tagged, cell, "_part", [member], {"idx": ("sum", F.lit(1), False)}).drop("_part")


def sizes_of(members: DataFrame, cell: Sequence[str]) -> DataFrame:
    return members.groupBy(*cell).agg(F.count("*").alias("size"))


def one_stream(sizes: DataFrame, stratum: Column | str) -> DataFrame:
    """Every cell draws from the beginning."""
    stratum = F.lit(stratum) if isinstance(stratum, str) else stratum
    return sizes.withColumns({"_stratum": stratum, "_start": F.lit(0).cast("long")})


def stream_after_stream(sizes: DataFrame, cell: Sequence[str], strata: Sequence[str], boot: Boot) -> DataFrame:
    """The strata of a cell, one after another; in ``numpy`` each goes on where the one before it stopped.

    ``sizes`` (cell, stratum, size).
    """
    cell = list(cell)
    if boot.method != "numpy":
        return one_stream(sizes, F.col("stratum"))
    at = sizes.select(*cell).distinct().withColumn("_start", F.lit(0).cast("long"))
    parts = []
    for name in strata:
        here = join_same(sizes.filter(F.col("stratum") == name), at, cell).withColumn("_stratum", F.lit("numpy"))
        parts.append(here)
        kinds = here.select(F.col("_stratum").alias("stratum"), "size", F.col("_start").alias("start")).distinct()
        used = words_used(kinds, boot.seed, boot.n_resamples).select("size", F.col("start").alias("_start"), "used")
        moved = here.join(used, ["size", "_start"]).select(*cell, "used")
        at = cut_lineage(
            join_same(at, moved, cell, "left").select(*cell, (F.col("_start") + F.coalesce("used", F.lit(0))).alias("_start"))
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def replicate_means(sums: DataFrame, cell: Sequence[str], patient: str, boot: Boot) -> DataFrame:
    """(cell, replicate, mean): the mean over values of the drawn patients."""
    cell, members = list(cell), counted(sums)
    listed = indexed(members, cell, patient, boot).select(*cell, "idx", "total", "values")
    streams = one_stream(sizes_of(members, cell), "numpy" if boot.method == "numpy" else "all")
    added = weighted_sums(listed, cell, streams, ["total", "values"], boot.seed, boot.n_resamples, boot.method)
    return added.select(*cell, "replicate", (F.col("total") / F.col("values")).alias("mean"))


def poisson_means(sums: DataFrame, cell: Sequence[str], patient: str, boot: Boot) -> DataFrame:
    """Poisson bootstrap for very many patients: one pass, no join, sample size not fixed.

    Opt-in. The weight of a patient in a replicate is a Poisson(1) variate read off a hash, so
    rows are weighted where they lie and only cells x replicates are shuffled. All cells of a patient
    share its weights, which are hashed once; the last ten hex digits of ``draw`` are compared as they are.
    """
    cell = list(cell)
    limits, term, below = [], 0.36787944117144233, 0.0
    for k in range(1, 18):
        below += term
        limits.append(floor(Fraction(below) * (1 << 40) - Fraction(1, 2)) + 1)
        term /= k
    digest = F.md5(F.concat_ws("|", F.lit(str(boot.seed)), F.lit("poisson"), F.col("replicate").cast("string"), F.col(patient).cast("string")))
    limits = [f"{m:010x}" for m in limits if m < 1 << 40]
    weight = F.lit(len(limits))
    for k in range(len(limits) - 1, -1, -1):
        weight = F.when(F.col("_digits") < limits[k], F.lit(k)).otherwise(weight)
    patients = counted(sums).groupBy(patient).agg(F.collect_list(F.struct(*cell, "total", "values")).alias("_cells"))
    # Dealt by number: few bytes become many draws, and AQE would merge them into few tasks.
    dealt = patients.repartition(width(sums.sparkSession), F.xxhash64(patient))
    drawn = dealt.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(boot.n_resamples - 1)))).select(
        "replicate", "_cells", F.substring(digest, 6, 10).alias("_digits")
    )
    weighted = drawn.select("replicate", weight.alias("_w"), "_cells").filter("_w > 0").select("replicate", "_w", F.inline("_cells"))
    return (
        weighted.groupBy(*cell, "replicate")
        .agg(F.try_divide(F.sum(F.col("total") * F.col("_w")), F.sum(F.col("values") * F.col("_w"))).alias("mean"))
        .filter("mean IS NOT NULL")
    )


def interval(replicates: DataFrame, cell: Sequence[str], boot: Boot, value: str = "mean") -> DataFrame:
    tails = replicates.groupBy(*cell).agg(F.percentile(value, boot.tails()).alias("_ci"))
    return tails.select(
        *cell, F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high")
    )


def estimate(
    rows: DataFrame,
    cell: Sequence[str],
    boot: Boot,
    patient: str = "patient_id",
    value: str = "value",
    method: str = "exact",
) -> DataFrame:
    """Per cell: value, interval, n patients and n measurements.

    The value is the mean over measurements. Cells without a defined value keep a row with
    NULL and n = 0; one patient gives a degenerate interval.
    """
    cell = list(cell)
    return estimate_sums(cluster_sums(rows, cell, patient, value), cell, boot, patient, method)


def estimate_sums(
    sums: DataFrame, cell: Sequence[str], boot: Boot, patient: str = "patient_id",
    method: str = "exact",
) -> DataFrame:
    """``estimate`` from sums per patient."""
    cell = list(cell)
    points = sums.groupBy(*cell).agg(
        F.try_divide(F.sum("total"), F.sum("values")).alias("value"),
        F.count_if(F.col("values") > 0).alias("n"),
        F.sum("measured").alias("n_measurements"),
    )
    means = {"exact": replicate_means, "poisson": poisson_means}[method]
    tails = interval(means(sums, cell, patient, boot), cell, boot)
    single = F.col("n") == 1
    return join_same(points, tails, cell, "left").select(
        *cell,
        "value",
        F.when(single, F.col("value")).otherwise(F.col("ci_low")).alias("ci_low"),
        F.when(single, F.col("value")).otherwise(F.col("ci_high")).alias("ci_high"),
        "n",
        "n_measurements",
    )


def with_all_vendors(rows: DataFrame, vendor: str = "vendor", name: str = "all_vendors") -> DataFrame:
    """Each row under its vendor and once more under the pooled name: both blocks, one pass."""
    return rows.withColumn(vendor, F.explode(F.array(F.col(vendor), F.lit(name))))


def by_vendor(rows: DataFrame, boot: Boot, cell: Sequence[str] = ("cls", "metric")) -> DataFrame:
    """Estimates per vendor, and over all vendors beside them."""
    return estimate(with_all_vendors(rows), ["vendor", *cell], boot)


def element_estimate(rows: DataFrame, cell: Sequence[str], boot: Boot, element: str) -> DataFrame:
    """Each measurement as its own cluster."""
    return estimate(rows, cell, boot, patient=element)


def strata(held: DataFrame, ref: DataFrame, cell: Sequence[str], patient: str) -> DataFrame:
    """Patients of two arms, one row each: in the held-out arm, the in-domain arm, or both."""
    keys = [*cell, patient]
    both = held.select(*keys, F.col("value").alias("held")).join(
        ref.select(*keys, F.col("value").alias("ref")), keys, "full"
    )
    kind = (
        F.when(F.col("ref").isNull(), F.lit("held_only"))
        .when(F.col("held").isNull(), F.lit("ref_only"))
        .otherwise(F.lit("both"))
    )
    return both.withColumn("stratum", kind)


def joint_difference(
    held: DataFrame, ref: DataFrame, cell: Sequence[str], boot: Boot, patient: str = "patient_id"
) -> DataFrame:
    """Held-out minus in-domain mean under one patient draw, one value per patient and arm.

    Each stratum is resampled at its fixed size and a shared patient is drawn once for both arms.
    """
    cell = list(cell)
    members = cut_lineage(strata(held, ref, cell, patient))
    inner = [*cell, "stratum"]
    totals = members.groupBy(*cell).agg(
        F.count("held").alias("n_held"),
        F.count("ref").alias("n_ref"),
        F.avg("held").alias("_mean_held"),
        F.avg("ref").alias("_mean_ref"),
    )
    listed = indexed(members, inner, patient, boot).select(*inner, "idx", "held", "ref")
    streams = stream_after_stream(sizes_of(members, inner), cell, ("held_only", "ref_only", "both"), boot)
    by_stratum = weighted_sums(listed, inner, streams, ["held", "ref"], boot.seed, boot.n_resamples, boot.method)
    sums = by_stratum.groupBy(*cell, "replicate").agg(F.sum("held").alias("held"), F.sum("ref").alias("ref"))
    diffs = join_same(sums, totals, cell).withColumn(
        "mean", F.col("held") / F.col("n_held") - F.col("ref") / F.col("n_ref")
    )
    tails = interval(diffs, cell, boot)
    return join_same(totals, tails, cell, "left").select(
        *cell,
        (F.col("_mean_held") - F.col("_mean_ref")).alias("difference"),
        "ci_low",
        "ci_high",
        "n_held",
        "n_ref",
    )


def independent_difference(
    held: DataFrame, ref: DataFrame, cell: Sequence[str], boot: Boot, patient: str = "patient_id"
) -> DataFrame:
    """Arms resampled independently: only for figures first published that way."""
    cell = list(cell)
    inner = [*cell, "stratum"]
    members = counted(
        cluster_sums(
            held.withColumn("stratum", F.lit("held")).unionByName(ref.withColumn("stratum", F.lit("ref"))), inner, patient, "value"
        )
    )
    listed = indexed(members, inner, patient, boot).select(*inner, "idx", "total", "values")
    streams = stream_after_stream(sizes_of(members, inner), cell, ("held", "ref"), boot)
    means = weighted_sums(listed, inner, streams, ["total", "values"], boot.seed, boot.n_resamples, boot.method)

    def apart(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        side = F.col("stratum") == "held"
        mean = F.sum("total") / F.sum("values")
        each = df.groupBy(*keys, "stratum").agg(mean.alias("m"))
        both = each.groupBy(*keys).agg(F.max(F.when(side, F.col("m"))).alias("h"), F.max(F.when(~side, F.col("m"))).alias("r"))
        return both.select(*keys, (F.col("h") - F.col("r")).alias("mean"))

    tails = interval(apart(means, [*cell, "replicate"]), cell, boot)
    points = apart(members, cell).filter("mean IS NOT NULL").withColumnRenamed("mean", "difference")
    return join_same(points, tails, cell).select(*cell, "difference", "ci_low", "ci_high")


def with_boot(estimates: DataFrame, boot: Boot) -> DataFrame:
    """The estimate as the struct a record stores."""
    return estimates.withColumn(
        "estimate",
        F.struct(
            "value",
            "ci_low",
            "ci_high",
            "n",
            F.lit(boot.unit).alias("n_unit"),
            "n_measurements",
            F.struct(
                F.lit(boot.n_resamples).alias("n_resamples"),
                F.lit(boot.alpha).alias("alpha"),
                F.lit(boot.seed).cast("bigint").alias("seed"),
                F.lit(boot.unit).alias("unit"),
            ).alias("bootstrap"),
        ),
    )
