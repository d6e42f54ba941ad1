"""AUROC by midranks, and its bootstrap intervals, exact in integers.

Twice the Mann-Whitney count is a sum over distinct scores: positives at the score times (twice
the negatives below it plus the negatives tied with it). So cases are counted per score first,
and only the running number of negatives is needed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscale.operators.bootstrap import Boot
from cohortscale.operators.multiplicities import TASKS, WORK, drawn_runs, per_block, replicates_of_block
from cohortscale.plans.ordered import join_same, range_bucket, running
from cohortscale.session import width

#: Products of two counts pass the range of BIGINT.
WIDE = "decimal(19, 0)"


def score_counts(cases: DataFrame, cell: Sequence[str], score: str, label: str) -> DataFrame:
    """Positives and negatives per distinct score, tagged with a range bucket of the scores."""
    kept = cases.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    counts = kept.groupBy(*cell, F.col(score).alias("score")).agg(
        F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg")
    )
    return range_bucket(counts, [*cell, "score"])


def twice_u(counts: DataFrame, cell: Sequence[str]) -> DataFrame:
    """(cell, two_u, positives, negatives) from bucketed score counts."""
    below = running(counts, cell, "_part", ["score"], {"below": ("sum", "neg", False)})
    return below.groupBy(*cell).agg(
        F.sum(F.col("pos").cast(WIDE) * (2 * F.col("below") + F.col("neg")).cast(WIDE)).alias("two_u"),
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
    )


def _area() -> Column:
    total = 2 * F.col("positives").cast(WIDE) * F.col("negatives").cast(WIDE)
    return F.try_divide(F.col("two_u").cast("double"), total.cast("double"))


def auroc(cases: DataFrame, cell: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """(cell, auroc, positives, negatives); NULL with only one class. NaN scores are dropped."""
    out = twice_u(score_counts(cases, cell, score, label), cell)
    return out.select(*cell, _area().alias("auroc"), "positives", "negatives")


def _replicates(counts: DataFrame, cell: Sequence[str], strata: Sequence[str], boot: Boot) -> DataFrame:
    """(cell, replicate, two_u, positives, negatives) of every replicate; ``strata`` is one name, drawn together, or those of both labels.

    Cases of one score and label are interchangeable, so what goes to the tasks are the counts per score, not
    cases, and what comes back is one row per replicate. A cell's replicates are dealt to at most ``TASKS`` tasks, which
    hold its counts whole (16 bytes a score) and make the draws of a block at a time.
    """
    cell = list(cell)
    totals = counts.groupBy(*cell).agg(
        F.sum("pos").alias("_positives"), F.sum("neg").alias("_negatives"), F.count("*").alias("_scores")
    )
    size = F.col("_positives") + F.col("_negatives")
    drawn = size > 0 if len(strata) == 1 else (F.col("_positives") > 0) & (F.col("_negatives") > 0)
    per = F.when(size > 0, per_block("_size"))
    tasks = F.least(F.lit(TASKS), F.floor((F.lit(boot.n_resamples) - 1) / per) + 1, F.ceil(F.lit(boot.n_resamples) * size / WORK))
    totals = totals.filter(drawn).withColumn("_size", size).withColumn("_tasks", tasks.cast("long")).drop("_positives", "_negatives")
    rows = join_same(counts.drop("_part"), totals, cell)
    dealt = rows.withColumn("_task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tasks") - 1)))
    dealt = dealt.repartition(width(counts.sparkSession), *cell, "_task").sortWithinPartitions(*cell, "_task", "score")
    kinds = {f.name: f.dataType.simpleString() for f in counts.schema.fields}
    schema = "".join(f"`{c}` {kinds[c]}, " for c in cell) + "replicate int, two_u long, positives long, negatives long"
    names = [*cell, "replicate", "two_u", "positives", "negatives"]

    def of_cell(head: pa.RecordBatch, pos: np.ndarray, neg: np.ndarray) -> Iterator[pa.RecordBatch]:
        size, task, tasks = (head.column(c)[0].as_py() for c in ("_size", "_task", "_tasks"))
        runs = [np.stack([pos, neg], axis=1).ravel()] if len(strata) == 1 else [pos, neg]
        for first, found in drawn_runs(boot.seed, strata, runs, size, range(task, -(-boot.n_resamples // replicates_of_block(size)), tasks), boot.n_resamples):
            p, n = (found[0][:, 0::2], found[0][:, 1::2]) if len(strata) == 1 else found
            below = np.cumsum(n, axis=1) - n
            two_u = (p * (2 * below + n)).sum(axis=1)
            same = [head.column(c).take(pa.array(np.zeros(len(p), np.int64))) for c in cell]
            replicate = pa.array(np.arange(first, first + len(p), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*same, replicate, *(pa.array(x) for x in (two_u, p.sum(axis=1), n.sum(axis=1)))], names=names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head, missing = [], None, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                if not missing:
                    head, held = batch.slice(at, 1).take(pa.array([0])), []
                    missing = head.column("_scores")[0].as_py()
                part = batch.slice(at, missing)
                held.append([part.column(c).to_numpy().copy() for c in ("pos", "neg")])
                missing, at = missing - part.num_rows, at + part.num_rows
                if not missing:
                    yield from of_cell(head, *(np.concatenate(x) for x in zip(*held)))

    return dealt.select(*cell, "_size", "_task", "_tasks", "_scores", "pos", "neg").mapInArrow(each, schema)


def stratified_interval(
    cases: DataFrame, cell: Sequence[str], boot: Boot, score: str = "score", label: str = "label"
) -> DataFrame:
    """Positives and negatives resampled separately, their counts fixed.

    The interval is NULL ("not estimable") where every replicate separates perfectly, decided
    in integers; a cell with one class has no replicate and no interval.
    """
    cell = list(cell)
    counts = score_counts(cases, cell, score, label)
    point = twice_u(counts, cell).select(*cell, _area().alias("auroc"), "positives", "negatives")
    reps = _replicates(counts, cell, ("pos", "neg"), boot).withColumn("mean", _area())
    perfect = F.bool_and(F.col("two_u") == 2 * F.col("positives") * F.col("negatives"))
    tails = reps.groupBy(*cell).agg(
        F.percentile("mean", boot.tails()).alias("_ci"), perfect.alias("_perfect")
    )
    usable = F.when(~F.col("_perfect"), F.col("_ci"))
    return point.join(tails, cell, "left").select(
        *point.columns, usable[0].alias("ci_low"), usable[1].alias("ci_high")
    )


def unstratified_interval(
    cases: DataFrame, cell: Sequence[str], boot: Boot, score: str = "score", label: str = "label"
) -> DataFrame:
    """Cases resampled together; replicates lacking a class are dropped, and counted."""
    cell = list(cell)
    counts = score_counts(cases, cell, score, label)
    reps = _replicates(counts, cell, ("joint",), boot)
    usable = (F.col("positives") > 0) & (F.col("negatives") > 0)
    tails = reps.groupBy(*cell).agg(
        F.percentile(F.when(usable, _area()), boot.tails()).alias("_ci"),
        F.count_if(~usable).alias("dropped"),
    )
    return tails.select(
        *cell, F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high"), "dropped"
    )


def auroc_table(
    cases: DataFrame, stored: DataFrame, cell: Sequence[str], patient: str,
    score: str = "score", label: str = "label",
) -> DataFrame:
    """Recomputed against stored AUROC, and patients holding more than one case of a cell."""
    cell = list(cell)
    point = auroc(cases, cell, score, label)
    repeated = (
        cases.groupBy(*cell, patient).agg(F.count("*").alias("_n")).groupBy(*cell)
        .agg(F.count_if(F.col("_n") > 1).alias("repeated_patients"))
    )
    old = stored.select(*cell, F.col("auroc").alias("stored"))
    return point.join(repeated, cell).join(old, cell, "left").select(
        *point.columns,
        "repeated_patients",
        "stored",
        F.col("auroc").eqNullSafe(F.col("stored")).alias("matches"),
    )
