"""Access, epoch and telemetry logs in batch."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscale.operators.select import first_and_last_means
from cohortscale.plans.ordered import join_same, range_bucket, running

EPOCHS_PER_BUCKET = 4096
DETERMINISM = r"^\s*(\S+) does not have a deterministic implementation"


def access_counts(log: DataFrame) -> DataFrame:
    """Runs that opened a bucket: distinct run ids, and entries without one counted singly."""
    return log.groupBy("bucket", "fold_id").agg(
        (F.count_distinct("run_id") + F.count_if(F.col("run_id").isNull())).alias("accesses")
    )


def gate_calls(log: DataFrame) -> DataFrame:
    """Raw entries per bucket and fold."""
    return log.groupBy("bucket", "fold_id").agg(F.count("*").alias("calls"))


def prior_accesses(log: DataFrame) -> DataFrame:
    """Accesses before every entry: runs first met earlier, and earlier entries without a run.

    ``log`` has (bucket, fold_id, ts, entry, run_id). The running sum goes by ranges of (ts, entry), whatever falls into one hour.
    """
    keys = ["bucket", "fold_id"]
    firsts = (
        log.filter("run_id IS NOT NULL")
        .groupBy(*keys, "run_id")
        .agg(F.min(F.struct("ts", "entry")).alias("f"))
        .select(*keys, F.col("f.entry").alias("entry"), F.lit(True).alias("_first"))
    )
    counted = (F.col("_first").isNotNull() | F.col("run_id").isNull()).cast("bigint")
    flagged = join_same(log, firsts, [*keys, "entry"], "left").withColumn("_counts", counted)
    tagged = range_bucket(flagged, [*keys, "ts", "entry"])
    out = running(tagged, keys, "_part", ["ts", "entry"], {"prior": ("sum", "_counts", False)})
    return out.drop("_first", "_counts", "_part")


def audit_findings(log: DataFrame) -> DataFrame:
    """Entries whose recorded ``prior_accesses`` is not the count of earlier accesses."""
    return prior_accesses(log).filter(~F.col("prior_accesses").eqNullSafe(F.col("prior")))


def best_and_patience(epochs: DataFrame, run: Sequence[str], metric: str = "val_dice") -> DataFrame:
    """Best metric so far, its epoch, and validated epochs since it; epochs count from 0.

    Epochs without validation neither improve nor count. Buckets are ranges of epochs, so a run
    of any length is never sorted as a whole.
    """
    run = list(run)
    m = F.nanvl(F.col(metric), F.lit(None).cast("double"))
    rows = epochs.withColumn("_m", m).withColumn("_b", F.floor(F.col("epoch") / EPOCHS_PER_BUCKET))
    first = running(
        rows,
        run,
        "_b",
        ["epoch"],
        {
            "_before": ("max", "_m", False),
            "_validated": ("sum", F.col("_m").isNotNull().cast("bigint"), True),
        },
    )
    improved = F.col("_m").isNotNull() & (F.col("_before").isNull() | (F.col("_m") > F.col("_before")))
    second = running(
        first.withColumn("improved", improved),
        run,
        "_b",
        ["epoch"],
        {
            "_at": ("max", F.when(F.col("improved"), F.col("_validated")), True),
            "best_epoch": ("max", F.when(F.col("improved"), F.col("epoch")), True),
        },
    )
    return second.select(
        *epochs.columns,
        "improved",
        F.greatest("_before", "_m").alias("best_metric"),
        F.coalesce("best_epoch", F.lit(-1)).cast("bigint").alias("best_epoch"),
        F.coalesce(F.col("_validated") - F.col("_at"), F.lit(0)).alias("since_improvement"),
    )


def stopped_early(patience: DataFrame, run: Sequence[str], limit: int) -> DataFrame:
    """First epoch at which a run had no improvement for ``limit`` validated epochs."""
    return (
        patience.filter((F.col("since_improvement") >= limit) & (F.col("best_epoch") >= 0))
        .groupBy(*run).agg(F.min("epoch").alias("stopped_at"))
    )


def sessions(
    events: DataFrame, run: Sequence[str], start: Column, end: Column, order: Sequence[str]
) -> DataFrame:
    """Sessions of a run by their start events: length, whether they ended, whether they resume.

    Rows before the first start are session 0; ``order`` leaves no ties. Ranges of it are the
    buckets, so a busy hour is no task's.
    """
    run = list(run)
    flagged = range_bucket(events.withColumn("_start", start.cast("bigint")).withColumn("_end", end), [*run, *order])
    numbered = running(flagged, run, "_part", order, {"session": ("sum", "_start", True)})
    return numbered.groupBy(*run, "session").agg(
        F.min(order[0]).alias("from_ts"),
        F.max(order[0]).alias("to_ts"),
        F.count("*").alias("events"),
        F.bool_or("_end").alias("ended"),
        (F.col("session") > 1).alias("resumed"),
    )


def unterminated(sessions_: DataFrame) -> DataFrame:
    return sessions_.filter((F.col("session") > 0) & ~F.col("ended"))


def loss_criterion(epochs: DataFrame, run: Sequence[str], loss: str, k: int = 3, least: float = 0.10) -> DataFrame:
    """Relative fall of the mean loss from the first to the last ``k`` epochs, and the verdict."""
    means = first_and_last_means(epochs, run, loss, k)
    fall = F.try_divide(F.col("first_mean") - F.col("last_mean"), F.col("first_mean"))
    return means.withColumn("reduction", fall).withColumn(
        "passed", F.coalesce(F.col("reduction") >= least, F.lit(False))
    )


def training_curves(log: DataFrame, kind: Column, columns: Sequence[str]) -> DataFrame:
    return log.filter(kind).select(*columns)


def telemetry_summary(samples: DataFrame, run: Sequence[str]) -> DataFrame:
    """Temperature range, peak share of memory, samples and failed samples."""
    return samples.groupBy(*run).agg(
        F.min("temperature").alias("min_temperature"),
        F.max("temperature").alias("max_temperature"),
        F.max(F.try_divide(F.col("memory_used"), F.col("memory_total"))).alias("peak_memory_share"),
        F.count("*").alias("samples"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def epoch_timing(epochs: DataFrame, frames: DataFrame, run: Sequence[str]) -> DataFrame:
    """Seconds per epoch, and the mean against the number of training frames."""
    t = epochs.groupBy(*run).agg(
        F.min("seconds").alias("shortest"), F.max("seconds").alias("longest"),
        F.avg("seconds").alias("mean"), F.sum("seconds").alias("total"), F.count("*").alias("epochs"),
    )
    return t.join(frames, list(run)).withColumn(
        "seconds_per_frame", F.try_divide(F.col("mean"), F.col("frames").cast("double"))
    )


def warning_rollup(messages: DataFrame, run: Sequence[str] = (), chars: int | None = None) -> DataFrame:
    """One row per operation: how often it warned, and its first message by sequence.

    A message that names no operation stands for itself by its first line; ``chars`` takes only that
    many characters of it, so that messages that differ further on are one operation.
    """
    trimmed = F.trim("message")
    named = F.regexp_extract("message", DETERMINISM, 1)
    first_line = F.split(trimmed, "\n", 2)[0]
    if chars is not None:
        first_line = F.substring(first_line, 1, chars)
    op = F.when(named != "", named).otherwise(first_line)
    return messages.withColumn("operation", op).groupBy(*run, "operation").agg(
        F.count("*").alias("count"), F.min_by(trimmed, "seq").alias("first_seen")
    )


def determinism(runs: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """Achieved only if granted and nothing fell back; whether the recorded flag agrees."""
    counts = fallbacks.groupBy("run").agg(F.count("*").alias("fallbacks"))
    achieved = F.col("granted") & (F.col("fallbacks") == 0)
    return (
        runs.join(counts, "run", "left").fillna(0, ["fallbacks"])
        .withColumn("achieved", achieved)
        .withColumn("consistent", F.col("achieved") == F.col("recorded"))
    )


def phase_fractions(timings: DataFrame, elapsed: DataFrame, phases: Sequence[str]) -> DataFrame:
    """Share of each phase in the accounted time, and the time no phase accounts for."""
    wide = timings.groupBy("run").agg(
        *[F.sum(F.when(F.col("phase") == p, F.col("seconds")).otherwise(F.lit(0.0))).alias(p) for p in phases]
    )
    accounted = sum((F.col(p) for p in phases[1:]), F.col(phases[0]))
    return wide.join(elapsed, "run").select(
        "run",
        *[F.try_divide(F.col(p), accounted).alias(f"{p}_fraction") for p in phases],
        (F.col("elapsed") - accounted).alias("unaccounted"),
    )
