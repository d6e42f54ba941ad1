"""The log operators as streams.

Counts, windows and sessions are native streaming aggregations in append mode: a window leaves the state, and is
written once, when the watermark has passed it. Operators that carry a value over a run keep one small
fold per key in the keyed state store, a hot run being many keys, and the folds are put together where they are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from cohortscale.operators import logs
from cohortscale.plans.ordered import join_same, range_bucket, running
from cohortscale.session import cut_lineage, scratch_path


def read_parquet_log(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def read_json_log(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def append_json(stream: DataFrame, path: str, checkpoint: str):
    """Append-only JSON Lines sink, checkpointed; processes what is there and stops."""
    return (
        stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def run_to_table(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what is there and return its result, kept as files.

    ``complete`` and ``update`` results are replaced per batch, ``append`` results are added.
    """
    spark = stream.sparkSession
    root = scratch_path(spark, name)
    if mode == "append":
        query = (
            stream.writeStream.format("parquet").option("path", f"{root}/out")
            .option("checkpointLocation", f"{root}/checkpoint").outputMode("append")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/out")

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out")

    query = (
        stream.writeStream.foreachBatch(replace).option("checkpointLocation", f"{root}/checkpoint")
        .outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def follow(
    parts: Iterable[DataFrame], schema: str, build: Callable[[DataFrame], DataFrame], name: str,
    sink: Callable[[DataFrame, int], None] | None = None, progress: list | None = None, lines: bool = False,
) -> DataFrame | None:
    """Append the parts to a log one after another and let a stream follow it; what it appended so far is returned.

    The stream stops when it has caught up and goes on from its checkpoint with the next part, so its state outlives
    every stop. ``build`` makes the stream from the log; ``sink`` writes a batch by its number instead
    of appending it. ``lines``: the log is text, one row a line, not JSON. ``progress`` is added what the stream reports of its batches.
    """
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    root = None
    for part in parts:
        spark = part.sparkSession
        if root is None:
            root = scratch_path(spark, name)
            keyed_state(spark)
        kind = "text" if lines else "json"
        part.write.mode("append").options(**exact).format(kind).save(f"{root}/log")
        made = build(spark.readStream.schema(schema).options(**exact).format(kind).load(f"{root}/log"))
        writer = made.writeStream.outputMode("append").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
        if sink:
            writer = writer.foreachBatch(sink)
        else:
            writer = writer.format("parquet").option("path", f"{root}/out")
        query = writer.start()
        query.awaitTermination()
        if progress is not None:
            progress += query.recentProgress
    return None if sink else spark.read.schema(made.schema).parquet(f"{root}/out")


def keyed_state(spark: SparkSession) -> None:
    """State that is looked up by key and kept beside the executors; only its changes are written in a batch."""
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)


def access_counts(log: DataFrame) -> DataFrame:
    """Runs per bucket and fold; the state is the set of runs. Entries without a run are singles, kept nowhere."""
    keys = ["bucket", "fold_id"]
    runs = log.filter("run_id IS NOT NULL").dropDuplicates([*keys, "run_id"]).select(*keys)
    singles = log.filter("run_id IS NULL").select(*keys)
    return runs.union(singles).groupBy(*keys).agg(F.count("*").alias("accesses"))


def gate_calls(log: DataFrame) -> DataFrame:
    return log.groupBy("bucket", "fold_id").agg(F.count("*").alias("calls"))


def _held(names: Sequence[str], key: tuple, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The rows of a key in this batch, its columns among them whether or not they come with the rows."""
    held = pd.concat(list(rows), ignore_index=True)
    for name, value in zip(names, key):
        if name not in held.columns:
            held[name] = pd.Series([value] * len(held), index=held.index, dtype=object if value is None else None)
    return held


#: Keys that the rows of one run are dealt to.
SALTS = 16


def counted_accesses(log: DataFrame) -> DataFrame:
    """``log`` (bucket, fold_id, ts, entry, run_id, ...) and, marked by ``_met``, a row for each run that is met the first time.

    What is kept is one mark per run, looked up by key. A run's rows are dealt to ``SALTS`` keys first; of each only the
    first goes on to the run's own key, so a run with most of the entries is no task's. ``prior_sink`` says which
    entry of the batch it is that counts.
    """
    keys = ["bucket", "fold_id", "run_id"]
    salted = log.filter("run_id IS NOT NULL").select(*keys, F.pmod(F.xxhash64("entry"), F.lit(SALTS)).cast("int").alias("_salt"))
    runs = salted.dropDuplicates([*keys, "_salt"]).select(*keys).dropDuplicates(keys)
    return log.withColumn("_met", F.lit(False)).unionByName(runs.withColumn("_met", F.lit(True)), allowMissingColumns=True)


def _with_counts(batch: DataFrame) -> DataFrame:
    """The entries of a stored batch of ``counted_accesses`` with ``counts``: whether an entry is a new access.

    That is the first entry by (ts, entry) of a run met the first time, one of those that tie, and every entry without a run.
    """
    placed = batch.withColumn("_row", F.monotonically_increasing_id())
    order = F.struct(F.col("ts").isNull(), "ts", F.col("entry").isNull(), "entry", F.col("_row").alias("row"))
    firsts = placed.groupBy("bucket", "fold_id", "run_id").agg(F.bool_or("_met").alias("_met"), F.min(F.when(~F.col("_met"), order)).alias("_first"))
    firsts = firsts.filter("_met").select(F.col("_first.row").alias("_row"), F.lit(True).alias("_counts"))
    counts = F.col("run_id").isNull() | F.col("_counts").isNotNull()
    return placed.filter("NOT _met").join(firsts, "_row", "left").withColumn("counts", counts).drop("_row", "_met", "_counts")


def prior_sink(root: str) -> Callable[[DataFrame, int], None]:
    """Writes every batch of ``counted_accesses`` with the accesses before each entry, under its number.

    Beside it goes a row per bucket and fold with the accesses of the batch. A batch reads itself and those rows of
    earlier batches, nothing else of the past. Within a batch entries go by (ts, entry), batches as they came.
    """
    keys = ["bucket", "fold_id"]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kinds = dict(batch.dtypes)
        totals = spark.read.schema(f"bucket {kinds['bucket']}, fold_id {kinds['fold_id']}, n long, batch long")
        known = [f"{root}/totals/batch={k}" for k in range(batch_id)]
        counted = _with_counts(cut_lineage(batch))
        tagged = range_bucket(counted.withColumn("_n", F.col("counts").cast("long")), [*keys, "ts", "entry"])
        out = running(tagged, keys, "_part", ["ts", "entry"], {"prior": ("sum", "_n", False)}).drop("_part", "_n")
        if known:
            before = totals.parquet(*known).groupBy(*keys).agg(F.sum("n").alias("_before"))
            out = join_same(out, before, keys, "left").withColumn("prior", F.col("prior") + F.coalesce("_before", F.lit(0))).drop("_before")
        out.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")
        here = tagged.groupBy(*keys).agg(F.sum("_n").alias("n"))
        here.write.mode("overwrite").parquet(f"{root}/totals/batch={batch_id}")

    return write


def follow_prior_accesses(parts: Iterable[DataFrame], schema: str) -> DataFrame:
    """Entries of a log that is followed part by part, with ``prior``: the accesses before each."""
    parts = list(parts)
    spark = parts[0].sparkSession
    root = scratch_path(spark, "prior-accesses")
    follow(parts, schema, counted_accesses, "access-log", prior_sink(root))
    return spark.read.parquet(f"{root}/out").drop("batch", "counts")


class _Patience(StatefulProcessor):
    """Running best, validated epochs and epochs since the best within one range of a run's epochs."""

    def __init__(self, keys: Sequence[str], metric: str):
        self.keys, self.metric = list(keys), metric

    def init(self, handle) -> None:
        self.fold = handle.getValueState("fold", "best double, best_epoch long, validated long, since long, last long")

    def handleInputRows(self, key, rows, timerValues):
        held = _held(self.keys, key, rows).sort_values("epoch", kind="stable", ignore_index=True)
        best, best_epoch, validated, since, last = self.fold.get() if self.fold.exists() else (None, -1, 0, 0, -1)
        late = (held["epoch"] <= last).to_numpy()
        epochs, values = held["epoch"].to_numpy()[~late], held[self.metric].to_numpy(float)[~late]
        defined = ~np.isnan(values)
        run = np.maximum.accumulate(np.concatenate([[-np.inf if best is None else best], np.where(defined, values, -np.inf)]))
        improved = defined & (run[1:] > run[:-1])
        count = validated + np.cumsum(defined)
        at = np.maximum.accumulate(np.where(improved, np.arange(len(values)), -1))
        found_epoch = np.where(at >= 0, epochs[at] if len(epochs) else 0, best_epoch)
        found_since = np.where(at >= 0, count - (count[at] if len(count) else 0), since + np.cumsum(defined))
        for name, kind in (("local_best", float), ("local_epoch", float), ("validated", float), ("local_since", float)):
            held[name] = np.full(len(held), np.nan, kind)
        held["improved"] = np.zeros(len(held), bool)
        held["late"] = late
        if len(epochs):
            held.loc[~late, "local_best"] = np.where(np.isinf(run[1:]), np.nan, run[1:])
            held.loc[~late, "local_epoch"], held.loc[~late, "validated"] = found_epoch, count
            held.loc[~late, "local_since"], held.loc[~late, "improved"] = found_since, improved
            top = None if np.isinf(run[-1]) else float(run[-1])
            self.fold.update((top, int(found_epoch[-1]), int(count[-1]), int(found_since[-1]), int(epochs[-1])))
        yield held

    def close(self) -> None:
        pass


def range_patience(log: DataFrame, run: Sequence[str], metric: str = "val_dice") -> DataFrame:
    """Every epoch with the best metric, its epoch and the patience within its range of epochs of the run.

    State is one fold per run and range, so a run of any length is many keys. An epoch at or before one that an earlier
    batch brought in its range came late: it is marked and left out. ``run_patience`` puts the ranges together.
    """
    keys = [*run, "_range"]
    rows = log.select(*run, "epoch", F.col(metric).cast("double").alias(metric)).withColumn("_range", F.floor(F.col("epoch") / logs.EPOCHS_PER_BUCKET))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = f"{ddl}, local_best double, local_epoch double, validated double, local_since double, improved boolean, late boolean"
    return rows.groupBy(*keys).transformWithStateInPandas(_Patience(keys, metric), outputStructType=out, outputMode="Append", timeMode="None")


def run_patience(ranges: DataFrame, run: Sequence[str], metric: str = "val_dice") -> DataFrame:
    """``range_patience`` as it stands, over whole runs: what ``logs.best_and_patience`` finds, and ``late``.

    Ranges before an epoch's own come in as one fold each: the best of them, the first to reach it, and the validated epochs.
    """
    run = list(run)
    last = ranges.filter("NOT late").groupBy(*run, "_range").agg(
        F.max_by(F.struct("local_best", "local_epoch", "validated", "local_since"), "epoch").alias("f")
    )
    of_run = Window.partitionBy(*run).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    folds = last.withColumn("_n", F.coalesce(F.sum("f.validated").over(of_run), F.lit(0.0)))
    reached = F.struct(
        F.col("f.local_best").alias("best"), (-F.col("_range")).alias("first"), F.col("f.local_epoch").alias("epoch"),
        (F.col("_n") + F.col("f.validated") - F.col("f.local_since")).alias("at"),
    )
    carried = folds.select(*run, "_range", "_n", F.max(F.when(F.col("f.local_best").isNotNull(), reached)).over(of_run).alias("_c"))
    rows = join_same(ranges, carried, [*run, "_range"], "left")
    own = F.col("local_best").isNotNull() & (F.col("_c").isNull() | (F.col("local_best") > F.col("_c.best")))
    here = ~F.col("late")
    return rows.select(
        *run, "epoch", metric, "late",
        (F.col("improved") & (F.col("_c").isNull() | (F.col(metric) > F.col("_c.best")))).alias("improved"),
        F.when(here, F.greatest("local_best", "_c.best")).alias("best_metric"),
        F.when(here, F.when(own, F.col("local_epoch")).otherwise(F.coalesce("_c.epoch", F.lit(-1.0)))).cast("bigint").alias("best_epoch"),
        F.when(
            here,
            F.when(own, F.col("local_since")).when(F.col("_c").isNull(), F.lit(0.0)).otherwise(F.col("_n") + F.col("validated") - F.col("_c.at")),
        ).cast("bigint").alias("since_improvement"),
    )


def follow_patience(parts: Iterable[DataFrame], schema: str, run: Sequence[str], metric: str = "val_dice") -> DataFrame:
    """Best metric and patience of a log that is followed part by part."""
    return run_patience(follow(parts, schema, lambda log: range_patience(log, run, metric), "epoch-log"), run, metric)


def late_sink(root: str, seconds: int) -> Callable[[DataFrame, int], None]:
    """Writes of every batch the rows that are late: older than the newest time of earlier batches by more than ``seconds``.

    A window with a watermark of so many seconds drops such rows; this counts what it drops, by run. A batch reads itself
    and one number of each earlier batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = [f"{root}/newest/batch={k}" for k in range(batch_id)]
        newest = spark.read.schema("newest long").parquet(*known).agg(F.max("newest")).first()[0] if known else None
        late = batch.filter(F.unix_micros("ts") < (newest or 0) - seconds * 1_000_000) if newest is not None else batch.filter("false")
        late.groupBy("run").agg(F.count("*").alias("late")).write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")
        batch.agg(F.max(F.unix_micros("ts")).alias("newest")).write.mode("overwrite").parquet(f"{root}/newest/batch={batch_id}")

    return write


def follow_late_rows(parts: Iterable[DataFrame], schema: str, seconds: int) -> DataFrame:
    """(run, late) of a log that is followed part by part."""
    parts = list(parts)
    spark = parts[0].sparkSession
    root = scratch_path(spark, "late-rows")
    follow(parts, schema, lambda log: log, "late-log", late_sink(root, seconds))
    return spark.read.parquet(f"{root}/out").groupBy("run").agg(F.sum("late").alias("late"))


def gap_sessions(log: DataFrame, gap: str, watermark: str, run: str = "run") -> DataFrame:
    """Sessions by inactivity: a session ends after ``gap`` without an event."""
    return (
        log.withWatermark("ts", watermark)
        .groupBy(run, F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("events"))
        .select(run, F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "events")
    )


def telemetry_windows(samples: DataFrame, width: str, watermark: str, slide: str | None = None) -> DataFrame:
    """Telemetry summary per run and time window, each (run, time) counted once."""
    return (
        samples.withWatermark("ts", watermark)
        .dropDuplicatesWithinWatermark(["run", "ts"])
        .groupBy("run", F.window("ts", width, slide or width).alias("w"))
        .agg(
            F.min("temperature").alias("min_temperature"),
            F.max("temperature").alias("max_temperature"),
            F.max("memory_share").alias("peak_memory_share"),
            F.count("*").alias("samples"),
            F.count_if(F.col("error").isNotNull()).alias("errors"),
        )
        .select(
            "run", F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"),
            "min_temperature", "max_temperature", "peak_memory_share", "samples", "errors",
        )
    )


