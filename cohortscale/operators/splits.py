"""Leave-one-vendor-out splits at patient level, and the checks that nothing leaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscale.functions.hashing import order_hash
from cohortscale.plans.ordered import hash_ranked

BUCKETS = ("train", "val", "test", "in_domain_ref")


def bucket_sizes(n: Column, val_fraction: float, ref_fraction: float) -> tuple[Column, Column]:
    """(n_ref, n_val): rounded half to even, then shrunk until a training patient remains.

    While the two fill the fold, the larger one gives up a patient (validation on a tie). With
    fractions below 1 in sum, rounding exceeds that by at most two, so two steps are enough.
    """
    ref = F.bround(n * F.lit(ref_fraction)).cast("bigint")
    val = F.bround(n * F.lit(val_fraction)).cast("bigint")
    for _ in range(2):
        full = (ref + val >= n) & (ref + val > 0)
        shrink_val = full & (val >= ref)
        shrink_ref = full & (val < ref)
        ref, val = (
            F.when(shrink_ref, ref - 1).otherwise(ref),
            F.when(shrink_val, val - 1).otherwise(val),
        )
    return ref, val


def leave_one_vendor_out(
    manifest: DataFrame,
    held_out_vendors: Sequence[str],
    val_fraction: float,
    seed: int,
    ref_fraction: float = 0.15,
) -> DataFrame:
    """All folds at once, as a long table of one row per fold and patient.

    The seeded shuffle is an order by hash of (seed, fold, patient): it does not depend on
    partitioning, and ranks are taken within hash buckets, never over a whole fold in one task.
    """
    for name, value in (("val_fraction", val_fraction), ("ref_fraction", ref_fraction)):
        if not 0.0 <= value < 1.0:
            raise ValueError(f"{name} must be in [0, 1), got {value}")
    if val_fraction + ref_fraction >= 1.0:
        raise ValueError("val_fraction + ref_fraction must leave patients for training")
    if not held_out_vendors:
        raise ValueError("name at least one vendor to hold out")
    patients = manifest.select("patient_id", "vendor").distinct()
    folds = patients.withColumn(
        "held_out_vendor", F.explode(F.array(*[F.lit(v) for v in held_out_vendors]))
    )
    rest = folds.filter(F.col("vendor") != F.col("held_out_vendor"))
    shuffled = hash_ranked(
        rest,
        ["held_out_vendor"],
        order_hash(seed, F.col("patient_id"), F.col("held_out_vendor")),
        ["patient_id"],
    )
    n_ref, n_val = bucket_sizes(F.col("n"), val_fraction, ref_fraction)
    sizes = rest.groupBy("held_out_vendor").agg(F.count("*").alias("n"))
    sizes = sizes.select("held_out_vendor", n_ref.alias("n_ref"), n_val.alias("n_val"))
    rank = F.col("rank")
    inside = shuffled.join(sizes, "held_out_vendor").select(
        "held_out_vendor",
        F.when(rank <= F.col("n_ref"), F.lit("in_domain_ref"))
        .when(rank <= F.col("n_ref") + F.col("n_val"), F.lit("val"))
        .otherwise(F.lit("train"))
        .alias("bucket"),
        "patient_id",
        "vendor",
    )
    test = folds.filter(F.col("vendor") == F.col("held_out_vendor")).select(
        "held_out_vendor", F.lit("test").alias("bucket"), "patient_id", "vendor"
    )
    return inside.unionByName(test).select(
        F.concat("held_out_vendor", F.lit("_holdout")).alias("fold_id"),
        "bucket",
        "patient_id",
        "vendor",
        "held_out_vendor",
        F.lit(seed).cast("bigint").alias("seed"),
    )


def overlap_violations(split: DataFrame, manifest: DataFrame) -> DataFrame:
    """Leaks of a split: unknown, shared, unassigned and wrong-vendor patients, per fold."""
    known = manifest.select("patient_id", F.col("vendor").alias("true_vendor")).distinct()
    folds = split.select("fold_id").distinct()
    seen = split.groupBy("fold_id", "patient_id").agg(
        F.count_distinct("bucket").alias("buckets"),
        F.bool_or(F.col("bucket") == "test").alias("in_test"),
        F.min("held_out_vendor").alias("held_out_vendor"),
    )
    tagged = seen.join(known.withColumn("_known", F.lit(True)), "patient_id", "left")
    unknown = F.col("_known").isNull()
    wrong = F.col("in_test") & (F.col("true_vendor") != F.col("held_out_vendor"))
    problems = tagged.withColumn(
        "problem",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(unknown, F.lit("unknown")),
                    F.when(F.col("buckets") > 1, F.lit("shared")),
                    F.when(wrong, F.lit("wrong_vendor")),
                )
            )
        ),
    ).select("fold_id", "patient_id", "problem")
    # Folds are few (one per held-out vendor), so every patient is expected once in each.
    per_patient = split.groupBy("patient_id").agg(F.collect_set("fold_id").alias("have"))
    all_folds = folds.agg(F.collect_set("fold_id").alias("want"))
    missing = (
        known.select("patient_id")
        .join(per_patient, "patient_id", "left")
        .join(F.broadcast(all_folds))
        .withColumn(
            "fold_id",
            F.explode(
                F.when(F.col("have").isNull(), F.col("want")).otherwise(
                    F.array_except("want", "have")
                )
            ),
        )
        .select("fold_id", "patient_id", F.lit("unassigned").alias("problem"))
    )
    return problems.unionByName(missing)


def expand_to_frames(split: DataFrame, frame_counts: DataFrame) -> DataFrame:
    """Frames inherit the bucket of their volume; a frame id is ``patient#0007``."""
    counts = frame_counts.select("patient_id", "frames")
    return (
        split.join(counts, "patient_id")
        .filter("frames > 0")
        .withColumn("frame_index", F.explode(F.sequence(F.lit(0), F.col("frames") - 1)))
        .select(
            "fold_id",
            "bucket",
            "patient_id",
            "frame_index",
            F.format_string("%s#%04d", F.col("patient_id").cast("string"), F.col("frame_index")).alias(
                "frame_id"
            ),
        )
    )


def frame_count_violations(split: DataFrame, frame_counts: DataFrame) -> DataFrame:
    """Assigned patients without a frame count, or with none: refused, never dropped."""
    patients = split.select("patient_id").distinct()
    joined = patients.join(frame_counts.select("patient_id", "frames"), "patient_id", "left")
    return joined.filter("frames IS NULL OR frames <= 0").select(
        "patient_id",
        "frames",
        F.when(F.col("frames").isNull(), F.lit("missing")).otherwise(F.lit("empty")).alias("problem"),
    )


def frame_overlap_violations(frames: DataFrame, manifest: DataFrame) -> DataFrame:
    """The leak checks again on expanded frames, and every frame exactly once per fold."""
    known = manifest.select("patient_id").distinct()
    unknown = (
        frames.select("fold_id", "patient_id").distinct().join(known, "patient_id", "left_anti")
    ).select("fold_id", "patient_id", F.lit("unknown").alias("problem"))
    per_patient = frames.groupBy("fold_id", "patient_id").agg(
        F.count_distinct("bucket").alias("buckets"),
        F.count("*").alias("rows"),
        F.count_distinct("frame_id").alias("ids"),
    )
    shared = per_patient.filter("buckets > 1").select(
        "fold_id", "patient_id", F.lit("shared").alias("problem")
    )
    repeated = per_patient.filter("rows > ids").select(
        "fold_id", "patient_id", F.lit("repeated_frame").alias("problem")
    )
    return unknown.unionByName(shared).unionByName(repeated)


def frame_records(frames: DataFrame, manifest: DataFrame) -> DataFrame:
    """Frames with the attributes of their volume. A frame without one stays, unmatched."""
    volume = manifest.select(
        "patient_id", "sample_id", "vendor", "source_path", "spacing_mm", "intensity_window",
        F.lit(True).alias("matched"),
    )
    out = frames.join(volume, "patient_id", "left").withColumn(
        "matched", F.coalesce("matched", F.lit(False))
    )
    return out.withColumn(
        "parsed_index", F.regexp_extract("frame_id", r"#(\d+)$", 1).cast("int")
    )


def split_flow(split: DataFrame, vendors: Sequence[str]) -> DataFrame:
    """Patients per fold and bucket, with a column per vendor."""
    return (
        split.groupBy("fold_id", "bucket")
        .pivot("vendor", list(vendors))
        .agg(F.count(F.lit(1)))
        .fillna(0)
        .withColumn("patients", sum((F.col(v) for v in vendors[1:]), F.col(vendors[0])))
    )


def split_documents(split: DataFrame, parts: int = 1) -> DataFrame:
    """Per fold, the sorted patient list of every bucket: the form saved as JSON.

    ``parts`` documents of the same fields hold a fold, each the patients of one part by hash: one, as the form was
    first meant, or more for cohorts of many millions.
    """
    lists = [
        F.sort_array(F.collect_list(F.when(F.col("bucket") == b, F.col("patient_id")))).alias(b)
        for b in BUCKETS
    ]
    part = F.pmod(F.xxhash64("patient_id"), F.lit(parts)).alias("_part")
    return split.groupBy("fold_id", "held_out_vendor", "seed", part).agg(*lists).drop("_part")


def epoch_order(items: DataFrame, seed: int, epochs: Sequence[int], key: str) -> DataFrame:
    """Position of every item in every epoch: a function of (seed, epoch, item) alone."""
    out = items.select(key).withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in epochs])))
    ranks = hash_ranked(out, ["epoch"], order_hash(seed, F.col(key), F.col("epoch")), [key])
    return ranks.select("epoch", key, F.col("rank").alias("position"))
