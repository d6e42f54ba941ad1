"""The given tables seen as cohort data.

No masks exist in the test data, so order lines stand in for voxels: an order is a sample, its
customer the patient, the market segment the vendor, the return flag the class. ``lattice``
places the lines of a customer on a 7 x 16 x 16 grid, which gives shapes for surfaces.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscale.operators import masks, splits
from cohortscale.plans.ordered import range_bucket, running
from cohortscale.session import stored, tasks_for, width

CLASSES = ("A", "N", "R")
VENDORS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
GRID_SHAPE = (7, 16, 16)
SEED = 20260916
# Stand-in spacings per vendor in mm (axial, lateral, separation), all components distinct.
SPACING = {
    "AUTOMOBILE": (0.0020, 0.0117, 0.0469),
    "BUILDING": (0.0039, 0.0110, 0.1200),
    "FURNITURE": (0.0026, 0.0118, 0.0470),
    "HOUSEHOLD": (0.0035, 0.0120, 0.0940),
    "MACHINERY": (0.0030, 0.0100, 0.0600),
}


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def samples(self) -> DataFrame:
        """Every order is a sample; orders without lines are all-background samples."""
        owner = self.table("customer").select(
            F.col("c_custkey").alias("patient_id"), F.col("c_mktsegment").alias("vendor")
        )
        return (
            self.table("orders")
            .select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("patient_id"))
            .join(owner, "patient_id")
            .select("sample_id", "patient_id", "vendor")
        )

    @cached_property
    def case_voxels(self) -> DataFrame:
        """Paired voxels: (sample_id, cls, z, y, x, predicted, reference, price)."""
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("sample_id"),
            F.col("l_returnflag").alias("cls"),
            F.col("l_linenumber").alias("z"),
            F.col("l_partkey").alias("y"),
            F.col("l_suppkey").alias("x"),
            (F.col("l_discount") >= 0.05).alias("p"),
            (F.col("l_tax") >= 0.04).alias("r"),
            F.col("l_extendedprice").alias("price"),
        )
        return lines.groupBy("sample_id", "cls", "z", "y", "x").agg(
            F.bool_or("p").alias("predicted"),
            F.bool_or("r").alias("reference"),
            F.max("price").alias("price"),
        )

    @cached_property
    def voxel_counts(self) -> DataFrame:
        """Counts and score per sample and class that has a voxel."""
        score = F.max(F.when(F.col("predicted"), F.col("price"))).alias("score")
        return masks.overlap_counts(self.case_voxels, ["sample_id", "cls"], score)

    def volumes_of(self, counts: DataFrame) -> DataFrame:
        keys = ["sample_id", "cls"]
        full = masks.with_dice(masks.on_grid(counts, masks.class_grid(self.samples, CLASSES), keys))
        return full.withColumn("reference_present", F.col("reference_voxels") > 0)

    @cached_property
    def per_volume(self) -> DataFrame:
        """One row per sample and class: counts, Dice, presence and score."""
        return self.volumes_of(self.voxel_counts)

    @cached_property
    def counted_volumes(self) -> DataFrame:
        """``per_volume`` without the score, from counts that are stored first."""
        return self.volumes_of(stored(self.voxel_counts.drop("score")))

    @cached_property
    def stored_volumes(self) -> DataFrame:
        """``per_volume`` stored, its counts first: no step's shuffles lie beside the next one's."""
        return stored(self.volumes_of(stored(self.voxel_counts)))

    @cached_property
    def patients(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("patient_id"), F.col("c_mktsegment").alias("vendor")
        )

    @cached_property
    def split(self) -> DataFrame:
        """Leave-one-vendor-out over all vendors: (fold_id, bucket, patient_id, vendor, ...)."""
        return splits.leave_one_vendor_out(
            self.patients, VENDORS, val_fraction=0.15, ref_fraction=0.15, seed=SEED
        )

    @cached_property
    def arm_patients(self) -> DataFrame:
        """(run, arm, patient_id) of the test, in-domain and validation buckets of every fold."""
        return self.split.filter(F.col("bucket") != "train").select(
            F.col("held_out_vendor").alias("run"), F.col("bucket").alias("arm"), "patient_id"
        )

    @cached_property
    def arms(self) -> DataFrame:
        """Per-volume rows of the test, in-domain and validation buckets of every fold."""
        return self.per_volume.join(self.arm_patients, "patient_id")

    @cached_property
    def stored_arms(self) -> DataFrame:
        """``arms`` without the score, stored step by step."""
        return stored(stored(self.counted_volumes).join(self.arm_patients, "patient_id"))

    @cached_property
    def arm_sizes(self) -> DataFrame:
        """(run, arm, n): rows of ``arms``, counted without them."""
        return self.samples.join(self.arm_patients, "patient_id").groupBy("run", "arm").agg((F.count("*") * len(CLASSES)).alias("n"))

    @cached_property
    def line_tasks(self) -> int:
        """How many tasks the order lines are dealt to; their number is in the footers of the files."""
        return tasks_for(self.spark, self.table("lineitem").count())

    @cached_property
    def lattice_lines(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("sample_id"))
        if self.line_tasks > width(self.spark):
            # Beyond a broadcast a task holds a table of its orders; a sort would hold its lines.
            orders = orders.hint("shuffle_hash")
        # What a line becomes is made before the join: it takes less room there than the line.
        lines = self.table("lineitem").select(
            "l_orderkey",
            F.col("l_returnflag").alias("cls"),
            (F.col("l_linenumber") - 1).alias("z"),
            (F.col("l_partkey") % 16).cast("int").alias("y"),
            (F.col("l_suppkey") % 16).cast("int").alias("x"),
            (F.col("l_discount") >= 0.05).alias("p"),
            (F.col("l_tax") >= 0.04).alias("r"),
            F.col("l_extendedprice").alias("price"),
        )
        joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.select("sample_id", "cls", "z", "y", "x", "p", "r", "price")

    def lattice(self, side: str) -> DataFrame:
        """Voxels of one side on the small grid: ``pred`` or ``ref``."""
        return self.lattice_rows(side).distinct()

    def lattice_rows(self, side: str) -> DataFrame:
        """``lattice`` with a voxel as often as lines give it, for operators that merge voxels themselves."""
        return self.lattice_lines.filter("p" if side == "pred" else "r").select("sample_id", "cls", "z", "y", "x")

    @cached_property
    def lattice_paired(self) -> DataFrame:
        return masks.pair(self.lattice_rows("pred"), self.lattice_rows("ref"), ["sample_id", "cls"], self.line_tasks)

    @cached_property
    def manifest(self) -> DataFrame:
        """One volume per patient with shape, spacing and window, derived from ``customer``."""
        return self.table("customer").select(
            F.col("c_custkey").alias("sample_id"),
            F.col("c_name").alias("patient_id"),
            F.col("c_mktsegment").alias("vendor"),
            F.array(*[F.lit(n) for n in GRID_SHAPE]).alias("shape"),
            F.lit("uint16").alias("dtype"),
            spacing_of(F.col("c_mktsegment"), F.col("c_custkey")).alias("spacing_mm"),
            F.array(F.col("c_acctbal"), F.col("c_acctbal") + 1000.0).alias("intensity_window"),
            F.concat(F.lit("vol/"), F.col("c_name")).alias("source_path"),
            F.concat(F.lit("obj/"), F.col("c_name")).alias("path"),
        )

    @cached_property
    def dirty_manifest(self) -> DataFrame:
        """The manifest with defects planted by customer key."""
        k, s = F.col("sample_id"), F.col("spacing_mm")
        return self.manifest.withColumn(
            "spacing_mm",
            F.when(k % 11 == 1, F.array(s[0] * 1000.0, s[1], s[2]))
            .when(k % 11 == 2, F.array(s[1], s[0], s[2]))
            .when(k % 11 == 3, F.array(s[1], s[1], s[1]))
            .when(k % 11 == 4, F.array(s[0], s[1]))
            .when(k % 11 == 5, F.array(F.lit(0.0), s[1], s[2]))
            .when(k % 11 == 6, F.array(s[0], F.lit(float("nan")), s[2]))
            .when(k % 11 != 7, s),
        ).withColumn(
            "intensity_window",
            F.when(k % 13 == 1, F.array(F.lit(5.0), F.lit(5.0)))
            .when(k % 13 != 2, F.col("intensity_window")),
        ).withColumn(
            "shape",
            F.when(k % 17 == 1, F.array(F.lit(7), F.lit(16))).otherwise(F.col("shape")),
        )

    @cached_property
    def lattice_spacing(self) -> DataFrame:
        """(sample_id, sz, sy, sx): spacing on the array axes."""
        m = self.manifest.select("sample_id", masks.array_axis_spacing().alias("s"))
        return m.select(
            "sample_id",
            F.col("s")[0].alias("sz"), F.col("s")[1].alias("sy"), F.col("s")[2].alias("sx"),
        )

    @cached_property
    def scored(self) -> DataFrame:
        """Binary label, score and cell per document."""
        return self.table("documents").join(self.table("labels"), "doc_id").select(
            F.col("doc_id").alias("case_id"),
            F.col("lang").alias("cell"),
            (F.col("quality") == 1).alias("label"),
            F.col("n_chars").cast("double").alias("score"),
        )

    @cached_property
    def log(self) -> DataFrame:
        """Events as a run log: run, time, kind and a metric."""
        return self.table("events").select(
            F.col("user_id").alias("run"),
            "event_id",
            F.col("ts").cast("timestamp").alias("ts"),
            "event_type",
            "value",
            "props",
        )

    @cached_property
    def epochs(self) -> DataFrame:
        """The log numbered per run from 0 in time order; ranges of it are the buckets of a long run."""
        ranges = range_bucket(self.log, ["run", "ts", "event_id"])
        out = running(ranges, ["run"], "_part", ["ts", "event_id"], {"epoch": ("sum", F.lit(1), False)})
        return out.drop("_part")


def spacing_of(vendor: Column, key: Column) -> Column:
    """Vendor spacing, varied a little by key so that a vendor has a range."""
    factor = F.lit(1.0) + F.lit(0.01) * (key % 5)
    out = F.lit(None).cast("array<double>")
    for name, parts in SPACING.items():
        out = F.when(vendor == name, F.array(*[F.lit(p) * factor for p in parts])).otherwise(out)
    return out
