"""Volume manifests, splits and published tables as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscale.operators.splits import BUCKETS, split_documents
from cohortscale.operators.validate import ValidationError, assert_empty, missing_fields
from cohortscale.schemas import REQUIRED_VOLUME_FIELDS, SPLIT_JSON_FIELDS, VOLUME, struct

SPLIT_DOCUMENT = (
    "fold_id STRING, held_out_vendor STRING, seed BIGINT, "
    + ", ".join(f"{b} ARRAY<STRING>" for b in BUCKETS)
)


def refused_lists(spark: SparkSession, path: str) -> DataFrame:
    """(path, head) of files that hold no JSON array, and how they begin."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.filter(~F.startswith(F.ltrim("value"), F.lit("["))).select("path", F.left("value", F.lit(40)).alias("head"))


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of volumes per file; a file that holds anything else is refused.

    Such a file is read by one task. Large manifests are kept as lines: ``load_manifest_lines``.
    """
    assert_empty(refused_lists(spark, path), f"{path} is not a list")
    rows = spark.read.schema(VOLUME + ", _bad STRING").option(
        "columnNameOfCorruptRecord", "_bad"
    ).option("multiLine", True).json(path)
    broken = rows.filter("_bad IS NOT NULL OR (sample_id IS NULL AND patient_id IS NULL)").select("_bad")
    assert_empty(broken, f"{path} is not a list of volumes")
    return rows.drop("_bad")


def load_manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VOLUME).option("mode", "FAILFAST").json(path)


def save_manifest(manifest: DataFrame, path: str) -> None:
    """Checked, sorted by vendor and patient, as JSON Lines parts in that order."""
    assert_empty(missing_fields(manifest, REQUIRED_VOLUME_FIELDS, "sample_id"), "manifest")
    columns = [f.name for f in struct(VOLUME)]
    manifest.select(*columns).orderBy("vendor", "patient_id").write.mode("errorifexists").json(path)


def save_split(split: DataFrame, path: str, parts: int = 1) -> None:
    """``parts`` JSON documents per fold, with sorted fields and sorted patient lists."""
    named = split.withColumn("patient_id", F.col("patient_id").cast("string"))
    docs = split_documents(named, parts)
    names = sorted(SPLIT_JSON_FIELDS)
    docs.select(F.to_json(F.struct(*names)).alias("value")).write.mode("errorifexists").text(path)


def load_split(spark: SparkSession, path: str) -> DataFrame:
    """Back to the long table; a document whose fields are not exactly the expected ones is refused."""
    raw = spark.read.text(path)
    fields = F.array_sort(F.json_object_keys("value"))
    expected = F.array(*[F.lit(n) for n in sorted(SPLIT_JSON_FIELDS)])
    assert_empty(raw.filter(~fields.eqNullSafe(expected)).select(fields.alias("fields")), path)
    doc = raw.select(F.from_json("value", struct(SPLIT_DOCUMENT)).alias("d")).select("d.*")
    lists = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(b).alias("ids")) for b in BUCKETS])
    return doc.select("fold_id", "held_out_vendor", "seed", F.explode(lists).alias("l")).select(
        "fold_id", "l.bucket", F.explode("l.ids").alias("patient_id"), "held_out_vendor", "seed"
    )


def publish_csv(rows: DataFrame, path: str, single_file: bool = False) -> None:
    """A published table; one file only for tables known to be small, such as a report's."""
    out = rows.coalesce(1) if single_file else rows
    out.write.mode("errorifexists").option("header", True).csv(path)


def publish_json(rows: DataFrame, path: str) -> None:
    """NaN has no JSON form: it is published as null."""
    out = [
        F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if t == "double" else F.col(c)
        for c, t in rows.dtypes
    ]
    rows.select(*out).write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def read_published_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
