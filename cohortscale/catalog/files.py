"""Sources and sinks: tables written in each format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortscale.catalog.base import query
from cohortscale.catalog.estimates import CUBE_BOOT, _ARM_EST, rounded
from cohortscale.catalog.logs import as_telemetry, event_stream, parts_by
from cohortscale.catalog.sql import ARMS, LATTICE, MANIFEST, PER_VOLUME, SPLIT, with_ctes
from cohortscale.operators import bootstrap
from cohortscale.schemas import RECORD, TELEMETRY, VOLUME, struct
from cohortscale.plans.views import VENDORS
from cohortscale.session import freed_shuffles, scratch_path, stored
from cohortscale.sources import logfiles, manifest, maskstore, records, volumes
from cohortscale.streaming import logs as stream

_MANIFEST_OUT = """SELECT sample_id::VARCHAR AS sample_id, patient_id, vendor, shape, dtype, spacing_mm, intensity_window, source_path, path FROM manifest"""


def text_manifest(v):
    return v.manifest.withColumn("sample_id", F.col("sample_id").cast("string"))


@query("A1_load_manifest", with_ctes(MANIFEST) + _MANIFEST_OUT)
def a1(v):
    path = scratch_path(v.spark, "manifest-lines")
    text_manifest(v).write.json(path)
    return manifest.load_manifest_lines(v.spark, path)


def manifest_lists(v):
    """The manifest as JSON arrays of some 500 volumes, a file each."""
    path = scratch_path(v.spark, "manifest-lists")
    rows = text_manifest(v).select([f.name for f in struct(VOLUME)])
    n = max(1, rows.count() // 500)
    text = rows.groupBy(F.pmod(F.xxhash64("sample_id"), F.lit(n))).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    text.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("A1_manifest_lists", with_ctes(MANIFEST) + _MANIFEST_OUT)
def a1_lists(v):
    return manifest.load_manifest(v.spark, manifest_lists(v))


@query(
    "A1_refused_lists",
    """SELECT '{"vendor":"' || c_mktsegment || '","volumes":' || count(*) || '}' AS head FROM customer GROUP BY c_mktsegment""",
)
def a1_refused(v):
    """Files that hold an object stand among the lists."""
    path = manifest_lists(v)
    others = v.manifest.groupBy("vendor").agg(F.count("*").alias("volumes"))
    others.select(F.to_json(F.struct("vendor", "volumes")).alias("value")).write.mode("append").option("maxRecordsPerFile", 1).text(path)
    return manifest.refused_lists(v.spark, path).select("head")


@query("A2_save_manifest", with_ctes(MANIFEST) + _MANIFEST_OUT)
def a2(v):
    path = scratch_path(v.spark, "manifest")
    manifest.save_manifest(text_manifest(v), path)
    return manifest.load_manifest_lines(v.spark, path)


@query(
    "A3_split_documents",
    with_ctes(SPLIT) + "SELECT fold_id, bucket, patient_id::VARCHAR AS patient_id, held_out_vendor, seed FROM split",
)
def a3(v):
    path = scratch_path(v.spark, "splits")
    manifest.save_split(v.split, path)
    return manifest.load_split(v.spark, path)


_RECORD_EST = """, out AS (SELECT run, arm, 'all_vendors' AS vendor, cls, 'dice' AS metric, * EXCLUDE (run, arm, cls) FROM est)
    SELECT run, arm, vendor, cls, metric, round(value, 9) AS value, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, n, n_measurements,
      20260916 AS seed, 2000 AS n_resamples, 0.05::DOUBLE AS alpha FROM out"""


def written_records(v):
    est = bootstrap.estimate(
        v.arms.withColumn("vendor", F.lit("all_vendors")).withColumn("metric", F.lit("dice")),
        ["run", "arm", "vendor", "cls", "metric"], CUBE_BOOT, value="dice",
    )
    return records.nested_estimates(est, ["run", "arm"], CUBE_BOOT)


@query("A4_A5_evaluation_records", with_ctes(ARMS, _ARM_EST) + _RECORD_EST)
def a4(v):
    """Estimates nested and written as sorted JSON documents, read back and flattened."""
    path = scratch_path(v.spark, "records")
    docs = written_records(v)
    records.write_records(docs, path)
    back = records.read_record_lines(v.spark, path, f"run STRING, arm STRING, {RECORD}")
    return rounded(records.flat_estimates(back, ["run", "arm"]))


@query(
    "A5_per_volume_rows",
    with_ctes(ARMS)
    + "SELECT sample_id, patient_id, vendor, cls, round(dice, 9) AS dice, predicted_voxels, reference_voxels, run, arm FROM arms",
)
def a5(v):
    path = scratch_path(v.spark, "per-volume")
    rows = v.arms.select("sample_id", "patient_id", "vendor", "cls", "dice", "predicted_voxels", "reference_voxels", "run", "arm")
    records.write_per_volume(rows, path, ["run", "arm"])
    back = v.spark.read.schema(rows.schema).json(path)
    return back.withColumn("dice", F.round("dice", 9))


@query(
    "A4_tagged_per_volume",
    with_ctes(ARMS)
    + """SELECT 'current' AS record_set, run, arm, sample_id::VARCHAR AS sample_id, patient_id::VARCHAR AS patient_id, vendor, cls, round(dice, 9) AS dice,
      reference_present, reference_voxels, predicted_voxels FROM arms""",
)
def a4_tagged(v):
    """A record per fold and arm with its volumes in it, in files of bounded size; set, fold and arm are read off the path."""
    root = scratch_path(v.spark, "tagged-records")
    volume = F.struct(
        F.col("sample_id").cast("string").alias("sample_id"), F.col("patient_id").cast("string").alias("patient_id"), "vendor",
        F.col("cls").alias("fluid_class"), "dice", "reference_present", "reference_voxels", "predicted_voxels",
    )
    sizes = stored(v.arm_sizes)
    rounds, tasks = records.rounds_of(sizes)
    docs = records.volume_documents(v.stored_arms, ["run", "arm"], volume, sizes, tasks)
    value = F.to_json(F.struct(F.col("run").alias("fold_id"), F.col("arm").alias("bucket"), "per_volume")).alias("value")
    for k in range(rounds):
        text = records.in_round(docs, k, rounds).select("run", "arm", value).write.partitionBy("run", "arm")
        with freed_shuffles(v.spark):
            text.mode("append").option("maxRecordsPerFile", 1).option("compression", "gzip").text(f"{root}/current")
    tags = r"/([^/]+)/run=([^/]+)/arm=([^/]+)/[^/]*$"
    got = records.read_records(v.spark, f"{root}/current/*/*", tags)
    rows = records.per_volume_of(got, ["record_set", "run", "arm"])
    return rows.withColumn("dice", F.round("dice", 9)).drop("hd95", "score")


_LOG_SQL = "SELECT event_id, user_id, event_type, value, props FROM events"
LOG = "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


@query("A6_json_lines", _LOG_SQL)
def a6(v):
    path = scratch_path(v.spark, "log")
    v.table("events").select("event_id", "user_id", "event_type", "value", "props").write.json(path)
    return logfiles.read_json_lines(v.spark, path, LOG)


@query("A7_append_json_lines", _LOG_SQL)
def a7(v):
    """Written in two appends."""
    path = scratch_path(v.spark, "append-log")
    rows = v.table("events").select("event_id", "user_id", "event_type", "value", "props")
    logfiles.append_json_lines(rows.filter("event_type = 'error'"), path)
    logfiles.append_json_lines(rows.filter("event_type <> 'error'"), path)
    return logfiles.read_json_lines(v.spark, path, LOG)


@query("A7_append_stream", _LOG_SQL)
def a7_stream(v):
    rows = event_stream(v).select("event_id", "user_id", "event_type", "value", "props")
    path, checkpoint = scratch_path(v.spark, "stream-log"), scratch_path(v.spark, "stream-state")
    stream.append_json(rows, path, checkpoint).awaitTermination()
    return logfiles.read_json_lines(v.spark, path, LOG)


@query(
    "A8_telemetry_csv",
    r"""SELECT user_id AS run, round(value, 6) AS temperature_gpu, regexp_extract(props, '(\d+)', 1)::DOUBLE AS memory_used, event_type = 'error' AS failed FROM events""",
)
def a8(v):
    path = scratch_path(v.spark, "telemetry")
    t = as_telemetry(v.table("events"))
    empty = F.lit(None).cast("double")
    rows = t.select(
        F.col("ts").alias("timestamp_utc"), F.lit(0.0).alias("elapsed_s"), F.col("run").cast("string").alias("name"),
        F.col("temperature").alias("temperature_gpu"),
        *[empty.alias(c) for c in ("clocks_current_graphics", "clocks_current_sm", "utilization_gpu", "utilization_memory")],
        "memory_used", "memory_total", empty.alias("power_draw"), "error",
    )
    logfiles.write_telemetry(rows, path)
    back = logfiles.read_telemetry(v.spark, path, TELEMETRY)
    return back.select(
        F.col("name").cast("bigint").alias("run"), F.round("temperature_gpu", 6).alias("temperature_gpu"),
        "memory_used", F.col("error").isNotNull().alias("failed"),
    )


@query(
    "A8_telemetry_csv_stream",
    r"""SELECT user_id AS run, CASE WHEN event_id % 17 <> 3 AND event_id % 23 <> 5 THEN round(value, 6) END AS temperature_gpu,
      CASE WHEN event_id % 17 <> 3 THEN regexp_extract(props, '(\d+)', 1)::DOUBLE END AS memory_used,
      event_id % 17 <> 3 AND event_type = 'error' AS failed, event_id % 17 = 3 OR event_id % 19 = 4 OR event_id % 23 = 5 AS malformed FROM events""",
)
def a8_stream(v):
    """A file in five parts, each with its header, and with lines that are short, long, or hold no number."""
    k = F.col("event_id")
    cells = F.concat_ws(
        ",", F.lit("2026-01-01T00:00:00.000Z"), F.lit("0.0"), F.col("user_id").cast("string"),
        F.when(k % 23 == 5, "hot").otherwise(F.col("value").cast("string")), F.lit(",,,"),
        F.get_json_object("props", "$.k"), F.lit("100.0"), F.lit(""), F.when(F.col("event_type") == "error", '"failed, twice"').otherwise(""),
    )
    short = F.concat_ws(",", F.lit("2026-01-01T00:00:00.000Z"), F.lit("0.0"), F.col("user_id").cast("string"))
    line = F.when(k % 17 == 3, short).when(k % 19 == 4, F.concat(cells, F.lit(",more,cells"))).otherwise(cells)
    header = v.spark.range(1).select(F.lit(",".join(logfiles.telemetry_columns())).alias("value"))
    lines = v.table("events").select(line.alias("value"), "event_id")
    parts = [header.unionAll(p.select("value")) for p in parts_by(v, lines, k % 5, 5)]
    out = stream.follow(parts, "value STRING", logfiles.parse_telemetry, "telemetry-csv", lines=True)
    return out.select(
        F.col("name").cast("bigint").alias("run"), F.round("temperature_gpu", 6).alias("temperature_gpu"), "memory_used",
        F.col("error").isNotNull().alias("failed"), F.col("malformed").isNotNull().alias("malformed"),
    )


_RELEASE = "CASE WHEN c_mktsegment = 'MACHINERY' AND c_custkey % 2 = 0 THEN 'second' ELSE 'first' END"
_FOLDER = f"'Training' || c_mktsegment || '/' || {_RELEASE} || '/vol-' || c_custkey"
# Defects by customer key: the image's spacing, its size, no image, a label too many, a short payload, a packed one.
_SUBJECTS = f"""subject AS (SELECT c_custkey AS k, c_mktsegment, {_FOLDER} AS folder FROM customer),
refused AS (SELECT k, folder, 'reference' AS stem, 'spacings differ' AS problem FROM subject WHERE k % 19 = 3 AND k % 23 <> 2 AND k % 29 <> 1 AND k % 41 <> 5
  UNION ALL SELECT k, folder, 'reference', 'sizes differ' FROM subject WHERE k % 23 = 2 AND k % 29 <> 1 AND k % 41 <> 5
  UNION ALL SELECT k, folder, 'oct', 'header missing' FROM subject WHERE k % 29 = 1
  UNION ALL SELECT k, folder, 'reference', 'label outside the set' FROM subject WHERE k % 31 = 4 AND k % 37 <> 6 AND k % 41 <> 5
  UNION ALL SELECT k, folder, 'reference', 'element count' FROM subject WHERE k % 37 = 6 AND k % 41 <> 5
  UNION ALL SELECT k, folder, 'reference', 'compressed' FROM subject WHERE k % 41 = 5)"""
VENDOR_FOLDERS = {f"Training{v}": v for v in VENDORS} | {"TrainingNONE": "NONE"}
_WRITTEN: dict[tuple[str, str], str] = {}
#: Subjects whose files share the packs of one number, one in each release folder.
SUBJECTS = 5_000


def volume_folder(v) -> str:
    """The subjects' volume files, an image and a reference each, written once per session and set of tables."""
    at = (v.spark.sparkContext.applicationId, v.sf_dir)
    if at not in _WRITTEN:
        root = scratch_path(v.spark, "volumes")
        k, vendor = F.col("c_custkey"), F.col("c_mktsegment")
        release = F.when((vendor == "MACHINERY") & (k % 2 == 0), "second").otherwise("first")
        customers = v.table("customer")
        packs = -(-customers.count() // SUBJECTS) or 1  # the number is in the footers
        pack = F.concat(F.lit("/p"), F.pmod(F.xxhash64(k), F.lit(packs)).cast("string"), F.lit(f"{volumes.PACK}/vol-"))
        folder = F.concat(F.lit(f"{root}/Training"), vendor, F.lit("/"), release, pack, k.cast("string"))
        all_subjects = customers.select(k.alias("k"), folder.alias("folder"))
        grid, lateral = F.array(F.lit(16), F.lit(16), F.lit(7)), F.lit(0.0117)
        shape = {"dims": grid, "element_spacing": F.array(lateral, F.lit(0.002), F.lit(0.047))}
        references = all_subjects.select("k", "folder", F.lit("reference").alias("stem"), *[c.alias(n) for n, c in shape.items()], F.lit("MET_UCHAR").alias("element_type"))
        k = F.col("k")
        images = all_subjects.filter(k % 29 != 1).select(
            "k", "folder", F.lit("oct").alias("stem"),
            F.when(k % 23 == 2, F.array(F.lit(16), F.lit(16), F.lit(6))).otherwise(shape["dims"]).alias("dims"),
            F.when(k % 19 == 3, F.array(F.lit(0.002), lateral, F.lit(0.047))).otherwise(shape["element_spacing"]).alias("element_spacing"),
            F.lit("MET_USHORT").alias("element_type"),
        )
        code = F.when(F.col("cls") == "A", 1).when(F.col("cls") == "N", 2).otherwise(3)
        labels = v.lattice_rows("ref").select(F.col("sample_id").alias("k"), "z", "y", "x", code.alias("label"))
        odd = all_subjects.filter(k % 31 == 4).select("k", *[F.lit(0).alias(c) for c in "zyx"], F.lit(7).alias("label"))
        cells = stored(labels.unionByName(odd).groupBy("k", "z", "y", "x").agg(F.max("label").alias("label")))
        written = volumes.write_label_volumes(
            references.unionByName(images), cells.withColumn("stem", F.lit("reference")), volumes.open_packs, ["k", "stem"]
        )
        with freed_shuffles(v.spark):
            written.count()
        packed = F.lit("NDims = 3\nCompressedData = True\nDimSize = 16 16 7\nElementType = MET_UCHAR\n")
        spoiled = all_subjects.select(
            F.when(k % 41 == 5, F.concat("folder", F.lit("/reference.mhd"))).when(k % 37 == 6, F.concat("folder", F.lit("/reference.raw"))).alias("path"),
            F.encode(F.when(k % 41 == 5, packed).otherwise("cut off"), "utf-8").alias("content"),
        ).filter("path IS NOT NULL")
        volumes.write_files(spoiled, volumes.open_packs).count()
        _WRITTEN[at] = root
    return _WRITTEN[at]


def within(root: str, column: str):
    """A path as it is below the root, whatever packs it is in."""
    below = F.substring_index(F.col(column), root.rstrip("/").rsplit("/", 1)[1] + "/", -1)
    return F.regexp_replace(below, rf"[^/]*\Q{volumes.PACK}\E/", "")


def read_volumes(v):
    """The volume files, listed once: headers and payloads are told apart by their names."""
    root = volume_folder(v)
    files = stored(volumes.list_payloads(v.spark, root, store=volumes.open_packs))
    headers = stored(volumes.parse_headers(volumes.read_headers(files, store=volumes.open_packs)))
    payloads = files.filter(volumes.named("*.raw"))
    return root, headers, payloads, volumes.label_voxels(headers.filter("stem = 'reference'"), payloads, volumes.open_packs)


@query(
    "A9_volume_ingest",
    with_ctes(LATTICE, _SUBJECTS)
    + """SELECT folder AS source, z, y, x, max(CASE cls WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) AS label
      FROM ref JOIN subject ON k = sample_id WHERE k NOT IN (SELECT k FROM refused) GROUP BY ALL""",
)
def a9(v):
    """Voxels of the subjects that nothing is wrong with, out of their files."""
    root, headers, payloads, voxels = read_volumes(v)
    voxels = stored(voxels)  # files are read once, voxels twice
    refused = volumes.refusals(headers, payloads, voxels).select(F.col("folder").alias("source"))
    good = voxels.join(refused, "source", "left_anti")
    return good.select(within(root, "source").alias("source"), "z", "y", "x", "label")


@query("A9_refusals", with_ctes(_SUBJECTS) + "SELECT folder, stem, problem FROM refused")
def a9_refusals(v):
    root, headers, payloads, voxels = read_volumes(v)
    return volumes.refusals(headers, payloads, voxels).select(within(root, "folder").alias("folder"), "stem", "problem")


@query(
    "A9_headers",
    with_ctes(_SUBJECTS)
    + """SELECT folder, 'reference' AS stem, [16, 16, 7] AS dims, [0.0117::DOUBLE, 0.002::DOUBLE, 0.047::DOUBLE] AS element_spacing,
      'MET_UCHAR' AS element_type, 'reference.raw' AS data_file, false AS msb_first, NULL::VARCHAR AS problem FROM subject WHERE k % 41 <> 5
      UNION ALL SELECT folder, 'reference', [16, 16, 7], NULL, 'MET_UCHAR', NULL, false, 'compressed' FROM subject WHERE k % 41 = 5
      UNION ALL SELECT folder, 'oct', [16, 16, CASE WHEN k % 23 = 2 THEN 6 ELSE 7 END],
        CASE WHEN k % 19 = 3 THEN [0.002::DOUBLE, 0.0117::DOUBLE, 0.047::DOUBLE] ELSE [0.0117::DOUBLE, 0.002::DOUBLE, 0.047::DOUBLE] END,
        'MET_USHORT', 'oct.raw', false, NULL FROM subject WHERE k % 29 <> 1""",
)
def a9_headers(v):
    root, headers, _, _ = read_volumes(v)
    return headers.withColumn("folder", within(root, "folder"))


@query(
    "A9_subjects",
    with_ctes(_SUBJECTS)
    + """SELECT 'vol-' || k AS patient_id, c_mktsegment AS vendor, [CASE WHEN k % 23 = 2 THEN 6 ELSE 7 END, 16, 16] AS shape,
      CASE WHEN k % 19 = 3 THEN [0.0117::DOUBLE, 0.002::DOUBLE, 0.047::DOUBLE] ELSE [0.002::DOUBLE, 0.0117::DOUBLE, 0.047::DOUBLE] END AS spacing_mm,
      folder AS source_path FROM subject WHERE k % 29 <> 1""",
)
def a9_subjects(v):
    root, headers, _, _ = read_volumes(v)
    return volumes.subjects(headers, VENDOR_FOLDERS).withColumn("source_path", within(root, "source_path")).drop("problem")


@query(
    "A9_directory_walk",
    with_ctes(_SUBJECTS)
    + f"""SELECT v AS vendor, CASE WHEN n IS NULL THEN 'vendor folder missing' ELSE n || ' release folders' END AS problem
      FROM (VALUES {", ".join(f"('{n}')" for n in VENDOR_FOLDERS.values())}) w(v)
      LEFT JOIN (SELECT c_mktsegment, count(DISTINCT split_part(folder, '/', 2)) AS n FROM subject GROUP BY 1) ON c_mktsegment = v WHERE n IS NULL OR n > 1""",
)
def a9_walk(v):
    root = volume_folder(v)
    return volumes.walk_problems(volumes.list_payloads(v.spark, root, store=volumes.open_packs), root, VENDOR_FOLDERS)


_PUBLISHED = with_ctes(PER_VOLUME) + "SELECT vendor, cls, count(*) AS n, round(avg(dice), 9) AS dice FROM per_volume GROUP BY ALL"


@query("A10_published_tables", _PUBLISHED)
def a10(v):
    path = scratch_path(v.spark, "published")
    small = v.per_volume.groupBy("vendor", "cls").agg(F.count("*").alias("n"), F.round(F.avg("dice"), 9).alias("dice"))
    manifest.publish_json(small, path + "-json")
    manifest.publish_csv(small, path, single_file=True)
    return manifest.read_published_csv(v.spark, path, "vendor STRING, cls STRING, n BIGINT, dice DOUBLE")


@query(
    "A11_mask_store",
    with_ctes(
        LATTICE,
        "slices AS (SELECT sample_id, z, count(*) AS voxels, sha256(string_agg(cls || ':' || y || ':' || x, ',' ORDER BY cls || ':' || y || ':' || x)) AS h FROM pred GROUP BY ALL)",
    )
    + "SELECT sample_id, sha256(string_agg(z || '=' || h, ',' ORDER BY z)) AS sha256, sum(voxels)::BIGINT AS voxels FROM slices GROUP BY 1",
)
def a11(v):
    path = scratch_path(v.spark, "masks")
    maskstore.save(v.lattice("pred"), path)
    changed = maskstore.verify(v.spark, path).select("sample_id")
    return v.spark.read.parquet(f"{path}/manifest").join(changed, "sample_id", "left_anti")
