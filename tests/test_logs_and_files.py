import json
import os

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from cohortscale.operators import logs, validate
from cohortscale.sources import logfiles, manifest, maskstore, records, volumes
from cohortscale.streaming import logs as stream

ACCESS = "bucket STRING, fold_id STRING, ts TIMESTAMP, entry BIGINT, run_id STRING, prior_accesses BIGINT"


def access_rows(n=60):
    rows = []
    for i in range(n):
        run = None if i % 7 == 0 else f"r{(i * 5) % 11}"
        rows.append(("test" if i % 3 else "ref", "f", f"2026-01-01 {i // 6:02d}:{i % 6 * 10:02d}:00", i, run))
    seen, out = {}, []
    for b, f, ts, i, run in rows:
        runs, singles = seen.setdefault((b, f), (set(), [0]))
        out.append({"bucket": b, "fold_id": f, "ts": ts, "entry": i, "run_id": run, "prior_accesses": len(runs) + singles[0]})
        if run is None:
            singles[0] += 1
        else:
            runs.add(run)
    return out, {k: len(r) + s[0] for k, (r, s) in seen.items()}


def replay(folder, rows, parts):
    """JSON Lines files whose times follow their order, so a stream takes them one by one."""
    import os

    folder.mkdir()
    size = -(-len(rows) // parts)
    for k in range(parts):
        path = folder / f"part-{k}.json"
        path.write_text("".join(json.dumps(r) + "\n" for r in rows[k * size : (k + 1) * size]))
        os.utime(path, (1_700_000_000 + k * 60,) * 2)
    return str(folder)


def in_parts(spark, rows, schema, parts):
    """The rows as that many frames, in order."""
    from cohortscale.schemas import struct

    size = -(-len(rows) // parts)
    text = ", ".join(f"{f.name} {'string' if f.dataType.typeName() == 'timestamp' else f.dataType.simpleString()}" for f in struct(schema))
    frames = (spark.createDataFrame([tuple(r[f.name] for f in struct(schema)) for r in rows[k * size : (k + 1) * size]], text) for k in range(parts))
    return [df.select([F.col(f.name).cast(f.dataType) for f in struct(schema)]) for df in frames]


def test_audit_log_in_batch_and_in_several_micro_batches(spark, tmp_path):
    rows, totals = access_rows()
    folder = replay(tmp_path / "log", rows, 4)
    batch = logfiles.read_json_lines(spark, folder, ACCESS)
    assert logs.audit_findings(batch).isEmpty()
    spoiled = batch.withColumn("prior_accesses", F.when(F.col("entry") == 33, F.lit(0)).otherwise(F.col("prior_accesses")))
    assert [r.entry for r in logs.audit_findings(spoiled).collect()] == [33]
    assert {(r.bucket, r.fold_id): r.accesses for r in logs.access_counts(batch).collect()} == totals
    out = stream.follow_prior_accesses(in_parts(spark, rows, ACCESS, 5), ACCESS)
    assert out.count() == len(rows) and out.filter("prior <> prior_accesses").isEmpty()
    counted = stream.run_to_table(stream.access_counts(stream.read_json_log(spark, folder, ACCESS)), "complete", "count-test")
    assert {(r.bucket, r.fold_id): r.accesses for r in counted.collect()} == totals


EPOCH = "run STRING, epoch BIGINT, val_dice DOUBLE"


def epoch_rows():
    rng = np.random.default_rng(4)
    return [
        {"run": r, "epoch": e, "val_dice": None if e % 4 == 3 else round(float(rng.random()), 3)}
        for e in range(40)
        for r in ("a", "b", "c")
    ]


def patience_in_python(rows):
    state, out = {}, {}
    for r in rows:
        best, at, since = state.get(r["run"], (None, -1, 0))
        if r["val_dice"] is not None:
            best, at, since = (r["val_dice"], r["epoch"], 0) if best is None or r["val_dice"] > best else (best, at, since + 1)
        state[r["run"]] = (best, at, since)
        out[r["run"], r["epoch"]] = (best, at, since)
    return out


@pytest.mark.parametrize("parts", [1, 3])
def test_patience_stream_equals_batch_and_the_plain_loop(spark, tmp_path, parts):
    rows = epoch_rows()
    folder = replay(tmp_path / "epochs", rows, parts)
    want = patience_in_python(rows)

    def as_dict(df):
        return {(r.run, r.epoch): (r.best_metric, r.best_epoch, r.since_improvement) for r in df.collect()}

    assert as_dict(logs.best_and_patience(logfiles.read_json_lines(spark, folder, EPOCH), ["run"])) == want
    frames = in_parts(spark, rows + [{"run": None, "epoch": 2, "val_dice": 0.5}], EPOCH, parts)
    out = stream.follow_patience(frames, EPOCH, ["run"])
    assert out.filter("late").isEmpty() and as_dict(out) == want | {(None, 2): (0.5, 2, 0)}


def test_patience_over_ranges_of_epochs(spark, monkeypatch):
    """A run in many ranges, each a key of its own: values tie, fall and rise across them, and some have none."""
    monkeypatch.setattr(logs, "EPOCHS_PER_BUCKET", 4)
    values = [None, None, None, None, 0.2, 0.1, None, 0.2, 0.2, 0.1, 0.1, 0.1, None, None, 0.3, 0.25, 0.3, 0.31, None, 0.1, 0.0, None, 0.31, 0.32]
    rows = [{"run": "a", "epoch": e, "val_dice": v} for e, v in enumerate(values)]
    out = stream.follow_patience(in_parts(spark, rows, EPOCH, 5), EPOCH, ["run"]).collect()
    assert {(r.run, r.epoch): (r.best_metric, r.best_epoch, r.since_improvement) for r in out} == patience_in_python(rows)
    rises = [e for e, v in enumerate(values) if v is not None and v > max((x for x in values[:e] if x is not None), default=-1)]
    assert sorted(r.epoch for r in out if r.improved) == rises


def test_late_epochs_are_marked_and_left_out(spark):
    rows = [{"run": "a", "epoch": e, "val_dice": 0.1 * e} for e in (0, 1, 2, 5)] + [
        {"run": "a", "epoch": e, "val_dice": v} for e, v in ((3, 9.0), (6, 0.2))
    ]
    out = stream.follow_patience(in_parts(spark, rows, EPOCH, 2), EPOCH, ["run"])  # 5, 3 and 6 come second
    assert out.filter("late").isEmpty()
    out = stream.follow_patience(in_parts(spark, rows, EPOCH, 3), EPOCH, ["run"])
    assert [r.epoch for r in out.filter("late").collect()] == [3]
    last = out.filter("epoch = 6").first()
    assert (last.best_epoch, last.since_improvement) == (5, 1)


def test_windows_leave_the_state_when_the_watermark_passes(spark):
    rows = [{"run": 1 + h % 3, "ts": f"2026-01-{1 + d:02d} {h:02d}:00:00", "temperature": float(d + h), "memory_share": 0.5, "error": None} for d in range(6) for h in range(24)]
    schema = "run BIGINT, ts TIMESTAMP, temperature DOUBLE, memory_share DOUBLE, error STRING"
    progress = []
    out = stream.follow(
        in_parts(spark, rows, schema, 6), schema, lambda live: stream.telemetry_windows(live, "6 hours", "6 hours"), "windows-test", progress=progress
    )
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(kept) <= 3 * 8 and len(kept) >= 6 and 3 * 4 * 4 < out.count() < 3 * 4 * 6
    assert out.select("run", "from_ts").distinct().count() == out.count()
    assert out.filter("samples <> 2").isEmpty()
    sessions = stream.follow(in_parts(spark, rows, schema, 6), schema, lambda live: stream.gap_sessions(live, "2 hours", "6 hours"), "sessions-test")
    assert sessions.filter("events <> 1").isEmpty() and sessions.count() > 100


def test_late_telemetry_is_counted(spark):
    rows = [{"run": "a", "ts": f"2026-01-01 {h:02d}:00:00"} for h in (5, 6, 9, 1, 8, 2)]
    out = stream.follow_late_rows(in_parts(spark, rows, "run STRING, ts TIMESTAMP", 2), "run STRING, ts TIMESTAMP", 2 * 3600)
    assert [(r.run, r.late) for r in out.collect()] == [("a", 2)]


def write_volume(folder, dims=(8, 6, 4), spacing="0.0117 0.002 0.047", kind="MET_UCHAR", dtype="u1", stem="reference", extra=(), cut=0):
    folder.mkdir(parents=True, exist_ok=True)
    n = dims[0] * dims[1] * dims[2]
    data = (np.arange(n) % 4).astype(dtype)
    raw = data.tobytes()
    (folder / f"{stem}.raw").write_bytes(raw[: len(raw) - cut])
    head = {
        "ObjectType": "Image", "NDims": "3", "CompressedData": "False", "ElementSpacing": spacing,
        "DimSize": " ".join(map(str, dims)), "ElementType": kind, "ElementDataFile": f"{stem}.raw", **dict(extra),
    }
    (folder / f"{stem}.mhd").write_text("".join(f"{k} = {v}\r\n" for k, v in head.items()))
    return data.reshape(dims[::-1])


def test_volume_files_to_voxels_and_refusals(spark, tmp_path):
    root = tmp_path / "raw" / "VendorOne"
    good = write_volume(root / "good")
    big = write_volume(root / "big", kind="MET_USHORT", dtype=">u2", extra=[("BinaryDataByteOrderMSB", "True")])
    write_volume(root / "short", cut=3)
    write_volume(root / "packed", extra=[("CompressedData", "True")])
    write_volume(root / "flat", extra=[("NDims", "2")])
    write_volume(root / "odd", kind="MET_LONG")
    write_volume(root / "sized", extra=[("DimSize", "8 0 4")])
    write_volume(root / "spaced", spacing="0.1 0.2")
    write_volume(root / "good", stem="oct")
    headers = volumes.parse_headers(volumes.list_headers(spark, str(tmp_path / "raw")))
    payloads = volumes.list_payloads(spark, str(tmp_path / "raw"), "*.raw")
    problems = {r.folder.rsplit("/", 1)[1]: r.problem for r in headers.filter("stem = 'reference'").collect()}
    assert problems == {
        "good": None, "big": None, "short": None, "packed": "compressed", "flat": "not 3-D",
        "odd": "element type", "sized": "size", "spaced": "spacing",
    }
    assert [r.problem for r in volumes.payload_problems(headers, payloads).collect()] == ["element count"]
    got = volumes.label_voxels(headers.filter("stem = 'reference'"), payloads).collect()
    for name, array in (("good", good), ("big", big)):
        want = {(*map(int, at), int(array[tuple(at)])) for at in np.argwhere(array)}
        assert {(r.z, r.y, r.x, r.label) for r in got if r.source.endswith("/" + name)} == want
    assert not [r for r in got if r.source.endswith("/short")]
    row = volumes.subjects(headers, {"VendorOne": "one"}).first()
    assert (row.patient_id, row.vendor, row["shape"], row.spacing_mm) == ("good", "one", [4, 6, 8], [0.002, 0.0117, 0.047])


def test_volumes_written_and_read_in_ranges_of_bytes(spark, tmp_path):
    root = str(tmp_path / "store")
    folders = [f"{root}/TrainingA/one/s1", f"{root}/TrainingA/one/s2", f"{root}/TrainingB/one/s3", f"{root}/TrainingB/two/s4"]
    shape = ([5, 4, 9], [0.0117, 0.002, 0.047])
    manifest_rows = [(f, stem, *shape, "MET_SHORT") for f in folders for stem in ("oct", "reference")]
    manifest_rows = [r for r in manifest_rows if r[:2] != (folders[3], "oct")]
    places = [(folders[0], "reference", z, y, x, 1 + (z + y + x) % 3) for z in range(9) for y in range(4) for x in range(5) if (z * y + x) % 4 == 1]
    places += [(folders[1], "reference", 8, 3, 4, 9)]
    m = spark.createDataFrame(manifest_rows, "folder string, stem string, dims array<int>, element_spacing array<double>, element_type string")
    voxels = spark.createDataFrame(places, "folder string, stem string, z int, y int, x int, label int")
    written = volumes.write_label_volumes(m, voxels).collect()
    assert len(written) == 14 and {r.length for r in written if r.path.endswith(".raw")} == {5 * 4 * 9 * 2}
    headers = volumes.parse_headers(volumes.list_headers(spark, root))
    payloads = volumes.list_payloads(spark, root, "*.raw")
    references = headers.filter("stem = 'reference'")
    for range_bytes, ranges in ((1, 36), (100, 20), (1 << 20, 4)):
        assert volumes.slice_ranges(references, payloads, range_bytes).count() == ranges
        got = volumes.label_voxels(references, payloads, range_bytes=range_bytes)
        assert sorted((r.source.removeprefix("file:"), r.z, r.y, r.x, r.label) for r in got.collect()) == sorted((f, *at) for f, _, *at in places)
    bad = volumes.refusals(headers, payloads, volumes.label_voxels(references, payloads))
    assert sorted((r.folder[-2:], r.stem, r.problem) for r in bad.collect()) == [("s2", "reference", "label outside the set"), ("s4", "oct", "header missing")]
    walked = volumes.walk_problems(volumes.list_payloads(spark, root), root, {"TrainingA": "a", "TrainingB": "b", "TrainingC": "c"})
    assert sorted(map(tuple, walked.collect())) == [("b", "2 release folders"), ("c", "vendor folder missing")]
    volumes.write_files(spark.createDataFrame([(f"{folders[0]}/reference.raw", b"short")], "path string, content binary")).collect()
    payloads = volumes.list_payloads(spark, root, "*.raw")
    assert [(r.folder[-2:], r.problem) for r in volumes.payload_problems(headers, payloads).collect()] == [("s1", "element count")]
    assert not volumes.label_voxels(references, payloads).filter("source like '%s1'").count()


def test_manifest_must_be_a_list(spark, tmp_path):
    row = {"sample_id": "s", "patient_id": "p", "vendor": "v", "shape": [1, 2, 3], "spacing_mm": [0.1, 0.2, 0.3]}
    (tmp_path / "list.json").write_text(json.dumps([row, {**row, "sample_id": "t"}]))
    (tmp_path / "one.json").write_text(json.dumps(row))
    assert manifest.load_manifest(spark, str(tmp_path / "list.json")).count() == 2
    with pytest.raises(validate.ValidationError):
        manifest.load_manifest(spark, str(tmp_path / "one.json"))


def test_split_documents_must_have_exactly_their_fields(spark, tmp_path):
    (tmp_path / "split.json").write_text(json.dumps({"fold_id": "f", "train": [], "extra": 1}) + "\n")
    with pytest.raises(validate.ValidationError):
        manifest.load_split(spark, str(tmp_path / "split.json"))


def test_malformed_telemetry_rows_never_fail(spark, tmp_path):
    columns = logfiles.telemetry_columns()
    lines = [",".join(columns), "2026-01-01T00:00:00Z,1.0,gpu,55,,,,,10,100,,", "2026-01-01T00:00:05Z,2.0,gpu", "x,y,z,hot,,,,,,,,oops,more,cells"]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    rows = logfiles.read_telemetry(spark, str(tmp_path / "t.csv")).collect()
    assert len(rows) == 3 and [r.temperature_gpu for r in rows] == [55.0, None, None]
    assert rows[1].name == "gpu" and rows[2].error == "oops"
    padded = spark.read.text(str(tmp_path / "t.csv")).select(F.size(logfiles.pad_or_trim()).alias("n")).distinct().collect()
    assert [r.n for r in padded] == [len(columns)]


def test_mask_store_refuses_to_overwrite_and_sees_changes(spark, tmp_path):
    voxels = spark.range(300).select(
        F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("sample_id"), F.lit("a").alias("cls"),
        (F.col("id") % 5).cast("int").alias("z"), (F.col("id") % 7).cast("int").alias("y"), F.col("id").cast("int").alias("x"),
    )
    path = str(tmp_path / "masks")
    maskstore.save(voxels, path)
    assert maskstore.verify(spark, path).isEmpty()
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        maskstore.save(voxels, path)
    a = {r.sample_id: r.sha256 for r in maskstore.checksums(voxels.repartition(5)).collect()}
    b = {r.sample_id: r.sha256 for r in maskstore.checksums(voxels.filter("x <> 4")).collect()}
    assert {k for k in a if a[k] != b[k]} == {"s1"}


def test_nested_records_are_tagged_by_path_and_flattened(spark, tmp_path):
    est = {"value": 0.5, "ci_low": 0.1, "ci_high": 0.9, "n": 7, "n_unit": "patients", "n_measurements": 7,
           "bootstrap": {"n_resamples": 10, "alpha": 0.05, "seed": 1, "unit": "patients"}}
    record = {
        "fold_id": "f", "bucket": "test", "segmentation": {"all_vendors": {"IRF": {"dice": est}}, "by_vendor": {"v": {"IRF": {"dice": est}}}},
        "per_volume": [{"sample_id": "s", "patient_id": "p", "vendor": "v", "fluid_class": "IRF", "dice": 0.5, "hd95": None,
                        "reference_present": True, "reference_voxels": 3, "predicted_voxels": 2, "score": 0.9}],
    }
    for run in ("one", "two"):
        folder = tmp_path / "current" / run
        folder.mkdir(parents=True)
        (folder / "evaluation_test.json").write_text(json.dumps(record, indent=2))
    got = records.read_records(spark, str(tmp_path / "*" / "*"), r"([^/]+)/([^/]+)/evaluation_(\w+)\.json$")
    flat = records.flat_estimates(got, ["record_set", "run", "arm"])
    assert {(r.record_set, r.run, r.arm, r.vendor) for r in flat.collect()} == {
        ("current", r, "test", v) for r in ("one", "two") for v in ("v", "all_vendors")
    }
    assert records.per_volume_of(got, ["run"]).filter("cls = 'IRF' AND dice = 0.5").count() == 2
    leaves = records.record_leaves(got, ["run"])
    assert leaves.filter("leaf = 'all_vendors/IRF/dice/ci_low' AND value = 0.1").count() == 2


def test_sessions_pair_starts_and_ends(spark):
    kinds = ["session_start", "epoch", "session_end", "session_start", "epoch", "session_start", "session_end"]
    rows = spark.createDataFrame([("r", i, k) for i, k in enumerate(kinds)], "run STRING, at INT, event STRING")
    out = logs.sessions(
        rows.withColumn("b", F.floor(F.col("at") / 2)), ["run"], F.col("event") == "session_start",
        F.col("event") == "session_end", ["at"],
    )
    got = {r.session: (r.events, r.ended, r.resumed) for r in out.collect()}
    assert got == {1: (3, True, False), 2: (2, False, True), 3: (2, True, True)}
    assert [r.session for r in logs.unterminated(out).collect()] == [2]


def test_runs_of_the_audit_stream_are_met_without_a_call_each(spark):
    """Many runs, some in several parts, some twice at one time, two without a time: as a loop over the parts counts them."""
    rows = [
        {"bucket": None if i % 5 == 0 else "b", "fold_id": "f", "ts": None if i in (40, 41) else f"2026-01-01 00:{i % 50 // 10:02d}:00", "entry": i // 2, "run_id": f"r{i * 7 % 150}"}
        for i in range(400)
    ]
    rows = [r | {"prior_accesses": 0} for r in rows]
    parts = in_parts(spark, rows, ACCESS, 2)
    seen, want = set(), {}
    for part in (rows[:200], rows[200:]):
        met = {(r["bucket"], r["run_id"]) for r in part} - seen
        seen |= met
        for b in (None, "b"):
            want[b] = want.get(b, 0) + sum(m[0] == b for m in met)
    progress, batches = [], []
    stream.follow(parts, ACCESS, stream.counted_accesses, "met-test", lambda batch, k: batches.append(stream._with_counts(batch.localCheckpoint()).collect()), progress)
    counted = [r for b in batches for r in b if r.counts]
    assert sum(len(b) for b in batches) == len(rows) and len({(r.bucket, r.run_id) for r in counted}) == len(counted)
    assert {b: sum(r.bucket == b for r in counted) for b in want} == want
    times = {(r.bucket, r.run_id): r.ts for r in counted if r.ts is not None}
    assert all(r.ts is None or times[r.bucket, r.run_id] <= r.ts for r in batches[0] if (r.bucket, r.run_id) in times)
    assert {o["operatorName"] for p in progress for o in p["stateOperators"]} == {"dedupe"}


def test_files_are_written_by_all_tasks_and_listed_at_any_depth(spark, tmp_path):
    names = ["top.raw", "v/a.raw", "v/r/b.raw", "v/r/s/c.raw", "v/r/s/deep/d.raw", "v/r/t/e.raw"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
    files = spark.createDataFrame([(f"{tmp_path}/{n}", n) for n in names], "path STRING, content STRING").coalesce(1)
    written = volumes.write_files(files.withColumn("content", F.encode("content", "utf-8")))
    assert written.rdd.getNumPartitions() == 8 and written.count() == len(names)
    listed = volumes.list_payloads(spark, str(tmp_path), "*.raw")
    assert sorted((r.path, r.length) for r in listed.collect()) == sorted((f"{tmp_path}/{n}", len(n)) for n in names)


def test_ingest_lists_the_files_once_and_makes_few_batches(spark, tmp_path, monkeypatch):
    from cohortscale.catalog import files

    root = str(tmp_path)
    folders = [f"{root}/TrainingA/first/vol-{k}" for k in range(40)]
    manifest = spark.createDataFrame(
        [(f, stem, [3, 2, 2], [0.1, 0.2, 0.3], "MET_UCHAR") for f in folders for stem in ("oct", "reference")],
        "folder STRING, stem STRING, dims ARRAY<INT>, element_spacing ARRAY<DOUBLE>, element_type STRING",
    )
    voxels = spark.createDataFrame(
        [(f, "reference", 1, 0, k % 3, 1 + k % 3) for k, f in enumerate(folders) if k % 4], "folder STRING, stem STRING, z INT, y INT, x INT, label INT"
    )
    volumes.write_label_volumes(manifest, voxels).count()
    calls, listing = [], volumes.list_payloads
    monkeypatch.setattr(files, "volume_folder", lambda v: root)
    monkeypatch.setattr(volumes, "list_payloads", lambda *a, **k: calls.append(a) or listing(*a, **k))
    v = type("V", (), {"spark": spark})
    _, headers, payloads, found = files.read_volumes(v)
    assert headers.count() == 80 and headers.filter("problem IS NULL").count() == 80 and payloads.count() == 80
    got = {(r["source"], r["z"], r["y"], r["x"], r["label"]) for r in found.collect()}
    assert got == {(f, 1, 0, k % 3, 1 + k % 3) for k, f in enumerate(folders) if k % 4}
    assert len(calls) == 1


def test_packed_volumes_are_files_like_others(spark, tmp_path):
    """Packs hold every file under its name: listed, read, replaced; a folder of such a name is a folder, a large file stays apart."""
    root = str(tmp_path)
    folders = [f"{root}/TrainingA/first/p{k % 3}.pack/vol-{k}" for k in range(30)] + [f"{root}/TrainingA/first/vol-30", f"{root}/TrainingB/odd.pack/vol-31"]
    (tmp_path / "TrainingB/odd.pack").mkdir(parents=True)
    manifest_rows = [(k, f, stem, [4, 3, 2], [0.1, 0.2, 0.3], "MET_SHORT") for k, f in enumerate(folders) for stem in ("oct", "reference")]
    kinds = "k INT, folder STRING, stem STRING, dims ARRAY<INT>, element_spacing ARRAY<DOUBLE>, element_type STRING"
    rows = spark.createDataFrame(manifest_rows + manifest_rows[:6], kinds)  # some are written twice
    places = [(k, "reference", 1, k % 3, k % 4, 1 + k % 3) for k in range(32) if k % 5]
    voxels = spark.createDataFrame(places, "k INT, stem STRING, z INT, y INT, x INT, label INT")
    written = volumes.write_label_volumes(rows, voxels, volumes.open_packs, ["k", "stem"])
    want = {f"{f}/{stem}.{end}" for f in folders for stem in ("oct", "reference") for end in ("mhd", "raw")}
    assert {r.path for r in written.collect()} == want
    on_disk = [p for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith(".")]
    assert len(on_disk) == 3 + 8 and sum(p.suffix == ".pack" for p in on_disk) == 3
    replaced = [(f"{folders[k]}/reference.raw", b"short") for k in (4, 7, 30)] + [(f"{folders[5]}/note.txt", b"more")]
    volumes.write_files(spark.createDataFrame(replaced, "path STRING, content BINARY"), volumes.open_packs).collect()
    listed = volumes.list_payloads(spark, root, store=volumes.open_packs)
    sizes = {r.path: r.length for r in listed.collect()}
    assert set(sizes) == want | {replaced[3][0]} and listed.count() == len(sizes)
    assert [p for p, n in sizes.items() if p.endswith(".raw") and n != 48] == [p for p in sizes if p in dict(replaced[:3])]
    headers = volumes.parse_headers(volumes.read_headers(listed, store=volumes.open_packs))
    assert headers.count() == 64 and headers.filter("problem IS NULL AND stem = 'oct'").count() == 32
    payloads, references = listed.filter(volumes.named("*.raw")), headers.filter("stem = 'reference'")
    for range_bytes in (1, 1 << 20):
        got = volumes.label_voxels(references, payloads, volumes.open_packs, range_bytes).collect()
        assert sorted((r.source, r.z, r.y, r.x, r.label) for r in got) == sorted((folders[k], *at) for k, _, *at in places if k not in (4, 7, 30))
    problems = volumes.payload_problems(headers, payloads).collect()
    assert sorted((r.folder, r.problem) for r in problems) == sorted((folders[k], "element count") for k in (4, 7, 30))
    system, name = volumes.open_packs(folders[1])
    assert system.get_file_info(name).type == system.get_file_info(name.rpartition("/")[0]).type == fs.FileType.Directory
    assert system.get_file_info(f"{name}/none.raw").type == fs.FileType.NotFound and system.get_file_info(f"{name}/oct.raw").size == 48


def test_volumes_of_many_subjects_take_few_files_of_few_bytes(spark, tmp_path, monkeypatch):
    """Four files and a folder a subject took 20 KB of disk each."""
    from cohortscale.catalog import files
    from cohortscale.plans.views import Views

    n, k = 300, F.col("id")
    spark.range(1, n + 1).select(k.alias("c_custkey"), F.when(k % 2 == 0, "MACHINERY").otherwise("BUILDING").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(n).select(k.alias("o_orderkey"), (k + 1).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    line = {"l_orderkey": k % n, "l_returnflag": F.lit("A"), "l_linenumber": (k % 7 + 1).cast("int"), "l_partkey": k, "l_suppkey": k * 3,
            "l_discount": F.lit(0.1), "l_tax": F.lit(0.08), "l_extendedprice": F.lit(1.0)}
    spark.range(4 * n).select(*[c.alias(name) for name, c in line.items()]).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(files, "_WRITTEN", {})
    root = files.volume_folder(Views(spark, str(tmp_path))).removeprefix("file:")
    found = [(d, f) for d, _, names in os.walk(root) for f in names if not f.startswith(".")]
    assert len(found) <= 12 and sum(os.path.getsize(f"{d}/{f}") for d, f in found) < 2000 * n
    assert volumes.list_payloads(spark, root, store=volumes.open_packs).count() > 3 * n


def test_stored_rows_are_the_rows_and_their_shuffles_are_freed(spark):
    from cohortscale.session import stored

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).alias("v"), F.array("id").alias("a"))
    grouped = rows.groupBy("k").agg(F.count("v").alias("n"), F.sum("v").alias("v"), F.collect_list("a").alias("a"))
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    held = manager.shuffleStatuses().size()
    got = stored(grouped)
    assert manager.shuffleStatuses().size() <= held
    assert got.dtypes == grouped.dtypes and {r.k: (r.n, len(r.a)) for r in got.collect()} == {r.k: (r.n, len(r.a)) for r in grouped.collect()}
    assert spark.conf.get(name, None) == before


def test_documents_are_written_in_rounds_and_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    """A round shuffles its own volumes only; a task holds few documents; the files are compressed; every volume is in one."""
    monkeypatch.setattr(records, "VOLUMES", 10)
    monkeypatch.setattr(records, "DOCUMENTS", 4)
    rows = spark.range(400).select(F.when(F.col("id") % 4 > 0, F.lit("r")).alias("run"), F.concat(F.lit("a"), F.floor(F.col("id") / 1000).cast("string")).alias("arm"), F.col("id").cast("string").alias("sample_id"))
    sizes = rows.groupBy("run", "arm").agg(F.count("*").alias("n"))
    rounds, tasks = records.rounds_of(sizes)
    assert rounds == 8 and tasks >= 40 // 8 // records.HELD
    monkeypatch.setattr(records, "HELD", 0.5)
    assert records.rounds_of(sizes)[1] == 10
    docs = records.volume_documents(rows, ["run", "arm"], F.struct("sample_id"), sizes, 13)
    assert docs.rdd.getNumPartitions() == 13
    for k in range(rounds):
        here = records.in_round(docs, k, rounds)
        assert {r.part % rounds for r in here.collect()} <= {k}
        records.write_records(here.drop("part"), str(tmp_path / "out"), "append")
    files = [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]
    assert files and all(f.endswith(".gz") for f in files)
    back = records.read_record_lines(spark, str(tmp_path / "out"), "run STRING, arm STRING, per_volume ARRAY<STRUCT<sample_id: STRING>>")
    got = back.select("run", F.explode("per_volume.sample_id").alias("s")).collect()
    assert sorted((int(r.s), r.run) for r in got) == [(k, "r" if k % 4 else None) for k in range(400)]
