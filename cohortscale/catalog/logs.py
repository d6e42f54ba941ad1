"""Access, epoch and telemetry logs on the events table, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortscale.catalog.base import query
from cohortscale.catalog.selection import EPOCHS
from cohortscale.catalog.sql import with_ctes
from cohortscale.operators import logs
from cohortscale.session import scratch_path
from cohortscale.streaming import logs as stream

_ACCESS = """acc AS (SELECT event_type AS bucket, (user_id % 3)::INTEGER AS fold_id, ts, event_id AS entry, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS run_id,
  event_id % 50 AS prior_accesses FROM events)"""


def as_access_log(events):
    return events.select(
        F.col("event_type").alias("bucket"),
        (F.col("user_id") % 3).cast("int").alias("fold_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("entry"),
        F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("run_id"),
        (F.col("event_id") % 50).alias("prior_accesses"),
    )


def event_stream(v):
    return stream.read_parquet_log(v.spark, v.sf_dir, "events.parquet", v.table("events").schema)


def parts_in_time(v, rows, n=5):
    """The rows of a log in ``n`` parts by time, as they would be appended; written once, read a part at a time."""
    micros = F.unix_micros("ts")
    cuts = rows.agg(F.percentile_approx(micros, [k / n for k in range(1, n)])).first()[0] or []
    return parts_by(v, rows, sum(((micros > c).cast("int") for c in cuts), F.lit(0)), n)


def parts_by(v, rows, part, n):
    path = scratch_path(v.spark, "log-parts")
    rows.withColumn("_part", part.cast("int")).write.partitionBy("_part").parquet(path)
    whole = v.spark.read.schema(f"{ddl_of(rows)}, _part int").parquet(path)
    return [whole.filter(F.col("_part") == k).drop("_part") for k in range(n)]


def ddl_of(rows):
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def closing(parts):
    """The parts, then two rows of a run of its own long after them, so that every window is closed."""
    rows = parts[0]
    last = max(p.agg(F.max("ts")).first()[0] for p in parts)
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in ("run", "ts")]
    ends = rows.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("run"), *others)
    late = [ends.withColumn("ts", F.lit(last) + F.expr(f"INTERVAL '{d}' DAY")).select(*rows.columns) for d in (90, 180)]
    return [*parts, *late]


_I1 = with_ctes(_ACCESS) + "SELECT bucket, fold_id, count(DISTINCT run_id) + count(*) FILTER (run_id IS NULL) AS accesses FROM acc GROUP BY ALL"


@query("I1_access_counts", _I1)
def i1(v):
    return logs.access_counts(as_access_log(v.table("events")))


@query("I1_access_counts_stream", _I1)
def i1_stream(v):
    return stream.run_to_table(stream.access_counts(as_access_log(event_stream(v))), "complete", "access-counts")


_I2 = with_ctes(_ACCESS) + "SELECT bucket, fold_id, count(*) AS calls FROM acc GROUP BY ALL"


@query("I2_gate_calls", _I2)
def i2(v):
    return logs.gate_calls(as_access_log(v.table("events")))


@query("I2_gate_calls_stream", _I2)
def i2_stream(v):
    return stream.run_to_table(stream.gate_calls(as_access_log(event_stream(v))), "complete", "gate-calls")


_I3 = (
    with_ctes(_ACCESS)
    + """, f AS (SELECT *, run_id IS NULL OR row_number() OVER (PARTITION BY bucket, fold_id, run_id ORDER BY ts, entry) = 1 AS counts FROM acc)
    SELECT bucket, fold_id, entry, prior_accesses, coalesce(sum(counts::INT) OVER (PARTITION BY bucket, fold_id ORDER BY ts, entry
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior FROM f QUALIFY prior <> prior_accesses"""
)


@query("I3_audit_findings", _I3)
def i3(v):
    out = logs.audit_findings(as_access_log(v.table("events")))
    return out.select("bucket", "fold_id", "entry", "prior_accesses", "prior")


@query("I3_audit_findings_stream", _I3)
def i3_stream(v):
    """The log in five parts, each followed where the stream before it stopped."""
    rows = as_access_log(v.table("events"))
    out = stream.follow_prior_accesses(parts_in_time(v, rows), ddl_of(rows))
    return out.filter("prior_accesses <> prior").select("bucket", "fold_id", "entry", "prior_accesses", "prior")


_METRIC = "CASE WHEN event_type <> 'error' THEN value END"
_I4 = (
    with_ctes(EPOCHS)
    + f""", m AS (SELECT run, epoch, {_METRIC} AS val_dice FROM epochs),
    b AS (SELECT *, max(val_dice) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
      count(val_dice) OVER (PARTITION BY run ORDER BY epoch) AS validated FROM m),
    i AS (SELECT *, val_dice IS NOT NULL AND (before IS NULL OR val_dice > before) AS improved FROM b)
    SELECT run, epoch, val_dice, improved, greatest(before, val_dice) AS best_metric,
      coalesce(max(epoch) FILTER (improved) OVER (PARTITION BY run ORDER BY epoch), -1) AS best_epoch,
      coalesce(validated - max(validated) FILTER (improved) OVER (PARTITION BY run ORDER BY epoch), 0) AS since_improvement FROM i"""
)


def metric_epochs(v):
    return v.epochs.select("run", "epoch", F.when(F.col("event_type") != "error", F.col("value")).alias("val_dice"))


@query("I4_best_and_patience", _I4)
def i4(v):
    return logs.best_and_patience(metric_epochs(v), ["run"])


@query("I4_best_and_patience_stream", _I4)
def i4_stream(v):
    """The epochs in five parts, in the order of time; epochs of one moment are in one part."""
    rows = v.epochs.select("run", "epoch", "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("val_dice"))
    parts = [p.drop("ts") for p in parts_in_time(v, rows)]
    out = stream.follow_patience(parts, "run BIGINT, epoch BIGINT, val_dice DOUBLE", ["run"])
    return out.filter("NOT late").select("run", "epoch", "val_dice", "improved", "best_metric", "best_epoch", "since_improvement")


@query(
    "I4_stopped_early",
    _I4.replace("SELECT run, epoch, val_dice, improved,", ", p AS (SELECT run, epoch, val_dice, improved,")
    + ") SELECT run, min(epoch) AS stopped_at FROM p WHERE since_improvement >= 10 AND best_epoch >= 0 GROUP BY run",
)
def i4_stopped(v):
    return logs.stopped_early(logs.best_and_patience(metric_epochs(v), ["run"]), ["run"], 10)


_SESS = """s AS (SELECT run, event_type, ts, sum((event_type = 'signup')::INT) OVER (PARTITION BY run ORDER BY ts, event_id) AS session FROM epochs)"""
_SESS_OUT = """SELECT run, session::BIGINT AS session, min(ts) AS from_ts, max(ts) AS to_ts, count(*) AS events,
  bool_or(event_type = 'purchase') AS ended, session > 1 AS resumed FROM s GROUP BY ALL"""


def event_sessions(v):
    return logs.sessions(
        v.log, ["run"], F.col("event_type") == "signup", F.col("event_type") == "purchase", ["ts", "event_id"]
    )


@query("I5_sessions", with_ctes(EPOCHS, _SESS) + _SESS_OUT)
def i5(v):
    return event_sessions(v)


@query(
    "I5_unterminated",
    with_ctes(EPOCHS, _SESS, f"o AS ({_SESS_OUT})") + "SELECT * FROM o WHERE session > 0 AND NOT ended",
)
def i5_open(v):
    return logs.unterminated(event_sessions(v))


@query(
    "I5_gap_sessions_stream",
    """WITH g AS (SELECT user_id AS run, ts, event_id, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       n AS (SELECT run, ts, sum(new) OVER (PARTITION BY run ORDER BY ts, event_id) AS k FROM g)
       SELECT run, min(ts) AS from_ts, max(ts) + INTERVAL 6 HOUR AS to_ts, count(*) AS events FROM n GROUP BY run, k""",
)
def i5_stream(v):
    """In five parts; a session is written when the watermark has passed its end, and its state goes."""
    log = v.table("events").select(F.col("user_id").alias("run"), F.col("ts").cast("timestamp").alias("ts"))
    build = lambda rows: stream.gap_sessions(rows, "6 hours", "1 day")
    out = stream.follow(closing(parts_in_time(v, log)), "run BIGINT, ts TIMESTAMP", build, "gap-sessions")
    return out.filter("run >= 0")


@query(
    "I6_loss_criterion",
    with_ctes(EPOCHS)
    + """, m AS (SELECT *, max(epoch) OVER (PARTITION BY run) AS last FROM epochs),
    f AS (SELECT run, count(*) AS epochs, avg(value) FILTER (epoch < 3) AS a, avg(value) FILTER (epoch > last - 3) AS b FROM m GROUP BY run)
    SELECT run, epochs, round(a, 9) AS first_mean, round(b, 9) AS last_mean, round((a - b) / nullif(a, 0), 9) AS reduction, coalesce((a - b) / nullif(a, 0) >= 0.10::DOUBLE, false) AS passed FROM f""",
)
def i6(v):
    out = logs.loss_criterion(v.epochs, ["run"], "value")
    return out.select("run", "epochs", *[F.round(c, 9).alias(c) for c in ("first_mean", "last_mean", "reduction")], "passed")


@query("I7_training_curves", with_ctes(EPOCHS) + "SELECT run, epoch, value FROM epochs WHERE event_type = 'view'")
def i7(v):
    return logs.training_curves(v.epochs, F.col("event_type") == "view", ["run", "epoch", "value"])


def as_telemetry(events):
    return events.select(
        F.col("user_id").alias("run"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("temperature"),
        F.get_json_object("props", "$.k").cast("double").alias("memory_used"),
        F.lit(100.0).alias("memory_total"),
        F.when(F.col("event_type") == "error", F.lit("query failed")).alias("error"),
    ).withColumn("memory_share", F.col("memory_used") / F.col("memory_total"))


_MEM = r"regexp_extract(props, '(\d+)', 1)::DOUBLE / 100.0::DOUBLE"


@query(
    "I8_telemetry_summary",
    f"""SELECT user_id AS run, min(value) AS min_temperature, max(value) AS max_temperature, max({_MEM}) AS peak_memory_share,
        count(*) AS samples, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1""",
)
def i8(v):
    return logs.telemetry_summary(as_telemetry(v.table("events")), ["run"])


@query(
    "I8_telemetry_windows_stream",
    f"""SELECT user_id AS run, time_bucket(INTERVAL 1 DAY, ts) AS from_ts, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS to_ts,
        min(value) AS min_temperature, max(value) AS max_temperature, max({_MEM}) AS peak_memory_share,
        count(*) AS samples, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL""",
)
def i8_stream(v):
    return windows_of(v, "1 day", None)


def windows_of(v, width, slide):
    """In five parts; a window is written when the watermark has passed it, and its state goes."""
    rows = as_telemetry(v.table("events"))
    build = lambda live: stream.telemetry_windows(live, width, "1 day", slide)
    out = stream.follow(closing(parts_in_time(v, rows)), ddl_of(rows), build, "telemetry")
    return out.filter("run >= 0")


@query(
    "I8_sliding_windows_stream",
    f"""WITH w AS (SELECT *, time_bucket(INTERVAL 12 HOUR, ts) - to_hours(12 * k) AS f FROM events, range(2) s(k))
        SELECT user_id AS run, f AS from_ts, f + INTERVAL 1 DAY AS to_ts,
        min(value) AS min_temperature, max(value) AS max_temperature, max({_MEM}) AS peak_memory_share,
        count(*) AS samples, count(*) FILTER (event_type = 'error') AS errors FROM w GROUP BY ALL""",
)
def i8_sliding(v):
    return windows_of(v, "1 day", "12 hours")


@query(
    "I8_late_rows_stream",
    """WITH b AS (SELECT user_id AS run, ts, event_id % 5 AS part FROM events),
      n AS (SELECT part, max(ts) AS newest FROM b GROUP BY part)
      SELECT b.run, count(*) AS late FROM b WHERE ts < (SELECT max(newest) FROM n WHERE n.part < b.part) - INTERVAL 240 HOUR GROUP BY b.run""",
)
def i8_late_rows(v):
    """The events in five parts that overlap in time; rows ten days behind the newest of earlier parts are late."""
    rows = v.table("events").select(F.col("user_id").alias("run"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    parts = [p.drop("event_id") for p in parts_by(v, rows, F.col("event_id") % 5, 5)]
    return stream.follow_late_rows(parts, "run BIGINT, ts TIMESTAMP", 240 * 3600)


@query(
    "I9_epoch_timing",
    with_ctes(EPOCHS)
    + """SELECT e.run, min(value) AS shortest, max(value) AS longest, round(avg(value), 9) AS mean, round(sum(value), 6) AS total, count(*) AS epochs,
      any_value(frames) AS frames, round(avg(value) / any_value(frames), 9) AS seconds_per_frame
      FROM epochs e JOIN (SELECT o_custkey AS run, count(*) AS frames FROM orders GROUP BY 1) f ON f.run = e.run GROUP BY e.run""",
)
def i9(v):
    frames = v.table("orders").groupBy(F.col("o_custkey").alias("run")).agg(F.count("*").alias("frames"))
    out = logs.epoch_timing(v.epochs.withColumn("seconds", F.col("value")), frames, ["run"])
    return out.select(
        "run", "shortest", "longest", F.round("mean", 9).alias("mean"), F.round("total", 6).alias("total"),
        "epochs", "frames", F.round("seconds_per_frame", 9).alias("seconds_per_frame"),
    )


_MSG = """msg AS (SELECT event_id AS seq, user_id AS run, CASE WHEN event_id % 4 > 0 THEN ' ' || event_type || '_kernel does not have a deterministic implementation, id ' || event_id
  ELSE '  memory note of ' || event_type || chr(10) || 'details ' || event_id END AS message FROM events)"""


def messages(v):
    k, t = F.col("event_id"), F.col("event_type")
    text = F.when(
        k % 4 > 0, F.concat(F.lit(" "), t, F.lit("_kernel does not have a deterministic implementation, id "), k.cast("string"))
    ).otherwise(F.concat(F.lit("  memory note of "), t, F.lit("\n"), F.lit("details "), k.cast("string")))
    return v.table("events").select(k.alias("seq"), F.col("user_id").alias("run"), text.alias("message"))


@query(
    "I10_warning_rollup",
    with_ctes(_MSG)
    + r"""SELECT CASE WHEN seq % 4 > 0 THEN regexp_extract(message, '^\s*(\S+) does not', 1) ELSE split_part(trim(message), chr(10), 1) END AS operation,
      count(*) AS count, arg_min(trim(message), seq) AS first_seen FROM msg GROUP BY 1""",
)
def i10(v):
    return logs.warning_rollup(messages(v))


@query(
    "I11_determinism",
    """SELECT r.run, granted, recorded, fallbacks, granted AND fallbacks = 0 AS achieved, (granted AND fallbacks = 0) = recorded AS consistent
       FROM (SELECT c_custkey AS run, c_custkey % 3 > 0 AS granted, c_custkey % 4 > 0 AS recorded,
         (SELECT count(*) FROM events e WHERE e.user_id = c_custkey AND event_type = 'error') AS fallbacks FROM customer) r""",
)
def i11(v):
    k = F.col("c_custkey")
    runs = v.table("customer").select(k.alias("run"), (k % 3 > 0).alias("granted"), (k % 4 > 0).alias("recorded"))
    fallbacks = v.table("events").filter("event_type = 'error'").select(F.col("user_id").alias("run"))
    return logs.determinism(runs, fallbacks)


@query(
    "I12_phase_fractions",
    """WITH w AS (SELECT user_id AS run, coalesce(sum(value) FILTER (event_type = 'view'), 0) AS a, coalesce(sum(value) FILTER (event_type = 'click'), 0) AS b,
         coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS c, sum(value) AS e FROM events GROUP BY 1)
       SELECT run, round(a / nullif(a + b + c, 0), 9) AS view_fraction, round(b / nullif(a + b + c, 0), 9) AS click_fraction,
         round(c / nullif(a + b + c, 0), 9) AS purchase_fraction, round(e - (a + b + c), 6) AS unaccounted FROM w""",
)
def i12(v):
    e = v.table("events")
    timings = e.select(F.col("user_id").alias("run"), F.col("event_type").alias("phase"), F.col("value").alias("seconds"))
    elapsed = e.groupBy(F.col("user_id").alias("run")).agg(F.sum("value").alias("elapsed"))
    out = logs.phase_fractions(timings, elapsed, ("view", "click", "purchase"))
    return out.select("run", *[F.round(f"{p}_fraction", 9).alias(f"{p}_fraction") for p in ("view", "click", "purchase")], F.round("unaccounted", 6).alias("unaccounted"))
