"""Exact comparisons, gates and text checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortscale.catalog.base import BOOT, CLASSES, query
from cohortscale.catalog.selection import EPOCHS
from cohortscale.catalog.sql import ARMS, LATTICE, PER_VOLUME, SPLIT, with_ctes
from cohortscale.operators import bootstrap, masks, reconcile
from cohortscale.schemas import RECORD
from cohortscale.session import freed_shuffles, scratch_path, stored
from cohortscale.sources import maskstore, records

KEYS = ["sample_id", "cls"]
VALUES = ["dice", "predicted_voxels", "reference_voxels", "score"]

# A second record set: some Dice and scores changed, a class of some samples gone, others added.
_CAND = """cand AS (SELECT CASE WHEN sample_id % 97 = 5 THEN -sample_id ELSE sample_id END AS sample_id, patient_id, vendor, cls,
  CASE WHEN sample_id % 31 = 4 THEN dice / 2 ELSE dice END AS dice, predicted_voxels,
  CASE WHEN sample_id % 53 = 7 THEN reference_voxels + 1 ELSE reference_voxels END AS reference_voxels,
  CASE WHEN sample_id % 53 = 7 THEN true ELSE reference_present END AS reference_present,
  CASE WHEN sample_id % 37 = 6 THEN NULL ELSE score END AS score FROM per_volume)"""


def candidate(v):
    k = F.col("sample_id")
    hit = k % 53 == 7
    return (
        v.per_volume.withColumn("dice", F.when(k % 31 == 4, F.col("dice") / 2).otherwise(F.col("dice")))
        .withColumn("score", F.when(k % 37 == 6, F.lit(float("nan"))).otherwise(F.col("score")))
        .withColumn("reference_voxels", F.when(hit, F.col("reference_voxels") + 1).otherwise(F.col("reference_voxels")))
        .withColumn("reference_present", hit | F.col("reference_present"))
        .withColumn("sample_id", F.when(k % 97 == 5, -k).otherwise(k))
    )


def _leaf_union(source: str, values=VALUES) -> str:
    return " UNION ALL ".join(f"SELECT sample_id, cls, '{v}' AS leaf, {v}::DOUBLE AS value FROM {source}" for v in values)


def _diff(values) -> str:
    return f""", a AS (SELECT *, true AS x FROM ({_leaf_union('per_volume', values)})), b AS (SELECT *, true AS y FROM ({_leaf_union('cand', values)}))
    SELECT * FROM (SELECT sample_id, cls, leaf, a.value AS before, b.value AS after,
      CASE WHEN y IS NULL THEN 'only_reference' WHEN x IS NULL THEN 'only_candidate' WHEN a.value IS DISTINCT FROM b.value THEN 'changed' END AS state
      FROM a FULL JOIN b USING (sample_id, cls, leaf)) WHERE state IS NOT NULL"""


def leaf_pair(v, values=VALUES):
    def clean(df):
        return df.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))

    return (
        reconcile.leaves(clean(v.per_volume), KEYS, values),
        reconcile.leaves(clean(candidate(v)), KEYS, values),
    )


@query("G1_record_comparison", with_ctes(PER_VOLUME, _CAND) + _diff(VALUES))
def g1(v):
    return reconcile.compare_leaves(*leaf_pair(v), KEYS)


@query("G2_all_but_one_metric", with_ctes(PER_VOLUME, _CAND) + _diff(["predicted_voxels", "reference_voxels", "score"]))
def g2(v):
    return reconcile.compare_leaves(*leaf_pair(v), KEYS, ignore=F.col("leaf") == "dice")


# Records of another shape: a class and a field gone, a list longer, a truth value for a number, other notes.
_NESTED = """ra AS (SELECT sample_id, unnest([{'path': '/vendor', 'value': vendor}, {'path': '/classes/' || cls || '/dice', 'value': dice::VARCHAR},
    {'path': '/classes/' || cls || '/voxels#len', 'value': '2'}, {'path': '/classes/' || cls || '/voxels[0]', 'value': predicted_voxels::VARCHAR},
    {'path': '/classes/' || cls || '/voxels[1]', 'value': reference_voxels::VARCHAR}, {'path': '/classes/' || cls || '/present', 'value': reference_present::INT::VARCHAR},
    {'path': '/classes/' || cls || '/score', 'value': coalesce(score::VARCHAR, 'nan')}], recursive := true) FROM per_volume),
  rb AS (SELECT sample_id, unnest([{'path': '/vendor', 'value': vendor}, {'path': '/classes/' || cls || '/dice', 'value': CASE WHEN sample_id % 31 = 4 THEN dice / 2 ELSE dice END::VARCHAR},
    {'path': '/classes/' || cls || '/voxels#len', 'value': CASE WHEN sample_id % 41 = 5 THEN '3' ELSE '2' END}, {'path': '/classes/' || cls || '/voxels[0]', 'value': predicted_voxels::VARCHAR},
    {'path': '/classes/' || cls || '/voxels[1]', 'value': reference_voxels::VARCHAR}, {'path': CASE WHEN sample_id % 41 = 5 THEN '/classes/' || cls || '/voxels[2]' END, 'value': '-1'},
    {'path': '/classes/' || cls || '/present', 'value': reference_present::INT::VARCHAR}, {'path': CASE WHEN sample_id % 47 <> 6 THEN '/classes/' || cls || '/score' END, 'value': coalesce(score::VARCHAR, 'nan')}], recursive := true)
    FROM per_volume WHERE NOT (sample_id % 43 = 3 AND cls = 'A'))"""


@query(
    "G1_nested_records",
    with_ctes(PER_VOLUME, _NESTED)
    + """SELECT sample_id, path, before, after FROM (SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, coalesce(a.path, b.path) AS path,
      CASE WHEN a.path IS NULL THEN '<absent>' WHEN a.path LIKE '%/present' THEN (a.value = '1')::VARCHAR
        ELSE replace(coalesce(round(try_cast(a.value AS DOUBLE), 6)::VARCHAR, a.value), 'nan', 'NaN') END AS before,
      CASE WHEN b.path IS NULL THEN '<absent>' ELSE replace(coalesce(round(try_cast(b.value AS DOUBLE), 6)::VARCHAR, b.value), 'nan', 'NaN') END AS after, a.value AS x, b.value AS y
      FROM (SELECT DISTINCT * FROM ra) a FULL JOIN (SELECT DISTINCT * FROM rb WHERE path IS NOT NULL) b ON a.sample_id = b.sample_id AND a.path = b.path) WHERE x IS DISTINCT FROM y""",
)
def g1_nested(v):
    """A record per sample, nested as they are written, against records of another shape; leaf by leaf."""
    k = F.col("sample_id")

    def documents(rows, name, voxels, present, score):
        cell = F.concat(
            F.lit('"'), F.col("cls"), F.lit('": {"dice": '), name.cast("string"), F.lit(', "voxels": '), F.to_json(voxels), F.lit(', "present": '), present, score, F.lit("}")
        )
        classes = rows.groupBy("sample_id", "vendor").agg(F.array_sort(F.collect_list(cell)).alias("c"))
        text = F.concat(
            F.lit('{"vendor": "'), F.col("vendor"), F.lit('", "utc": "'), F.lit(rows.columns[-1]), F.lit('", "classes": {'), F.array_join("c", ", "), F.lit("}}")
        )
        return classes.select("sample_id", text.alias("document"))

    rows = v.stored_volumes
    counts = [F.col("predicted_voxels"), F.col("reference_voxels")]
    score = F.concat(F.lit(', "score": '), F.coalesce(F.col("score").cast("string"), F.lit("NaN")))
    before = documents(rows, F.col("dice"), F.array(*counts), F.col("reference_present").cast("string"), score)
    changed = rows.filter(~((k % 43 == 3) & (F.col("cls") == "A"))).withColumn("later", F.lit(1))
    after = documents(
        changed, F.when(k % 31 == 4, F.col("dice") / 2).otherwise(F.col("dice")),
        F.when(k % 41 == 5, F.array(*counts, F.lit(-1).cast("bigint"))).otherwise(F.array(*counts)),
        F.col("reference_present").cast("int").cast("string"), F.when(k % 47 == 6, F.lit("")).otherwise(score),
    )
    out = reconcile.compare_records(before, after, ["sample_id"])

    def shown(column):
        return F.coalesce(F.round(F.col(column).try_cast("double"), 6).cast("string"), F.col(column)).alias(column)

    return out.select("sample_id", "path", shown("before"), shown("after"))


_POP = """, rows AS (SELECT * FROM (SELECT 'row' AS what, sample_id::VARCHAR || '/' || cls AS key, leaf, a.value AS before, b.value AS after,
   CASE WHEN y IS NULL THEN 'only_reference' WHEN x IS NULL THEN 'only_candidate' WHEN a.value IS DISTINCT FROM b.value THEN 'changed' END AS state
   FROM (SELECT *, true AS x FROM (SELECT sample_id, cls, unnest(['reference_present', 'reference_voxels']) AS leaf, unnest([reference_present::INT::DOUBLE, reference_voxels::DOUBLE]) AS value FROM per_volume)) a
   FULL JOIN (SELECT *, true AS y FROM (SELECT sample_id, cls, unnest(['reference_present', 'reference_voxels']) AS leaf, unnest([reference_present::INT::DOUBLE, reference_voxels::DOUBLE]) AS value FROM cand)) b
   USING (sample_id, cls, leaf)) WHERE state IS NOT NULL),
 ca AS (SELECT vendor, cls, unnest(['positives', 'negatives']) AS leaf, unnest([count(*) FILTER (reference_present), count(*) FILTER (NOT reference_present)])::DOUBLE AS value FROM per_volume GROUP BY vendor, cls),
 cb AS (SELECT vendor, cls, unnest(['positives', 'negatives']) AS leaf, unnest([count(*) FILTER (reference_present), count(*) FILTER (NOT reference_present)])::DOUBLE AS value FROM cand GROUP BY vendor, cls)
 SELECT * FROM rows UNION ALL SELECT 'cell', vendor || '/' || cls, leaf, ca.value, cb.value, 'changed' FROM ca JOIN cb USING (vendor, cls, leaf) WHERE ca.value <> cb.value"""


@query("G3_population_gate", with_ctes(PER_VOLUME, _CAND) + _POP)
def g3(v):
    return reconcile.population_gate(v.per_volume, candidate(v), KEYS)


_HEADER = ["n_patients", "n_volumes", "n_rows"]


def _header_sql(name, table):
    return f"""{name} AS (SELECT vendor, unnest({_HEADER}) AS leaf, unnest([count(DISTINCT patient_id)::VARCHAR,
      count(DISTINCT sample_id)::VARCHAR, count(*)::VARCHAR]) AS value FROM {table} GROUP BY vendor)"""


@query(
    "G3_header_gate",
    with_ctes(PER_VOLUME, _CAND, _header_sql("ha", "per_volume"), _header_sql("hb", "cand"))
    + """SELECT vendor, leaf, ha.value AS before, hb.value AS after, CASE WHEN hb.value IS NULL THEN 'only_reference'
      WHEN ha.value IS NULL THEN 'only_candidate' ELSE 'changed' END AS state
      FROM ha FULL JOIN hb USING (vendor, leaf) WHERE ha.value IS DISTINCT FROM hb.value""",
)
def g3_header(v):
    def header(rows):
        return rows.groupBy("vendor").agg(
            F.count_distinct("patient_id").alias("n_patients"), F.count_distinct("sample_id").alias("n_volumes"), F.count("*").alias("n_rows")
        )

    return reconcile.header_gate(header(v.per_volume), header(candidate(v)), ["vendor"], _HEADER)


_SHA = """slices AS (SELECT sample_id, z, count(*) AS voxels, sha256(string_agg(cls || ':' || y || ':' || x, ',' ORDER BY cls || ':' || y || ':' || x)) AS h FROM pred GROUP BY ALL),
entries AS (SELECT sample_id AS patient_id, 'map-' || sample_id AS file, sha256(string_agg(z || '=' || h, ',' ORDER BY z)) AS sha256, sum(voxels)::BIGINT AS voxels FROM slices GROUP BY sample_id)"""


@query(
    "G4_manifest_against_files",
    with_ctes(LATTICE, _SHA)
    + """, files AS (SELECT CASE WHEN patient_id % 19 = 3 THEN 'stray-' || patient_id ELSE file END AS file,
        CASE WHEN patient_id % 23 = 2 THEN sha256(sha256) ELSE sha256 END AS sha256 FROM entries),
    measured AS (SELECT CASE WHEN c_custkey % 29 = 1 THEN -c_custkey ELSE c_custkey END AS patient_id FROM customer)
    SELECT patient_id::VARCHAR AS key, 'measured but not saved' AS problem FROM measured WHERE patient_id NOT IN (SELECT patient_id FROM entries)
    UNION ALL SELECT patient_id::VARCHAR, 'saved but not measured' FROM entries WHERE patient_id NOT IN (SELECT patient_id FROM measured)
    UNION ALL SELECT patient_id::VARCHAR, 'file missing' FROM entries WHERE file NOT IN (SELECT file FROM files)
    UNION ALL SELECT patient_id::VARCHAR, 'checksum mismatch' FROM entries e JOIN files f ON f.file = e.file WHERE f.sha256 <> e.sha256
    UNION ALL SELECT file, 'file not listed' FROM files WHERE file NOT IN (SELECT file FROM entries)""",
)
def g4(v):
    entries = maskstore.checksums(v.lattice("pred"), "sample_id").select(
        F.col("sample_id").alias("patient_id"), F.concat(F.lit("map-"), F.col("sample_id").cast("string")).alias("file"), "sha256"
    )
    p = F.col("patient_id")
    files = entries.select(
        F.when(p % 19 == 3, F.concat(F.lit("stray-"), p.cast("string"))).otherwise(F.col("file")).alias("file"),
        F.when(p % 23 == 2, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"),
    )
    measured = v.patients.select(F.when(p % 29 == 1, -p).otherwise(p).alias("patient_id"))
    return reconcile.manifest_problems(entries, files, measured)


@query(
    "G5_exact_match_gate",
    with_ctes(PER_VOLUME, _CAND)
    + """, k AS (SELECT DISTINCT sample_id FROM per_volume UNION SELECT DISTINCT sample_id FROM cand),
    m AS (SELECT a.sample_id, bool_and(a.dice = b.dice AND a.predicted_voxels = b.predicted_voxels) AS same, count(*) AS n
      FROM per_volume a JOIN cand b ON a.sample_id = b.sample_id AND a.cls = b.cls GROUP BY 1)
    SELECT k.sample_id FROM k LEFT JOIN m ON m.sample_id = k.sample_id WHERE NOT coalesce(same AND n = 3, false)""",
)
def g5(v):
    return reconcile.exact_gate(v.per_volume, candidate(v), ["sample_id"], ["dice", "predicted_voxels"], len(CLASSES))


RULES = {"dice": (0.0, 0.0), "predicted_voxels": (0.0, 0.0), "score": (1e-4, 0.0), "reference_voxels": (0.0, 1.5)}


@query(
    "G6_two_implementations",
    with_ctes(PER_VOLUME)
    + """, second AS (SELECT sample_id, cls, CASE WHEN sample_id % 31 = 4 THEN dice + 1e-15::DOUBLE ELSE dice END AS dice, predicted_voxels,
       CASE WHEN sample_id % 3 = 0 THEN score * 1.00001::DOUBLE ELSE score * 1.001::DOUBLE END AS score, reference_voxels + sample_id % 3 AS reference_voxels FROM per_volume),
    rules(leaf, relative, absolute) AS (VALUES ('dice', 0.0::DOUBLE, 0.0::DOUBLE), ('predicted_voxels', 0.0::DOUBLE, 0.0::DOUBLE), ('score', 1e-4::DOUBLE, 0.0::DOUBLE), ('reference_voxels', 0.0::DOUBLE, 1.5::DOUBLE)),
    la AS ("""
    + _leaf_union("per_volume")
    + "), lb AS ("
    + _leaf_union("second")
    + """) SELECT la.leaf, count(*) AS outside, round(max(abs(la.value - lb.value)), 4) AS widest FROM la JOIN lb USING (sample_id, cls, leaf) JOIN rules USING (leaf)
      WHERE la.value IS DISTINCT FROM lb.value AND NOT coalesce(abs(la.value - lb.value) <= greatest(relative * greatest(abs(la.value), abs(lb.value)), absolute), false) GROUP BY ALL""",
)
def g6(v):
    k = F.col("sample_id")
    second = (
        v.per_volume.withColumn("dice", F.when(k % 31 == 4, F.col("dice") + 1e-15).otherwise(F.col("dice")))
        .withColumn("score", F.when(k % 3 == 0, F.col("score") * 1.00001).otherwise(F.col("score") * 1.001))
        .withColumn("reference_voxels", F.col("reference_voxels") + k % 3)
    )
    a, b = reconcile.leaves(v.per_volume, KEYS, VALUES), reconcile.leaves(second, KEYS, VALUES)
    found = reconcile.cross_check(a, b, KEYS, reconcile.tolerance_rules(v.spark, RULES))
    return found.groupBy("leaf").agg(F.count("*").alias("outside"), F.round(F.max(F.abs(F.col("a") - F.col("b"))), 4).alias("widest"))


@query(
    "G7_published_table",
    """SELECT * FROM (SELECT doc, position, want, have, CASE WHEN want IS NULL THEN 'extra' WHEN have IS NULL THEN 'missing' WHEN want <> have THEN 'differs' END AS problem FROM
      (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, o_orderpriority AS want FROM orders)
      FULL JOIN (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position,
        CASE WHEN o_orderkey % 40 = 3 THEN 'edited' ELSE o_orderpriority END AS have FROM orders WHERE o_orderstatus <> 'P' OR o_custkey % 7 <> 2) USING (doc, position)) WHERE problem IS NOT NULL""",
)
def g7(v):
    from cohortscale.plans.ordered import ranked

    rows = v.table("orders").select(F.col("o_custkey").alias("doc"), "o_orderkey", "o_orderpriority", "o_orderstatus")
    generated = ranked(rows, ["doc"], ["o_orderkey"], "position").withColumn("line", F.col("o_orderpriority"))
    kept = rows.filter("o_orderstatus <> 'P' OR doc % 7 <> 2")
    edited = F.when(F.col("o_orderkey") % 40 == 3, F.lit("edited")).otherwise(F.col("o_orderpriority"))
    published = ranked(kept, ["doc"], ["o_orderkey"], "position").withColumn("line", edited)
    return reconcile.table_differences(generated, published, ["doc"])


_STATEMENTS = """st AS (SELECT item_id * 1000 + i AS statement_id, trim(s) AS statement FROM (
   SELECT item_id, unnest(regexp_split_to_array(text, '[.\\n]')) AS s, generate_subscripts(regexp_split_to_array(text, '[.\\n]'), 1) - 1 AS i FROM benchmark) WHERE trim(s) <> ''),
sn AS (SELECT statement_id, regexp_replace(statement, '\\s+', ' ', 'g') AS s FROM st),
dn AS (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM documents)"""


def statements(v):
    parts = F.posexplode(F.split("text", r"[.\n]", -1)).alias("i", "s")
    return v.table("benchmark").select("item_id", parts).select(
        (F.col("item_id") * 1000 + F.col("i")).alias("statement_id"), F.trim("s").alias("statement")
    ).filter("statement <> ''")


_HIT = r"""regexp_matches(t, '(^|[^\pL\pN_])' || regexp_escape(s) || '($|[^\pL\pN_.]|\.$|\.[^0-9])')"""


@query(
    "G8_statement_containment",
    with_ctes(_STATEMENTS) + f"SELECT statement_id, doc_id FROM sn JOIN dn ON contains(t, s) WHERE {_HIT}",
)
def g8(v):
    return reconcile.contained_statements(statements(v), v.table("documents"))


@query(
    "G8_missing_statements",
    with_ctes(_STATEMENTS) + f"SELECT statement_id FROM sn WHERE statement_id NOT IN (SELECT statement_id FROM sn JOIN dn ON contains(t, s) WHERE {_HIT})",
)
def g8_missing(v):
    return reconcile.missing_statements(statements(v), v.table("documents"))


@query(
    "G9_agreeing_prefix",
    with_ctes(EPOCHS)
    + """, second AS (SELECT run, epoch, CASE WHEN epoch > 3 + run % 17 AND event_type = 'click' THEN value + 1 ELSE value END AS value FROM epochs)
    SELECT run, count(*) AS epochs, min(epoch) FILTER (a.value <> b.value) AS first_difference,
      coalesce(min(epoch) FILTER (a.value <> b.value), count(*)) - 1 AS agree_through FROM epochs a JOIN second b USING (run, epoch) GROUP BY run""",
)
def g9(v):
    drift = (F.col("epoch") > 3 + F.col("run") % 17) & (F.col("event_type") == "click")
    second = v.epochs.withColumn("value", F.when(drift, F.col("value") + 1).otherwise(F.col("value")))
    return reconcile.agreeing_prefix(v.epochs, second, ["run"], ["value"])


@query(
    "G10_expected_counts",
    with_ctes(SPLIT)
    + """, c AS (SELECT held_out_vendor AS run, bucket, count(*) AS n FROM split GROUP BY ALL),
    after AS (SELECT run, bucket, n + 1 + CASE WHEN bucket = 'test' AND run IN ('BUILDING', 'FURNITURE') THEN 1 ELSE 0 END AS n FROM c)
    SELECT run, bucket, after.n AS expected, c.n + 1 AS found FROM after JOIN c USING (run, bucket) WHERE after.n <> c.n + 1""",
)
def g10(v):
    counts = v.split.groupBy(F.col("held_out_vendor").alias("run"), "bucket").agg(F.count("*").alias("n"))
    picked = v.spark.createDataFrame([("BUILDING",), ("FURNITURE",)], "run STRING")
    found = counts.withColumn("n", F.col("n") + 1)
    return reconcile.count_differences(reconcile.expected_after(counts, picked), found, ["run", "bucket"])


# A capital and two to four small letters, alone: ASCII letters, digits and _ make words, as in the SQL's \b.
_ID = r"(?<![A-Za-z0-9_])[A-Z][a-z]{2,4}(?![A-Za-z0-9_])"


@query(
    "G11_new_identifiers",
    r"""SELECT DISTINCT identifier FROM (SELECT unnest(regexp_extract_all(text, '\b[A-Z][a-z]{2,4}\b')) AS identifier FROM documents)
        WHERE identifier NOT IN (SELECT unnest(regexp_extract_all(text, '\b[A-Z][a-z]{2,4}\b')) FROM benchmark)""",
)
def g11(v):
    return reconcile.new_identifiers(
        reconcile.identifiers(v.table("documents"), "text", _ID), reconcile.identifiers(v.table("benchmark"), "text", _ID)
    )


@query(
    "G12_intervals_recomputed",
    with_ctes(ARMS)
    + """SELECT DISTINCT run, arm, 'all_vendors' AS vendor, cls, 'dice' AS metric, CASE WHEN cls = 'R' THEN 'ci_low' ELSE 'n' END AS leaf
      FROM arms WHERE (run = 'BUILDING' AND cls = 'R') OR (run = 'MACHINERY' AND cls = 'A' AND arm = 'test')""",
)
def g12_intervals(v):
    """Stored records with their volumes; an interval and a count among their estimates were altered."""
    path = scratch_path(v.spark, "stored-records")
    rows = v.stored_arms.withColumns({"patient_id": F.col("patient_id").cast("string"), "vendor": F.lit("all_vendors"), "metric": F.lit("dice")})
    est = bootstrap.estimate(rows, ["run", "arm", "vendor", "cls", "metric"], BOOT, value="dice")
    low = (F.col("run") == "BUILDING") & (F.col("cls") == "R")
    more = (F.col("run") == "MACHINERY") & (F.col("cls") == "A") & (F.col("arm") == "test")
    est = est.withColumn("ci_low", F.when(low, F.col("ci_low") - 0.001).otherwise(F.col("ci_low"))).withColumn("n", F.col("n") + more.cast("int"))
    volume = F.struct(*[F.col(c).cast("string").alias(c) for c in ("sample_id", "patient_id")], "vendor", F.col("cls").alias("fluid_class"), "dice")
    sizes = stored(v.arm_sizes)
    rounds, tasks = records.rounds_of(sizes)
    volumes = records.volume_documents(v.stored_arms, ["run", "arm"], volume, sizes, tasks)
    # The first document of a record has its estimates.
    nested = stored(records.nested_estimates(est, ["run", "arm"], BOOT).withColumn("part", F.lit(0).cast("long")))
    for k in range(rounds):
        here = [records.in_round(d, k, rounds) for d in (nested.hint("shuffle_hash"), volumes)]  # documents are too long to sort
        with freed_shuffles(v.spark):
            records.write_records(here[0].join(here[1], ["run", "arm", "part"], "full").drop("part"), path, "append")
    back = records.read_record_lines(v.spark, path, f"run STRING, arm STRING, {RECORD}")
    return reconcile.recomputed_differences(back, ["run", "arm"], BOOT).drop("recomputed", "stored")


@query(
    "G12_aggregates_recomputable",
    with_ctes(PER_VOLUME)
    + """, agg AS (SELECT vendor, cls, round(avg(dice), 9) AS dice, count(*)::DOUBLE AS n, sum(predicted_voxels)::DOUBLE AS predicted_voxels FROM per_volume GROUP BY ALL),
    l AS (SELECT vendor, cls, unnest(['dice', 'n', 'predicted_voxels']) AS leaf, unnest([dice, n, predicted_voxels]) AS before,
      unnest([dice + CASE WHEN vendor = 'BUILDING' THEN 0.5::DOUBLE ELSE 0 END, n, predicted_voxels + CASE WHEN cls = 'R' THEN 1 ELSE 0 END]) AS after FROM agg)
    SELECT vendor, cls, leaf, before, after, 'changed' AS state FROM l WHERE before <> after""",
)
def g12(v):
    def aggregate(df):
        return df.groupBy("vendor", "cls").agg(
            F.round(F.avg("dice"), 9).alias("dice"), F.count("*").alias("n"), F.sum("predicted_voxels").alias("predicted_voxels")
        )

    keys, values = ["vendor", "cls"], ["dice", "n", "predicted_voxels"]
    agg = aggregate(v.per_volume)
    stored = agg.withColumn("dice", F.col("dice") + F.when(F.col("vendor") == "BUILDING", F.lit(0.5)).otherwise(F.lit(0.0))).withColumn(
        "predicted_voxels", F.col("predicted_voxels") + F.when(F.col("cls") == "R", F.lit(1)).otherwise(F.lit(0))
    )
    return reconcile.compare_leaves(reconcile.leaves(agg, keys, values), reconcile.leaves(stored, keys, values), keys)


@query(
    "G13_union_of_sets",
    with_ctes(PER_VOLUME, _CAND)
    + """SELECT record_set, cls, count(*) AS n, round(avg(dice), 9) AS dice FROM (SELECT 'previous' AS record_set, cls, dice FROM per_volume
      UNION ALL SELECT 'new', cls, dice FROM cand) GROUP BY ALL""",
)
def g13(v):
    both = reconcile.union_sets(previous=v.per_volume, new=candidate(v))
    return both.groupBy("record_set", "cls").agg(F.count("*").alias("n"), F.round(F.avg("dice"), 9).alias("dice"))
