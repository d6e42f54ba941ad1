"""Exact comparison of record sets, gates, and checks of published tables and text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscale.functions.text import collapse_spaces
from cohortscale.operators.bootstrap import Boot, estimate, with_all_vendors
from cohortscale.plans.ordered import join_same
from cohortscale.session import cut_lineage, stored
from cohortscale.sources.records import flat_estimates, per_volume_of

ABSENT = "<absent>"
WORD = r"([\p{L}\p{N}]+)"


def leaves(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per scalar: keys, the name of the field and its number. NaN becomes NULL-safe."""
    return rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(
        list(keys), list(values), "leaf", "value"
    )


def compare_leaves(
    reference: DataFrame, candidate: DataFrame, keys: Sequence[str], ignore: Column | None = None
) -> DataFrame:
    """Every differing leaf, exactly compared; NaN and NULL equal themselves.

    ``ignore`` is a predicate on ``leaf`` for the fields that may change.
    """
    on = [*keys, "leaf"]
    if ignore is not None:
        reference, candidate = reference.filter(~ignore), candidate.filter(~ignore)
    a = reference.select(*on, F.col("value").alias("before"), F.lit(True).alias("_a"))
    b = candidate.select(*on, F.col("value").alias("after"), F.lit(True).alias("_b"))
    state = (
        F.when(F.col("_b").isNull(), F.lit("only_reference"))
        .when(F.col("_a").isNull(), F.lit("only_candidate"))
        .when(~F.col("before").eqNullSafe(F.col("after")), F.lit("changed"))
    )
    return a.join(b, on, "full").withColumn("state", state).filter("state IS NOT NULL").drop("_a", "_b")


#: What a record may change at its top without being another.
UNCOMPARED = ("utc", "notes", "bucket_access_count", "per_volume")
_NOT_FINITE = "\x01"
#: Leaves of a round of comparison, at least, and rounds, at most.
LEAVES, ROUNDS = 1 << 21, 8


def _readable(document: Column) -> Column:
    """JSON text in which NaN and the infinities, which are no JSON, are marked strings; texts keep theirs."""
    tokens = F.regexp_extract_all(document, F.lit(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]++|"'), F.lit(0))
    marked = F.transform(
        tokens, lambda t: F.when(F.startswith(t, F.lit('"')), t).otherwise(F.regexp_replace(t, r"NaN|-?Infinity", r'"\\u0001$0"'))
    )
    return F.when(F.rlike(document, F.lit("NaN|Infinity")), F.array_join(marked, "")).otherwise(document)


def _comparable(node: Column, kind: Column) -> Column:
    """Text that is the same for values that are: numbers by value, truth values as 1 and 0, NaN as itself."""
    number, text = node.cast("double"), node.cast("string")
    whole = F.when(F.abs(number) < 1e37, F.when(number == F.floor(number), number.cast("decimal(38,0)").cast("string")))
    integer = (kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$")
    return (
        F.when(integer, node.cast("decimal(38,0)").cast("string"))
        .when(kind == "BOOLEAN", node.cast("boolean").cast("int").cast("string"))
        .when((kind == "STRING") & F.startswith(text, F.lit(_NOT_FINITE)), F.substring(text, 2, 20))
        .when(kind == "STRING", F.concat(F.lit('"'), text))
        .when((kind == "DOUBLE") | (kind == "FLOAT") | F.startswith(kind, F.lit("DECIMAL")), F.coalesce(whole, number.cast("string")))
        .when(kind == "VOID", F.lit("null"))
    )


def record_leaves(records: DataFrame, keys: Sequence[str], document: str = "document", uncompared: Sequence[str] = UNCOMPARED) -> DataFrame:
    """(keys, path, value, comparable): every scalar of every record, whatever its shape, and the length of every list.

    A field is ``/name`` under its parent, a list entry ``[index]``, a list's length ``#len``; ``value`` is JSON text.
    ``uncompared`` fields are left out at the top. A record that is no JSON has one leaf, ``<unreadable>``.
    The records are read as VARIANT, so nothing of their shape is known before, and walked level by
    level: a level opens what the one before it held, all records at once.
    """
    keys = list(keys)
    node, kind = F.col("_node"), F.col("_kind")
    level = records.select(*keys, F.lit("").alias("path"), F.try_parse_json(_readable(F.col(document))).alias("_node"))
    is_list, is_object = (F.startswith(kind, F.lit(k)) for k in ("ARRAY", "OBJECT"))
    entry, field = (lambda step, child: F.struct(F.concat("path", step).alias("path"), child.alias("_node"))), F.lit("/")
    entries = F.transform(node.cast("array<variant>"), lambda x, i: entry(F.concat(F.lit("["), i.cast("string"), F.lit("]")), x))
    fields = F.map_entries(node.cast("map<string, variant>"))
    not_finite = (kind == "STRING") & F.startswith(node.cast("string"), F.lit(_NOT_FINITE))
    shown = F.when(not_finite, F.substring(node.cast("string"), 2, 20)).otherwise(F.to_json(node))
    length = F.size(node.cast("array<variant>")).cast("string")
    unreadable = F.lit("<unreadable>")
    found, top = None, True
    while True:
        # A level is one set of rows, neither a union of its kinds nor read twice: its tasks stay as many as the records'.
        # In an array a variant is read as it is: Spark else casts it where it lies, whatever its kind.
        kept_level = stored(level.select(*keys, "path", F.array(node).alias("_node"), F.schema_of_variant(node).alias("_kind")))
        level = kept_level.withColumn("_node", node[0])
        here = level.filter(kind.isNull() | ~is_object if top else ~is_object).select(
            *keys,
            F.when(is_list, F.concat("path", F.lit("#len"))).otherwise(F.col("path")).alias("path"),
            F.when(kind.isNull(), unreadable).when(is_list, length).otherwise(shown).alias("value"),
            F.when(kind.isNull(), unreadable).when(is_list, length).otherwise(_comparable(node, kind)).alias("comparable"),
        )
        found = here if found is None else found.unionByName(here)
        deeper = level.filter(is_list | is_object)
        if deeper.isEmpty():
            return found
        kept = F.filter(fields, lambda e: ~e["key"].isin(*uncompared)) if top and uncompared else fields
        children = F.when(is_list, entries).otherwise(F.transform(kept, lambda e: entry(F.concat(field, e["key"]), e["value"])))
        level, top = deeper.select(*keys, F.explode(children).alias("_e")).select(*keys, "_e.path", "_e._node"), False


def compare_records(
    reference: DataFrame, candidate: DataFrame, keys: Sequence[str], document: str = "document", uncompared: Sequence[str] = UNCOMPARED
) -> DataFrame:
    """(keys, path, before, after) of every leaf in which two sets of records differ; one that a record lacks is ``<absent>``.

    Records are matched by ``keys``, NULL with NULL, numbers compared by value and exactly, NaN with itself. Leaves are
    many more bytes than records: those of a part of the records are shuffled at a time, by hash of the keys.
    """
    on = [*keys, "path"]
    a = record_leaves(reference, keys, document, uncompared).select(*on, F.col("value").alias("before"), F.col("comparable").alias("_a"))
    b = record_leaves(candidate, keys, document, uncompared).select(*on, F.col("value").alias("after"), F.col("comparable").alias("_b"))
    rounds = max(1, min(ROUNDS, a.count() // LEAVES))
    absent, found = F.lit(ABSENT), None
    for k in range(rounds):
        x, y = (side.filter(F.pmod(F.xxhash64(*keys), F.lit(rounds)) == k) for side in (a, b))
        differ = join_same(x, y, on, "full").filter(~F.col("_a").eqNullSafe(F.col("_b")))
        rows = differ.select(*on, F.coalesce("before", absent).alias("before"), F.coalesce("after", absent).alias("after"))
        rows = stored(rows) if rounds > 1 else rows
        found = rows if found is None else found.unionAll(rows)
    return found


def population_gate(previous: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Who and what was measured may not change; metrics are not read.

    Compares the reference columns per row, and positives and negatives per vendor and class.
    """
    columns = ("reference_present", "reference_voxels")
    rows = compare_leaves(leaves(previous, keys, columns), leaves(new, keys, columns), keys)

    def counts(df: DataFrame) -> DataFrame:
        c = df.groupBy("vendor", "cls").agg(
            F.count_if("reference_present").alias("positives"),
            F.count_if(~F.col("reference_present")).alias("negatives"),
        )
        return leaves(c, ["vendor", "cls"], ["positives", "negatives"])

    cells = compare_leaves(counts(previous), counts(new), ["vendor", "cls"])
    row_key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    return rows.select(
        F.lit("row").alias("what"), row_key.alias("key"), "leaf", "before", "after", "state"
    ).unionByName(
        cells.select(
            F.lit("cell").alias("what"), F.concat_ws("/", "vendor", "cls").alias("key"),
            "leaf", "before", "after", "state",
        )
    )


def header_gate(previous: DataFrame, new: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Header fields of a record that may not change, compared as text."""

    def long(df: DataFrame) -> DataFrame:
        return df.select(*keys, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(
            list(keys), list(fields), "leaf", "value"
        )

    return compare_leaves(long(previous), long(new), keys)


def manifest_problems(entries: DataFrame, files: DataFrame, measured: DataFrame) -> DataFrame:
    """Saved maps against the files present and the rows measured.

    ``entries`` (patient_id, file, sha256), ``files`` (file, sha256), ``measured`` (patient_id).
    """
    have_rows = measured.select("patient_id").distinct()
    found = files.select("file", F.col("sha256").alias("found"), F.lit(True).alias("_file"))
    unsaved = have_rows.join(entries, "patient_id", "left_anti").select(
        F.col("patient_id").cast("string").alias("key"), F.lit("measured but not saved").alias("problem")
    )
    orphan = entries.join(have_rows, "patient_id", "left_anti").select(
        F.col("patient_id").cast("string").alias("key"), F.lit("saved but not measured").alias("problem")
    )
    problem = F.when(F.col("_file").isNull(), F.lit("file missing")).when(
        ~F.col("sha256").eqNullSafe(F.col("found")), F.lit("checksum mismatch")
    )
    content = (
        entries.join(found, "file", "left").withColumn("problem", problem)
        .filter("problem IS NOT NULL").select(F.col("patient_id").cast("string").alias("key"), "problem")
    )
    unlisted = files.join(entries, "file", "left_anti").select(
        F.col("file").alias("key"), F.lit("file not listed").alias("problem")
    )
    return unsaved.unionByName(orphan).unionByName(content).unionByName(unlisted)


def exact_gate(
    regenerated: DataFrame, recorded: DataFrame, keys: Sequence[str], values: Sequence[str], classes: int
) -> DataFrame:
    """Keys that do not match in every value of every class."""
    a = regenerated.select(*keys, "cls", *[F.col(c).alias(f"_a_{c}") for c in values])
    b = recorded.select(*keys, "cls", *[F.col(c).alias(f"_b_{c}") for c in values])
    same = F.lit(True)
    for c in values:
        same = same & F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    matched = a.join(b, [*keys, "cls"]).groupBy(*keys).agg(
        F.bool_and(same).alias("_same"), F.count("*").alias("_n")
    )
    wanted = a.select(*keys).unionByName(b.select(*keys)).distinct()
    ok = F.coalesce(F.col("_same") & (F.col("_n") == classes), F.lit(False))
    return wanted.join(matched, list(keys), "left").filter(~ok).select(*keys)


def tolerance_rules(spark: SparkSession, rules: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(leaf, relative, absolute) tolerances; zero for both means exact."""
    return spark.createDataFrame(
        [(k, float(r), float(a)) for k, (r, a) in rules.items()],
        "leaf STRING, relative DOUBLE, absolute DOUBLE",
    )


def cross_check(first: DataFrame, second: DataFrame, keys: Sequence[str], rules: DataFrame) -> DataFrame:
    """Leaves of two implementations that differ beyond the tolerance of their column.

    A column without a rule must agree exactly. ``rules`` is configuration, a row per column.
    """
    on = [*keys, "leaf"]
    a = first.select(*on, F.col("value").alias("a"))
    b = second.select(*on, F.col("value").alias("b"))
    gap = F.abs(F.col("a") - F.col("b"))
    relative, absolute = (F.coalesce(c, F.lit(0.0)) for c in ("relative", "absolute"))
    room = F.greatest(relative * F.greatest(F.abs(F.col("a")), F.abs(F.col("b"))), absolute)
    same = F.col("a").eqNullSafe(F.col("b")) | F.coalesce(gap <= room, F.lit(False))
    # The rules are one row per column of the comparison.
    return a.join(b, on, "full").join(F.broadcast(rules), "leaf", "left").filter(~same)


def recomputed_differences(records: DataFrame, keys: Sequence[str], boot: Boot, relative: float = 1e-9) -> DataFrame:
    """(keys, vendor, cls, metric, leaf, recomputed, stored): estimates of records that their own volumes do not give again.

    ``records`` as ``sources.records`` reads them, with estimates and the volumes they were made of. Dice means and their
    intervals are made from the volumes with the settings of ``boot``, per vendor where the record has it and over all,
    and compared leaf by leaf; ``relative`` leaves room for sums in another order. A missing one is NULL.
    """
    cell = [*keys, "vendor", "cls", "metric"]
    leaves_of = ("value", "ci_low", "ci_high", "n", "n_measurements")
    stored = flat_estimates(records, keys).filter("metric = 'dice'")
    rows = per_volume_of(records, keys).select(*keys, "vendor", "cls", "patient_id", "dice").withColumn("metric", F.lit("dice"))
    wanted = stored.select(*cell).distinct()
    made = estimate(with_all_vendors(rows).join(wanted, cell, "left_semi"), cell, boot, value="dice")
    rules = tolerance_rules(records.sparkSession, {c: (relative, 0.0) for c in leaves_of[:3]})
    found = cross_check(leaves(made, cell, leaves_of), leaves(stored, cell, leaves_of), cell, rules)
    return found.select(*cell, "leaf", F.col("a").alias("recomputed"), F.col("b").alias("stored"))


def table_differences(generated: DataFrame, published: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Published rows against generated rows by position: differing, missing and extra."""
    on = [*keys, "position"]
    g = generated.select(*on, F.col("line").alias("want"))
    p = published.select(*on, F.col("line").alias("have"))
    problem = (
        F.when(F.col("want").isNull(), F.lit("extra"))
        .when(F.col("have").isNull(), F.lit("missing"))
        .when(F.col("want") != F.col("have"), F.lit("differs"))
    )
    return join_same(g, p, on, "full").withColumn("problem", problem).filter("problem IS NOT NULL")


def _run_keys(rows: DataFrame, key: str, text: str, lengths: Sequence[int], longest: bool) -> DataFrame:
    """(key, run): hashes of the runs of words of the given lengths, or of the longest only."""
    words = rows.select(key, F.regexp_extract_all(text, F.lit(WORD), F.lit(1)).alias("_w"))
    w, n = F.col("_w"), F.size("_w")
    shifted = F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), n).alias("b"), F.slice(w, F.lit(3), n).alias("c"))
    at = words.select(key, n.alias("n"), F.explode(shifted).alias("z")).select(key, "n", "z.a", "z.b", "z.c")
    runs = []
    for k in lengths:
        parts = ["a", "b", "c"][:k]
        whole = F.col(parts[-1]).isNotNull()
        wanted = whole & (F.least("n", F.lit(3)) == k) if longest else whole
        runs.append(F.when(wanted, F.xxhash64(F.lit(k), *parts)))
    return at.select(key, F.explode(F.array_compact(F.array(*runs))).alias("run")).distinct()


def whole_pattern(statement: Column) -> Column:
    """A pattern for the statement where it is no part of a longer word or number.

    A letter or digit at its start may not follow a word's character, and a digit not a point; one
    at its end may not stand before a word's character, or before a point and a digit.
    """
    head, tail = F.left(statement, F.lit(1)), F.right(statement, F.lit(1))
    digit, letter = r"^\d$", r"(?U)^[\p{L}\p{N}]$"
    before = (
        F.when(head.rlike(digit), F.lit(r"(?:^|[^\w.])")).when(head.rlike(letter), F.lit(r"(?:^|\W)")).otherwise(F.lit(""))
    )
    after = F.when(tail.rlike(letter), F.lit(r"(?:\z|[^\w.]|\.(?:\z|\D))")).otherwise(F.lit(""))
    quoted = F.concat(F.lit(r"\Q"), F.replace(statement, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))
    return F.concat(F.lit("(?U)"), before, quoted, after)


def contained_statements(statements: DataFrame, documents: DataFrame) -> DataFrame:
    """(statement_id, doc_id) for every statement that occurs whole in a document.

    A statement can only occur where all its runs of words occur, so its rarest run picks the
    candidate documents by an equi-join on hashes, and only those that contain the statement's
    text are matched at its ends. Statements of one or two words use runs of that length; those
    without a word are looked up by their first character. A statement of blanks is in no document.
    """
    s = statements.select("statement_id", collapse_spaces(F.col("statement")).alias("_s")).filter(F.trim("_s") != "")
    d = documents.select("doc_id", collapse_spaces(F.col("text")).alias("_t"))
    s_runs = _run_keys(s, "statement_id", "_s", (1, 2, 3), longest=True)
    n_words = F.least(F.size(F.regexp_extract_all("_s", F.lit(WORD), F.lit(1))), F.lit(3))
    first = F.when(n_words == 0, F.left(F.trim("_s"), F.lit(1)))
    # At most the four lengths, and the symbols that statements begin with.
    kinds = s.select(n_words.alias("n"), first.alias("symbol")).distinct().collect()
    lengths = sorted({r["n"] for r in kinds} - {0})
    symbols = sorted({r["symbol"] for r in kinds} - {None})
    d_runs = _run_keys(d, "doc_id", "_t", lengths, longest=False) if lengths else None
    if symbols:
        signs = [F.when(F.contains("_t", F.lit(c)), F.xxhash64(F.lit(0), F.lit(c))) for c in symbols]
        by_sign = d.select("doc_id", F.explode(F.array_compact(F.array(*signs))).alias("run"))
        d_runs = by_sign if d_runs is None else d_runs.unionAll(by_sign)
        s_runs = s_runs.unionAll(s.filter(n_words == 0).select("statement_id", F.xxhash64(F.lit(0), first).alias("run")))
    if d_runs is None:
        return statements.join(documents.select("doc_id"), F.lit(False)).select("statement_id", "doc_id")
    hits = cut_lineage(d_runs.join(s_runs.select("run").distinct(), "run", "left_semi"))
    spread = hits.groupBy("run").agg(F.count("*").alias("docs"))
    rarest = (
        s_runs.join(spread, "run", "left")
        .groupBy("statement_id")
        .agg(F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "run")).alias("r"))
        .select("statement_id", F.col("r.run").alias("run"))
    )
    candidates = rarest.join(hits, "run").select("statement_id", "doc_id")
    texts = candidates.join(d, "doc_id").join(s, "statement_id")
    whole = F.contains("_t", "_s") & F.rlike(F.col("_t"), whole_pattern(F.col("_s")))
    return texts.filter(whole).select("statement_id", "doc_id")


def missing_statements(statements: DataFrame, documents: DataFrame) -> DataFrame:
    """Statements no document contains."""
    found = contained_statements(statements, documents).select("statement_id").distinct()
    return statements.join(found, "statement_id", "left_anti").select("statement_id")


def agreeing_prefix(first: DataFrame, second: DataFrame, run: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Last epoch through which two logs of a run agree in every field, and the first that differs."""
    on = [*run, "epoch"]
    a = first.select(*on, *[F.col(f).alias(f"_a_{f}") for f in fields], F.lit(True).alias("_a"))
    b = second.select(*on, *[F.col(f).alias(f"_b_{f}") for f in fields], F.lit(True).alias("_b"))
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    for f in fields:
        same = same & F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}"))
    joined = a.join(b, on, "full")
    return joined.groupBy(*run).agg(
        F.count("*").alias("epochs"), F.min(F.when(~same, F.col("epoch"))).alias("first_difference")
    ).withColumn(
        "agree_through", F.coalesce(F.col("first_difference"), F.col("epochs")) - 1
    )


def count_differences(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose found count is not the expected one; an absent key counts zero."""
    e = expected.select(*keys, F.col("n").alias("expected"))
    f = found.select(*keys, F.col("n").alias("found"))
    return e.join(f, list(keys), "full").fillna(0, ["expected", "found"]).filter("expected <> found")


def expected_after(counts: DataFrame, picked: DataFrame) -> DataFrame:
    """Each bucket opened once more, and a test bucket once again where it holds a pick.

    ``counts`` (run, bucket, n), ``picked`` (run).
    """
    p = picked.select("run").distinct().withColumn("_picked", F.lit(1))
    again = F.when(F.col("bucket") == "test", F.coalesce("_picked", F.lit(0))).otherwise(F.lit(0))
    return counts.join(p, "run", "left").select("run", "bucket", (F.col("n") + 1 + again).alias("n"))


def identifiers(texts: DataFrame, text: str, pattern: str) -> DataFrame:
    """Distinct identifiers found in a text column."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), F.lit(1))
    return texts.select(F.explode(F.array_distinct(found)).alias("identifier")).distinct()


def new_identifiers(added: DataFrame, register: DataFrame) -> DataFrame:
    """Identifiers introduced by new text that the register does not hold."""
    return added.join(register, "identifier", "left_anti")


def union_sets(**sets: DataFrame) -> DataFrame:
    """Record sets one under another, tagged with their name."""
    frames = [df.withColumn("record_set", F.lit(name)) for name, df in sets.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out
