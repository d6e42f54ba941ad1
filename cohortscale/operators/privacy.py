"""De-identification by profile, its verification, and checks on what is published."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscale.functions.hashing import pseudonym, salt_fingerprint
from cohortscale.plans.ordered import join_same, ranked

REMOVE, EMPTY, PSEUDONYM = "REMOVE", "EMPTY", "PSEUDONYM"
PREFIX = "COHORT-"
DECLARED = "identity_removed"


def deidentify(
    rows: DataFrame, profile: Mapping[str, str], salt: str, must_survive: Sequence[str] = (), prefix: str = PREFIX
) -> DataFrame:
    """Drop, blank or pseudonymise the columns a profile names; declare the result as such."""
    lost = [c for c in must_survive if c in rows.columns and profile.get(c) == REMOVE]
    if lost:
        raise ValueError(f"the profile removes columns that must survive: {lost}")
    out = []
    for c in rows.columns:
        action = profile.get(c)
        if action == REMOVE:
            continue
        if action == EMPTY:
            out.append(F.when(F.col(c).isNotNull(), F.lit("")).alias(c))
        elif action == PSEUDONYM:
            out.append(F.when(F.col(c).isNotNull(), pseudonym(F.col(c), salt, prefix)).alias(c))
        else:
            out.append(F.col(c))
    return rows.select(*out, F.lit("YES").alias(DECLARED), salt_fingerprint(salt).alias("salt_fingerprint"))


def verify(rows: DataFrame, profile: Mapping[str, str], key: str, prefix: str = PREFIX) -> DataFrame:
    """(key, violations): sorted names of columns that still hold what the profile forbids.

    Clean rows are not listed. Only columns the profile names can be checked.
    """
    checks = []
    for c, action in profile.items():
        if c not in rows.columns:
            continue
        value = F.col(c).cast("string")
        if action == REMOVE:
            bad = value.isNotNull()
        elif action == EMPTY:
            bad = value.isNotNull() & (value != "")
        else:
            bad = value.isNotNull() & ~value.startswith(prefix)
        checks.append(F.when(bad, F.lit(c)))
    declared = F.coalesce(F.col(DECLARED), F.lit("")) if DECLARED in rows.columns else F.lit("")
    checks.append(F.when(declared != "YES", F.lit(DECLARED)))
    return rows.select(
        key, F.array_sort(F.array_compact(F.array(*checks))).alias("violations")
    ).filter(F.size("violations") > 0)


def survivors(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null counts of the columns that must survive, before and after."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        have = [c for c in columns if c in df.columns]
        one = df.agg(*[F.count(c).alias(c) for c in have])
        return one.unpivot([], have, "column", name)

    b, a = counts(before, "before"), counts(after, "after")
    return b.join(a, "column", "left").fillna(0, ["after"]).withColumn(
        "survived", F.col("before") == F.col("after")
    )


def pseudonym_audit(
    originals: DataFrame, current: DataFrame, earlier: DataFrame, salt: str, key: str, prefix: str = PREFIX
) -> DataFrame:
    """One row of counts: equal to a recomputation, distinct, unchanged since an earlier run.

    ``originals`` (key, identifier), ``current`` and ``earlier`` (key, pseudonym).
    """
    c = current.select(key, F.col("pseudonym").alias("now"))
    e = earlier.select(key, F.col("pseudonym").alias("then"))
    j = originals.select(key, "identifier").join(c, key, "left").join(e, key, "left")
    again = pseudonym(F.col("identifier"), salt, prefix)
    return j.agg(
        F.count("*").alias("patients"),
        F.count_if(F.col("now") == again).alias("recomputed_equal"),
        F.count_distinct("now").alias("distinct_pseudonyms"),
        F.count_if(F.col("now") == F.col("then")).alias("unchanged"),
        F.count_if(F.col("now") != F.col("then")).alias("changed"),
    )


def text_in_columns(rows: DataFrame, needle: str) -> DataFrame:
    """Rows per string column that contain a text, such as the salt; every column is listed."""
    strings = [c for c, t in rows.dtypes if t == "string"]
    one = rows.agg(*[F.count_if(F.contains(F.col(c), F.lit(needle))).alias(c) for c in strings])
    return one.unpivot([], strings, "column", "rows")


def published(rows: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Allow-listed fields only, in that order; NaN becomes NULL."""
    types = dict(rows.dtypes)
    return rows.select(
        *[
            F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if types[c] == "double" else F.col(c)
            for c in allowed
        ]
    )


def leaks(texts: DataFrame, key: str, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """(key, kind, found) for every match of an identifying pattern in published text."""
    found = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(F.col(text), F.lit(f"({p})"), F.lit(1)).alias("hits"))
            for k, p in patterns.items()
        ]
    )
    return (
        texts.select(key, F.explode(found).alias("f"))
        .select(key, "f.kind", F.explode("f.hits").alias("found"))
    )


def order_leaks(rows: DataFrame, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Sort keys shared by rows that differ in a published field: their order can tell them apart."""
    image = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return (
        rows.groupBy(*order).agg(F.count_distinct(image).alias("variants")).filter("variants > 1")
    )


def unsorted_positions(rows: DataFrame, groups: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Published rows whose position is not the one their values give them.

    ``rows`` carries the ``position`` it was published at. Ties may swap: they hold equal keys.
    """
    right = ranked(rows.select(*groups, *order), groups, [F.col(c).asc_nulls_last() for c in order], "position")
    keyed = right.select(*groups, "position", *[F.col(c).alias(f"_r_{c}") for c in order])
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return join_same(rows, keyed, [*groups, "position"], "left").filter(~same).select(*groups, "position")


def withheld_columns(rows: DataFrame, withheld: Sequence[str]) -> list[str]:
    """Withheld columns that are in a published table."""
    return [c for c in rows.columns if c in set(withheld)]
