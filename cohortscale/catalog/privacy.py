"""De-identification and publication safety, on the customer table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortscale.catalog.base import query
from cohortscale.catalog.sql import ARMS, with_ctes
from cohortscale.functions.hashing import pseudonym
from cohortscale.operators import privacy
from cohortscale.plans.ordered import ranked

SALT = "pepper-0042"
PROFILE = {"c_name": privacy.PSEUDONYM, "c_acctbal": privacy.REMOVE, "c_phone": privacy.REMOVE, "c_comment": privacy.EMPTY}
SURVIVE = ("c_mktsegment",)
_PSEUDO = f"'COHORT-' || upper(substr(sha256('{SALT}:' || c_name), 1, 16))"
_FINGER = f"substr(sha256('{SALT}'), 1, 16)"


def customers(v):
    return v.table("customer").withColumn("c_comment", F.concat(F.lit("note on "), F.col("c_name")))


def clean(v):
    return privacy.deidentify(customers(v), PROFILE, SALT, SURVIVE)


@query("H1_pseudonym", f"SELECT c_custkey, {_PSEUDO} AS pseudonym FROM customer")
def h1(v):
    return v.table("customer").select("c_custkey", pseudonym(F.col("c_name"), SALT, privacy.PREFIX).alias("pseudonym"))


@query(
    "H2_profile",
    f"""SELECT c_custkey, {_PSEUDO} AS c_name, c_nationkey, c_mktsegment, '' AS c_comment, 'YES' AS identity_removed,
        {_FINGER} AS salt_fingerprint FROM customer""",
)
def h2(v):
    return clean(v)


def spoiled(v):
    """A de-identified table in which some rows lost a step."""
    k = F.col("c_custkey")
    return (
        clean(v)
        .withColumn("c_name", F.when(k % 50 == 1, F.lit("Doe^Jane")).otherwise(F.col("c_name")))
        .withColumn("c_comment", F.when(k % 60 == 2, F.lit("seen")).otherwise(F.col("c_comment")))
        .withColumn("c_acctbal", F.when(k % 70 == 3, F.lit(1.0)))
        .withColumn("identity_removed", F.when(k % 80 == 4, F.lit("NO")).otherwise(F.col("identity_removed")))
    )


@query(
    "H3_verification",
    """SELECT c_custkey, string_split(array_to_string([
         CASE WHEN c_custkey % 70 = 3 THEN 'c_acctbal' END, CASE WHEN c_custkey % 60 = 2 THEN 'c_comment' END,
         CASE WHEN c_custkey % 50 = 1 THEN 'c_name' END, CASE WHEN c_custkey % 80 = 4 THEN 'identity_removed' END], ','), ',') AS violations
       FROM customer WHERE c_custkey % 50 = 1 OR c_custkey % 60 = 2 OR c_custkey % 70 = 3 OR c_custkey % 80 = 4""",
)
def h3(v):
    return privacy.verify(spoiled(v), PROFILE, "c_custkey")


@query(
    "H4_must_survive",
    """SELECT 'c_mktsegment' AS column, count(c_mktsegment) AS before, count(CASE WHEN c_custkey % 9 > 0 THEN c_mktsegment END) AS after, false AS survived FROM customer
       UNION ALL SELECT 'c_nationkey', count(c_nationkey), count(c_nationkey), true FROM customer""",
)
def h4(v):
    after = clean(v).withColumn("c_mktsegment", F.when(F.col("c_custkey") % 9 > 0, F.col("c_mktsegment")))
    return privacy.survivors(customers(v), after, ("c_mktsegment", "c_nationkey"))


@query(
    "H5_pseudonym_audit",
    f"""SELECT count(*) AS patients, count(*) FILTER (c_custkey % 100 <> 7) AS recomputed_equal,
        count(DISTINCT CASE WHEN c_custkey % 100 = 7 THEN 'COHORT-0' ELSE {_PSEUDO} END) AS distinct_pseudonyms,
        count(*) FILTER (c_custkey % 100 <> 7) AS unchanged, count(*) FILTER (c_custkey % 100 = 7) AS changed FROM customer""",
)
def h5(v):
    c = v.table("customer")
    earlier = h1(v)
    now = earlier.withColumn("pseudonym", F.when(F.col("c_custkey") % 100 == 7, F.lit("COHORT-0")).otherwise(F.col("pseudonym")))
    return privacy.pseudonym_audit(c.select("c_custkey", F.col("c_name").alias("identifier")), now, earlier, SALT, "c_custkey")


@query(
    "H5_salt_absent",
    "SELECT unnest(['c_name', 'c_mktsegment', 'c_comment', 'identity_removed', 'salt_fingerprint']) AS column, unnest([0, 0, 0, 0, 0]) AS rows",
)
def h5_salt(v):
    return privacy.text_in_columns(clean(v), SALT)


FIELDS = ("run", "arm", "vendor", "cls", "dice", "predicted_voxels")


@query(
    "H6_published_projection",
    with_ctes(ARMS) + "SELECT run, arm, vendor, cls, round(dice, 9) AS dice, predicted_voxels FROM arms",
)
def h6(v):
    return privacy.published(v.arms, FIELDS).withColumn("dice", F.round("dice", 9))


PATTERNS = {"email": r"[A-Za-z0-9._]+@[A-Za-z0-9]+\.[a-z]+", "number": r"\d{3}-\d{2}-\d{4}"}


@query(
    "H7_leak_scan",
    r"""SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9]+\.[a-z]+')) AS found FROM documents
        UNION ALL SELECT doc_id, 'number', unnest(regexp_extract_all(text, '\d{3}-\d{2}-\d{4}')) FROM documents""",
)
def h7(v):
    return privacy.leaks(v.table("documents"), "doc_id", "text", PATTERNS)


@query(
    "H8_order_leaks",
    with_ctes(ARMS)
    + """SELECT run, arm, cls, predicted_voxels, count(DISTINCT (vendor, reference_voxels)) AS variants FROM arms GROUP BY ALL
      HAVING count(DISTINCT (vendor, reference_voxels)) > 1""",
)
def h8(v):
    return privacy.order_leaks(v.arms, ["run", "arm", "cls", "predicted_voxels"], ["vendor", "reference_voxels"])


@query(
    "H9_withheld_order",
    with_ctes(ARMS)
    + """, pub AS (SELECT run, arm, predicted_voxels, row_number() OVER (PARTITION BY run, arm ORDER BY reference_present DESC, predicted_voxels) AS position FROM arms),
    good AS (SELECT run, arm, predicted_voxels, row_number() OVER (PARTITION BY run, arm ORDER BY predicted_voxels) AS position FROM arms)
    SELECT run, arm, position FROM pub p JOIN good g USING (run, arm, position) WHERE p.predicted_voxels <> g.predicted_voxels""",
)
def h9(v):
    """Published grouped by a withheld column: the order gives the column away."""
    groups, order = ["run", "arm"], ["predicted_voxels"]
    leaky = ranked(v.arms, groups, [F.col("reference_present").desc(), "predicted_voxels", "sample_id", "cls"], "position")
    table = leaky.select(*groups, *order, "position")
    assert not privacy.withheld_columns(table, ["reference_present"])
    return privacy.unsorted_positions(table, groups, order)
