"""Running aggregates and ranks over groups of any size.

A window with an ORDER BY sorts its whole group in one task, so a group holding a third of
the table would stop the job. Here every group is cut into buckets that follow the order: the
buckets are aggregated first, the carry of a bucket is a window over the few bucket rows, and
only the rows of one bucket are sorted together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortscale.session import cut_lineage

BEFORE = (Window.unboundedPreceding, -1)
UP_TO = (Window.unboundedPreceding, Window.currentRow)

_FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL meets NULL; an outer join has the keys of either side."""
    named = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_same_{k}"))
    out = left.join(named, same, how)
    if how == "full":
        out = out.withColumns({k: F.coalesce(k, f"_same_{k}") for k in keys})
    return out.drop(*[f"_same_{k}" for k in keys])


def hash_bucket(column: str | Column, digits: int = 3) -> Column:
    """Up to 16^digits buckets that follow the md5 order of a key."""
    col = F.col(column) if isinstance(column, str) else column
    return F.substring(F.md5(col.cast("string")), 1, digits)


def range_bucket(df: DataFrame, cols: Sequence[str | Column], name: str = "_part") -> DataFrame:
    """Tag rows with a range bucket over ``cols``; ties on ``cols`` share a bucket.

    Spark samples the bounds, so the tagged rows are checkpointed: both uses of a bucket (its
    total and its rows) must see the same bounds, also after an executor is lost.
    """
    return cut_lineage(df.repartitionByRange(*cols).withColumn(name, F.spark_partition_id()))


def running(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[str | Column],
    specs: Mapping[str, tuple[str, str | Column, bool]],
) -> DataFrame:
    """Add running aggregates per ``keys`` in (``bucket``, ``order``) order.

    ``specs`` maps a new column to (``sum``/``max``/``min``, column, whether the current row
    counts). A NULL in ``keys`` or ``bucket`` is a group of its own, a NULL bucket the first.

    What a bucket carries goes before its rows as one row more, so a NULL key needs no join.
    """
    keys = list(keys)
    folded = {n: _FOLDS[kind](c).alias(n) for n, (kind, c, _) in specs.items()}
    totals = df.groupBy(*keys, bucket).agg(*folded.values())
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(*BEFORE)
    carries = totals.select(
        *keys, bucket, *[_FOLDS[kind](n).over(earlier).alias(f"_fold_{n}") for n, (kind, _, _) in specs.items()], F.lit(0).alias("_real")
    )
    kinds = {f.name: f.dataType for f in carries.schema.fields}
    rows = df.withColumns(
        {f"_fold_{n}": (F.col(c) if isinstance(c, str) else c).cast(kinds[f"_fold_{n}"]) for n, (_, c, _) in specs.items()}
    ).withColumn("_real", F.lit(1))
    inside = Window.partitionBy(*keys, bucket).orderBy("_real", *order)
    out = rows.unionByName(carries, allowMissingColumns=True)
    for n, (kind, _, inclusive) in specs.items():
        value = _FOLDS[kind](f"_fold_{n}").over(inside.rowsBetween(*(UP_TO if inclusive else BEFORE)))
        out = out.withColumn(n, F.coalesce(value, F.lit(0)) if kind == "sum" else value)
    return out.filter("_real = 1").drop("_real", *[f"_fold_{n}" for n in specs])


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "rank"
) -> DataFrame:
    """Row number from 1 per ``keys`` in ``order``, without sorting a group in one task.

    Rows equal in ``order`` come in an order of their own, scrambled so that it tells nothing, and
    may be in different buckets. The tagged rows are stored, so their order stays.
    """
    tied = df.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    tagged = range_bucket(tied, [*keys, *order, "_tie"])
    return running(tagged, keys, "_part", [*order, "_tie"], {name: ("sum", F.lit(1), True)}).drop("_part", "_tie")


def hash_ranked(
    df: DataFrame, keys: Sequence[str], hashed: Column, tie: Sequence[str], name: str = "rank",
    digits: int = 3,
) -> DataFrame:
    """Row number from 1 per ``keys`` in (hash, ``tie``) order; buckets are hash prefixes."""
    tagged = df.withColumn("_hash", hashed).withColumn("_part", F.substring("_hash", 1, digits))
    out = running(tagged, keys, "_part", ["_hash", *tie], {name: ("sum", F.lit(1), True)})
    return out.drop("_part", "_hash")


def percentiles(
    df: DataFrame, keys: Sequence[str], value: str, tails: Mapping[str, float]
) -> DataFrame:
    """Exact percentiles, linear between ranks, of groups of any size and any number of values.

    Equal values are counted, the counts are ranked, and only the two neighbours of each wanted
    position are kept. ``tails`` maps a new column to its fraction.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(
        F.count("*").alias("_n")
    )
    placed = range_bucket(counts, [*keys, "_v"])
    totals = placed.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    rows = running(placed, keys, "_part", ["_v"], {"_from": ("sum", "_n", False)})
    rows = join_same(rows, totals, keys)
    picks, out = [], []
    for name, q in tails.items():
        at = F.lit(q) * (F.col("_total") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("_from") <= rank) & (rank < F.col("_from") + F.col("_n"))
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{name}_{side}"))
        place = F.lit(q) * (F.col("_total") - 1)
        share = place - F.floor(place)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((low + (high - low) * share).alias(name))
    return rows.groupBy(*keys, "_total").agg(*picks).select(*keys, *out)
