"""Shards along a Hilbert curve over several metadata fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortscale.session import cut_lineage

#: Bits each field is quantised to.
BITS = 10


def curve_steps(n: int) -> list[int]:
    """The curve in ``n`` dimensions as a table: at state * 2^n + cell stands next state * 2^n + digit.

    A state is an entry corner and an axis. Within a cell of one level, the corners are walked in
    the order of the Gray code, turned and mirrored by the state.
    """
    size, mask = 1 << n, (1 << n) - 1

    def turn(x: int, by: int) -> int:
        by %= n
        return ((x << by) | (x >> (n - by))) & mask

    gray = [i ^ (i >> 1) for i in range(size)]
    place = {g: i for i, g in enumerate(gray)}
    corner = [0 if w == 0 else gray[2 * ((w - 1) // 2)] for w in range(size)]

    def trailing(i: int) -> int:
        return ((~i & (i + 1)).bit_length() - 1) % n

    axis = [0 if w == 0 else trailing(w - 1 if w % 2 == 0 else w) for w in range(size)]
    table = []
    for state in range(size * n):
        entry, d = divmod(state, n)
        for cell in range(size):
            w = place[turn(cell ^ entry, -(d + 1))]
            entry_next = entry ^ turn(corner[w], d + 1)
            table.append((entry_next * n + (d + axis[w] + 1) % n) * size + w)
    return table


def curve_index(levels: Sequence[Column], bits: int = BITS) -> Column:
    """Place on the curve of the cell whose coordinates are ``levels``, each of ``bits`` bits."""
    n = len(levels)
    if n * bits > 62:
        raise ValueError("the index must fit 62 bits")
    size = 1 << n
    steps = F.array(*[F.lit(v) for v in curve_steps(n)])

    def step(acc: Column, k: Column) -> Column:
        cell = sum(
            (F.call_function("shiftright", x, k).bitwiseAND(F.lit(1)) * (1 << i) for i, x in enumerate(levels)),
            F.lit(0),
        )
        to = F.element_at(steps, (acc["state"] * size + cell + 1).cast("int"))
        return F.struct(
            (F.floor(to / size)).cast("int").alias("state"),
            (acc["at"] * size + to % size).cast("long").alias("at"),
        )

    first = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), first, step, lambda acc: acc["at"])


def _number(df: DataFrame, name: str) -> Column:
    """A field as a number whose order is the field's: numbers on a log scale, text by its first bytes."""
    col = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(col, "utf-8"), 1, 7)), 14, "0")
        return F.conv(head, 16, 10).cast("double")
    value = col.cast("double")
    return F.signum(value) * F.log1p(F.abs(value))


def assign_shards(
    samples: DataFrame, key: Sequence[str], fields: Sequence[str], shards: int, bits: int = BITS
) -> DataFrame:
    """Cut ``samples`` into ``shards`` runs of a Hilbert curve over ``fields``, counts at most one apart.

    Adds (curve, shard, slot): the place on the curve, the run 0 to ``shards`` - 1, and the place
    inside the run from 0 without gaps. A field is quantised to ``bits`` bits between its smallest
    and largest value, numbers on a log scale and text by its first seven bytes, so a file of one
    shard spans a narrow range of every field and is skipped by most filters on any of them.

    Rows are ordered by (curve, ``key``); rows equal in all of these may swap places. NULL fields take level 0. An empty table
    stays empty; fewer rows than shards leave the last ones empty. Give few narrow columns: they are sorted and stored.
    Columns that begin with ``_hil_`` must not be there.
    """
    numbers = [_number(samples, f) for f in fields]
    ends = samples.agg(*[f(x) for x in numbers for f in (F.min, F.max)], F.count("*")).first()
    levels, top = [], (1 << bits) - 1
    for i, x in enumerate(numbers):
        low, high = ends[2 * i], ends[2 * i + 1]
        if low is None or high <= low:
            levels.append(F.lit(0))
        else:
            level = F.floor((x - F.lit(low)) / F.lit(high - low) * top)
            levels.append(F.coalesce(level, F.lit(0)).cast("int"))
    total = ends[-1]
    placed = samples.withColumn("curve", curve_index(levels, bits))
    order = ["curve", *key]
    # The id of a row is its partition and its place there; stored, so that both stay as they are.
    rows = cut_lineage(
        placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_hil_id", F.monotonically_increasing_id())
    ).select("*", F.expr("shiftright(_hil_id, 33)").alias("_hil_part"), F.expr(f"_hil_id & {(1 << 33) - 1}").alias("_hil_at"))
    parts = rows.groupBy("_hil_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("_hil_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("_hil_part", F.coalesce(before, F.lit(0)).alias("_hil_from"))
    rank = F.col("_hil_from") + F.col("_hil_at")
    shard = F.expr(f"(_hil_from + _hil_at) * {shards} div {max(total, 1)}")
    slot = rank - F.expr(f"(shard * {max(total, 1)} + {shards - 1}) div {shards}")
    return (
        rows.join(starts, "_hil_part").withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long"))
        .drop("_hil_id", "_hil_part", "_hil_at", "_hil_from")
    )


def shard_ranges(sharded: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(shard, rows, and the least and greatest of each field): what a reader skips shards by."""
    ends = [f(c).alias(f"{n}_{c}") for c in fields for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *ends)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; its files are runs of slots, so a large shard is written by several tasks."""
    spread = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    spread.write.partitionBy("shard").parquet(path)
