"""Bootstrap draws made once per number of members, for all cells of that size, where they are used.

The draws of a replicate depend on the seed, the stratum and the number of members alone, so cells
of one size share them. No draw is a row and none is shuffled: what is sent to a block of replicates are the
cells' values, what comes back are sums.

``hash`` draws by a hash of (seed, stratum, replicate, slot), which SQL can repeat. ``numpy`` draws what
``numpy.random.default_rng(seed).integers(0, size, (replicates, size))`` does. Its generator can be started
anywhere, but a value may be rejected, which moves all later ones: rejections are counted per block
first, and every block then knows where its draws stand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortscale.plans.ordered import join_same
from cohortscale.session import freed_shuffles, scratch_path, width

#: A prime by which cubing is one to one, and what is added between cubes.
PRIME, STEP_A, STEP_B, STEP_C = 2147483579, 1013904223, 374761393, 668265263
#: Replicates of a block, and cells of its table of members by replicates, at most.
BLOCK, CELLS = 250, 1 << 22
ROWS = 1 << 14
#: Draws that are hashed at a time, members of a cell in a row, and cells that share a task's draws, at most.
TEMPORARY, SLICE, SHARED = 1 << 15, 256, 64
#: Draws of a task, tasks of a stream (each is sent the values), members of shared cells held at once (one cell is
#: held whole), and members whose draws are counted at a time.
WORK, TASKS, HELD, RANGE = 1 << 26, 32, 1 << 25, 1 << 23
#: Members of a cell whose values are stored once and read by each of its tasks, at least; those of smaller ones are sent to
#: all. Draws of a wide cell that are added at a time.
WIDE, CHUNK = 1 << 18, 1 << 18
SCHEMA = "stratum string, size long, start long, block int, idx long, weights array<smallint>"


def replicates_of_block(size: int) -> int:
    return max(1, min(BLOCK, CELLS // max(size, 1)))


def per_block(size: str) -> Column:
    """``replicates_of_block`` as a column."""
    return F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(CELLS) / F.col(size)))).cast("long")


def _rest(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime; numpy divides by one number faster than it takes the remainder."""
    return x - x // PRIME * PRIME


def _cube(x: np.ndarray) -> np.ndarray:
    return _rest(_rest(x * x) * x)


def stratum_key(seed: int, stratum: str) -> int:
    return int(hashlib.md5(f"{seed}|{stratum}".encode()).hexdigest()[:7], 16)


def hash_draws(seed: int, stratum: str, size: int, first: int, n: int, low: int = 0, high: int | None = None) -> np.ndarray:
    """Members drawn by replicates ``first`` to ``first + n``, a row each; of slots ``low`` to ``high`` only."""
    one = _cube(_rest(stratum_key(seed, stratum) + np.arange(first, first + n, dtype=np.uint64)))
    one = _cube(_rest(one + STEP_A))
    two = _cube(_rest(one + STEP_B))
    slots = np.arange(low, size if high is None else high, dtype=np.uint64)
    out = np.empty((n, len(slots)), np.int32)
    step = max(1, TEMPORARY // max(len(slots), 1))
    for a in range(0, n, step):
        for s in range(0, len(slots), TEMPORARY):
            x = _cube(_rest(slots[None, s : s + TEMPORARY] + one[a : a + step, None]))
            x = _cube(_rest(x + two[a : a + step, None]))
            x = _cube(_rest(x + STEP_C))
            out[a : a + step, s : s + TEMPORARY] = x - x // size * size
    return out


def raw_words(seed: int, start: int, n: int) -> np.ndarray:
    """``n`` 32-bit words of numpy's default generator from word ``start`` on; of each 64 bits the low half is first."""
    generator = np.random.PCG64(seed)
    generator.advance(start // 2)
    odd = start % 2
    return generator.random_raw((odd + n + 1) // 2).astype("<u8").view("<u4")[odd : odd + n].astype(np.uint64)


def bounded(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The member each word stands for, and whether it is taken: the multiply-and-shift rule with rejection."""
    product = words * np.uint64(size)
    taken = (product & np.uint64(0xFFFFFFFF)) >= np.uint64(((1 << 32) - size) % size)
    return (product >> np.uint64(32)).astype(np.int64), taken


def _word_blocks(streams: DataFrame, n_resamples: int) -> DataFrame:
    """Blocks of words of each (stratum, size, start): more of them than replicates need by what may be rejected."""
    per = per_block("size")
    rejected = (F.pmod(F.lit(1 << 32) - F.col("size"), F.col("size")) / F.lit(float(1 << 32))).cast("double")
    need = F.lit(float(n_resamples)) / (1 - rejected) * (1 + F.lit(0.01) * F.signum(rejected))
    last = F.ceil(need / per).cast("long")  # one block more than is likely to be needed
    return streams.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("_per", per)


def _taken(streams: DataFrame, seed: int, n_resamples: int) -> DataFrame:
    """(stratum, size, start, block, _per, n, before): words taken in each block, and before it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for row in batch.to_pylist():
                length = row["_per"] * row["size"]
                n.append(int(bounded(raw_words(seed, row["start"] + row["block"] * length, length), row["size"])[1].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "n"])

    blocks = _word_blocks(streams, n_resamples)
    dealt = blocks.repartition(width(streams.sparkSession), "stratum", "size", "start", "block")
    counted = dealt.mapInArrow(count, "stratum string, size long, start long, block long, _per long, n long")
    # A window over the blocks of one stream: replicates over replicates of a block.
    earlier = Window.partitionBy("stratum", "size", "start").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def words_used(streams: DataFrame, seed: int, n_resamples: int) -> DataFrame:
    """(stratum, size, start, used): words that all replicates of a stream take, the rejected ones too; a single member takes none."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            used = []
            for row in batch.to_pylist():
                length = row["_per"] * row["size"]
                taken = bounded(raw_words(seed, row["start"] + row["block"] * length, length), row["size"])[1]
                last = n_resamples * row["size"] - row["before"] - 1
                used.append(row["block"] * length + int(np.flatnonzero(taken)[last]) + 1)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("stratum", "size", "start")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(used, pa.int64())], names=["stratum", "size", "start", "used"])

    wanted = F.lit(n_resamples) * F.col("size")
    taken = _taken(streams.filter("size > 1"), seed, n_resamples).filter((F.col("before") < wanted) & (F.col("before") + F.col("n") >= wanted))
    single = streams.filter("size <= 1").select("stratum", "size", "start", F.lit(0).cast("long").alias("used"))
    return taken.mapInArrow(find, "stratum string, size long, start long, used long").unionByName(single)


def multiplicities(streams: DataFrame, seed: int, n_resamples: int) -> DataFrame:
    """(stratum, size, start, block, idx, weights): how often the replicates of a block draw each member, by ``hash``.

    ``streams`` (stratum, size, start). ``weights`` has one number for each replicate of the block; a member that is
    not drawn in it has no row. For what needs more of a replicate than sums.
    """
    blocks = streams.filter("size > 0").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.lit(n_resamples) - 1) / per_block("size"))))
    )
    dealt = blocks.select("stratum", "size", "start", "block").repartition(width(streams.sparkSession), "stratum", "size", "start", "block")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            size, per = row["size"], replicates_of_block(row["size"])
            draws = hash_draws(seed, row["stratum"], size, row["block"] * per, min(per, n_resamples - row["block"] * per))
            place = draws.astype(np.int64) * per + np.arange(len(draws))[:, None]
            table = np.bincount(place.ravel(), minlength=size * per).reshape(size, per).astype(np.int16)
            drawn = np.flatnonzero(table.any(axis=1))
            for a in range(0, len(drawn), ROWS):
                part = drawn[a : a + ROWS]
                n = len(part)
                weights = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * per), pa.array(table[part].ravel()))
                same = [pa.array([row[c]] * n, t) for c, t in (("stratum", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("block", pa.int32()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(part), weights], names=["stratum", "size", "start", "block", "idx", "weights"])

    return dealt.mapInArrow(make, SCHEMA)


def block_draws(seed: int, method: str, stratum: str, size: int, start: int, block: int, n_resamples: int, before: list[int] | None) -> np.ndarray:
    """Members drawn by the replicates of a block, a row each. ``before``: words taken before each block of words."""
    per = replicates_of_block(size)
    first, n = block * per, min(per, n_resamples - block * per)
    if method == "hash":
        return hash_draws(seed, stratum, size, first, n)
    if size == 1:
        return np.zeros((n, 1), np.int32)
    length, found = per * size, []
    at = int(np.searchsorted(before, first * size, side="right")) - 1
    skip, missing = first * size - before[at], n * size
    while missing:
        members, taken = bounded(raw_words(seed, start + at * length, length), size)
        found.append(members[taken][skip : skip + missing].astype(np.int32))
        missing, skip, at = missing - len(found[-1]), 0, at + 1
    return np.concatenate(found).reshape(n, size)


def drawn_sums(held: list[np.ndarray], draws: np.ndarray) -> list[np.ndarray]:
    """For each (columns, members) of ``held`` the sums per column and replicate; draws of many members are counted first, once for all."""
    size = draws.shape[1]
    if size <= TEMPORARY:
        return [np.stack([column[draws].sum(axis=1) for column in numbers]) for numbers in held]
    out = [np.zeros((len(numbers), len(draws))) for numbers in held]
    for low in range(0, size, RANGE):
        n = min(RANGE, size - low)
        for k, row in enumerate(draws):
            here = row if n == size else row[(row >= low) & (row < low + n)] - low
            weights = np.bincount(here, minlength=n).astype(np.float64)
            for numbers, sums in zip(held, out):
                sums[:, k] += numbers[:, low : low + n] @ weights
    return out


def drawn_runs(seed: int, strata: Sequence[str], runs: list[np.ndarray], size: int, blocks: range, n_resamples: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first replicate, [replicates x runs] of each stratum): how often the replicates of each of ``blocks``, by ``hash``, draw a member of each run.

    ``runs`` are the lengths of the runs that a stratum's members stand in, in order; a block has as many replicates as
    ``size`` members allow.
    """
    per = replicates_of_block(size)
    codes = [np.repeat(np.arange(len(r), dtype=np.int32), r) for r in runs]
    for block in blocks:
        n, found = min(per, n_resamples - block * per), []
        for stratum, code, lengths in zip(strata, codes, runs):
            draws, times = hash_draws(seed, stratum, len(code), block * per, n), np.zeros((n, len(lengths)), np.int64)
            step = max(1, RANGE // max(len(code), 1))
            for a in range(0, n, step):
                for s in range(0, len(code), RANGE):
                    here = code[draws[a : a + step, s : s + RANGE]] + np.arange(min(step, n - a))[:, None] * len(lengths)
                    times[a : a + step] += np.bincount(here.ravel(), minlength=len(here) * len(lengths)).reshape(len(here), -1)
            found.append(times)
        yield block * per, found


class Coded:
    """The numbers of each member, some columns: two bytes a member while few members differ, else eight a column."""

    def __init__(self, members: int):
        self.codes, self.known, self.numbers = np.zeros(members, np.uint16), {}, None

    def put(self, place: np.ndarray, numbers: list[np.ndarray]) -> None:
        if self.numbers is None:
            codes = [self.known.setdefault(x, len(self.known)) for x in zip(*(n.tolist() for n in numbers))]
            if len(self.known) <= 1 << 16:
                self.codes[place] = codes
                return
            self.numbers = [column[self.codes] for column in self.table()]
            self.codes = None
        for column, n in zip(self.numbers, numbers):
            column[place] = n

    def table(self) -> np.ndarray:
        return np.array(list(self.known), np.float64).T

    def sums_of(self, drawn: np.ndarray) -> np.ndarray:
        if self.numbers is not None:
            return np.array([column[drawn].sum() for column in self.numbers])
        return self.table() @ np.bincount(self.codes[drawn], minlength=len(self.known)).astype(np.float64)


def wide_sums(
    packed: DataFrame, cell: list[str], sets: list, values: list[str], seed: int, n_resamples: int, method: str, schema: str
) -> DataFrame:
    """What ``add`` of ``weighted_sums`` gives, for cells of so many members that not even their values can go to every task.

    The values, in rows of ``SLICE`` members, are stored once, a folder for each of ``sets``, cells that share their draws.
    A task reads its folder whole: so many tasks share the draws, and none writes.
    """
    spark = packed.sparkSession
    path = scratch_path(spark, "values")
    rows = packed.select("_set", "_slice", "_before", "_place", *values, *cell)
    with freed_shuffles(spark):
        rows.write.partitionBy("_set").option("compression", "zstd").parquet(path)
    columns = T.StructType([f for f in rows.schema.fields if f.name != "_set"])
    parts = []
    for at in sets:
        blocks = -(-n_resamples // replicates_of_block(at["_size"]))
        tasks = max(1, min(blocks, at["_most"], -(-n_resamples * at["_size"] // WORK)))
        one = spark.read.schema(columns).parquet(f"{path}/_set={at['_set']}")
        same = {"_stratum": at["_stratum"], "_size": at["_size"], "_start": at["_start"], "_tasks": tasks}
        for task in range(tasks):
            parts.append(one.coalesce(1).select(*[F.lit(x).alias(n) for n, x in same.items()], F.lit(task).alias("_task"), "*"))
    # A union of single partitions only would be one: here is another that is not, and has no rows.
    parts.append(one.coalesce(2).filter("_slice < 0").select(*[F.lit(x).alias(n) for n, x in same.items()], F.lit(-1).alias("_task"), "*"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, before, held, heads = None, None, {}, []
        for batch in batches:
            for i in range(batch.num_rows):
                key = key or tuple(batch.column(k)[i].as_py() for k in range(5))
                if not i and any(len(batch.column(k).unique()) > 1 or batch.column(k)[0].as_py() != key[k] for k in range(5)):
                    raise RuntimeError("the values of several tasks are in one")
                before = before or batch.column(6)[i].as_py()
                head = batch.slice(i, 1).select(cell)
                which = tuple(c[0].as_py() for c in head.columns)
                if which not in held:
                    held[which] = Coded(key[1])
                    heads.append(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in head.columns], names=cell))
                place = batch.column(7)[i].values.to_numpy().astype(np.int64) + batch.column(5)[i].as_py() * SLICE
                held[which].put(place, [batch.column(8 + j)[i].values.to_numpy() for j in range(len(values))])
        if not held:
            return
        stratum, size, start, tasks, task = key
        per = replicates_of_block(size)
        for block in range(task, -(-n_resamples // per), tasks):
            n = min(per, n_resamples - block * per)
            found = np.zeros((len(values), len(held), n))
            whole = None if method == "hash" else block_draws(seed, method, stratum, size, start, block, n_resamples, before)
            for k in range(n):
                for low in range(0, size, CHUNK):
                    high = min(size, low + CHUNK)
                    drawn = hash_draws(seed, stratum, size, block * per + k, 1, low, high)[0] if whole is None else whole[k, low:high]
                    for c, numbers in enumerate(held.values()):
                        found[:, c, k] += numbers.sums_of(drawn)
            sums = [pa.array(list(f), pa.list_(pa.float64())) for f in found]
            same = [pa.array([x] * len(held), pa.int64()) for x in (block, size)]
            kept = [pa.concat_arrays([h.column(k) for h in heads]) for k in range(len(cell))]
            yield pa.RecordBatch.from_arrays([*kept, *same, *sums], names=[*cell, "_block", "_size", *values])

    return reduce(DataFrame.unionAll, parts).mapInArrow(add, schema)


def weighted_sums(
    members: DataFrame, cell: list[str], streams: DataFrame, values: list[str], seed: int, n_resamples: int, method: str = "hash"
) -> DataFrame:
    """(cell, replicate, values): sums of the values of the drawn members, each as often as it is drawn.

    ``members`` (cell, idx, values), idx without gaps, ``streams`` (cell, size, _stratum, _start) says which draws a cell
    has. A stream's blocks of replicates are dealt to at most ``TASKS`` tasks. A cell's values go to each of them in rows
    of ``SLICE`` members, and up to ``SHARED`` cells of one size meet there, for which the draws of a block are made once.
    Cells of ``WIDE`` members and more are left to ``wide_sums``.
    """
    stream = ["_stratum", "_size", "_start"]
    kinds = {f.name: f.dataType.simpleString() for f in members.schema.fields}
    named = join_same(members, streams.select(*cell, F.col("size").alias("_size"), "_stratum", "_start"), cell)
    numbers = [F.collect_list(F.coalesce(F.col(v).cast("double"), F.lit(0.0))).alias(v) for v in values]
    place = F.collect_list((F.col("idx") % SLICE).cast("smallint")).alias("_place")
    packed = named.groupBy(*cell, *stream, F.floor(F.col("idx") / SLICE).alias("_slice")).agg(place, *numbers)
    kinds_of = streams.groupBy("_stratum", F.col("size").alias("_size"), "_start")
    together = F.greatest(F.lit(1), F.least(F.lit(SHARED), F.floor(F.lit(HELD) / F.col("_size"))))
    shares = kinds_of.agg(F.ceil(F.count("*") / together).alias("_shares"), (F.col("_size") * F.count("*")).alias("_all"))
    # Each stream's part of the tasks follows its part of the values: what is sent is bounded by all values, not by streams.
    whole = shares.agg(F.sum("_all").alias("_whole"))
    part = F.greatest(F.lit(1), F.least(F.lit(TASKS), F.ceil(F.lit(2 * TASKS) * F.col("_all") / F.col("_whole"))))
    shares = shares.crossJoin(F.broadcast(whole)).withColumn("_most", part).drop("_all", "_whole")
    share = F.pmod(F.xxhash64(*cell) if cell else F.lit(0), "_shares")
    packed = packed.join(shares, stream).withColumn("_share", share)
    if method == "numpy":
        counted = _taken(
            shares.select(F.col("_stratum").alias("stratum"), F.col("_size").alias("size"), F.col("_start").alias("start")).filter("size > 1"),
            seed, n_resamples,
        )
        each = counted.groupBy("stratum", "size", "start").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("block", "before"))), lambda b: b["before"]).alias("_words")
        )
        words = each.withColumnsRenamed({"stratum": "_stratum", "size": "_size", "start": "_start"})
        # Only the first row of a cell brings the words taken before each block.
        packed = packed.join(words, stream, "left").withColumn("_before", F.when(F.col("_slice") == 0, F.col("_words")))
    else:
        packed = packed.withColumn("_before", F.lit(None).cast("array<long>"))
    names = "".join(f"`{c}` {kinds[c]}, " for c in cell)
    sums = ", ".join(f"`{v}` array<double>" for v in values)
    schema = f"{names}_block long, _size long, {sums}"
    of_set = F.xxhash64(*stream, "_share").alias("_set")
    sized = streams.filter(F.col("size") >= WIDE).withColumnRenamed("size", "_size").join(shares, stream).withColumn("_share", share)
    # A row for so many members: few.
    sets = sized.select(*stream, "_most", of_set).distinct().collect()
    wide = packed.filter(F.col("_size") >= WIDE).withColumn("_set", of_set)
    packed = packed.filter(F.col("_size") < WIDE) if sets else packed
    blocks = F.floor((F.lit(n_resamples) - 1) / per_block("_size")) + 1
    tasks = F.least(blocks, F.col("_most"), F.ceil(F.lit(n_resamples) * F.col("_size") / WORK))
    dealt = packed.withColumn("_tasks", tasks).withColumn("_task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tasks") - 1)))
    order = [*stream, "_tasks", "_task"]
    dealt = dealt.select(*order, "_slice", "_before", "_place", *values, *cell, "_share")
    dealt = dealt.repartition(width(members.sparkSession), *order, "_share").sortWithinPartitions(*order, "_share", *cell, "_slice")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, before, held, missing = None, None, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            stratum, size, start, tasks, task = key
            for block in range(task, -(-n_resamples // replicates_of_block(size)), tasks):
                draws = block_draws(seed, method, stratum, size, start, block, n_resamples, before)
                found = drawn_sums([numbers for _, numbers in held], draws)
                sums = [pa.array([f[j] for f in found], pa.list_(pa.float64())) for j in range(len(values))]
                same = [pa.array([n] * len(held), pa.int64()) for n in (block, size)]
                yield pa.RecordBatch.from_arrays([*heads, *same, *sums], names=[*cell, "_block", "_size", *values])

        for batch in batches:
            for i in range(batch.num_rows):
                if not missing:
                    here = tuple(batch.column(k)[i].as_py() for k in range(5))
                    if held and (here != key or (len(held) + 1) * here[1] > HELD):
                        heads = [pa.concat_arrays([h.column(k) for h, _ in held]) for k in range(len(cell))]
                        yield from flush()
                        held = []
                    if here != key:
                        key, before = here, batch.column(6)[i].as_py()
                    missing = key[1]
                    head = batch.slice(i, 1).select(cell)
                    held.append((pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in head.columns], names=cell), np.zeros((len(values), missing))))
                place = batch.column(7)[i].values.to_numpy().astype(np.int64) + batch.column(5)[i].as_py() * SLICE
                for j in range(len(values)):
                    held[-1][1][j][place] = batch.column(8 + j)[i].values.to_numpy()
                missing -= len(place)
        if held:
            heads = [pa.concat_arrays([h.column(k) for h, _ in held]) for k in range(len(cell))]
            yield from flush()

    added = dealt.mapInArrow(add, schema)
    if sets:
        added = added.unionAll(wide_sums(wide, cell, sets, values, seed, n_resamples, method, schema))
    first = (F.col("_block") * per_block("_size")).cast("int")
    each = added.select(*cell, first.alias("_from"), F.posexplode(F.arrays_zip(*values)).alias("_k", "_v"))
    return each.select(*cell, (F.col("_from") + F.col("_k")).alias("replicate"), "_v.*")
