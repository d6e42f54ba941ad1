"""Frames as short codes: every part of a frame's pixels becomes the number of a codebook entry."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cohortscale.session import scratch_path

#: Pixels are counted in steps of one over this.
STEPS = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Frames in one tree, and members of a node that is not split further.
TREE_FRAMES, LEAF = 2048, 8
#: Steps from which the sums of squares of a part might leave 64 bits; such frames are refused.
MOST_STEPS = 1 << 26


@dataclass(frozen=True)
class CoverTree:
    """Nested balls over the points of one part, in an order in which each node's points are one run.

    Of node k: ``low``-``high`` its points, ``centre`` one of them, ``radius`` the distance to the
    farthest, ``child`` and ``children`` the first node below it and their number.
    """

    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray


def build_tree(points: np.ndarray, leaf: int = LEAF) -> CoverTree:
    """A node's points are dealt to a net of at most half its radius, first come first, its own centre first."""
    order = np.arange(len(points))
    nodes: list[list] = [[0, len(points), 0, 0.0, 0, 0]]
    at = 0
    floats = points.astype(np.float64)
    while at < len(nodes):
        low, high, centre = nodes[at][:3]
        members = order[low:high]
        far = np.sqrt(((floats[members] - floats[centre]) ** 2).sum(axis=1))
        radius = nodes[at][3] = float(far.max())
        if radius > 0 and high - low > leaf:
            runs, first = [], len(nodes)
            while len(members):
                near = far <= radius / 2
                runs.append((members[near], centre))
                members = members[~near]
                if len(members):
                    centre = int(members[0])
                    far = np.sqrt(((floats[members] - floats[centre]) ** 2).sum(axis=1))
            order[low:high] = np.concatenate([r for r, _ in runs])
            for run, its in runs:
                nodes.append([low, low + len(run), its, 0.0, 0, 0])
                low += len(run)
            nodes[at][4:] = first, len(runs)
        at += 1
    low, high, centre, radius, child, children = (np.array(x) for x in zip(*nodes))
    return CoverTree(order, low, high, centre, radius.astype(np.float64), child, children)


def nearest_entries(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each point by squared distance, exact in integers, the lower index at ties."""
    far = ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(points)), best]


def settled_nodes(tree: CoverTree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes whose points all have one nearest entry, that entry, and the points that must be compared one by one.

    A node is settled when its nearest entry is nearer to the centre than any other by more than the
    diameter, so no point of the ball can have another, nor a tie. Others are opened, level by level.
    """
    asked, nodes, chosen, single = np.array([0]), [], [], []
    floats, wanted = points.astype(np.float64), entries.astype(np.float64)
    slack = 1e-9 * (1 + np.abs(wanted).max(initial=0) + np.abs(floats).max(initial=0)) * math.sqrt(points.shape[1])
    while len(asked):
        far = np.sqrt(((floats[tree.centre[asked]][:, None, :] - wanted[None, :, :]) ** 2).sum(axis=2))
        best = far.argmin(axis=1)
        least = far[np.arange(len(asked)), best]
        far[np.arange(len(asked)), best] = np.inf
        sure = far.min(axis=1) - least > 2 * tree.radius[asked] + slack
        nodes.append(asked[sure])
        chosen.append(best[sure])
        open_nodes = asked[~sure]
        ends = open_nodes[tree.children[open_nodes] == 0]
        single += [np.arange(a, b) for a, b in zip(tree.low[ends], tree.high[ends])]
        open_nodes = open_nodes[tree.children[open_nodes] > 0]
        width = tree.children[open_nodes]
        at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        asked = np.repeat(tree.child[open_nodes], width) + at
    return np.concatenate(nodes), np.concatenate(chosen), np.concatenate(single or [np.zeros(0, np.int64)])


def part_sums(tree: CoverTree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and count of the points of each entry; whole subtrees are added by differences of running sums."""
    nodes, chosen, single = settled_nodes(tree, points, entries)
    placed = points[tree.order]
    running = np.vstack([np.zeros((1, points.shape[1]), np.int64), np.cumsum(placed, axis=0)])
    sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    np.add.at(sums, chosen, running[tree.high[nodes]] - running[tree.low[nodes]])
    np.add.at(counts, chosen, tree.high[nodes] - tree.low[nodes])
    best, _ = nearest_entries(placed[single], entries)
    np.add.at(sums, best, placed[single])
    np.add.at(counts, best, 1)
    return sums, counts


def part_codes(tree: CoverTree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each point, and its squared distance."""
    nodes, chosen, single = settled_nodes(tree, points, entries)
    placed, best = points[tree.order], np.zeros(len(points), np.int64)
    for low, high, entry in zip(tree.low[nodes], tree.high[nodes], chosen):
        best[low:high] = entry
    best[single], _ = nearest_entries(placed[single], entries)
    error = ((placed - entries[best]) ** 2).sum(axis=1)
    codes, errors = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    codes[tree.order], errors[tree.order] = best, error
    return codes, errors


def usable_frames(frames: DataFrame) -> DataFrame:
    """(frame_id, vendor, steps): frames with pixels that are all finite, each pixel as a whole number of steps, rounded down."""
    pixels = F.transform("pixels", lambda x: x.cast("double"))
    fine = F.forall(pixels, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = frames.filter(F.col("pixels").isNotNull() & F.coalesce(fine, F.lit(False)))
    return kept.select("frame_id", "vendor", F.transform(pixels, lambda x: F.floor(x * STEPS)).alias("steps"))


def _lots(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, size):
            yield batch.slice(a, min(size, batch.num_rows - a))


def plant_trees(frames: DataFrame, parts: int) -> DataFrame:
    """Trees of at most ``TREE_FRAMES`` frames each, where the frames lie: (frame_id, vendor, steps) as arrays,
    and for every part the tree as arrays."""
    kinds = {f.name: f.dataType for f in frames.schema.fields}
    names = ["frame_id", "vendor", "steps", "trees"]
    held = {n: to_arrow_type(kinds[n]) for n in names[:2]}
    ints = pa.list_(pa.int32())
    tree_type = pa.struct([("order", ints), ("low", ints), ("high", ints), ("centre", ints), ("radius", pa.list_(pa.float64())), ("child", ints), ("children", ints)])

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches, TREE_FRAMES):
            points = lot.column(2).flatten().to_numpy().reshape(lot.num_rows, parts, -1)
            trees = [build_tree(points[:, p]) for p in range(parts)]
            rows = [{n: getattr(t, n).tolist() for n in ("order", "low", "high", "centre", "radius", "child", "children")} for t in trees]
            columns = [
                pa.array([lot.column(0).to_pylist()], pa.list_(held["frame_id"])), pa.array([lot.column(1).to_pylist()], pa.list_(held["vendor"])),
                pa.array([points.ravel()], pa.list_(pa.int64())), pa.array([rows], pa.list_(tree_type)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    ids, vendors = (kinds[n].simpleString() for n in names[:2])
    tree = "struct<order: array<int>, low: array<int>, high: array<int>, centre: array<int>, radius: array<double>, child: array<int>, children: array<int>>"
    return frames.mapInArrow(plant, f"frame_id array<{ids}>, vendor array<{vendors}>, steps array<long>, trees array<{tree}>")


def _grown(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, list[CoverTree]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            ids, vendors, steps = (row.column(k).flatten() for k in range(3))
            trees = row.column(3).flatten()
            grown = [CoverTree(*[a.flatten().to_numpy() for a in trees.slice(p, 1).flatten()]) for p in range(parts)]
            yield ids, vendors, steps.to_numpy().reshape(len(ids), parts, -1), grown


def _round_sums(trees: DataFrame, codebooks: np.ndarray) -> list[Row]:
    """One row per part and entry that has points: its sum and count over all tasks."""
    parts, entries, width = codebooks.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(codebooks.shape, np.int64), np.zeros(codebooks.shape[:2], np.int64)
        for _, _, points, grown in _grown(batches, parts):
            for p in range(parts):
                s, n = part_sums(grown[p], points[:, p], codebooks[p])
                sums[p] += s
                counts[p] += n
        part, entry, at = (x.ravel() for x in np.indices(codebooks.shape))
        columns = [part.astype(np.int32), entry.astype(np.int32), at.astype(np.int32), sums.ravel(), np.repeat(counts.ravel(), width)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "at", "total", "n"])

    added = trees.mapInArrow(add, "part int, entry int, at int, total long, n long").filter("n > 0")
    # Decimals, so that no sum over all frames overflows.
    total = F.sum(F.col("total").cast("decimal(20,0)"))
    return added.groupBy("part", "entry", "at").agg(total.alias("total"), F.sum("n").alias("n")).collect()


def fit_codebooks(trees: DataFrame, codebooks: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds: every part goes to its nearest entry, every entry to the mean of its parts, rounded down.

    An entry without parts stays. What the driver sees is one sum per part, entry and pixel.
    """
    for _ in range(rounds):
        moved = codebooks.copy()
        for row in _round_sums(trees, codebooks):
            moved[row["part"], row["entry"], row["at"]] = int(row["total"]) // row["n"]
        codebooks = moved
    return codebooks


def encode_frames(trees: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(frame_id, vendor, code, error): two hex digits for each part, and the squared distances summed."""
    parts = len(codebooks)
    kinds = {f.name: f.dataType.elementType for f in trees.schema.fields if f.name in ("frame_id", "vendor")}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vendors, points, grown in _grown(batches, parts):
            found = [part_codes(grown[p], points[:, p], codebooks[p]) for p in range(parts)]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            error = sum(e for _, e in found)
            yield pa.RecordBatch.from_arrays([ids, vendors, pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], names=["frame_id", "vendor", "code", "error"])

    ids, vendors = (kinds[n].simpleString() for n in ("frame_id", "vendor"))
    return trees.mapInArrow(encode, f"frame_id {ids}, vendor {vendors}, code string, error long")


def first_codebooks(frames: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The parts of the frames of smallest ids; equal ids by their pixels."""
    first = frames.orderBy(F.asc_nulls_last("frame_id"), "steps").limit(entries).select("steps").collect()
    points = np.array([r["steps"] for r in first], np.int64).reshape(len(first), parts, -1)
    return points.transpose(1, 0, 2).copy()


def codebooks_digest(codebooks: np.ndarray) -> str:
    """SHA-256 of the numbers of all entries by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress_frames(frames: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Codes of all frames, and the codebooks (part, entry, pixel) in steps that they refer to.

    ``frames`` (frame_id, pixels, vendor, ...): ``pixels`` is a frame as an array of numbers. A frame without pixels,
    or with one that is NULL or not finite, is left out. A pixel counts in steps of 1/4096, rounded down, and a
    frame is cut into ``parts`` equal consecutive parts. A part's codebook starts as that part of the ``entries`` frames of
    smallest ids, and is moved by ``rounds`` of Lloyd's method; distances are squared and Euclidean, ties
    go to the lower index. Codes are (frame_id, vendor, code, error, vendor_error): two hex digits for each part, the squared
    distances summed, and their sum over all frames of that vendor, NULL vendors together.

    Each task builds cover trees over at most 2048 of its frames, stored once; a round sends the codebooks to them
    and gets sums back: a subtree whose ball lies nearer to one entry than to any other by the triangle
    inequality is added whole, from running sums, others are opened, and what is left is compared exactly. The answer
    is that of comparing every part with every entry.

    Every row is a frame, repeated ids too; NULL ids are the largest. With fewer frames than ``entries`` there are as
    many entries; without frames there are none and no codes. Frames of unequal length, of a length that ``parts``
    does not divide, or with a pixel beyond 2^26 steps are refused with a ValueError. Other columns are not read.
    """
    spark = frames.sparkSession
    usable = usable_frames(frames)
    beyond = F.exists("steps", lambda x: F.abs(x) > MOST_STEPS)
    sizes = usable.agg(F.min(F.size("steps")), F.max(F.size("steps")), F.coalesce(F.bool_or(beyond), F.lit(False))).first()
    if sizes[0] != sizes[1] or (sizes[0] or 0) % parts or sizes[2]:
        raise ValueError(f"frames of {sizes[0]} to {sizes[1]} pixels in {parts} parts, pixels beyond 2^26 steps: {sizes[2]}")
    codebooks = first_codebooks(usable, parts, entries) if sizes[0] else np.zeros((parts, 0, 1), np.int64)
    path = scratch_path(spark, "cover-trees")
    plant_trees(usable.filter(F.size("steps") > 0), parts).write.parquet(path)
    trees = spark.read.parquet(path)
    if codebooks.size:
        codebooks = fit_codebooks(trees, codebooks, rounds)
    codes = encode_frames(trees, codebooks)
    path = scratch_path(spark, "frame-codes")
    codes.write.parquet(path)
    codes = spark.read.parquet(path)
    by_vendor = codes.groupBy(F.col("vendor").alias("_vendor")).agg(F.sum("error").alias("vendor_error"))
    return codes.join(by_vendor, F.col("vendor").eqNullSafe(F.col("_vendor"))).drop("_vendor"), codebooks
