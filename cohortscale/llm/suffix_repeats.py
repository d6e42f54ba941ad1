"""Strings of bytes that stand in several places of the report documents, by sorted suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscale.llm.rows import row_key
from cohortscale.session import scratch_path

#: Bytes of a string that must go where it stands twice.
MIN_BYTES = 400
#: Bytes of an anchor: of all anchors in a string the one of least hash says where it is compared.
ANCHOR_BYTES = 128
#: Different pieces around one anchor that are sorted in one task; more are told apart by longer anchors first.
GROUP = 1024
#: Windows that a piece may span after each such step.
FINER = (64, 8, 1)
#: Bytes of documents, and of pieces, taken at a time in a task.
LOT, SORTED = 1 << 19, 1 << 18
_PLACE = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_RANGES = "array<struct<start: int, end: int>>"


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` bytes that follow each other: a polynomial off running sums, then mixed."""
    up, down = _powers(LOT * 2)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    out = (sums[n:] - sums[:-n]) * down[: len(codes) - n + 1]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(32)
    return out


def _least(values: np.ndarray, n: int) -> np.ndarray:
    step = 1
    while 2 * step <= n:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[: len(values) - (n - step)], values[n - step :]) if n > step else values


def _digest(text: bytes) -> tuple[int, int]:
    found = hashlib.blake2b(text, digest_size=16).digest()
    return int.from_bytes(found[:8], "little", signed=True), int.from_bytes(found[8:], "little", signed=True)


def cut_pieces(text: bytes, ends: np.ndarray, min_bytes: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(first, count, offset, anchor, digest, digest) of the pieces of texts that are written one after the other.

    A piece is ``count`` windows of ``min_bytes`` from ``first`` on that share their anchor, ``offset`` after the
    first. ``ends`` are where the texts end; no window reaches over one. Equal windows have equal anchors.
    """
    size = min(ANCHOR_BYTES, min_bytes)
    codes = np.frombuffer(text, np.uint8).astype(np.uint64)
    hashes = gram_hashes(codes, size)
    ranked = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (_least(ranked, min_bytes - size + 1) & _PLACE).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    whole = np.zeros(len(anchor) + 1, np.int64)
    enough = ends - starts >= min_bytes
    whole[starts[enough]] += 1
    whole[ends[enough] - min_bytes + 1] -= 1
    anchor[np.cumsum(whole[:-1]) == 0] = -1
    begins = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    begins[starts[enough]] = True
    new = np.flatnonzero(begins)
    count, signed = np.diff(np.append(new, len(anchor))), hashes.view(np.int64)
    for first, n, at, mark in zip(new.tolist(), count.tolist(), anchor[new].tolist(), signed[anchor[new]].tolist()):
        if at >= 0:
            yield first, n, at - first, mark, *_digest(text[first : first + n - 1 + min_bytes])


def document_pieces(documents: DataFrame, min_bytes: int) -> DataFrame:
    """(_row_a, _row_b, low, count, offset, anchor, a, b): the pieces of every document that is long enough."""
    names = ["_row_a", "_row_b", "low", "count", "offset", "anchor", "a", "b"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lot(rows: list[tuple], parts: list[bytes]) -> pa.RecordBatch:
            ends = np.cumsum([len(p) for p in parts])
            found = np.array(list(cut_pieces(b"".join(parts), ends, min_bytes)), np.int64).reshape(-1, 6)
            owner = np.searchsorted(ends, found[:, 0], side="right")
            held = np.array(rows, np.int64)[owner].reshape(-1, 3)
            low = held[:, 2] + found[:, 0] - (np.concatenate([[0], ends[:-1]]))[owner]
            columns = [held[:, 0], held[:, 1], low.astype(np.int32), *(found[:, k].astype(np.int32) for k in (1, 2)), *(found[:, k] for k in (3, 4, 5))]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

        rows, parts, size = [], [], 0
        for batch in batches:
            for a, b, text in zip(*(batch.column(k) for k in range(3))):
                text = text.as_py()
                # A very long text goes in stretches that share all but one byte of a window.
                for start in range(0, len(text) - min_bytes + 1, LOT // 2):
                    rows.append((a.as_py(), b.as_py(), start))
                    parts.append(text[start : start + LOT // 2 + min_bytes - 1])
                    size += len(parts[-1])
                    if size >= LOT:
                        yield lot(rows, parts)
                        rows, parts, size = [], [], 0
        if rows:
            yield lot(rows, parts)

    texts = documents.select("_row_a", "_row_b", F.col("text").cast("binary").alias("text"))
    texts = texts.filter(F.octet_length("text") >= min_bytes)
    return texts.mapInArrow(cut, "_row_a long, _row_b long, low int, count int, offset int, anchor long, a long, b long")


def smaller_than_next(codes: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last is not, the empty one being least."""
    step = np.diff(codes.astype(np.int16))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    at = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(step, 0)[at] > 0, False)


def sorted_suffixes(text: bytes, depth: int) -> np.ndarray:
    """Places of all suffixes in order, to ``depth`` bytes at least, in two stages.

    Suffixes smaller than their successors are sorted directly. A scan over the order then puts before
    each bucket's sorted ones those that are larger: when a suffix is met, the larger one that begins a byte before it is
    the next in its bucket.
    """
    codes = np.frombuffer(text, np.uint8)
    smaller = smaller_than_next(codes)
    letters = text.decode("latin-1")
    direct = sorted(np.flatnonzero(smaller).tolist(), key=lambda p: letters[p : p + depth])
    ends = np.cumsum(np.bincount(codes, minlength=256))
    first = codes[direct]
    own = np.bincount(first, minlength=256)
    order = np.full(len(codes), -1, np.int64)
    order[ends[first] - own[first] + np.arange(len(direct)) - (np.cumsum(own) - own)[first]] = direct
    head = (ends - np.bincount(codes, minlength=256)).tolist()
    order, larger = order.tolist(), (~smaller).tolist()
    if text:
        order[head[text[-1]]] = len(text) - 1
        head[text[-1]] += 1
    for place in order:  # later entries are written while it runs, always before they are met
        if place > 0 and larger[place - 1]:
            code = text[place - 1]
            order[head[code]] = place - 1
            head[code] += 1
    return np.array(order, np.int64)


def adjacent_prefixes(text: bytes, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix in ``order`` shares with the next one, counted up to ``most``."""
    padded = np.frombuffer(text + bytes(most + 16), np.uint8)
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8").ravel()
    common = np.full(max(0, len(order) - 1), most, np.int64)
    pairs = np.arange(len(common))
    for done in range(0, most, 8):
        differ = words[order[pairs] + done] ^ words[order[pairs + 1] + done]
        ended = differ != 0
        lowest = differ[ended] & (~differ[ended] + np.uint64(1))
        common[pairs[ended]] = np.minimum(most, done + np.log2(lowest.astype(np.float64)).astype(np.int64) // 8)
        pairs = pairs[~ended]
    return common


def repeated_places(pieces: list[tuple[bytes, int]], min_bytes: int) -> list[np.ndarray]:
    """Of each piece (text, windows) whether each window also begins anywhere else in the pieces."""
    text = b"\xff".join(p for p, _ in pieces)
    starts = np.cumsum([0, *(len(p) + 1 for p, _ in pieces)])[:-1]
    window = np.zeros(len(text) + 1, np.int64)
    for start, (_, n) in zip(starts, pieces):
        window[start : start + n] = 1
    order = sorted_suffixes(text, min_bytes)
    group = np.concatenate([[0], np.cumsum(adjacent_prefixes(text, order, min_bytes) < min_bytes)])
    many = np.bincount(group, weights=window[order])[group] > 1
    repeated = np.zeros(len(text), bool)
    repeated[order] = many & (window[order] > 0)
    return [repeated[s : s + n] for s, (_, n) in zip(starts, pieces)]


def _ranges(flags: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return [{"start": a, "end": b} for a, b in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist())]


def sorted_repeats(pieces: DataFrame, min_bytes: int) -> DataFrame:
    """(a, b, ranges) of pieces with windows that other pieces around the same anchor have, or that they have twice.

    All pieces of an anchor meet in one task; there are at most ``GROUP`` of them.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lot(held: list[tuple]) -> pa.RecordBatch:
            flags = repeated_places([(text, n) for _, _, n, text in held], min_bytes)
            found = [(a, b, _ranges(f)) for (a, b, _, _), f in zip(held, flags) if f.any()]
            columns = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([f[2] for f in found], _SPANS)], names=["a", "b", "ranges"])

        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if held and row[1:3] == held[-1][:2]:
                    continue
                if size >= SORTED and row[0] != last:
                    yield lot(held)
                    held, size = [], 0
                held.append(row[1:])
                size += len(row[4])
                last = row[0]
        if held:
            yield lot(held)

    rows = pieces.select("anchor", "a", "b", "count", "text").repartition("anchor").sortWithinPartitions("anchor", "a", "b")
    return rows.mapInArrow(find, f"a long, b long, ranges {_RANGES}")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def finer_pieces(pieces: DataFrame, span: int, min_bytes: int) -> DataFrame:
    """(root_a, root_b, rel, n, count, offset, anchor, a, b, text): pieces cut to at most ``span`` windows.

    Windows are dealt by how far before the anchor they begin, in steps of ``span``, and what all windows of a step
    have in common is the new anchor. Equal windows stay together, as they begin equally far before equal anchors.
    """
    names = ["root_a", "root_b", "rel", "n", "count", "offset", "anchor", "a", "b", "text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, n, count, offset, text in zip(*(batch.column(k).to_pylist() for k in range(6))):
                last = offset - count + 1  # of the windows' distances from the anchor, which fall
                for step in range(last // span, offset // span + 1):
                    low, high = offset - min(offset, step * span + span - 1), offset - max(last, step * span) + 1
                    own = text[low : high - 1 + min_bytes]
                    core = text[offset - step * span : offset - step * span - span + 1 + min_bytes]
                    out.append((a, b, low, n, high - low, offset - low, _digest(step.to_bytes(4, "little", signed=True) + core)[0], *_digest(own), own))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 10, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = pieces.select("a", "b", "n", "count", "offset", "text")
    schema = "root_a long, root_b long, rel int, n long, count int, offset int, anchor long, a long, b long, text binary"
    return rows.mapInArrow(cut, schema)


def repeats_of(pieces: DataFrame, min_bytes: int, group: int, finer: tuple[int, ...]) -> DataFrame:
    """(a, b, ranges) of pieces (anchor, a, b, n, count, offset, text, pieces): their repeated windows.

    ``n`` places have a piece, ``pieces`` different ones its anchor; rows given twice count once. An anchor of more than ``group`` is hot: its
    pieces are cut finer under longer anchors, until a piece is one window and is counted.
    """
    found = sorted_repeats(pieces.filter(F.col("pieces") <= group), min_bytes)
    hot = pieces.filter(F.col("pieces") > group).dropDuplicates(["a", "b"])
    if hot.isEmpty():
        return found
    cut = _stored(finer_pieces(hot, finer[0], min_bytes), "finer-pieces")
    each = cut.groupBy("anchor", "a", "b").agg(F.sum("n").alias("n"), *[F.any_value(c).alias(c) for c in ("count", "offset", "text")])
    each = _stored(each, "different-pieces")
    around = each.groupBy("anchor").agg(F.count("*").alias("pieces"))
    often = each.filter("n > 1").select("a", "b", F.array(F.struct(F.lit(0).alias("start"), F.col("count").alias("end"))).alias("ranges"))
    met = each.join(around.filter("pieces > 1"), "anchor")
    parts = often
    if len(finer) > 1:
        rest = repeats_of(_stored(met, "met-pieces"), min_bytes, group, finer[1:])
        parts = often.unionByName(rest.join(often.select("a", "b"), ["a", "b"], "left_anti"))
    placed = cut.select("root_a", "root_b", "rel", "a", "b").join(parts, ["a", "b"])
    moved = F.transform("ranges", lambda r: F.struct((r["start"] + F.col("rel")).alias("start"), (r["end"] + F.col("rel")).alias("end")))
    whole = placed.groupBy(F.col("root_a").alias("a"), F.col("root_b").alias("b")).agg(F.flatten(F.collect_list(moved)).alias("ranges"))
    return found.unionByName(whole)


def _texts_of(documents: DataFrame, wanted: DataFrame, min_bytes: int) -> DataFrame:
    """``wanted`` pieces (_row_a, _row_b, low, count, ...) with their text, once for each equal row of their document."""
    names = [c for c in wanted.columns if c not in ("_row_a", "_row_b", "low")]
    own = wanted.groupBy("_row_a", "_row_b").agg(F.collect_list(F.struct("low", *names)).alias("_pieces"))
    rows = documents.select("_row_a", "_row_b", F.col("text").cast("binary").alias("text")).join(own, ["_row_a", "_row_b"])
    cut = F.transform(
        "_pieces",
        lambda p: p.withField("text", F.substring("text", p["low"] + 1, p["count"] - 1 + min_bytes)),
    )
    return rows.select(F.explode(cut).alias("p")).select(*[F.col(f"p.{c}") for c in (*names, "text")])


def repeated_windows(documents: DataFrame, min_bytes: int, group: int = GROUP) -> DataFrame:
    """(_row_a, _row_b, ranges): where in each document the windows begin that also begin anywhere else."""
    pieces = _stored(document_pieces(documents, min_bytes), "byte-pieces")
    key = ["anchor", "a", "b"]
    each = pieces.groupBy(*key).agg(F.count("*").alias("n"))
    around = each.groupBy("anchor").agg(F.count("*").alias("pieces"))
    met = each.join(around, "anchor").filter("n > 1 OR pieces > 1")
    marked = _stored(pieces.join(met, key), "met-pieces")
    first = marked.filter("pieces > 1").groupBy(*key).agg(
        F.min(F.struct("_row_a", "_row_b", "low")).alias("place"), *[F.any_value(c).alias(c) for c in ("n", "pieces", "count", "offset")]
    )
    wanted = first.select("place.*", *key, "n", "pieces", "count", "offset")
    different = _stored(_texts_of(documents, wanted, min_bytes), "piece-texts")
    partly = repeats_of(different, min_bytes, group, FINER)
    whole = marked.filter("n > 1").select("_row_a", "_row_b", "low", F.array(F.struct(F.lit(0).alias("start"), F.col("count").alias("end"))).alias("ranges"))
    once = marked.filter("n = 1").select("_row_a", "_row_b", "low", "a", "b").join(partly, ["a", "b"]).drop("a", "b")
    moved = F.transform("ranges", lambda r: F.struct((r["start"] + F.col("low")).alias("start"), (r["end"] + F.col("low")).alias("end")))
    return whole.unionByName(once).groupBy("_row_a", "_row_b").agg(F.array_sort(F.flatten(F.collect_list(moved))).alias("ranges"))


def _covered(ranges: list[dict], min_bytes: int) -> list[list[int]]:
    """(start, end) of the bytes that windows of the ranges cover, overlapping and touching ones as one."""
    out: list[list[int]] = []
    for r in ranges:
        low, high = r["start"], r["end"] - 1 + min_bytes
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def remove_repeated_bytes(documents: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``documents`` with the bytes that are left of each text, and where others were taken out.

    ``documents`` (doc_id, text, ...) are report documents; a text is its UTF-8 bytes. Every byte goes that is covered
    by a string of ``min_bytes`` bytes which also begins anywhere else, in the same document or another; strings lie within
    one document, may overlap, and are judged on the whole input; ``min_bytes`` is from 1 to 2^17. Adds ``kept`` (binary: what is left, joined) and
    ``removed``, array of (start, end) in bytes: the maximal runs taken out, in order.

    Only strings that share the anchor of least hash can be equal, so texts are cut into pieces, runs of strings around
    one anchor. A piece that stands in several places is repeated whole; different pieces around an anchor are put
    together in one task, their suffixes sorted in two stages, and neighbours with a common prefix of ``min_bytes`` are
    repeated. Equal pieces are counted before they are sent, and an anchor with very many different ones is cut finer, so
    no group grows with the documents.

    Every row is a document, repeated rows and NULL ids too: a row given twice is repeated whole if it is long
    enough. NULL text has NULL ``kept``; NULL, empty and shorter texts lose nothing. Other columns are carried; names
    that begin with ``_row_`` or ``_kept_`` and the names ``kept`` and ``removed`` must be free.
    """
    if not 1 <= min_bytes <= 1 << 17:
        raise ValueError(f"{min_bytes} bytes: from 1 to 2^17")
    keyed = documents.select("*", *row_key("doc_id", "text"))
    found = repeated_windows(keyed, min_bytes).select(
        F.col("_row_a").alias("_kept_a"), F.col("_row_b").alias("_kept_b"), F.col("ranges").alias("_kept_ranges")
    )
    same = (F.col("_row_a") == F.col("_kept_a")) & (F.col("_row_b") == F.col("_kept_b"))
    rows = keyed.join(found, same, "left").drop("_row_a", "_row_b", "_kept_a", "_kept_b")
    names = documents.columns
    text_at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for text, ranges in zip(batch.column(text_at).cast(pa.binary()), batch.column(len(names))):
                text, runs = text.as_py(), _covered(ranges.as_py() or [], min_bytes)
                if runs:
                    text = b"".join(text[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(text)]))
                kept.append(text)
                removed.append([{"start": a, "end": b} for a, b in runs])
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary()), pa.array(removed, _SPANS)], names=[*names, "kept", "removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return rows.mapInArrow(cut, f"{schema}, kept binary, removed {_RANGES}")
