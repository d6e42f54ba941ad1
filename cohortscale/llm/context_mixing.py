"""Log probability of documents by online logistic mixing of hashed-context bit predictors."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscale.llm.rows import lower_ascii, row_key, split_blanks
from cohortscale.session import cut_lineage

#: Bytes of a piece: contexts of words start anew with it, so that a text of any length fits a task.
PIECE = 1 << 20
#: Bytes counted at a time, few enough to stay near the processor, and bytes mixed at a time.
COUNTED, MIXED = 1 << 16, 2 << 20
#: Bytes of the longest context.
HISTORY = 12
#: Decisions of a segment: the mixing weights start anew with it, so that segments go side by side.
SEGMENT = 2048
#: Bits of the largest table of contexts: it grows with what is learned from, between these.
LEAST_BITS, MOST_BITS = 18, 22
#: Slots of a table that travel as one row.
BLOCK = 1 << 14
#: Most frequent words whose counts every task gets, and their greatest length; the rest is joined.
FREQUENT = 1 << 17
FREQUENT_CHARS = 64
_TABLES = 4
_SMALLER = (3, 1, 0, 1)  # bits by which each table is smaller than the largest
_CONTEXT = np.uint32(0x9E3779B1)
_NODE = np.uint32(0x85EBCA6B)
_LAST = np.uint32(0xC2B2AE35)
_POWER = np.uint32(0x01000193)
_BACK = np.uint32(pow(0x01000193, -1, 1 << 32))
# Weights a segment begins with, and what is added where the longest context was met.
_START = np.array([[0.25, 0.3, 0.35, 0.0], [-0.15, -0.15, -0.1, 0.6]], np.float32)
_SIXTEENTH = np.float32(1 / 16)
_BUCKETS = 33
_RATE, _REFINE = np.float32(0.02), np.float32(0.02)


def tokens(text: str | None) -> list[str]:
    return split_blanks(lower_ascii(text)) if text else []


def normal_bytes(text: str | None) -> bytes:
    """A text as the model sees it: its words, A-Z lower-cased, one space between, then an end."""
    return " ".join(tokens(text)).encode("utf-8", "surrogatepass") + b"\n"


@dataclass(frozen=True)
class Code:
    """A prefix code of the bytes for each byte before: row 256 * before + byte of each array.

    How long the code word is, and its nodes and bits from the root, ``width`` entries a row.
    """

    lengths: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    width: int


def _code_words(counts: list[int]) -> list[list[tuple[int, int]]]:
    """(node, bit) from the root to each byte in the code of least mean length."""
    order = count()
    heap = [(256 * c + 1, next(order), s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], next(order), (a[2], b[2])))
    words: list[list[tuple[int, int]]] = [[] for _ in counts]
    walk, number = [(heap[0][2], [])], count()
    while walk:
        tree, path = walk.pop()
        if isinstance(tree, int):
            words[tree] = path
        else:
            node = next(number)
            walk += [(tree[0], [*path, (node, 0)]), (tree[1], [*path, (node, 1)])]
    return words


def prefix_code(counts: np.ndarray) -> Code:
    """The code for counts of (byte before, byte): what often follows takes few binary decisions."""
    plain = _code_words([0] * 256)
    rows = [w for row in counts for w in (_code_words(row.tolist()) if row.any() else plain)]
    lengths = np.array([len(w) for w in rows])
    width = int(lengths.max())
    nodes, bits = np.zeros((len(rows), width), np.uint8), np.zeros((len(rows), width), np.uint8)
    for i, word in enumerate(rows):
        nodes[i, : len(word)] = [n for n, _ in word]
        bits[i, : len(word)] = [b for _, b in word]
    return Code(lengths, nodes.ravel(), bits.ravel(), width)


def decisions(pieces: list[tuple[bytes, bytes]], code: Code, bits: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Bit of every binary decision over (history, piece) pairs, its slot in each table, and each piece's count.

    The contexts are the last three, five and twelve bytes and the word so far, each with the node
    of the code. What stands before a text is line ends.
    """
    gap = HISTORY
    raw = b"".join(h[-gap:].rjust(gap, b"\n") + p for h, p in pieces)
    b = np.frombuffer(raw, np.uint8)
    sizes = np.array([len(p) for _, p in pieces])
    ends = np.cumsum(sizes + gap)
    own = np.ones(len(b), bool)
    own[(ends - sizes)[:, None] - np.arange(1, gap + 1)] = False
    at = np.flatnonzero(own)
    wide = b.astype(np.uint32)
    back = [wide[at - k] for k in range(1, gap + 1)]
    three = back[0] | back[1] << np.uint32(8) | back[2] << np.uint32(16)
    five = (three | back[3] << np.uint32(24)) * _CONTEXT + back[4]
    twelve = five
    for k in range(5, gap):
        twelve = twelve * _CONTEXT + back[k]
    powers = np.full(len(b) + 1, _POWER, np.uint32)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(b) + 1, np.uint32)
    np.cumsum((wide + np.uint32(1)) * powers[:-1], dtype=np.uint32, out=sums[1:])
    inverse = np.full(len(b) + 1, _BACK, np.uint32)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    cut = (b == 32) | (b == 10) | ~own
    start = np.maximum.accumulate(np.where(cut, np.arange(1, len(b) + 1), 0))
    begun = np.concatenate([[0], start[:-1]])[at]
    word = (sums[at] - sums[begun]) * inverse[begun]
    row = (back[0] << np.uint32(8) | wide[at]).astype(np.int64)
    lengths = code.lengths[row]
    skipped = row * code.width - np.cumsum(lengths) + lengths
    flat = np.arange(int(lengths.sum())) + np.repeat(skipped, lengths)
    node = code.nodes[flat] * _NODE
    slots = []
    for context, less in zip((three, five, word, twelve), _SMALLER):
        hashed = context * _CONTEXT
        hashed ^= hashed >> np.uint32(15)
        hashed = np.repeat(hashed * _LAST, lengths)
        hashed += node
        hashed *= _LAST
        hashed >>= np.uint32(32 - bits + less)
        slots.append(hashed)
    each = np.add.reduceat(lengths, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0, int)
    return code.bits[flat], slots, each


def stretched(counts: np.ndarray) -> np.ndarray:
    """Log odds of bit 1 in sixteenths from rows of (zeros, ones)."""
    odds = np.log((counts[:, 1] + 0.4) / (counts[:, 0] + 0.4))
    return np.round(np.clip(odds, -7.9, 7.9) * 16).astype(np.int8)


def mixed_bits(bits: np.ndarray, odds: list[np.ndarray], each: np.ndarray) -> np.ndarray:
    """Bits that each piece takes: its segments are mixed side by side, decision by decision.

    A segment begins with the same weights and map. The log odds of the predictors are weighted by
    weights that the longest context gates: where it was met before, a second set is added. Both
    then move by the error. The mixed probability is refined by an adaptive map over its own level.
    """
    lanes_of = -(-each // SEGMENT)
    piece = np.repeat(np.arange(len(each)), lanes_of)
    first = np.cumsum(each) - each
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)
    start = first[piece] + offset * SEGMENT
    length = np.minimum(each[piece] - offset * SEGMENT, SEGMENT)
    order = np.argsort(-length, kind="stable")
    start, length, piece = start[order], length[order], piece[order]
    lanes = len(start)
    if not lanes:
        return np.zeros(len(each))
    steps = int(length[0])
    where = np.minimum(start[None, :].astype(np.int32) + np.arange(steps, dtype=np.int32)[:, None], np.int32(len(bits) - 1))
    table = np.empty((steps, _TABLES, lanes), np.int8)
    for k, o in enumerate(odds):
        table[:, k] = o[where]
    wanted = bits[where]
    active = np.searchsorted(-length, -np.arange(1, steps + 1), side="right")
    always, met = np.repeat(_START, lanes).reshape(2, _TABLES, lanes)
    levels = (np.arange(_BUCKETS, dtype=np.float32) - _BUCKETS // 2) / 2
    refined = np.tile(1 / (1 + np.exp(-levels)), lanes).astype(np.float32)
    maps = np.arange(lanes) * _BUCKETS + _BUCKETS // 2
    found = np.ones((steps, lanes), np.float32)
    for t in range(steps):
        n = int(active[t])
        x = table[t, :, :n] * _SIXTEENTH
        gate = (table[t, _TABLES - 1, :n] != 0).astype(np.float32)
        w = gate * met[:, :n]
        w += always[:, :n]
        w *= x
        level = w[0]
        for row in w[1:]:
            level += row
        np.clip(level, -7.9, 7.9, out=level)
        p = np.exp(-level)
        p += 1
        np.reciprocal(p, out=p)
        bit = wanted[t, :n].astype(np.float32)
        spot = maps[:n] + np.rint(level * 2).astype(np.int64)
        q = refined[spot]
        refined[spot] = q + (bit - q) * _REFINE
        np.subtract(bit, p, out=level)
        level *= _RATE
        x *= level
        always[:, :n] += x
        x *= gate
        met[:, :n] += x
        p += q
        p *= np.float32(0.5)
        np.abs(p - (1 - bit), out=found[t, :n])
    np.clip(found, 1e-4, 1, out=found)
    taken = -np.log2(found).sum(axis=0, dtype=np.float64)
    return np.bincount(piece, taken, minlength=len(each))


def _piece_batches(texts: Iterator[str | None], most: int = PIECE) -> Iterator[tuple[list[int], list[tuple[bytes, bytes]]]]:
    """Pieces of texts, at most about ``most`` bytes at a time, with the place of their text."""
    owners, pieces, held = [], [], 0
    for i, text in enumerate(texts):
        raw = normal_bytes(text)
        for a in range(0, len(raw), PIECE):
            owners.append(i)
            pieces.append((raw[max(a - HISTORY, 0) : a], raw[a : a + PIECE]))
            held += len(pieces[-1][1])
            if held >= most:
                yield owners, pieces
                owners, pieces, held = [], [], 0
    if pieces:
        yield owners, pieces


def word_counts(learned: DataFrame) -> DataFrame:
    """(word, n): occurrences of each word in ``learned`` (text), and of the end, the empty word."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for text in batch.column(0):
                seen.update(tokens(text.as_py()))
            seen[""] += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    return learned.select("text").mapInArrow(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class MixingModel:
    """The code and the log odds of each table: bounded by MOST_BITS, whatever is learned from."""

    code: Code
    odds: list[np.ndarray]
    bits: int


def looked_up(pieces: list[tuple[bytes, bytes]], model: MixingModel) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Bits of the decisions, log odds of each table, and decisions of each piece, a few pieces at a time."""
    found, held, size = [], [], 0
    for i, piece in enumerate(pieces):
        held.append(piece)
        size += len(piece[1])
        if size >= COUNTED or i == len(pieces) - 1:
            bit, slots, each = decisions(held, model.code, model.bits)
            found.append((bit, *[o[s] for o, s in zip(model.odds, slots)], each))
            held, size = [], 0
    bit, *odds, each = (np.concatenate(x) for x in zip(*found))
    return bit, odds, each


def fit_contexts(learned: DataFrame, vocabulary: DataFrame) -> MixingModel:
    """Count what follows each hashed context in every text of ``learned`` (text).

    Counts of byte pairs for the code come from ``vocabulary`` (word, n), the words of the same texts. Each task
    counts into tables, and their blocks are summed by Spark; only the log odds reach the driver.
    """

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            words = [b" " + w.encode("utf-8", "surrogatepass") + b" " if w else b" \n" for w in batch.column(0).to_pylist()]
            b = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
            sizes = np.array([len(w) for w in words], np.int64)
            times = np.repeat(batch.column(1).to_numpy(), sizes)
            inside = np.ones(len(b), bool)
            inside[np.cumsum(sizes) - 1] = False
            here = np.flatnonzero(inside)
            total += np.bincount(b[here] * 256 + b[here + 1], times[here], minlength=1 << 16).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    counts = np.zeros(1 << 16, np.int64)
    for r in vocabulary.mapInArrow(pairs_of, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r["pair"]] = r["n"]
    code = prefix_code(counts.reshape(256, 256))
    bits = int(np.clip(np.ceil(np.log2(max(counts.sum(), 1) / 8)), LEAST_BITS, MOST_BITS))
    sizes = [1 << (bits - less) for less in _SMALLER]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 * s, np.uint32) for s in sizes]
        some = False
        for batch in batches:
            for _, pieces in _piece_batches((t.as_py() for t in batch.column(0)), COUNTED):
                some = True
                bit, slots, _ = decisions(pieces, code, bits)
                for table, slot in zip(tables, slots):
                    np.add.at(table, (slot << np.uint32(1)) + bit, np.uint32(1))
        if some:
            for k, table in enumerate(tables):
                for j in range(0, len(table), 2 * BLOCK):
                    part = table[j : j + 2 * BLOCK]
                    if part.any():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([k], pa.int32()), pa.array([j // (2 * BLOCK)], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                            names=["k", "block", "counts"],
                        )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def done() -> pa.RecordBatch:
            odds = stretched(total.reshape(-1, 2)).tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([odds], pa.binary())], names=["k", "block", "odds"]
            )

        for batch in batches:
            for k, block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (k, block) != now:
                    if now is not None:
                        yield done()
                    now, total = (k, block), 0.0
                total = total + np.frombuffer(part.as_buffer(), np.uint32).astype(np.float64)
        if now is not None:
            yield done()

    parts = learned.select("text").mapInArrow(gather, "k int, block int, counts binary")
    sums = parts.repartition("k", "block").sortWithinPartitions("k", "block").mapInArrow(meet, "k int, block int, odds binary")
    odds = [np.zeros(s, np.int8) for s in sizes]
    for r in sums.collect():
        part = np.frombuffer(r["odds"], np.int8)
        odds[r["k"]][r["block"] * BLOCK : r["block"] * BLOCK + len(part)] = part
    return MixingModel(code, odds, bits)


def _base(documents: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(row, n_tokens, n_known, log_sum): the sum over tokens of log10(count + 0.1), and tokens with a count.

    The most frequent words are looked up where texts are read; the others meet their counts by a join.
    """
    top = vocabulary.filter(F.length("word") <= FREQUENT_CHARS).orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    known = documents.sparkSession.sparkContext.broadcast({r["word"]: r["n"] for r in top})
    kind = pa.list_(pa.struct([("word", pa.string()), ("tf", pa.int64())]))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_of = known.value
        log_of = {w: float(np.log10(n + 0.1)) for w, n in n_of.items()}
        for batch in batches:
            totals, sums, hits, others = [], [], [], []
            for text in batch.column(2):
                words = tokens(text.as_py())
                words.append("")
                found = [log_of[w] for w in words if w in log_of]
                rare = Counter(w for w in words if w not in log_of) if len(found) < len(words) else {}
                totals.append(len(words))
                sums.append(sum(found))
                hits.append(len(found))
                others.append([{"word": w, "tf": n} for w, n in rare.items()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(totals), pa.array(sums, pa.float64()), pa.array(hits), pa.array(others, kind)],
                names=["_row_a", "_row_b", "n_tokens", "log_sum", "n_known", "rare"],
            )

    rows = documents.select(*row_key("doc_id", "text"), "text")
    schema = "_row_a long, _row_b long, n_tokens long, log_sum double, n_known long, rare array<struct<word: string, tf: long>>"
    each = rows.mapInArrow(tally, schema).select("*", F.posexplode_outer("rare").alias("i", "r")).drop("rare")
    first = F.coalesce(F.col("i"), F.lit(0)) == 0
    once = [F.when(first, F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("n_tokens", "log_sum", "n_known")]
    joined = each.select("_row_a", "_row_b", first.alias("first"), *once, F.col("r.word").alias("word"), F.col("r.tf").alias("tf")).join(
        vocabulary.select("word", "n"), "word", "left"
    )
    log = F.when(F.col("word").isNotNull(), F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).otherwise(F.lit(0.0))
    sums = joined.groupBy("_row_a", "_row_b").agg(
        F.count_if("first").alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(F.lit(0)))).alias("n_known"),
        (F.sum("log_sum") + F.sum(log)).alias("log_sum"),
    )
    c = F.col("copies")
    return sums.select(
        "_row_a", "_row_b", (F.col("n_tokens") / c).cast("long").alias("n_tokens"), (F.col("n_known") / c).cast("long").alias("n_known"), (F.col("log_sum") / c).alias("log_sum")
    )


def score_documents(documents: DataFrame, learned: DataFrame) -> DataFrame:
    """How probable each whole text is, under words alone and under the mixed bit predictors.

    ``documents`` (doc_id, text) are scored, ``learned`` (text) is learned from. A text is its words, A-Z
    lower-cased, and one end. Returns (doc_id, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte), one row per row: tokens, those that were learned, all learned tokens, the log10
    probability by smoothed word counts, and that of the words with one space between by the
    model, and the model's bits per byte of that.

    Every byte is a few binary decisions of a prefix code. For each, the bits seen after four
    hashed contexts in the learned texts are four predictors; their log odds are mixed by gated weights that
    follow the text online, and refined by an adaptive map. Long texts restart weights every SEGMENT decisions.

    NULL text is empty: one token, the end. A NULL id is carried through; equal rows get equal
    scores; other columns are not read. With nothing learned every probability is that of the start.
    """
    texts = learned.select(F.coalesce("text", F.lit("")).alias("text"))
    vocabulary = cut_lineage(word_counts(texts))
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    model = fit_contexts(texts, vocabulary)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            taken = np.zeros(batch.num_rows)
            size = np.zeros(batch.num_rows, np.int64)
            for owners, pieces in _piece_batches((t.as_py() for t in batch.column(3)), MIXED):
                np.add.at(taken, owners, mixed_bits(*looked_up(pieces, m)))
                np.add.at(size, owners, [len(p) for _, p in pieces])
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(-taken * np.log10(2)), pa.array(taken / size)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_row_a", "_row_b", "score", "bits_per_byte"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", *row_key("doc_id", "text"), "text")
    mixed = rows.mapInArrow(score, f"doc_id {kind}, _row_a long, _row_b long, score double, bits_per_byte double")
    per_token = float(np.log10(total + 0.1 * (distinct + 1)))
    return mixed.join(_base(documents, vocabulary), ["_row_a", "_row_b"]).select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_sum") - F.col("n_tokens") * per_token).alias("base_score"),
        "score",
        "bits_per_byte",
    )
