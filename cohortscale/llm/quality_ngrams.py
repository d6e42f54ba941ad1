"""Rules on documents: fixed limits on their words, and a verdict from hashed n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscale.llm.rows import split_blanks

#: Hash slots of each kind of n-gram: words, pairs of words, triples of bytes.
SLOT_BITS = 13
SLOTS = 1 << SLOT_BITS
KINDS = 3
#: Rows with a verdict that are learned from, at most.
SAMPLE_ROWS = 20_000
#: Least probability of acceptance of a kept document.
KEEP_AT = 0.3
#: Tasks that learn side by side; their weights are averaged.
LEARNERS = 8
# Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_DOWN = np.uint64(64 - SLOT_BITS)
_ODD = np.random.default_rng(5).integers(1, 1 << 62, 5, dtype=np.uint64) | np.uint64(1)


def repeated_words(words: list[str]) -> int:
    """Words inside windows of five words that the text has twice or more, all occurrences included."""
    if len(words) < 6:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    n = len(ids) - 4
    mixed = np.zeros(n, np.uint64)
    for k in range(5):  # equal windows have equal hashes, so distinct hashes settle it
        mixed += (ids[k : k + n].astype(np.uint64) + np.uint64(1)) * _ODD[k]
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():
        return 0
    _, two = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, four = np.unique(two[:-2].astype(np.int64) * len(ids) + two[2:], return_inverse=True)
    _, five, times = np.unique(four[:-1].astype(np.int64) * len(number) + ids[4:], return_inverse=True, return_counts=True)
    starts = np.zeros(len(ids) + 1, np.int64)
    again = np.flatnonzero(times[five] > 1)
    np.add.at(starts, again, 1)
    np.add.at(starts, again + 5, -1)
    return int((np.cumsum(starts)[:-1] > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    seen, n = set(), 0
    for line in text.split("\n"):
        if split_blanks(line):
            n += line in seen
            seen.add(line)
    return n


def hashed_ngrams(text: str, words: list[str], memo: dict[str, int]) -> np.ndarray:
    """Square roots of the shares of each hash slot, for each kind of n-gram in turn."""
    if len(memo) > 1 << 19:
        memo.clear()
    known = []
    for w in words:
        h = memo.get(w)
        if h is None:
            memo[w] = h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        known.append(h)
    one = np.array(known, np.uint64)
    two = (one[:-1] * _MIX + one[1:]) * _MIX >> _DOWN
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
    three = ((b[:-2] << np.uint64(16)) + (b[1:-1] << np.uint64(8)) + b[2:]) * _MIX >> _DOWN
    out = np.empty(KINDS * SLOTS, np.float32)
    for kind, slots in enumerate((one * _MIX >> _DOWN, two, three)):
        counts = np.bincount(slots.astype(np.int64), minlength=SLOTS)
        out[kind * SLOTS : (kind + 1) * SLOTS] = counts * np.float32(1 / max(len(slots), 1))
    return np.sqrt(out, out=out)


@dataclass(frozen=True)
class NgramModel:
    """Weights of the slots, and the slope and shift that make probabilities of margins."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, grams: np.ndarray) -> float:
        return float(grams @ self.weights) + self.bias

    def probability(self, grams: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(grams) + self.shift, -40, 40))))


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def fit_rules(documents: DataFrame, verdicts: DataFrame, sample_rows: int = SAMPLE_ROWS, epochs: int = 4, rate: float = 2.0) -> NgramModel:
    """Learn ``verdicts`` (doc_id, accepted 0/1) from hashed n-grams of ``documents`` (doc_id, text).

    The rows learned from are those of least hash of doc_id, ``sample_rows`` of them in
    expectation; four in five fit the weights and the fifth fits the calibration. LEARNERS tasks each
    descend the logistic loss over their rows, and their weights are averaged. NULL verdicts and
    verdicts of no document are left out; without any, every probability is one half.
    """
    known = verdicts.filter("accepted IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("accepted").cast("int").alias("accepted"))
    total = max(known.count(), 1)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    chosen = known.filter(place < sample_rows / total)
    # At most about sample_rows rows of two numbers: bounded by the parameter, not by the table.
    rows = _texts(documents).join(F.broadcast(chosen), "doc_id").withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit("c")), F.lit(5)) == 0)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        slots, shares, wanted = [], [], []
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = hashed_ngrams(text, split_blanks(text), memo)
                at = np.flatnonzero(grams).astype(np.int32)
                slots.append(at)
                shares.append(grams[at])
                wanted.append(y)
        w, bias = np.zeros(KINDS * SLOTS, np.float32), 0.0
        order = np.random.default_rng(1)
        for epoch in range(epochs):
            for i in order.permutation(len(wanted)):
                p = 1 / (1 + np.exp(-np.clip(shares[i] @ w[slots[i]] + bias, -30, 30)))
                step = rate / (1 + epoch) * (wanted[i] - p)
                w[slots[i]] += step * shares[i]
                bias += 0.05 * step
        if wanted:
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(wanted)]), pa.array([float(bias)]), pa.array([w.tobytes()], pa.binary())], names=["n", "bias", "weights"]
            )

    # Dealt evenly, without a key: which rows a learner gets does not follow their source.
    fits = rows.filter("NOT calibrates").select("text", "accepted").repartition(LEARNERS)
    parts = fits.mapInArrow(learn, "n long, bias double, weights binary").collect()
    if not parts:
        return NgramModel(np.zeros(KINDS * SLOTS, np.float32), 0.0, 0.0, 0.0)
    n = sum(p["n"] for p in parts)
    weights = sum(np.frombuffer(p["weights"], np.float32) * (p["n"] / n) for p in parts).astype(np.float32)
    model = NgramModel(weights, sum(p["bias"] * p["n"] for p in parts) / n, 1.0, 0.0)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            found = [model.margin(hashed_ngrams(t, split_blanks(t), memo)) for t in batch.column(0).to_pylist()]
            bins = np.round(np.clip(found, -20, 20) * 50).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1)], names=["bin", "accepted"])

    bins = rows.filter("calibrates").select("text", "accepted").mapInArrow(margins, "bin int, accepted int").groupBy("bin").agg(F.sum("accepted"), F.count("*")).collect()
    return NgramModel(model.weights, model.bias, *_calibration(*(np.array([float(r[j]) for r in bins]) for j in range(3))))


def _calibration(bins: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift of least logistic loss, by Newton steps, with half a row added to each side."""
    if not n.sum():
        return 1.0, 0.0
    x = np.stack([bins / 50, np.ones(len(bins))], axis=1)
    target = (good + 0.5 * n / n.sum()) / (n + n / n.sum())
    beta = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (n * (target - p)) - 1e-3 * beta
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta = beta + np.linalg.solve(curve, slope)
    return float(beta[0]), float(beta[1])


def apply_rules(documents: DataFrame, model: NgramModel, keep_at: float = KEEP_AT) -> DataFrame:
    """Counts, the base rules and the verdict on each whole text of ``documents`` (doc_id, text).

    Returns (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    probability, kept), one row per row. A text fails the base rules with fewer than 10 words or with
    more than a fifth of them in repeated windows of five words; else it is kept if its probability of
    acceptance is ``keep_at`` or more. NULL text is an empty text, which fails. A NULL id is carried
    through; other columns are not read.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            counts, probabilities = [], []
            for t in batch.column(1):
                text = t.as_py()
                words = split_blanks(text)
                counts.append((
                    len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), repeated_lines(text), repeated_words(words),
                ))
                probabilities.append(model.probability(hashed_ngrams(text, words, memo)))
            n = np.array(counts, np.int64).reshape(-1, 5)
            p = np.array(probabilities)
            failed = (n[:, 0] < 10) | (100 * n[:, 4] > 20 * n[:, 0])
            columns = [batch.column(0), *[pa.array(n[:, i]) for i in range(5)], pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep_at))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:6]) + ", base_failed boolean, probability double, kept boolean"
    return _texts(documents).mapInArrow(judge, schema)
