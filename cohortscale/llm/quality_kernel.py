"""Review verdicts learned from document statistics by a Gaussian kernel in random features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscale.llm.rows import lower_ascii, split_blanks
from cohortscale.session import cut_lineage

STATISTICS = (
    "log_chars", "log_words", "word_chars", "distinct_words", "top_word", "repeated_runs", "upper", "digits", "blanks",
    "stops", "marks", "bars", "beyond_ascii", "log_lines", "repeated_lines", "marked_words", "byte_entropy",
)
# Classes of bytes whose shares are statistics.
_CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:", b"#*$%&!?<>{}[]@^~=+\\/_", b"|",
    bytes(range(128, 256)),
)
_SUMS = np.zeros((256, len(_CLASSES)))
for _i, _members in enumerate(_CLASSES):
    _SUMS[list(_members), _i] = 1


# A word that ends in a mark other than those of a sentence.
_MARKED = re.compile(r"[#*$%&!?<>{}\[\]@^~=+\\/_|][ \n]")


def text_statistics(text: str) -> list[float]:
    """The STATISTICS of one whole text; an empty one has zeros."""
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n = max(int(counts.sum()), 1)
    shares = (counts @ _SUMS) / n
    p = counts[counts > 0] / n
    words = split_blanks(lower_ascii(text))
    w = max(len(words), 1)
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:], words[2:]))) / max(len(words) - 2, 1) if len(words) > 2 else 1.0
    lines = [line for line in text.split("\n") if line]
    marked = len(_MARKED.findall(text))
    upper, digits, blanks, stops, marks, bars, beyond = shares.tolist()
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(sum(map(len, words)) / w), len(seen) / w,
        max(seen.values(), default=0) / w, 1.0 - pairs, upper, digits, blanks, stops, marks, bars, beyond,
        np.log1p(len(lines)), 1.0 - len(set(lines)) / max(len(lines), 1), marked / w, float(-(p * np.log2(p)).sum()),
    ]


@dataclass(frozen=True)
class KernelModel:
    """Scaling, random features, ridge weights and the calibration's steps; a few hundred numbers each."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def probability(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.steps, self.levels)


def pool_adjacent(totals: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Least-squares rising fit to totals / counts, by merging neighbours that fall."""
    blocks: list[list[float]] = []
    for t, c in zip(totals, counts):
        blocks.append([t, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, c, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t, blocks[-1][1] + c, blocks[-1][2] + k]
    return np.concatenate([np.full(int(k), t / c) for t, c, k in blocks]) if blocks else np.zeros(0)


def fit_verdicts(
    documents: DataFrame, verdicts: DataFrame, features: int = 256, width: float = 4.0, ridge: float = 1e-4, seed: int = 20260916
) -> KernelModel:
    """Learn ``verdicts`` (doc_id, accepted 0/1) from the statistics of ``documents`` (doc_id, text).

    Every row with a verdict is learned from. Each partition sums its normal equations, the sums
    meet by row of the matrix, and one matrix of ``features`` + 1 is solved. Raw scores are counted
    in bins of 1/1000 and fitted by a rising step function. Verdicts that are NULL or of no
    document are left out; without any, every score is 0.5.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [text_statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(stats, pa.list_(pa.float64()))], names=["doc_id", "stats"]
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = verdicts.filter("accepted IS NOT NULL").select("doc_id", F.col("accepted").cast("double").alias("accepted"))
    rows = cut_lineage(texts.mapInArrow(measure, f"doc_id {kind}, stats array<double>").join(known, "doc_id").select("stats", "accepted"))
    k = len(STATISTICS)
    ends = rows.agg(
        F.count("*"), *[f(F.col("stats")[i]) for i in range(k) for f in (F.avg, F.stddev_pop)]
    ).first()
    draw = np.random.default_rng(seed)
    directions = draw.normal(0, 1 / width, (k, features))
    phases = draw.uniform(0, 2 * np.pi, features)
    if not ends[0]:
        return KernelModel(np.zeros(k), np.ones(k), directions, phases, np.zeros(features + 1), np.zeros(1), np.full(1, 0.5))
    mean = np.array(ends[1::2])
    scale = np.array([s if s > 1e-9 else 1.0 for s in ends[2::2]])
    model = KernelModel(mean, scale, directions, phases, np.zeros(features + 1), np.zeros(1), np.zeros(1))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((features + 1, features + 2))
        for batch in batches:
            z = model.features(np.stack(batch.column(0).to_numpy(zero_copy_only=False)))
            both += z.T @ np.hstack([z, batch.column(1).to_numpy()[:, None]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(features + 1), pa.int32()), pa.array(list(both), pa.list_(pa.float64()))], names=["i", "sums"]
        )

    def meet(table: pa.Table) -> pa.Table:
        total = np.sum(np.stack(table.column("sums").to_numpy()), axis=0)
        return pa.table({"i": table.column("i")[:1], "sums": pa.array([total], pa.list_(pa.float64()))})

    parts = rows.mapInArrow(sums, "i int, sums array<double>")
    whole = np.zeros((features + 1, features + 2))
    for r in parts.groupBy("i").applyInArrow(meet, "i int, sums array<double>").collect():
        whole[r["i"]] = r["sums"]
    gram = whole[:, :-1] + np.eye(features + 1) * ridge * ends[0]
    weights = np.linalg.solve(gram, whole[:, -1])
    solved = KernelModel(mean, scale, directions, phases, weights, np.zeros(1), np.zeros(1))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = solved.raw(np.stack(batch.column(0).to_numpy(zero_copy_only=False)))
            bins = pa.array(np.round(np.clip(raw, -1, 2) * 1000).astype(np.int32))
            yield pa.RecordBatch.from_arrays([bins, batch.column(1)], names=["bin", "accepted"])

    bins = (
        rows.mapInArrow(binned, "bin int, accepted double").groupBy("bin").agg(F.sum("accepted"), F.count("*")).orderBy("bin").collect()
    )
    at, good, n = (np.array([float(r[j]) for r in bins]) for j in range(3))
    level = pool_adjacent(good, n)
    edge = np.concatenate([[True], np.diff(level) > 0])
    block = np.cumsum(edge) - 1
    centre = np.bincount(block, at * n) / np.bincount(block, n)
    return KernelModel(mean, scale, directions, phases, weights, centre / 1000, level[edge])


def score_verdicts(documents: DataFrame, model: KernelModel, score: str = "score") -> DataFrame:
    """``documents`` with the probability of acceptance of each whole text, from 0 to 1.

    NULL text is scored as empty text. Every row is kept, with all its columns; ``score`` must be a
    free name.
    """
    names = documents.columns
    at = names.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([text_statistics(t.as_py() or "") for t in batch.column(at)]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.probability(stats))], names=[*names, score])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return documents.mapInArrow(apply, f"{schema}, `{score}` double")
