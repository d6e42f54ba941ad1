"""Language of documents by the nearest of several centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots the n-grams of two and three bytes are hashed to.
SLOTS = 4096
#: Centroids per language, and documents per language that they are begun from, in expectation.
CENTROIDS = 4
SEEDS = 300
#: A document further from its centroid than this many deviations of what was learned is rejected.
FAR = 6.0
UNKNOWN = "und"
_MIX = np.uint32(2654435761)
_DOWN = np.uint32(32 - 12)
# Bytes that are no ASCII letter and not beyond ASCII become a space.
_LETTERS = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(128)) + bytes(range(128, 256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def slot_counts(text: str) -> np.ndarray:
    """How often each slot's n-grams occur in a whole text, lower-cased, with letters only."""
    raw = b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())
    b = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    two = (b[:-1] << np.uint32(8)) | b[1:]
    three = (two[:-1] << np.uint32(8)) | b[2:]
    slots = np.concatenate([(two * _MIX) >> _DOWN, (three * _MIX) >> _DOWN])
    return np.bincount(slots, minlength=SLOTS)


@dataclass(frozen=True)
class LanguageModel:
    """Weights of the slots, and the centroids with their languages and the least cosine of each."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray

    def vectors(self, texts: list[str]) -> np.ndarray:
        """Unit vectors of TF-IDF, term counts on a log scale; zero for a text without a letter."""
        tf = np.stack([slot_counts(t) for t in texts]).astype(np.float32)
        np.log1p(tf, out=tf)
        tf *= self.idf
        return tf / np.maximum(np.linalg.norm(tf, axis=1, keepdims=True), 1e-12)


def spherical_means(vectors: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Up to ``k`` unit centroids, begun far apart and moved to the mean of what is nearest."""
    centroids = [vectors[0]]
    while len(centroids) < min(k, len(vectors)):
        near = (vectors @ np.stack(centroids).T).max(axis=1)
        centroids.append(vectors[int(near.argmin())])
    c = np.stack(centroids)
    for _ in range(rounds):
        nearest = (vectors @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (nearest == j).any():
                m = vectors[nearest == j].sum(axis=0)
                c[j] = m / max(float(np.linalg.norm(m)), 1e-12)
    return c


def _chunks(texts: pa.Array, size: int = 256) -> Iterator[list[str]]:
    for i in range(0, len(texts), size):
        yield texts.slice(i, size).to_pylist()


def fit_languages(tagged: DataFrame, centroids: int = CENTROIDS, seeds: int = SEEDS) -> LanguageModel:
    """Learn from ``tagged`` (text, lang): every row with a letter and a language.

    Document frequencies are counted over all rows. Centroids begin as clusters of about ``seeds``
    rows per language, chosen by hash of the text, and are then moved to the mean of all rows nearest to each, by
    partition sums, which also give how far rows are from their centroid. Languages are few: what
    reaches the driver is a vector per centroid and one of frequencies.
    """
    rows = tagged.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, np.int64)
        n = 0
        for batch in batches:
            for text in batch.column(0):
                seen += slot_counts(text.as_py()) > 0
                n += 1
        slots = pa.array([*range(SLOTS), -1], pa.int32())
        yield pa.RecordBatch.from_arrays([slots, pa.array([*seen.tolist(), n], pa.int64())], names=["slot", "n"])

    found = rows.select("text").mapInArrow(frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(SLOTS)
    for r in found:
        if r["slot"] >= 0:
            df[r["slot"]] = r["n"]
    total = max((r["n"] for r in found if r["slot"] < 0), default=0)
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    bare = LanguageModel(idf, np.zeros((0, SLOTS), np.float32), [], np.zeros(0))

    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / (1 << 30)
    chosen = rows.join(counts, "lang").filter(place * F.col("n") < seeds).select("lang", "text")

    def begin(table: pa.Table) -> pa.Table:
        texts = [t for t in table["text"].to_pylist() if has_letter(t)]
        if not texts:
            return pa.table({"lang": pa.array([], pa.string()), "centroid": pa.array([], pa.list_(pa.float32()))})
        c = spherical_means(np.vstack([bare.vectors(texts[i : i + 256]) for i in range(0, len(texts), 256)]), centroids)
        return pa.table({"lang": [table["lang"][0].as_py()] * len(c), "centroid": pa.array(list(c), pa.list_(pa.float32()))})

    begun = chosen.groupBy("lang").applyInArrow(begin, "lang string, centroid array<float>").collect()
    if not begun:
        return bare
    begun.sort(key=lambda r: (r["lang"], tuple(r["centroid"][:8])))
    names = [r["lang"] for r in begun]
    start = np.array([r["centroid"] for r in begun], np.float32)
    of = {lang: np.array([i for i, n in enumerate(names) if n == lang]) for lang in set(names)}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(start), SLOTS + 3))
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for k, texts in enumerate(_chunks(batch.column(0))):
                v = bare.vectors(texts)
                cosines = v @ start.T
                for i, text in enumerate(texts):
                    own = of.get(langs[k * 256 + i])
                    if own is None or not has_letter(text):
                        continue
                    j = own[int(cosines[i, own].argmax())]
                    far = float(cosines[i, j])
                    sums[j, :SLOTS] += v[i]
                    sums[j, SLOTS:] += (1.0, far, far * far)
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(start)), pa.int32()), pa.array(list(sums), kind)], names=["i", "sums"])

    def meet(table: pa.Table) -> pa.Table:
        total = np.sum(np.stack(table["sums"].to_numpy()), axis=0)
        return pa.table({"i": table["i"][:1], "sums": pa.array([total], pa.list_(pa.float64()))})

    moved, least = start.copy(), np.zeros(len(start))
    for r in rows.mapInArrow(gather, "i int, sums array<double>").groupBy("i").applyInArrow(meet, "i int, sums array<double>").collect():
        s = np.array(r["sums"])
        n, near, squares = s[SLOTS:]
        if n:
            moved[r["i"]] = s[:SLOTS] / max(float(np.linalg.norm(s[:SLOTS])), 1e-12)
            least[r["i"]] = near / n - FAR * np.sqrt(max(squares / n - (near / n) ** 2, 0)) - 0.02
    return LanguageModel(idf, moved, names, least)


def detect_languages(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each whole text of ``documents`` (doc_id, text).

    ``lang_pred`` is the language of the centroid of greatest cosine, ``score`` that cosine from 0 to 1;
    ties take the language first in order. ``rejected`` marks a text further from its centroid than
    what was learned from: its language may be none of the learned. NULL text, text without
    a letter and a model without a centroid give ``und``, 0 and rejected. One row per row; a NULL id is
    carried through; other columns are not read.
    """

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, far = [], [], []
            for texts in _chunks(batch.column(1)):
                cosines = model.vectors(texts) @ model.centroids.T if model.languages else None
                for i, text in enumerate(texts):
                    if cosines is None or not has_letter(text):
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        far.append(True)
                        continue
                    j = int(cosines[i].argmax())
                    langs.append(model.languages[j])
                    scores.append(min(max(float(cosines[i, j]), 0.0), 1.0))
                    far.append(bool(cosines[i, j] < model.least[j]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(nearest, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
