"""Byte-level byte-pair encoding of documents, and its inverse."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct words a task remembers the ids of; beyond it, it starts anew.
REMEMBERED = 1 << 18
# White space by Unicode. A run is what stands between, with the one space before it, or white space as the patterns of byte-level vocabularies split it.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN = re.compile(rf" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+").findall


def read_ranks(spark: SparkSession, path: str) -> Broadcast:
    """The rank map of a vocabulary file, lines of base64 and rank, for every task.

    Its size is the vocabulary's, whatever the documents are.
    """
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
    return spark.sparkContext.broadcast(ranks)


def fold_merges(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one word: its bytes, with the adjacent pair of least rank merged while there is one."""
    whole = ranks.get(word)
    if whole is not None:
        return (whole,)
    far = len(ranks) + 1
    rank = ranks.get
    pieces = [word[i : i + 1] for i in range(len(word))]
    if len(pieces) > 256:
        return _fold_long(pieces, ranks)
    scores = [rank(a + b, far) for a, b in zip(pieces, pieces[1:])]
    while scores:
        best = min(scores)
        if best == far:
            break
        i = scores.index(best)
        pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        del scores[i]
        if i:
            scores[i - 1] = rank(pieces[i - 1] + pieces[i], far)
        if i < len(scores):
            scores[i] = rank(pieces[i] + pieces[i + 1], far)
    return tuple(ranks[p] for p in pieces)


def _fold_long(pieces: list[bytes], ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same for a word of any length, with a heap in place of the search for the least rank."""
    import heapq

    n = len(pieces)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, pieces[i], pieces[i + 1]) for i in range(n - 1) if (r := ranks.get(pieces[i] + pieces[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if pieces[i] is not left or j >= n or pieces[j] is not right:
            continue
        pieces[i], pieces[j] = left + right, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else n
            if b < n and (r := ranks.get(pieces[a] + pieces[b])) is not None:
                heapq.heappush(heap, (r, a, pieces[a], pieces[b]))
    return tuple(ranks[p] for p in pieces if p is not None)


class _Words(dict):
    """Ids of the distinct words met so far, and of the distinct runs between blanks made of them.

    A match of the pattern holds white space only as one leading space or as nothing else, so a run of
    other characters with the space before it can be split into words by itself, and once.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks, self.words, self.split = ranks, {}, regex.compile(pattern).findall

    def __missing__(self, run: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        ids: tuple[int, ...] = ()
        for word in self.split(run):
            found = self.words.get(word)
            if found is None:
                self.words[word] = found = fold_merges(word.encode(), self.ranks)
            ids += found
        self[run] = ids
        return ids


def encode_documents(documents: DataFrame, ranks: Broadcast, pattern: str) -> DataFrame:
    """(doc_id, ids): the token ids of each document's whole text, one row per row.

    ``documents`` (doc_id, text). Each match of ``pattern`` is a word; the ranked merges are folded
    over the bytes of a distinct word once, and its ids are remembered by the task within a bound.
    There are no special tokens. NULL and empty text have no ids; a NULL id is carried through;
    repeated rows are encoded alike; other columns are not read. ``pattern`` must hold white space only as
    one leading space of a word or by itself, as that of the vocabulary's description does.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(ranks.value, pattern)
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for text in batch.column(1):
                flat.extend(chain.from_iterable(map(words.__getitem__, RUN(text.as_py()))))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(
                pa.array(memoryview(ends), pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)])
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(encode, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, ranks: Broadcast) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``decoded``: the bytes of the pieces, one after another.

    NULL ids decode to no bytes; an id the vocabulary lacks stops the job.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = {i: p for p, i in ranks.value.items()}.__getitem__
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            texts = [b"".join(map(piece, flat[a:b].tolist())) for a, b in zip(ends, ends[1:])]
            decoded = pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, decoded], names=["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(decode, f"doc_id {kind}, ids array<int>, decoded binary")
