"""Documents ranked for every statement: the statements' terms are the index, the documents go through it."""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cohortscale.llm.rows import LOWER, UPPER
from cohortscale.session import scratch_path

#: Statements whose texts hold at most so many bytes are searched at a time; more are dealt into blocks.
INDEX_BYTES = 8 << 20
#: Scores held at a time in a task, documents by statements.
CELLS = 1 << 21
#: Words looked up at a time in a task.
LOT = 1 << 18
# Bytes of a term are digits, letters of A-Z and whatever is not ASCII.
_TERM_BYTES = b"0123456789" + UPPER.encode() + LOWER.encode() + bytes(range(0x80, 0x100))
_TERMS = bytes.maketrans(UPPER.encode(), LOWER.encode())
_BETWEEN = bytes(b for b in range(0x80) if b not in _TERM_BYTES)
_CUT = bytes.maketrans(_BETWEEN, b" " * len(_BETWEEN))
_TABLE = bytes(_TERMS[_CUT[b]] for b in range(0x100))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order: runs of digits, letters and bytes beyond ASCII, A-Z lower-cased."""
    return text.translate(_TABLE).split()


@dataclass(frozen=True)
class StatementIndex:
    """Inverted index of a block of statements: term to the statements that hold it."""

    ids: list
    vocabulary: dict[bytes, int]
    starts: np.ndarray  # of a term's statements in ``holders``
    holders: np.ndarray


def index_statements(statements: list[tuple[object, bytes | None]]) -> StatementIndex:
    """Rows of one ``statement_id`` are one statement; a term counts once in it."""
    ids: dict = {}
    vocabulary: dict[bytes, int] = {}
    pairs = set()
    for statement_id, statement in statements:
        at = ids.setdefault(statement_id, len(ids))
        pairs.update((vocabulary.setdefault(t, len(vocabulary)), at) for t in terms_of(statement or b""))
    held = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    starts = np.searchsorted(held[:, 0], np.arange(len(vocabulary) + 1))
    return StatementIndex(list(ids), vocabulary, starts, held[:, 1].copy())


def term_counts(documents: DataFrame, index: StatementIndex) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term: all its terms with repeats, and
    which terms of the index it holds how often."""
    id_type = documents.schema["doc_id"].dataType
    names = ["doc_id", "n", "terms", "counts"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, len(index.vocabulary))

        def lot(rows: list[int], sizes: list[int], words: list[bytes], ids: pa.Array) -> pa.RecordBatch:
            found = np.fromiter(map(index.vocabulary.get, words, repeat(-1)), np.int64, len(words))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            keys, counts = np.unique((owner * size + found)[found >= 0], return_counts=True)
            offsets = pa.array(np.searchsorted(keys // size, np.arange(len(sizes) + 1)).astype(np.int32))
            columns = [
                ids.take(pa.array(rows)), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array((keys % size).astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32))),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            rows, sizes, words = [], [], []
            for row, text in enumerate(batch.column(1)):
                own = terms_of(text.as_py())
                if own:
                    rows.append(row)
                    sizes.append(len(own))
                    words += own
                if len(words) >= LOT:
                    yield lot(rows, sizes, words, batch.column(0))
                    rows, sizes, words = [], [], []
            if rows:
                yield lot(rows, sizes, words, batch.column(0))

    texts = documents.select("doc_id", F.col("text").cast("binary").alias("text")).filter("text IS NOT NULL")
    return texts.mapInArrow(count, f"doc_id {id_type.simpleString()}, n long, terms array<int>, counts array<int>")


def term_weights(counted: DataFrame, index: StatementIndex) -> tuple[np.ndarray, int, int]:
    """Weight of every term of the index, documents with a term, and their terms with repeats."""
    total = counted.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    held = np.zeros(len(index.vocabulary), np.int64)
    each = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    for row in each.collect():  # at most one row for each term of the index
        held[row["term"]] = row["df"]
    weights = [math.floor(1000 * math.log((2 * total["documents"] + 2) / (2 * df + 1))) for df in held.tolist()]
    return np.array(weights, np.int64), total["documents"], total["terms"]


def _best_of_tasks(counted: DataFrame, index: StatementIndex, statement_type: str, top: int) -> DataFrame:
    """(statement_id, doc_id, score): each task's best documents of each statement."""
    weights, n_documents, n_terms = term_weights(counted, index)
    id_type = counted.schema["doc_id"].dataType
    id_arrow = to_arrow_type(id_type)
    n_statements = len(index.ids)
    schema = f"statement int, doc_id {id_type.simpleString()}, score long"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple]] = [[] for _ in range(n_statements)]
        least = np.ones(n_statements, np.int64)  # a score below it changes nothing
        widths = np.diff(index.starts)
        step = max(1, CELLS // max(1, n_statements))
        for batch in batches:
            ids = batch.column(0)
            lengths = batch.column(1).to_numpy()
            offsets = batch.column(2).offsets.to_numpy()
            for a in range(0, batch.num_rows, step):
                b = min(a + step, batch.num_rows)
                terms = batch.column(2).values.to_numpy()[offsets[a] : offsets[b]]
                tf = batch.column(3).values.to_numpy()[offsets[a] : offsets[b]].astype(np.int64)
                owner = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
                m = 10 + (90 * lengths[a:b] * n_documents) // n_terms
                gain = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
                width = widths[terms]
                at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                at += np.repeat(index.starts[terms], width)
                scores = np.zeros((b - a) * n_statements, np.int64)
                np.add.at(scores, np.repeat(owner, width) * n_statements + index.holders[at], np.repeat(gain, width))
                scores = scores.reshape(b - a, n_statements)
                for row, statement in np.argwhere(scores >= least).tolist():
                    score, heap = int(scores[row, statement]), heaps[statement]
                    doc_id = ids[a + row].as_py()
                    entry = (-score, doc_id is None, doc_id)
                    if len(heap) < top or entry < heap[-1]:
                        insort(heap, entry)
                        del heap[top:]
                        if len(heap) == top:
                            least[statement] = max(1, -heap[-1][0])
        found = [(s, doc_id, -score) for s, heap in enumerate(heaps) for score, _, doc_id in heap]
        columns = [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], id_arrow)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([f[2] for f in found], pa.int64())], names=["statement", "doc_id", "score"])

    spark = counted.sparkSession
    names = spark.createDataFrame(list(enumerate(index.ids)), f"statement int, statement_id {statement_type}")
    # The block's ids: bounded with the index.
    return counted.mapInArrow(search, schema).join(F.broadcast(names), "statement").drop("statement")


def _blocks(statements: DataFrame, index_bytes: int) -> Iterator[list[tuple[object, bytes | None]]]:
    """The statements in blocks of about ``index_bytes`` of text, dealt by a hash of their id."""
    sized = F.coalesce(F.sum(F.octet_length("statement")), F.lit(0)) + 64 * F.count("*")
    n, most = 1, statements.agg(sized).first()[0]
    while most > index_bytes and n < 1 << 20:
        n *= 2
        most = statements.groupBy(_block(n)).agg(sized.alias("size")).agg(F.max("size")).first()[0]
    rows = statements.select("statement_id", F.col("statement").cast("binary"))
    for block in range(n):
        yield [tuple(r) for r in rows.filter(_block(n) == block).collect()]


def _block(n: int) -> Column:
    return F.pmod(F.xxhash64("statement_id"), F.lit(n))


def rank_documents(documents: DataFrame, statements: DataFrame, top: int = 10, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(statement_id, rank, doc_id, score): the ``top`` report documents that match each statement best.

    ``documents`` (doc_id, text, ...) are searched for the terms of ``statements`` (statement_id, statement, ...),
    turned about: the statements make an inverted index, which is sent to every task, and every document's
    term counts go through it once, into a list of the best ``top`` for each statement; the tasks' lists are
    merged. The index is bounded: statements of more than ``index_bytes`` are searched in blocks.

    A term is a run of digits, letters and characters beyond ASCII, A-Z lower-cased. With N documents that have a
    term, L their terms with repeats, df the documents that hold a term and n a document's terms, a term weighs
    floor(1000 ln((2N+2)/(2df+1))) and adds weight * ((10^9 tf) div (1000 tf + 8 m)), m = 10 + (90 n N) div L.

    Every row of ``documents`` is a document, repeated rows too; NULL or empty texts have no term. Rows of
    one statement_id are one statement; one without a term has no result. Only scores above 0 are returned, equal
    scores by doc_id, NULL ids last. Other columns are not read.
    """
    statement_type = statements.schema["statement_id"].dataType.simpleString()
    spark = documents.sparkSession
    best = []
    for block in _blocks(statements, index_bytes):
        index = index_statements(block)
        if best and not index.ids:
            continue
        path = scratch_path(spark, "term-counts")
        term_counts(documents, index).write.parquet(path)
        best.append(_best_of_tasks(spark.read.parquet(path), index, statement_type, top))
    ordered = Window.partitionBy("statement_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionAll, best).withColumn("rank", F.row_number().over(ordered))
    return ranked.filter(F.col("rank") <= top).select("statement_id", "rank", "doc_id", "score")
