"""Passages that stand in several places: all but the earliest are cut, to the word."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cohortscale.llm.rows import lower_ascii
from cohortscale.session import scratch_path, width

#: Words that a passage must have to be cut where it stands again.
MIN_WORDS = 40
#: Words of an anchor: a text is cut into units around the anchors of least hash.
ANCHOR_WORDS = 16
#: Words hashed at a time, and distinct words whose digests a task remembers.
LOT, REMEMBERED = 1 << 17, 1 << 19
_WORD = re.compile(r"\S+")
# Two lanes, mixed apart.
_LEFT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_RIGHT = np.array([0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_LAST = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


class _Digests(dict):
    """128-bit digest of each word asked for."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        return found


def _hashes(words: list[str], digests: _Digests) -> np.ndarray:
    return np.frombuffer(b"".join([digests[w] for w in words]), np.uint64).reshape(-1, 2)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a * _LEFT) ^ (b + _RIGHT)
    out ^= out >> np.uint64(29)
    out *= _LAST
    out ^= out >> np.uint64(32)
    return out


def joined_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash, in two lanes, of every ``n`` words that follow each other."""
    power, out, done, step = hashes, None, 0, 1
    while done < n:
        if n & step:
            out = power if out is None else _mixed(out[: len(power) - done], power[done:])
            done += step
        if done < n:
            power = _mixed(power[:-step], power[step:])
            step *= 2
    return out


def _slid(x: np.ndarray, n: int, op: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``op`` over every ``n`` entries that follow each other."""
    step = 1
    while 2 * step <= n:
        x = op(x[:-step], x[step:])
        step *= 2
    return op(x[: len(x) - (n - step)], x[n - step :]) if n > step else x


def units(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of every ``min_words`` words of a text that follow each other.

    A-Z count as lower case and white space as single; ``end`` is where the next word starts.
    """
    starts = [m.start() for m in _WORD.finditer(text)]
    if len(starts) >= min_words:
        found = joined_hashes(_hashes(lower_ascii(text).split(), _Digests()), min_words)
        starts.append(len(text))
        for i, form in enumerate(found):
            yield starts[i], starts[i + min_words], form.tobytes()


def _lots(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of ``min_words`` words or more, a lot at a time: their rows' other values, which text
    each word is of, where the text starts, and the words' hashes."""
    digests, held, sizes, hashes, n = _Digests(), [], [], [], 0

    def lot():
        each = np.array(sizes)
        return held, np.repeat(np.arange(len(each)), each), np.cumsum(each) - each, np.concatenate(hashes)

    for batch in batches:
        for row in zip(*(batch.column(i) for i in range(batch.num_columns))):
            words = lower_ascii(row[1].as_py()).split()
            if len(words) < min_words:
                continue
            held.append((row[0].as_py(), *row[2:]))
            sizes.append(len(words))
            hashes.append(_hashes(words, digests))
            n += len(words)
            if n >= LOT:
                yield lot()
                held, sizes, hashes, n = [], [], [], 0
    if held:
        yield lot()


def _least_at(x: np.ndarray, n: int) -> np.ndarray:
    """Where the least of every ``n`` entries that follow each other stands, the first of equal ones."""

    def lesser(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(x[a] <= x[b], a, b)

    return _slid(np.arange(len(x)), n, lesser)


def document_units(documents: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, at, windows, anchor, digest): the units of each text.

    A unit is the windows of ``min_words`` words, in a row, whose anchor of least hash is the same; ``at`` is the
    first of them, counted in words from 0. So units are cut by what stands there, wherever a passage begins, and
    equal windows have equal anchors. ``digest`` is of the whole unit; with ``anchor`` it tells units apart.
    """
    id_type = documents.schema["doc_id"].dataType
    arrow_type = to_arrow_type(id_type)
    size = min(ANCHOR_WORDS, min_words)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, owner, starts, hashes in _lots(batches, min_words):
            anchors = joined_hashes(hashes, size)[:, 0]
            least = _least_at(anchors, min_words - size + 1)
            forms = joined_hashes(hashes, min_words)
            at = np.flatnonzero(owner[: len(least)] == owner[min_words - 1 :])
            new = np.ones(len(at), bool)
            new[1:] = (least[at[1:]] != least[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
            first = np.flatnonzero(new)
            windows = np.diff(np.append(first, len(at)))
            start = at[first]
            # The first window and the last have every word of the unit, as it has at most min_words windows.
            digest = _mixed(forms[start], forms[start + windows - 1] + windows.astype(np.uint64)[:, None])[:, 1]
            ids = pa.array([h[0] for h in held], arrow_type).take(pa.array(owner[start]))
            place = (start - starts[owner[start]]).astype(np.int32)
            columns = [ids, pa.array(place), pa.array(windows.astype(np.int32))]
            columns += [pa.array(anchors[least[start]].view(np.int64)), pa.array(digest.copy().view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "at", "windows", "anchor", "digest"])

    rows = documents.select("doc_id", "text").filter("text IS NOT NULL AND doc_id IS NOT NULL")
    return rows.mapInArrow(cut, f"doc_id {id_type.simpleString()}, at int, windows int, anchor long, digest long")


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _unit_windows(asked: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, at, a, b): place and digest of every window of the units asked for in ``_dup_asked``."""
    id_type = asked.schema["doc_id"].dataType
    arrow_type = to_arrow_type(id_type)
    columns = [asked.columns.index(name) for name in ("doc_id", "text", "_dup_asked")]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            few = pa.RecordBatch.from_arrays([batch.column(i) for i in columns], names=["doc_id", "text", "asked"])
            yield few.filter(pa.compute.and_(few.column(1).is_valid(), few.column(2).is_valid()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, owner, starts, hashes in _lots(texts(batches), min_words):
            forms = joined_hashes(hashes, min_words).view(np.int64)
            whole = owner[: len(forms)] == owner[min_words - 1 :]
            units = [(k, u["at"], u["windows"]) for k, h in enumerate(held) for u in h[1].as_py()]
            of, first, windows = np.array(units, np.int64).T
            start = np.repeat(starts[of] + first, windows)
            at = start + np.arange(len(start)) - np.repeat(np.cumsum(windows) - windows, windows)
            of = np.repeat(of, windows)
            # A row of the same id may have fewer words.
            inside = at < len(forms)
            inside[inside] = whole[at[inside]] & (owner[at[inside]] == of[inside])
            at, of = at[inside], of[inside]
            ids = pa.array([h[0] for h in held], arrow_type).take(pa.array(of))
            found = [ids, pa.array((at - starts[of]).astype(np.int32)), pa.array(forms[at, 0]), pa.array(forms[at, 1])]
            yield pa.RecordBatch.from_arrays(found, names=["doc_id", "at", "a", "b"])

    return asked.mapInArrow(cut, f"doc_id {id_type.simpleString()}, at int, a long, b long")


def repeated_windows(documents: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, again): (at, windows) of the runs of windows that an earlier place has already, by (doc_id, at).

    Units whose anchor stands in one place are new. Of the others, equal ones are grouped: all but the earliest
    are repeated as a whole. Only the earliest of each kind, and only where their anchor has several kinds, are
    looked at window by window. Groups are made with partial sums, and what is joined is stored first, so a hot
    anchor, unit or window is one row per task in a group and split by the adaptive skew join.
    """
    units = _stored(document_units(documents, min_words), "dedup-units")
    often = _stored(units.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "dedup-anchors")
    shared = _stored(units.join(often, "anchor"), "dedup-shared")
    kinds = shared.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at", "windows")).alias("first"))
    kinds = _stored(kinds.select("anchor", "digest", "n", "first.*"), "dedup-kinds")

    firsts = kinds.filter("n > 1").select("anchor", "digest", F.col("doc_id").alias("first_id"), F.col("at").alias("first_at"))
    whole = shared.join(firsts, ["anchor", "digest"]).filter("doc_id <> first_id OR at <> first_at").select("doc_id", "at", "windows")

    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("anchor")
    asked = kinds.join(_stored(several, "dedup-several"), "anchor").groupBy(F.col("doc_id").alias("_dup_id"))
    asked = asked.agg(F.collect_list(F.struct("at", "windows")).alias("_dup_asked"))
    # Joined as remove_repeated_units joins, with every column, so that texts are shuffled once for both.
    asked = documents.join(asked, documents["doc_id"] == asked["_dup_id"], "left").drop("_dup_id")
    each = _unit_windows(asked, min_words)
    first = each.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at")).alias("first")).filter("n > 1")
    # Dealt anew, few as they are, because the skew join splits a join of two plain shuffles only.
    first = first.repartition(width(documents.sparkSession))
    single = each.join(first, ["a", "b"]).filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("at") != F.col("first.at")))
    again = whole.unionAll(single.select("doc_id", "at", F.lit(1).alias("windows")))
    return again.groupBy("doc_id").agg(F.collect_set(F.struct("at", "windows")).alias("again"))


def repeated_runs(text: str, again: set[int], min_words: int) -> list[tuple[int, int]]:
    """(start, end) of the runs of words that repeated windows cover.

    Where a window overlaps its own first place in the text, the words of that place stay.
    """
    if not again:
        return []
    starts = [m.start() for m in _WORD.finditer(text)]
    edges, first = np.zeros(len(starts) + 1, np.int64), {}
    for i, (_, _, form) in enumerate(units(text, min_words)):
        j = first.setdefault(form, i)
        if i in again:
            edges[i if j in again else max(i, j + min_words)] += 1
            edges[i + min_words] -= 1
    covered = np.diff(np.concatenate([[0], np.cumsum(edges[:-1]) > 0, [0]]).astype(np.int8))
    starts = [0, *starts[1:], len(text)]
    return [(starts[a], starts[b]) for a, b in zip(np.flatnonzero(covered > 0), np.flatnonzero(covered < 0))]


def remove_repeated_units(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``documents`` with every repeated passage cut but for its earliest place, and where it stood.

    ``documents`` (doc_id, text, ...). Words stand between white space, A-Z are lower-cased. Every window of
    ``min_words`` words is told from others by a 128-bit digest over all documents; its place ranked earliest by
    (doc_id, position) stays, the others are repeated, and every word of a repeated window goes, wherever the
    passage begins or ends. Windows are grouped as units, by one digest each, and looked at one by one only where
    units differ around the same anchor. Adds ``removed``, array of (start, end): code points of the original text.

    NULL text stays NULL; a text that is cut as a whole becomes empty; a row without an id keeps its
    text and takes no part. Equal rows of one id share their places: the earliest stays in each.
    Other columns are carried; names that begin with ``_dup_`` and the name ``removed`` must be free.
    """
    again = repeated_windows(documents, min_words).select(F.col("doc_id").alias("_dup_id"), F.col("again").alias("_dup_again"))
    rows = documents.join(again, documents["doc_id"] == again["_dup_id"], "left").drop("_dup_id")
    names = documents.columns
    text_at, again_at = names.index("text"), len(names)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, places in zip(batch.column(text_at), batch.column(again_at)):
                text, places = text.as_py(), places.as_py()
                again = {i for p in places or () for i in range(p["at"], p["at"] + p["windows"])}
                runs = repeated_runs(text, again, min_words) if text else []
                if runs:
                    kept = zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(text)])
                    text = "".join(text[a:b] for a, b in kept)
                texts.append(text)
                removed.append([{"start": a, "end": b} for a, b in runs])
            columns = [batch.column(i) for i in range(len(names))]
            columns[text_at] = pa.array(texts, batch.column(text_at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, spans)], names=[*names, "removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return rows.mapInArrow(cut, f"{schema}, removed array<struct<start: int, end: int>>")
