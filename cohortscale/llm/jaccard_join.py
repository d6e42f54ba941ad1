"""Documents linked by the overlap of their word shingles, exactly and without all pairs."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortscale.llm.components import components
from cohortscale.llm.rows import lower_ascii, split_blanks
from cohortscale.session import cut_lineage, scratch_path

#: Words of a shingle, and the least overlap in hundredths of the union.
WORDS = 5
PERCENT = 80
#: Keys beyond what the overlap needs, one for so many shingles: linked sets share as many keys more.
SPARE = 10
#: Occurrences from which a shingle is common, those one task must see, and how many are common at most.
COMMON = 1 << 12
COMMON_SEEN = 4
COMMON_MOST = 1 << 20
#: Pairs up to which the ids to verify are sent to every task, two short rows a pair.
BROADCAST_ROWS = 1 << 18
#: Bits of a bitmap for each shingle, at least, and of the small one that tiles carry.
BITS = 8
TILE_BITS = 2
#: Documents of a tile, pairs compared at a time and bytes of their bitmaps, partners of one document that a task verifies.
TILE = 1024
PAIRS = 1 << 17
PAIR_BYTES = 1 << 24
PARTNERS = 256
#: Keys that a document of a tile carries, to tell that a pair was met under a lesser key.
LEAST_KEYS = 8
_LAST_KEY = np.iinfo(np.int64).max
#: Centres that a key's documents are compared with before they are compared among themselves.
CENTRES = 8
#: Words a task remembers the hash of.
REMEMBERED = 1 << 18
_ODD = np.random.default_rng(7).integers(1, 1 << 62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_NONE = np.zeros(0, np.uint64)


def _hashed(unit: str) -> int:
    return int.from_bytes(hashlib.blake2b(unit.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def shingles(text: str | None, memo: dict[str, int], words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, sorted; a shorter text is one shingle."""
    tokens = split_blanks(lower_ascii(text)) if text else []
    if not tokens:
        return _NONE
    if len(tokens) < words:
        return np.array([_hashed(" ".join(tokens))], np.uint64)
    if len(memo) > REMEMBERED:
        memo.clear()
    known = []
    for t in tokens:
        h = memo.get(t)
        if h is None:
            memo[t] = h = _hashed(t)
        known.append(h)
    h = np.array(known, np.uint64)
    n = len(h) - words + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(words):
        mixed += h[k : k + n] * _ODD[k % WORDS]
        mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def least_overlap(n: int, percent: int) -> int:
    """How many shingles of a set of ``n`` a linked set has too, at least; as many has the linked set."""
    return (percent * n + 99) // 100


def prefix_length(n: int, percent: int) -> int:
    """How many shingles, least first in any one order, stand for a set of ``n``.

    Of as many, linked sets share one more than the smaller one's size holds SPARE.
    """
    return min(n, n - least_overlap(n, percent) + 1 + n // SPARE)


def bitmap(grams: np.ndarray, each: int = BITS) -> bytes:
    """One bit per hash modulo a power of two, at least ``each`` times the size of the set."""
    bits = max(64, 1 << int(each * len(grams) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(grams >> np.uint64(20)) & np.uint64(bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def plausible(n_a: np.ndarray, n_b: np.ndarray, maps_a: pa.Array, maps_b: pa.Array, percent: int) -> np.ndarray:
    """Whether sizes and bit counts allow the overlap: a bit of one alone is a shingle the other lacks.

    Pairs whose bitmaps have the same two lengths go together; the longer is folded to the shorter.
    """
    keep = np.zeros(len(n_a), bool)
    if not len(n_a):
        return keep
    bits_a, bits_b = (pc.binary_length(m).to_numpy() // 8 for m in (maps_a, maps_b))
    n_a, n_b = np.asarray(n_a, np.int64), np.asarray(n_b, np.int64)
    for la, lb in set(zip(bits_a.tolist(), bits_b.tolist())):
        at = np.flatnonzero((bits_a == la) & (bits_b == lb))
        for part in np.array_split(at, len(at) * max(la, lb) // (1 << 20) + 1):
            a, b = (
                np.frombuffer(b"".join(m.take(pa.array(part)).to_pylist()), np.uint64).reshape(len(part), -1, min(la, lb))
                for m in (maps_a, maps_b)
            )
            a, b = np.bitwise_or.reduce(a, axis=1), np.bitwise_or.reduce(b, axis=1)
            lost = np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64)
            gained = np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64)
            most = np.minimum(n_a[part] - lost, n_b[part] - gained)
            keep[part] = 100 * most >= percent * (n_a[part] + n_b[part] - most)
    return keep


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return len(a) > 0 and len(b) > 0 and 100 * common >= percent * (len(both) - common)


def _sets(documents: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, digest, signature, outline, keys, often): ``often`` has keys many sets of a batch share.

    Stored in the shared folder, so texts are cut into shingles once and each later step reads its columns only.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            sizes, digests, maps, small, first = [], [], [], [], []
            for text in batch.column(1):
                grams = shingles(text.as_py(), memo, words)
                sizes.append(len(grams))
                digests.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                maps.append(bitmap(grams) if len(grams) else b"")
                small.append(bitmap(grams, TILE_BITS) if len(grams) else b"")
                first.append(grams[: prefix_length(len(grams), percent)].view(np.int64))
            every = np.concatenate([_NONE.view(np.int64), *first])
            keys, times = np.unique(every, return_counts=True)
            seen = times >= COMMON_SEEN
            often = [{"key": int(k), "n": int(n)} for k, n in zip(keys[seen], times[seen])]
            lists = [often] + [None] * (len(sizes) - 1) if sizes else []
            kind = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))
            ends = np.concatenate([[0], np.cumsum([len(f) for f in first], dtype=np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(maps, pa.binary()),
                    pa.array(small, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(every)), pa.array(lists, kind),
                ],
                names=["doc_id", "n_shingles", "digest", "signature", "outline", "keys", "often"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    found = documents.select("doc_id", "text").mapInArrow(
        measure,
        f"doc_id {kind}, n_shingles long, digest binary, signature binary, outline binary, keys array<long>, often array<struct<key: long, n: long>>",
    )
    path = scratch_path(documents.sparkSession, "shingle-sets")
    found.write.parquet(path)
    return documents.sparkSession.read.parquet(path)


def _shared_keys(rows: DataFrame, common: list[int]) -> DataFrame:
    """Rows (key, doc_id, n) whose key another row has too; common keys need not be looked at together."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, was = None, False  # the last row, not yet known to share its key with the next; whether with the one before
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch])
            key = table["key"].to_numpy()
            same = key[1:] == key[:-1]
            shared = np.zeros(len(key), bool)
            shared[0] = was
            shared[1:] |= same
            shared[:-1] |= same
            held, was = batch.slice(batch.num_rows - 1), bool(shared[-1])
            yield from table.slice(0, len(key) - 1).filter(pa.array(shared[:-1])).combine_chunks().to_batches()
        if was:
            yield held

    kind = rows.schema["doc_id"].dataType.simpleString()
    spark = rows.sparkSession
    hot = F.broadcast(spark.createDataFrame(pa.table({"key": pa.array(common, pa.int64())})))
    cold = rows.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    return cold.mapInArrow(runs, f"key long, doc_id {kind}, n long").unionAll(rows.join(hot, "key", "left_semi"))


def _rare_keys(shared: DataFrame, percent: int) -> DataFrame:
    """(key, band, doc_id, n): of each set that can be linked at all its rarest shared keys, as many as may matter.

    A set that shares fewer keys than every linked set of its size does is out. Of the others'
    keys, the most frequent are left out, one less than links need: two linked sets still share one.
    """
    times = shared.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    least = F.floor((F.col("n") * percent + 99) / 100)
    need = F.floor(least / SPARE) + 1
    mine = Window.partitionBy("doc_id", "n")
    ranked = shared.join(times, "key").withColumn("s", F.count("*").over(mine))
    ranked = ranked.filter(F.col("s") >= need).withColumn("place", F.row_number().over(mine.orderBy("m", "key")))
    band = F.floor(F.log("n") / math.log(100 / min(percent, 99)) + 1e-9).cast("int")
    return ranked.filter(F.col("place") <= F.col("s") - need + 1).select("key", band.alias("band"), "doc_id", "n")


def _stars(rare: DataFrame) -> DataFrame:
    """Pairs (a, b): each document with that first document of its keys and band it shares the most keys with."""
    first = rare.groupBy("key", "band").agg(F.min("doc_id").alias("a"))
    met = rare.join(first, ["key", "band"]).filter("a < doc_id").groupBy("a", "doc_id").agg(F.count("*").alias("m"))
    return met.groupBy(F.col("doc_id").alias("b")).agg(F.max_by("a", F.struct("m", "a")).alias("a")).select("a", "b")


def _plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and bitmaps allow a link."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, s_a, n_b, s_b = (batch.column(i) for i in range(2, 6))
            keep = plausible(n_a.to_numpy(), n_b.to_numpy(), s_a, s_b, percent)
            yield from pa.Table.from_batches([batch]).select(["a", "b"]).filter(pa.array(keep)).to_batches()

    left = sets.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("signature").alias("s_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("signature").alias("s_b"))
    sized = pairs.join(left, "a").join(right, "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    kind = sets.schema["doc_id"].dataType.simpleString()
    return sized.select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(bound, f"a {kind}, b {kind}")


def _verified(documents: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) that are linked, by intersection of their sorted shingles.

    The texts of an ``a`` and of its partners come together in parts of about PARTNERS, so an ``a`` with
    very many partners is not one task's.
    """
    stars = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    parts = cut_lineage(pairs.join(stars, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")))
    wanted = parts.select("a", "part", F.lit(1).alias("role"), F.col("b").alias("_doc")).unionAll(
        parts.select("a", "part").distinct().select("a", "part", F.lit(0).alias("role"), F.col("a").alias("_doc"))
    )
    if parts.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = documents.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("_doc")).drop("_doc")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        now, heads = None, []
        for batch in batches:
            a, b = [], []
            for key, part, role, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                if (key, part) != now:
                    now, heads = (key, part), []
                grams = shingles(text.as_py(), memo, words)
                if role == 0:
                    heads.append(grams)
                elif any(linked(h, grams, percent) for h in heads):
                    a.append(key)
                    b.append(doc_id)
            kind = batch.column(0).type
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    met = texts.select("a", "part", "role", "doc_id", "text").repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return met.mapInArrow(verify, f"a {kind}, b {kind}")


def _mixed(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, band, doc_id, n, component_id, m): rows of the keys whose documents are of more than one group."""
    named = shared.join(groups, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    named = named.select("key", "band", "doc_id", "n", "component_id")
    keys = named.groupBy("key").agg(F.min("component_id").alias("low"), F.max("component_id").alias("high"), F.count("*").alias("m"))
    return named.join(keys.filter("low < high").select("key", "m"), "key")


def _central_pairs(mixed: DataFrame) -> DataFrame:
    """Pairs (a, b) of a document and a centre of its key and band that is of another group.

    A centre is drawn by hash, one of CENTRES for each band of a key's kind, so a large group that one document does
    not hold together is tried from several sides, at a cost in proportion to its size.
    """
    order = F.xxhash64("doc_id", F.pmod(F.col("key"), F.lit(CENTRES)))
    centres = mixed.groupBy("key", "band").agg(F.min(F.struct(order.alias("h"), "doc_id", "component_id")).alias("c"))
    pairs = mixed.join(centres, ["key", "band"]).filter(F.col("component_id") != F.col("c.component_id"))
    return pairs.select(F.least("doc_id", "c.doc_id").alias("a"), F.greatest("doc_id", "c.doc_id").alias("b")).distinct()


def _open_pairs(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share a key, are of different groups and may be linked.

    The documents of a key are dealt into tiles of about TILE by (key, tile, tile), and a tile
    compares small bitmaps, not texts; the pairs they leave are bounded by the wide ones. A pair that shares
    many keys is compared under the least of them: each document carries its few least keys, and where two
    have one in common below the tile's own, the tile of that one has them too.
    """
    spots = mixed.withColumn("tiles", F.ceil(F.col("m") / TILE))
    mine = F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int")
    spots = spots.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("tiles") - 1).cast("int"))))
    spots = spots.withColumn("t1", F.least("mine", "other")).withColumn("t2", F.greatest("mine", "other"))
    least = mixed.groupBy("doc_id", "n").agg(F.slice(F.array_sort(F.collect_set("key")), 1, LEAST_KEYS).alias("least"))
    spots = spots.join(least.join(sets.select("doc_id", "outline"), "doc_id"), ["doc_id", "n"])
    kind = sets.schema["doc_id"].dataType.simpleString()
    columns = ["key", "t1", "t2", "mine", "n", "component_id", "doc_id", "outline", "least"]

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, t1, t2, mine, n, group, ids = (rows[c].to_numpy() for c in columns[:-2])
        maps, kind_of = rows["outline"].combine_chunks(), rows["doc_id"].type
        weight = pc.binary_length(maps).to_numpy()
        keys = np.full((len(key), LEAST_KEYS), _LAST_KEY)
        keys[np.arange(LEAST_KEYS) < pc.list_value_length(rows["least"]).to_numpy()[:, None]] = pc.list_flatten(rows["least"]).to_numpy()

        def bounded(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return plausible(n[i], n[j], maps.take(pa.array(i)), maps.take(pa.array(j)), percent)

        def judged(found: list[np.ndarray]) -> pa.RecordBatch:
            i, j = np.concatenate(found, axis=1)
            before = np.zeros(len(i), bool)
            for x in range(LEAST_KEYS):
                mine_at = keys[i, x]
                lesser = mine_at < key[i]
                for y in range(LEAST_KEYS):
                    before |= lesser & (mine_at == keys[j, y])
            i, j = i[~before], j[~before]
            low, high = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            order = np.lexsort((high, low))
            once = np.ones(len(order), bool)
            once[1:] = (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
            at = order[once]
            ends = np.cumsum(weight[i[at]] + weight[j[at]])
            parts = np.split(at, np.searchsorted(ends, np.arange(PAIR_BYTES, int(ends[-1]), PAIR_BYTES))) if len(at) else []
            keep = np.concatenate([at[:0], *(x[bounded(i[x], j[x])] for x in parts)])
            return pa.RecordBatch.from_arrays([pa.array(x[keep], kind_of) for x in (low, high)], names=["a", "b"])

        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])
        last = np.append(np.flatnonzero(new)[1:], len(key)) - 1
        left = last[np.cumsum(new) - 1] - np.arange(len(key))
        found, held, away, at = [], 0, 0, np.arange(len(key))
        while True:  # rows of a tile that stand ``away`` apart; they follow each other by size
            away += 1
            at = at[left[at] >= away]
            if not len(at):
                break
            to = at + away
            ok = (group[at] != group[to]) & (ids[at] != ids[to]) & (100 * n[at] >= percent * n[to]) & ((t1[at] == t2[at]) | (mine[at] != mine[to]))
            found.append(np.stack([at[ok], to[ok]]))
            held += int(ok.sum())
            if held >= PAIRS:
                yield judged(found)
                found, held = [], 0
        if held:
            yield judged(found)

    def tiles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last tile, which may go on
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            same = np.ones(len(rows), bool)
            for c in columns[:3]:
                values = rows[c].to_numpy()
                same &= values == values[-1]
            whole = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = rows.slice(whole)
            if whole:
                yield from compare(rows.slice(0, whole))
        if held is not None and len(held):
            yield from compare(held)

    spread = spots.select(*columns).repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2", "n")
    return _plausible(cut_lineage(spread.mapInArrow(tiles_of, f"a {kind}, b {kind}").distinct()), sets, percent)


def similar_documents(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Components of documents whose shingle sets overlap by ``percent`` hundredths of their union.

    ``documents`` (doc_id, text), numeric ids. A set is the distinct runs of ``words`` words, A-Z
    lower-cased, blanks between; a text of fewer words is one shingle; one without words is empty and linked
    with nothing. Returns (doc_id, n_shingles, component_id), one row per row: the least id
    reachable by links, its own included.

    Equal sets are one from the start. A set stands for itself by the first third, about, of its shingles in the
    order of their hashes, its keys; linked sets share a tenth of their sizes among them, so a set of which
    fewer keys are anywhere else is linked with nothing. Of the others' keys the rarest count, so a
    passage many documents share brings few of them together. A document is compared with the first of its keys
    that it shares the most with, then, as far as these links have not yet joined them, with
    centres drawn by hash, and what is left is compared pair by pair within tiles of a key; sizes and bitmaps
    bound the overlap from above. What may be linked is intersected exactly. No partner is dropped.

    A NULL text is empty; a row without an id takes no part and has no component; rows that repeat
    an id are one document with the texts of all. Other columns are not read.
    """
    found = _sets(documents, words, percent)
    often = found.select(F.explode("often").alias("o")).groupBy("o.key").agg(F.sum("o.n").alias("n")).filter(F.col("n") >= COMMON)
    # At most COMMON_MOST numbers, whatever the corpus; any set of common keys gives the same links.
    common = [r[0] for r in often.orderBy(F.desc("n"), "key").limit(COMMON_MOST).collect()]
    sets = found.filter("doc_id IS NOT NULL AND n_shingles > 0")
    alike = sets.groupBy("digest").agg(F.min("doc_id").alias("first"))
    named = cut_lineage(sets.select("doc_id", "digest").join(alike, "digest").select("doc_id", "first").distinct())
    same = named.filter("first < doc_id").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    one_each = sets.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    rows = one_each.select(F.explode("keys").alias("key"), "doc_id", "n")
    rare = cut_lineage(_rare_keys(cut_lineage(_shared_keys(rows, common)), percent))
    sets = sets.select("doc_id", "n_shingles", "signature", "outline").join(rare.select("doc_id").distinct(), "doc_id", "left_semi")
    tried = cut_lineage(_plausible(_stars(rare), sets, percent))
    links = cut_lineage(_verified(documents, tried, words, percent))
    groups = cut_lineage(components(links, "a", "b"))
    for last in (False, True):
        mixed = cut_lineage(_mixed(rare, groups))
        pairs = _open_pairs(mixed, sets, percent) if last else _plausible(_central_pairs(mixed), sets, percent)
        pairs = cut_lineage(pairs.join(tried, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            tried = tried.unionAll(pairs)
            links = cut_lineage(links.unionAll(_verified(documents, pairs, words, percent)))
            groups = cut_lineage(components(links, "a", "b"))
    groups = components(links.unionAll(same), "a", "b")
    sizes = found.select("doc_id", "n_shingles")
    return sizes.join(groups, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def first_of_each(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``documents`` without those that are linked, over any way, to a document of lesser id."""
    found = similar_documents(documents, words, percent).filter("component_id < doc_id").select("doc_id").distinct()
    return documents.join(found, "doc_id", "left_anti").select(*documents.columns)
