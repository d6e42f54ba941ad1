"""Sealed statements found in documents: marking, and removal of documents or passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortscale.llm.rows import ascii_lower, row_key

# Words are ASCII letters and digits, and everything beyond ASCII; these stand between.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
# A word with what stands before it; then what ends the text.
PIECE = rf"{BETWEEN}*+[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++|[\x00-\x7F]++"
#: Words of a window.
WINDOW = 13
#: Bytes of window words up to which the set of windows is sent to every task.
BROADCAST_BYTES = 64 << 20


def with_words(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Add the words of a text as they stand, before lower-casing; none for NULL."""
    cut = rows.withColumn("_cut", F.split(F.coalesce(F.col(text), F.lit("")), f"{BETWEEN}+"))
    first = (F.element_at("_cut", 1) == "").cast("int")
    last = (F.element_at("_cut", -1) == "").cast("int")
    n = F.greatest(F.size("_cut") - first - last, F.lit(0))
    return cut.withColumn(name, F.slice("_cut", first + 1, n)).drop("_cut")


def normalised(words: Column) -> Column:
    return F.transform(words, ascii_lower)


def statement_windows(statements: DataFrame, window: int = WINDOW) -> DataFrame:
    """(length, window, items): distinct normalised word windows of the statements and whose they are.

    A statement of fewer words than ``window``, but not none, is one window.
    """
    size = F.size("w")
    length = F.least(size, F.lit(window))
    spots = with_words(statements, "statement", "w").filter(size > 0)
    each = spots.select(
        F.col("statement_id").cast("string").alias("item"),
        normalised(F.col("w")).alias("w"),
        length.alias("length"),
        F.explode(F.sequence(F.lit(1), size - length + 1)).alias("at"),
    ).select("item", "length", F.slice("w", F.col("at"), F.col("length")).alias("window"))
    return each.groupBy("length", "window").agg(F.collect_set("item").alias("items"))


def _anchored(windows: DataFrame) -> DataFrame:
    """(anchor, offset, length, window, items): each window under the hash of its longest word."""
    longest = F.array_max(
        F.transform("window", lambda x, i: F.struct(F.length(x), F.xxhash64(x), (-i).alias("back"), x.alias("word")))
    )
    at = windows.withColumn("_longest", longest)
    return at.select(
        F.xxhash64(F.lower("_longest.word")).alias("anchor"), (-F.col("_longest.back")).alias("offset"), "length", "window", "items"
    )


def _matches(w: Column, at: Column, c: Column) -> Column:
    """Whether the words around position ``at`` are the window ``c``, word for word."""
    start = at - c["offset"]
    inside = (start >= 0) & (start + c["length"] <= F.size(w))
    return inside & (normalised(F.slice(w, F.greatest(start, F.lit(0)) + 1, c["length"])) == c["window"])


def _scan(documents: DataFrame, statements: DataFrame, window: int, broadcast_bytes: int) -> DataFrame:
    """(row, doc_id, n_words, base, start, length, items): the hits, and a base row for each row.

    Every word of the documents is looked up by hash in the set of anchors, and where one meets,
    the whole window is verified. The set is sent to every task if its measured bytes allow, so
    texts are scanned where they are read; beyond that, words and anchors meet by a shuffle.
    """
    windows = statement_windows(statements, window)
    used = windows.agg(F.sum(F.length(F.array_join("window", " ")) * 4 + F.size("items") * 24 + 64)).first()[0] or 0
    anchors = _anchored(windows).groupBy("anchor").agg(F.collect_list(F.struct("offset", "length", "window", "items")).alias("wins"))
    rows = with_words(documents.select("doc_id", "text", *row_key("doc_id", "text")), "text", "w").drop("text")
    spots = rows.select("*", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("at", "word"))
    spots = spots.withColumn("hash", F.xxhash64(F.lower("word"))).withColumn("base", F.coalesce(F.col("at") == 0, F.lit(True)))
    keys = ["_row_a", "_row_b", "doc_id", "n_words"]
    if used <= broadcast_bytes:
        met = spots.join(F.broadcast(anchors), spots["hash"] == anchors["anchor"], "left")
        # Only what stands around an anchor goes on, so the words of a text are not copied with it.
        left = F.greatest(F.col("at") - (window - 1), F.lit(0))
        near = met.filter("anchor IS NOT NULL OR base").select(
            *keys, "base", "at", (F.col("at") - left).alias("here"), F.slice("w", left + 1, F.lit(2 * window - 1)).alias("near"), "wins"
        )
        hits = F.filter("wins", lambda c: _matches(F.col("near"), F.col("here"), c))
        each = near.select(*keys, "base", "at", F.posexplode_outer(hits).alias("i", "c")).filter("base OR c IS NOT NULL")
        each = each.withColumn("base", F.col("base") & (F.coalesce("i", F.lit(0)) == 0))
    else:
        narrow = spots.filter("hash IS NOT NULL").select("_row_a", "_row_b", "at", "hash").distinct()
        met = narrow.join(anchors, narrow["hash"] == anchors["anchor"]).select("_row_a", "_row_b", "at", F.explode("wins").alias("c"))
        found = rows.dropDuplicates(["_row_a", "_row_b"]).join(met, ["_row_a", "_row_b"]).filter(_matches(F.col("w"), F.col("at"), F.col("c")))
        bases = rows.select("_row_a", "_row_b", "doc_id", F.size("w").alias("n_words"), F.lit(True).alias("base"), F.lit(None).cast("int").alias("at"))
        each = bases.unionByName(
            found.select("_row_a", "_row_b", "doc_id", F.size("w").alias("n_words"), F.lit(False).alias("base"), "at", "c"), allowMissingColumns=True
        )
    return each.select(*keys, "base", (F.col("at") - F.col("c.offset")).alias("start"), F.col("c.length").alias("length"), F.col("c.items").alias("items"))


def _per_row(scan: DataFrame) -> DataFrame:
    """One row per distinct row: its copies, words, hit words and the statements that hit."""
    order = Window.partitionBy("_row_a", "_row_b").orderBy("start", "length")
    end = F.col("start") + F.col("length")
    reached = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(reached, F.lit(0))))
    return (
        scan.withColumn("fresh", F.when(F.col("start").isNotNull(), fresh))
        .groupBy("_row_a", "_row_b", "doc_id", "n_words")
        .agg(
            F.count_if("base").alias("copies"),
            F.coalesce(F.sum("fresh"), F.lit(0)).cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )


def mark_contamination(
    documents: DataFrame,
    statements: DataFrame,
    window: int = WINDOW,
    share: int = 20,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """How much of each document stands in sealed statements.

    ``documents`` (doc_id, text), ``statements`` (statement_id, statement). Returns (doc_id,
    n_words, n_hit, n_items, items, contaminated), one row per row of ``documents``: a word is hit
    inside any occurrence of a statement's window, ``items`` are the statements with an occurring
    window, sorted as text, and a document is contaminated if it has a hit and ``share`` times its
    hits reach its words.

    NULL or empty text has no words and is clean. Rows that repeat a document get the same result;
    a NULL id is carried through. A NULL statement has no window; a window of a statement
    without an id counts as a hit of no item. No statements: nothing is hit. Other columns are
    not read.
    """
    each = _per_row(_scan(documents, statements, window, broadcast_bytes))
    hit = F.col("n_hit")
    return each.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        ((hit > 0) & (hit * share >= F.col("n_words"))).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")


def decontaminate(
    documents: DataFrame,
    statements: DataFrame,
    window: int = WINDOW,
    share: int = 20,
    remove: str = "documents",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``documents`` without contaminated rows, or with every hit passage cut from its text.

    ``remove="documents"`` drops the rows that ``mark_contamination`` marks.
    ``remove="spans"`` keeps every row and cuts the hit words, with what stands before each.
    All columns of ``documents`` stay; names that begin with ``_row_`` or ``_hit_`` must be free.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove!r}")
    keyed = documents.select("*", *row_key("doc_id", "text"))
    hits = _scan(documents, statements, window, broadcast_bytes).filter("start IS NOT NULL").drop("doc_id")
    if remove == "documents":
        found = _per_row(hits.withColumn("doc_id", F.lit(None))).filter(F.col("n_hit") * share >= F.col("n_words"))
        return keyed.join(found.select("_row_a", "_row_b"), ["_row_a", "_row_b"], "left_anti").select(*documents.columns)
    spots = F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.col("length")))
    found = hits.select("_row_a", "_row_b", spots.alias("_at")).groupBy("_row_a", "_row_b").agg(F.collect_set("_at").alias("_hit_at"))
    marked = keyed.join(found, ["_row_a", "_row_b"], "left")
    pieces = F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))
    kept = F.filter(pieces, lambda _, i: ~F.array_contains("_hit_at", i + 1))
    text = F.when(F.col("_hit_at").isNull(), F.col("text")).otherwise(F.array_join(kept, ""))
    return marked.select(*[text.alias("text") if c == "text" else F.col(c) for c in documents.columns])
