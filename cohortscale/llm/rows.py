"""What several operators of this folder share: tables, row keys, words and hold-outs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
# What separates words written with blanks.
BLANKS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; text of ASCII alone takes the quick way."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def row_key(*columns: str) -> list[Column]:
    """Two numbers, never NULL, that tell rows with different values apart; equal rows share them."""
    return [
        F.xxhash64(*columns).alias("_row_a"),
        F.xxhash64(F.lit("row"), *columns).alias("_row_b"),
    ]


def held_out(doc_id: Column, every: int) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo ``every``, is 0.

    A document without an id counts as if its id were the empty text.
    """
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % every == 0


# What Python calls white space besides the blanks.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split_blanks(text: str) -> list[str]:
    """The words of a text: what stands between blanks, as ``[^BLANKS]+`` matches."""
    return _WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def lower_ascii(text: str) -> str:
    """``ascii_lower`` inside a task."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
