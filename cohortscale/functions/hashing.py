"""Seeds, draws, pseudonyms and checksums as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_to_long(text: Column) -> Column:
    """At most 15 hex digits as a BIGINT."""
    return F.conv(text, 16, 10).cast("bigint")


def derived_seed(stream: str | Column, seed: int | Column, key: Column) -> Column:
    """First 8 bytes of sha256("stream:seed:key"), big endian, modulo 2^63 - 1."""
    stream = F.lit(stream) if isinstance(stream, str) else stream
    seed = F.lit(seed) if isinstance(seed, int) else seed
    digest = F.sha2(F.concat_ws(":", stream, seed.cast("string"), key.cast("string")), 256)
    word = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return (word % F.lit("9223372036854775807").cast("decimal(20,0)")).cast("bigint")


def draw(seed: int, stratum: Column, replicate: Column, slot: Column, size: Column) -> Column:
    """The member a bootstrap slot picks: a number in [0, size) from the hash of its position."""
    text = F.concat_ws(
        "|", F.lit(str(seed)), stratum, replicate.cast("string"), slot.cast("string")
    )
    # Never NULL; saying so spares a null filter that would hash every draw twice.
    return F.coalesce(hex_to_long(F.substring(F.md5(text), 1, 15)) % size, F.lit(0))


def order_hash(seed: int | Column, key: Column, *more: Column) -> Column:
    """Hash that stands for a seeded shuffle: sort by it, then by the key."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    parts = [seed.cast("string"), *[m.cast("string") for m in more], key.cast("string")]
    return F.md5(F.concat_ws("|", *parts))


def pseudonym(identifier: Column, salt: str, prefix: str) -> Column:
    """Prefix and 16 upper-case hex digits of sha256("salt:id"). An empty salt is refused."""
    if not salt:
        raise ValueError("a pseudonym needs a salt: an unsalted hash can be enumerated")
    digest = F.sha2(F.concat(F.lit(salt + ":"), identifier.cast("string")), 256)
    return F.concat(F.lit(prefix), F.upper(F.substring(digest, 1, 16)))


def salt_fingerprint(salt: str) -> Column:
    """What a report records in place of the salt."""
    return F.substring(F.sha2(F.lit(salt), 256), 1, 16)
