"""Content-derived identities as Column expressions, bit for bit the same wherever they are computed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the URL namespace of RFC 4122.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def content_hash(text) -> Column:
    """sha256 of the text's UTF-8, lower-case hex."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def uuid5(name: Column) -> Column:
    """Version 5 UUID of a name in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substr(h, F.lit(17), F.lit(2)), 16, 10).cast("long").bitwiseAND(63).bitwiseOR(128)))
    part = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(19, 2)), part(21, 12))


def corpus_uuid(text) -> Column:
    return uuid5(content_hash(text))


def chunk_uuid(index: Column, body: Column) -> Column:
    """The index, a NUL and the first 16 hex digits of the body's hash."""
    return uuid5(F.concat(index.cast("string"), F.lit("\0"), F.substr(content_hash(body), F.lit(1), F.lit(16))))
