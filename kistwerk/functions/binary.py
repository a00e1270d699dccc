"""Signatures, hashes and fixed-width values of binary columns, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kistwerk.formats import fixed as X


def _bytes(raw: bytes) -> Column:
    return F.expr(f"X'{raw.hex()}'")


def image_media(data: Column) -> Column:
    """Media type by the first bytes; null if they are of no image."""
    out = None
    for media, magic in X.IMAGE_MAGIC:
        hit = F.substring(data, 1, len(magic)) == _bytes(magic)
        out = F.when(hit, media) if out is None else out.when(hit, media)
    webp = (F.substring(data, 1, 4) == _bytes(b"RIFF")) & (F.substring(data, 9, 4) == _bytes(b"WEBP"))
    return out.when(webp, "image/webp")


def is_container(data: Column) -> Column:
    return F.substring(data, 1, 8) == _bytes(X.SIGNATURE)


def sha256(data: Column) -> Column:
    return F.sha2(data, 256)


def head(data: Column, size: int = 64 * 1024) -> Column:
    return F.substring(data, 1, size)


def guid_text(raw: Column) -> Column:
    """16 bytes as text; the first three groups are little-endian."""
    h = F.lower(F.hex(raw))
    at = lambda *pairs: F.concat(*(F.substring(h, 2 * i + 1, 2) for i in pairs))
    return F.concat_ws("-", at(3, 2, 1, 0), at(5, 4), at(7, 6), F.substring(h, 17, 4), F.substring(h, 21, 12))


def filetime_to_timestamp(ticks: Column) -> Column:
    """100 ns since 1601 to a timestamp, to the microsecond."""
    return F.timestamp_micros((F.floor(ticks.cast("decimal(20,0)") / 10) - X.FILETIME_EPOCH * 1_000_000).cast("long"))


def timestamp_to_filetime(t: Column) -> Column:
    return ((F.unix_micros(t).cast("decimal(20,0)") + X.FILETIME_EPOCH * 1_000_000) * 10).cast("decimal(20,0)")


def range_checked(value: Column, kind: str) -> Column:
    """The integer as tinyint, smallint, int or bigint, or null where it doesn't fit."""
    return value.try_cast(kind)
