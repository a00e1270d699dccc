"""Names for files: sanitised, never reserved, with an extension that fits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that a file must not have, before its first dot.
RESERVED = ["CON", "PRN", "AUX", "NUL"] + [f"{p}{i}" for p in ("COM", "LPT") for i in range(1, 10)]

# Extensions by media type, then by kind.
MEDIA_EXTENSION = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/bmp": ".bmp", "image/tiff": ".tiff", "image/webp": ".webp"}
KIND_EXTENSION = {"ole_file": ".ole", "ole_object": ".oleobj", "image": ".img"}
LONGEST_STEM, LONGEST_EXTENSION, LONGEST_TOKEN = 80, 16, 64


def sanitize(v: Column) -> Column:
    """Letters, digits, ``.``, ``_`` and ``-`` stay; others become ``_``; no ``_`` then no ``.`` or blank at the ends; a reserved name gets ``_`` in front."""
    s = F.regexp_replace(v, r"[^\p{L}\p{Nd}._-]", "_")
    s = F.regexp_replace(F.regexp_replace(s, r"^_+|_+\z", ""), r"^[. ]+|[. ]+\z", "")
    return F.when(F.upper(F.substring_index(s, ".", 1)).isin(RESERVED), F.concat(F.lit("_"), s)).otherwise(s)


def file_token(v: Column) -> Column:
    s = F.regexp_replace(F.trim(v), r"[^A-Za-z0-9._-]", "_")
    return F.substring(F.regexp_replace(s, r"^[._\- ]+|[._\- ]+\z", ""), 1, LONGEST_TOKEN)


def short_stem(s: Column) -> Column:
    """At most LONGEST_STEM bytes, cut between characters."""
    cut = F.substring(s, 1, LONGEST_STEM)
    for _ in range(3):  # a character has at most four bytes: fewer characters until the bytes fit
        over = F.greatest(F.octet_length(cut) - LONGEST_STEM, F.lit(0))
        cut = F.when(over > 0, F.substring(cut, F.lit(1), F.greatest(F.length(cut) - F.ceil(over / 3).cast("int"), F.lit(0)))).otherwise(cut)
    return F.when(F.octet_length(cut) > LONGEST_STEM, F.substring(cut, 1, LONGEST_STEM // 4)).otherwise(cut)


def extension(kind: Column, media: Column, file_name: Column) -> Column:
    """The embedded name's own extension where it is safe, else by media type, else by kind."""
    own = F.regexp_extract(file_name, r"(\.[^./]*)\z", 1)
    safe = (F.octet_length(own) <= LONGEST_EXTENSION) & own.rlike(r"^\.[\p{L}\p{Nd}]*\z")
    out = F.when(kind.isin("ole_object", "stream") & safe, F.lower(own))
    for m, e in MEDIA_EXTENSION.items():
        out = out.when(media == m, e)
    for k, e in KIND_EXTENSION.items():
        out = out.when(kind == k, e)
    return out.otherwise(".bin")


def preferred_stem(file_name: Column) -> Column:
    base = F.regexp_extract(F.regexp_replace(file_name, r"/+\z", ""), r"([^/]*)\z", 1)
    return sanitize(F.regexp_replace(base, r"\.[^.]*\z", ""))


def flat_name(seq: Column, path: Column, kind: Column, media: Column, file_name: Column, prefer_file_name: bool = False) -> Column:
    """``000007_stem.ext``; seq counts skipped artifacts too."""
    stem = sanitize(path)
    if prefer_file_name:
        stem = F.coalesce(F.nullif(preferred_stem(file_name), F.lit("")), stem)
    stem = short_stem(F.coalesce(F.nullif(stem, F.lit("")), F.lit("artifact")))
    return F.concat(F.lpad(seq.cast("string"), 6, "0"), F.lit("_"), stem, extension(kind, media, file_name))


def tree_name(seq: Column, path: Column, kind: Column, media: Column, file_name: Column, prefer_file_name: bool = False) -> Column:
    """As flat_name in directories for the segments; ``!`` makes a level of its own."""
    parts = F.filter(F.split(F.replace(F.regexp_replace(path, "^/", ""), F.lit("!"), F.lit("/_ole_/")), "/", -1), lambda s: s != "")
    parts = F.transform(parts, lambda s: F.coalesce(F.nullif(sanitize(s), F.lit("")), F.lit("artifact")))
    parts = F.when(F.size(parts) == 0, F.array(F.lit("artifact"))).otherwise(parts)
    last = F.element_at(parts, -1)
    if prefer_file_name:
        last = F.coalesce(F.nullif(preferred_stem(file_name), F.lit("")), last)
    name = F.concat(F.lpad(seq.cast("string"), 6, "0"), F.lit("_"), short_stem(last), extension(kind, media, file_name))
    return F.array_join(F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(name)), "/")
