"""Container paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_segment(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def decode_segment(segment: Column) -> Column:
    """Null where a tilde starts no escape."""
    plain = F.replace(F.replace(segment, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    return F.when(~segment.rlike("~(?![01])"), plain)


def is_canonical(path: Column) -> Column:
    """Whether a path may stand in a container: begins with /, no empty segment, valid escapes, segments to 31 characters, 4096 bytes in all."""
    segments = F.split(F.substring(path, 2, 1_000_000), "/", -1)
    fine = F.forall(segments, lambda s: (s != "") & ~s.rlike("~(?![01])") & (F.length(decode_segment(s)) <= 31))
    return F.when(path == "/", True).otherwise(path.startswith("/") & fine & (F.octet_length(path) <= 4096))


def join_path(parent: Column, name: Column) -> Column:
    return F.concat(F.when(parent == "/", "").otherwise(parent), F.lit("/"), encode_segment(F.trim(name)))


def parent_path(path: Column) -> Column:
    up = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(up == "", "/").otherwise(up)


def base_name(path: Column) -> Column:
    return F.when(path == "/", "/").otherwise(F.coalesce(decode_segment(F.regexp_extract(path, "/([^/]*)$", 1)), F.lit("")))


def path_key(path: Column) -> Column:
    return F.lower(path)


def artifact_path(prefix: Column, path: Column) -> Column:
    return F.when(prefix == "", path).otherwise(F.concat(prefix, F.lit("!"), path))
