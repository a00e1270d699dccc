"""SQL names: scalar functions, and table functions for LATERAL joins."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import containers as C
from . import schema as S
from kistwerk.formats.container import Limits
from kistwerk.formats.extract import Options


class _Nodes:
    def eval(self, content: bytes):
        for row in C._node_rows("", content, False, Limits()):
            yield tuple(row[c] for c in _columns(S.NODES)[1:])


class _Artifacts:
    def eval(self, content: bytes, include_raw: bool):
        for a in C._report_row("", content, Options(include_raw=bool(include_raw)))["artifacts"]:
            yield tuple(a[c] for c in ("seq", "id", "kind", "status", "artifact_path", "media_type", "size", "sha256", "raw", "depth", "parent_id", "children", "note"))


class _Properties:
    def eval(self, content: bytes, stream_path: str):
        for row in C._property_rows("", content, [stream_path] if stream_path else None):
            yield tuple(row.get(c) for c in _columns(S.PROPERTIES)[1:])


def _columns(ddl: str) -> list[str]:
    return [c.split(" ")[0] for c in ddl.split(", ")]


def register(spark: SparkSession) -> None:
    """The scalar functions of ``containers`` under their names; tables cfb_nodes(content), cfb_extract(content, include_raw), ole_properties(content, path)."""
    for f in (C.cfb_build, C.cfb_apply, C.cfb_apply_in_place, C.cfb_put_summary, C.cfb_read_stream, C.cfb_header_error, C.ole_detect, C.ole_properties_marshal, C.ole_native_build):
        spark.udf.register(f.__name__, f)
    artifact = "seq int, id string, kind string, status string, artifact_path string, media_type string, size bigint, sha256 string, raw binary, depth int, parent_id string, children int, note string"
    for name, cls, ddl in (("cfb_nodes", _Nodes, S.NODES.split(", ", 1)[1]), ("cfb_extract", _Artifacts, artifact), ("ole_properties", _Properties, S.PROPERTIES.split(", ", 1)[1])):
        spark.udtf.register(name, F.udtf(cls, returnType=ddl))
