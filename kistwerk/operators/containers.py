"""Containers as relations: one Arrow pass over ``containers(path, content)`` per operator.

A container is parsed and its extraction folded within one row, since dedup, quotas and nesting depend on the order of the visit;
containers are independent and spread over all tasks. Nothing here shuffles except ``gather`` and ``gathered``, which bring the streams of
a container together: as one record, or as a file of the task.
"""

from __future__ import annotations

import mmap
import tempfile
import time
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kistwerk.formats import embedded, fixed as X
from kistwerk.formats import properties as P
from kistwerk.formats.container import Container, Limits, read_header
from kistwerk.formats.extract import Options, extract
from kistwerk.formats.paths import Problem
from kistwerk.formats.writer import Draft, apply, build, build_file, commit

from . import schema as S

#: Rows, and bytes of payload, that a task puts into one Arrow batch of results.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def flat_map(df: DataFrame, columns: list[str], rows_of: Callable[..., Iterator[dict]], ddl: str) -> DataFrame:
    """rows_of(*columns of a row) gives the result's rows; batches stay small whatever the payloads."""
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(((values, rows_of(*values)) for values in _cells(batches)), schema)

    return df.select(*columns).mapInArrow(run, ddl)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    for b in batches:
        for cells in zip(*b.columns, strict=True):
            yield [c.as_py() for c in cells]


def _batched(results: Iterator[tuple[list, Iterator[dict]]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of result rows, from each input's values and rows."""
    held, size = [], 0
    for values, rows in results:
        for row in rows:
            held.append(row)
            if len(held) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
        size += sum(len(v) for v in values if isinstance(v, bytes))
        if held and size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def gathered(streams: DataFrame, rows_of: Callable[..., Iterator[dict]], ddl: str, by: str = "path", stream_path: str = "stream_path", data: str = "data") -> DataFrame:
    """rows_of(path, content) over the containers that ``gather`` gives, none of which has to be one record: the streams of a container come in
    order into one task, which writes them to a file on its own disk and hands on a map of that. Memory holds a container's directory alone."""
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched((([], _rows_of_file(path, streams, rows_of)) for path, streams in groupby(_cells(batches), lambda cells: cells[0])), schema)

    cells = streams.select(F.col(by).alias("path"), F.col(stream_path).alias("stream_path"), F.col(data).alias("data"))
    return cells.repartition("path").sortWithinPartitions("path", "stream_path", "data").mapInArrow(run, ddl)


def _rows_of_file(path: str | None, streams: Iterator[list], rows_of: Callable[..., Iterator[dict]]) -> Iterator[dict]:
    with tempfile.TemporaryFile() as file:
        try:
            with tempfile.TemporaryFile() as spool:
                build_file(((p, d) for _, p, d in streams), file, spool)
            file.flush()
            content = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)  # closed with the last view of it
        except Problem:  # as cfb_build: null where a path is invalid
            content = None
        yield from rows_of(path, content)


def _warning(k: int, p: Problem) -> dict:
    return {"seq": k, "code": p.code, "message": p.message, "node_path": p.path, "offset": p.offset, "op": p.op, "severity": "warning"}


def _report_row(path: str, content: bytes | None, options: Options) -> dict:
    began = time.monotonic()
    row = {"path": path, "size": len(content) if content is not None else 0, "success": False, "partial": False, "dedup_hits": 0, "bytes_exported": 0, "artifacts": [], "warnings": [], "error": None}
    try:
        r = extract(content, options)
    except Problem as p:
        row["error"] = p.row()
    else:
        row |= {"success": True, "partial": r.partial, "dedup_hits": r.dedup_hits, "bytes_exported": r.bytes_exported}
        row["artifacts"] = [
            {
                "seq": k, "id": a.id, "kind": a.kind, "status": a.status, "artifact_path": a.path, "media_type": a.media_type, "size": a.size, "sha256": a.sha256, "raw": a.raw, "depth": a.depth,
                "parent_id": a.parent_id, "children": a.children, "source_node_id": a.source_node_id, "ole_file_name": a.ole_file_name, "ole_source_path": a.ole_source_path,
                "ole_temp_path": a.ole_temp_path, "error": a.error and a.error.row(), "note": a.note,
            }
            for k, a in enumerate(r.artifacts)
        ]
        row["warnings"] = [_warning(k, p) for k, p in enumerate(r.warnings)]
    row["duration_ms"] = int((time.monotonic() - began) * 1000)
    return row


def extract_reports(containers: DataFrame, options: Options = Options()) -> DataFrame:
    """One report row per container; a null content is a file that could not be opened."""
    return flat_map(containers, ["path", "content"], lambda path, content: iter([_report_row(path, content, options)]), S.REPORT)


def artifacts(reports: DataFrame) -> DataFrame:
    return reports.select("path", F.explode("artifacts").alias("a")).select("path", "a.*")


def warnings(reports: DataFrame) -> DataFrame:
    return reports.select("path", F.explode("warnings").alias("w")).select("path", "w.*")


def _count(status: str) -> Column:
    return F.size(F.filter("artifacts", lambda a: a["status"] == status))


def files(reports: DataFrame) -> DataFrame:
    """One row per container as the corpus report lists it; a failed one has neither artifacts nor warnings."""
    return reports.select(
        "path", "size", "duration_ms", "success", "partial", F.size("artifacts").alias("artifacts_total"), _count("ok").alias("artifacts_ok"), _count("failed").alias("artifacts_failed"),
        F.size("warnings").alias("warnings"), F.col("error.code").alias("error_code"), F.col("error.message").alias("error_message"),
    )


def extract_stats(reports: DataFrame) -> DataFrame:
    """Totals per container. Depth is that of the deepest artifact."""
    deepest = F.coalesce(F.array_max(F.transform("artifacts", lambda a: a["depth"])), F.lit(0))
    return reports.select(
        "path", F.size("artifacts").alias("artifacts_total"), _count("ok").alias("artifacts_ok"), _count("partial").alias("artifacts_partial"), _count("failed").alias("artifacts_failed"),
        "dedup_hits", "bytes_exported", deepest.alias("max_depth_reached"),
    )


def _stats_row(path: str, content: bytes | None, options: Options) -> dict:
    row = dict.fromkeys(("artifact_total", "warning_total", "error_total", "node_total", "stream_total", "storage_total", "max_depth"), 0) | {"path": path}
    for n in _node_rows(path, content, False, Limits()):
        row["node_total"] += 1
        row["stream_total"] += n["type"] == "stream"
        row["storage_total"] += n["type"] == "storage"
        row["max_depth"] = max(row["max_depth"], n["depth"])
    try:
        r = extract(content, options)
    except Problem:
        return row | {"error_total": 1}
    return row | {"artifact_total": len(r.artifacts), "warning_total": len(r.warnings)}


def model_stats(containers: DataFrame, options: Options = Options()) -> DataFrame:
    """Totals per container of its nodes, artifacts, warnings and errors; one that can't be opened has no nodes and one error."""
    return flat_map(containers, ["path", "content"], lambda path, content: iter([_stats_row(path, content, options)]), S.STATS)


def gathered_model_stats(streams: DataFrame, options: Options = Options()) -> DataFrame:
    """model_stats of the containers that the streams make up, by ``gathered``."""
    return gathered(streams, lambda path, content: iter([_stats_row(path, content, options)]), S.STATS)


def mutations(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, kind, node_path, size_before, size_after): what a transaction has done to a container, from its nodes before and after: create, delete or update."""
    key = ["path", "node_path"]
    b = before.select(*key, F.col("type").alias("t"), F.col("size").alias("size_before"))
    a = after.select(*key, F.col("type").alias("u"), F.col("size").alias("size_after"))
    kind = F.when(F.col("t").isNull(), "create").when(F.col("u").isNull(), "delete").when((F.col("u") == "stream") & (F.col("size_before") != F.col("size_after")), "update")
    return b.join(a, key, "full_outer").withColumn("kind", kind).where("kind is not null").select("path", "kind", "node_path", "size_before", "size_after")


def _node_rows(path: str, content: bytes | None, strict: bool, limits: Limits) -> Iterator[dict]:
    try:
        c = Container(content or b"", strict, limits)
    except Problem:
        return
    breadth = {number: k for k, number in enumerate(c.breadth_first())}
    for k, (number, n) in enumerate(c.nodes.items()):
        e = n.entry
        yield {
            "path": path, "node_id": number, "type": n.type, "node_path": n.path, "name": e.name, "parent_id": n.parent_id, "size": e.size, "clsid": e.clsid, "state_bits": e.state_bits,
            "created_at": e.created_at, "modified_at": e.modified_at, "child_count": len(n.children), "depth": n.depth, "dfs_index": k, "bfs_index": breadth[number],
        }


def nodes(containers: DataFrame, strict: bool = False, limits: Limits = Limits()) -> DataFrame:
    """All nodes; a container that can't be opened has none."""
    return flat_map(containers, ["path", "content"], lambda path, content: _node_rows(path, content, strict, limits), S.NODES)


def gathered_nodes(streams: DataFrame, strict: bool = False, limits: Limits = Limits()) -> DataFrame:
    """All nodes of the containers that the streams make up, by ``gathered``."""
    return gathered(streams, lambda path, content: _node_rows(path, content, strict, limits), S.NODES)


def walk(nodes: DataFrame, breadth_first: bool = False, max_depth: int = 0, include_root: bool = True) -> DataFrame:
    """Walk events; their index counts the nodes that the filters leave out as well."""
    keep = F.lit(True)
    if max_depth > 0:
        keep = keep & (F.col("depth") <= max_depth)
    if not include_root:
        keep = keep & (F.col("node_id") != 0)
    return nodes.where(keep).withColumn("index", F.col("bfs_index" if breadth_first else "dfs_index"))


def walk_result(events: DataFrame) -> DataFrame:
    return events.groupBy("path").agg(F.count("*").cast("int").alias("visited"), F.max("depth").alias("max_depth"))


def node_by_path(nodes: DataFrame, node_path: str) -> DataFrame:
    """The first node in depth-first order with that path, whatever its case, of each container."""
    hit = nodes.where(F.lower("node_path") == F.lower(F.lit(node_path)))
    return hit.groupBy("path").agg(F.min_by(F.struct(*[c for c in nodes.columns if c != "path"]), "dfs_index").alias("n")).select("path", "n.*")


def child_counts(nodes: DataFrame) -> DataFrame:
    """Direct children per node that has any, counted from the parents' side: each node counts once for its parent, and one that may have children tells its path, so the nodes are read once."""
    itself = F.struct("node_id", "node_path", F.lit(0).alias("child"))
    parent = F.struct(F.col("parent_id").alias("node_id"), F.lit(None).cast("string").alias("node_path"), F.lit(1).alias("child"))
    tells = F.when(F.col("node_id") == 0, F.array(itself)).when(F.col("type") == "stream", F.array(parent)).otherwise(F.array(itself, parent))
    sides = nodes.select("path", F.explode(tells).alias("n")).select("path", "n.*")
    return sides.groupBy("path", "node_id").agg(F.max("node_path").alias("node_path"), F.sum("child").cast("int").alias("children")).where("children > 0")


def subtree(nodes: DataFrame, node_path: str) -> DataFrame:
    low = node_path.lower().rstrip("/")
    return nodes.where((F.lower("node_path") == (low or "/")) | F.lower("node_path").startswith(low + "/"))


def find_nodes(nodes: DataFrame, prefix: str | None = None, name_like: str | None = None, kind: str | None = None, limit: int | None = None, after: str | None = None) -> DataFrame:
    """Nodes by path prefix, name pattern (LIKE) and type, in path order; ``after`` continues behind a (path, node path) cursor."""
    out = nodes
    if prefix:
        out = out.where(F.col("node_path").startswith(prefix))
    if name_like:
        out = out.where(F.col("name").like(name_like))
    if kind:
        out = out.where(F.col("type") == kind)
    if after:
        out = out.where(F.concat("path", F.lit("!"), "node_path") > after)
    out = out.orderBy(F.concat("path", F.lit("!"), "node_path"))
    return out if limit is None else out.limit(limit)


def _property_rows(path: str, content: bytes | None, stream_paths: list[str] | None) -> Iterator[dict]:
    blank = dict.fromkeys(c.split(" ")[0] for c in S.PROPERTIES.split(", "))
    try:
        c = Container(content or b"")
    except Problem as p:
        yield blank | {"path": path, "error": p.code}
        return
    for stream_path in stream_paths or [n.path for n in c.nodes.values() if n.type == "stream" and n.path.lstrip("/").startswith("\x05")]:
        node = c.find(stream_path)
        if node is None:
            continue
        try:
            stream = P.parse(c.read(stream_path))
        except (Problem, P.PropertyError) as e:
            yield blank | {"path": path, "stream_path": node.path, "error": str(e)}
            continue
        for k, s in enumerate(stream.sets):
            for pid in sorted(s.properties):
                yield blank | {"path": path, "stream_path": node.path, "set_index": k, "format_id": s.format_id, "pid": pid} | property_value(s.properties[pid])


def property_value(p: P.Property) -> dict:
    from decimal import Decimal

    out: dict = {"vt": p.type, "raw": p.raw}
    v = p.value
    if p.type == X.VT_FILETIME and isinstance(v, int):
        out |= {"value_ts": P.from_filetime(v), "value_filetime": Decimal(v)}
    elif isinstance(v, bool):
        out["value_bool"] = v
    elif p.type == X.VT_UI8 and isinstance(v, int):
        out["value_ulong"] = Decimal(v)
    elif isinstance(v, int):
        out["value_long"] = v
    elif isinstance(v, str):
        out["value_string"] = v
    elif isinstance(v, bytes):
        out["value_bytes"] = v
    return out


def properties(containers: DataFrame, stream_paths: list[str] | None = None) -> DataFrame:
    """All properties of the named streams, or of all streams whose name begins with \\x05; an unreadable one gives a row with its error."""
    return flat_map(containers, ["path", "content"], lambda path, content: _property_rows(path, content, stream_paths), S.PROPERTIES)


def summary_information(containers: DataFrame) -> DataFrame:
    return properties(containers, list(X.SUMMARY_STREAMS)).where((F.col("format_id") == X.SUMMARY) | F.col("error").isNotNull())


def document_summary_information(containers: DataFrame) -> DataFrame:
    return properties(containers, list(X.DOCUMENT_SUMMARY_STREAMS)).where((F.col("format_id") == X.DOCUMENT_SUMMARY) | F.col("error").isNotNull())


# Scalar functions over Arrow batches; each is total, an error is a value.


_PROBLEM = T.StructType([T.StructField(n, T.LongType() if n == "offset" else T.StringType()) for n in ("code", "message", "path", "offset", "op")])
_OUTCOME = T.StructType().add("content", T.BinaryType()).add("bytes_written", T.LongType()).add("strategy_used", T.StringType()).add("error", _PROBLEM)
_DETECTION = T.StructType()
for _name in ("kind", "confidence", "file_name", "source_path", "user_type", "prog_id", "payload_size"):
    _DETECTION = _DETECTION.add(_name, T.DoubleType() if _name == "confidence" else T.LongType() if _name == "payload_size" else T.StringType())


def _raw(v) -> bytes | None:
    return None if v is None else bytes(v)


@F.pandas_udf(T.BinaryType())
def cfb_build(streams: pd.Series) -> pd.Series:
    """A container of array<struct<path, data>>; null where a path is invalid."""

    def one(pairs):
        try:
            return build([(s["path"], _raw(s["data"])) for s in pairs])
        except Problem:
            return None

    return streams.map(lambda x: None if x is None else one(x))


def _applied(content: pd.Series, operations: pd.Series, in_place: bool) -> pd.DataFrame:
    rows = []
    for c, ops in zip(content, operations, strict=True):
        c = _raw(c)
        try:
            done = apply(c, [] if ops is None else [{**o, "data": _raw(o["data"])} for o in ops], in_place)
            rows.append((done.content, done.bytes_written, done.strategy, None))
        except Problem as p:
            rows.append((c, 0, None, p.row()))
    return pd.DataFrame(rows, columns=["content", "bytes_written", "strategy_used", "error"])


@F.pandas_udf(_OUTCOME)
def cfb_apply(content: pd.Series, operations: pd.Series) -> pd.DataFrame:
    """One transaction on each container: all operations, or the first error and the content as it was."""
    return _applied(content, operations, False)


@F.pandas_udf(_OUTCOME)
def cfb_apply_in_place(content: pd.Series, operations: pd.Series) -> pd.DataFrame:
    """As cfb_apply; a change of one stream that keeps its size rewrites that stream's sectors alone."""
    return _applied(content, operations, True)


@F.pandas_udf(_OUTCOME)
def cfb_put_summary(content: pd.Series, format_id: pd.Series, stream: pd.Series) -> pd.DataFrame:
    """Puts the first set of a marshalled property stream in place of the container's set with that format id; other sets stay."""
    rows = []
    for c, f, raw in zip(content, format_id, stream, strict=True):
        c = _raw(c)
        try:
            draft = Draft(Container(c or b"", True))
            draft.put_summary(f, P.parse(_raw(raw) or b"").sets[0])
            done = commit(draft)
            rows.append((done.content, done.bytes_written, done.strategy, None))
        except Problem as p:
            rows.append((c, 0, None, p.row()))
        except (P.PropertyError, IndexError) as e:
            rows.append((c, 0, None, Problem(X.INVALID_ARGUMENT, f"property set: {e}", "property.put_named").row()))
    return pd.DataFrame(rows, columns=["content", "bytes_written", "strategy_used", "error"])


@F.pandas_udf(T.BinaryType())
def cfb_read_stream(content: pd.Series, path: pd.Series) -> pd.Series:
    """The stream's bytes; null where it can't be read."""

    def one(c, p):
        try:
            return Container(_raw(c) or b"").read(p or "")
        except Problem:
            return None

    return pd.Series([one(c, p) for c, p in zip(content, path, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def cfb_header_error(content: pd.Series) -> pd.Series:
    """Why the header is invalid; null where it is valid."""

    def one(c):
        try:
            read_header(_raw(c) or b"")
        except Problem as p:
            return p.message
        return None

    return content.map(one)


@F.pandas_udf(_DETECTION)
def ole_detect(path: pd.Series, head: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([vars(embedded.detect(p or "", _raw(h) or b"")) for p, h in zip(path, head, strict=True)])


def gather(streams: DataFrame, by: str = "path", stream_path: str = "stream_path", data: str = "data") -> DataFrame:
    """containers(path, content, size) from one row per stream; a container is one record, so its streams meet in one task."""
    grouped = streams.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(stream_path).alias("path"), F.col(data).alias("data")))).alias("s"))
    return grouped.select(F.col(by).alias("path"), cfb_build("s").alias("content")).withColumn("size", F.octet_length("content").cast("bigint"))


# Window forms of the fold's rules, exact for flat containers and one rule at a time.


def first_of_equal(artifacts: DataFrame) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("path", "sha256").orderBy("seq")
    return artifacts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_n(artifacts: DataFrame, n: int) -> DataFrame:
    from pyspark.sql.window import Window

    return artifacts.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("seq"))).where(F.col("_n") <= n).drop("_n")


def within_bytes(artifacts: DataFrame, quota: int) -> DataFrame:
    """Up to, and without, the first artifact that passes the quota."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return artifacts.withColumn("_sum", F.sum("size").over(w)).where(F.col("_sum") <= quota).drop("_sum")


@F.pandas_udf(T.BinaryType())
def ole_properties_marshal(format_id: pd.Series, props: pd.Series) -> pd.Series:
    """A property stream with one set of array<struct<pid, vt, value_string, value_long>>; null where a value does not fit its type."""

    def one(f, items):
        s = P.PropertySet(f)
        for i in items:
            vt, text = int(i["vt"]), i["value_string"]
            s.put(int(i["pid"]), text if vt in (X.VT_LPSTR, X.VT_LPWSTR) else None if vt == X.VT_EMPTY else bool(i["value_long"]) if vt == X.VT_BOOL else int(i["value_long"]), vt)
        try:
            return P.marshal(P.PropertyStream(sets=[s]))
        except P.PropertyError:
            return None

    return pd.Series([None if p is None else one(f, p) for f, p in zip(format_id, props, strict=True)], dtype=object)


@F.pandas_udf(T.BinaryType())
def ole_native_build(file_name: pd.Series, source_path: pd.Series, payload: pd.Series) -> pd.Series:
    """An Ole10Native stream around the payload."""

    def one(name, source, data):
        body = b"\x02\x00" + b"".join((s or "").encode() + b"\0" for s in (name, source, "")) + len(data).to_bytes(4, "little") + data
        return len(body).to_bytes(4, "little") + body

    return pd.Series([None if d is None else one(n, s, _raw(d)) for n, s, d in zip(file_name, source_path, payload, strict=True)], dtype=object)


def put_properties(node_path: Column, format_id: Column, props: Column) -> Column:
    """The operation for cfb_apply that puts a property stream with one set, array<struct<pid, vt, value_string, value_long>>, at the path."""
    return F.struct(F.lit("put").alias("op"), node_path.alias("path"), F.lit("").alias("new_path"), ole_properties_marshal(format_id, props).alias("data"))
