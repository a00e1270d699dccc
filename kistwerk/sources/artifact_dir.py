"""A sink for artifacts: tasks write into a staging directory, the driver's commit puts the files into place.

With ``atomic`` (the default) an existing file that is overwritten is kept aside until all files are in place, and a failure
puts everything back. Without it, files move one by one and a failure takes back only what this run has written,
if nothing was to be overwritten.

What is listed of the artifacts stays in the staging directory, in sorted runs that the commit merges as often as it reads
them, so that the driver holds none of it whatever the number of files.
"""

from __future__ import annotations

import heapq
import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from kistwerk.formats import fixed as X
from kistwerk.formats.paths import Problem
from kistwerk.functions import names

OP = "write_artifacts"

#: Rows of a sorted run, and runs that are open at once.
RUN_ROWS, OPEN_RUNS = 5000, 200


@dataclass
class _Written(WriterCommitMessage):
    """Files with sorted runs of rows, and of the places of their files."""

    rows: list[str] = field(default_factory=list)
    targets: list[str] = field(default_factory=list)


def _by_artifact(f: dict) -> tuple:
    return f["container"] or "", f["seq"]


def _read_run(path: str) -> Iterator:
    with open(path) as lines:
        yield from map(json.loads, lines)


def manifest_name(name: str) -> str:
    """A plain file name; none is manifest.json."""
    name = (name or "").strip()
    if not name:
        return "manifest.json"
    if "/" in name or "\\" in name or name in (".", ".."):
        raise Problem(X.INVALID_ARGUMENT, "manifest name must be a file name without path separators", OP)
    return name


class ArtifactDir(DataSource):
    """Options: path, overwrite (false), atomic (true), manifest (true), manifestName."""

    @classmethod
    def name(cls) -> str:
        return "artifact_dir"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        flag = lambda k, d: str(options.get(k, d)).lower() == "true"
        self.overwrite, self.atomic, self.manifest = flag("overwrite", "false"), flag("atomic", "true"), flag("manifest", "true")
        self.manifest_name = manifest_name(options.get("manifestname", options.get("manifestName", "")))
        self.stage = f"{self.root}.stage-{uuid.uuid4().hex}"

    def write(self, rows) -> WriterCommitMessage:
        out, held = _Written(), []
        for r in rows:
            d = r.asDict()
            raw = d.pop("raw")
            if raw:
                staged = self._staged()
                with open(staged, "wb") as f:
                    f.write(raw)
                d["staged"] = staged
            d["size"] = len(raw or b"")
            held.append(d)
            if len(held) >= RUN_ROWS:
                self._add_runs(out, held)
                held = []
        if held:
            self._add_runs(out, held)
        return out

    def _staged(self) -> str:
        os.makedirs(self.stage, exist_ok=True)
        return os.path.join(self.stage, uuid.uuid4().hex)

    def _run(self, values) -> str:
        path = self._staged()
        with open(path, "w") as out:
            out.writelines(json.dumps(v) + "\n" for v in values)
        return path

    def _add_runs(self, out: _Written, rows: list[dict]) -> None:
        out.rows.append(self._run(sorted(rows, key=_by_artifact)))
        out.targets.append(self._run(sorted(self._target(f) for f in rows if "staged" in f)))

    def _target(self, f: dict) -> str:
        return os.path.join(self.root, f["relative_path"])

    def _merged(self, runs: list[str], key: Callable | None = None) -> Iterator:
        return heapq.merge(*map(_read_run, runs), key=key)

    def _few(self, runs: list[str], key: Callable | None = None) -> list[str]:
        """Runs that may be open at once, with the rows of these."""
        while len(runs) > OPEN_RUNS:
            runs = [self._run(self._merged(runs[k : k + OPEN_RUNS], key)) for k in range(0, len(runs), OPEN_RUNS)]
        return runs

    def commit(self, messages) -> None:
        listing = os.path.join(self.root, self.manifest_name) if self.manifest else None
        try:
            targets = self._few([r for m in messages if m for r in m.targets])
            runs = self._few([r for m in messages if m for r in m.rows], _by_artifact)
            if any(a == b for a, b in pairwise(self._merged(targets))):
                raise Problem(X.CONFLICT, "two artifacts have one file name", OP)
            rows = lambda: self._merged(runs, _by_artifact)
            if not self.overwrite:
                for t in self._targets(rows(), listing):
                    if os.path.lexists(t):
                        raise Problem(X.CONFLICT, "target file already exists", OP, t)
            self._place(rows, listing)
        finally:
            shutil.rmtree(self.stage, ignore_errors=True)

    def _targets(self, rows: Iterator[dict], listing: str | None) -> Iterator[str]:
        yield from (self._target(f) for f in rows if "staged" in f)
        if listing:
            yield listing

    def _aside(self, k: int) -> str:
        return f"{self.stage}/{k}.kept"

    def _place(self, rows: Callable[[], Iterator[dict]], listing: str | None) -> None:
        """``rows`` gives them anew, in one order, at each call; the k-th file that is overwritten is kept under that number."""
        begun = placed = 0
        folder = None
        try:
            for f in rows():
                if "staged" not in f:
                    continue
                t = self._target(f)
                if os.path.dirname(t) != folder:
                    os.makedirs(folder := os.path.dirname(t), exist_ok=True)
                begun += 1
                self._keep(t, begun)
                shutil.move(f["staged"], t)
                placed += 1
            if listing:
                os.makedirs(self.root, exist_ok=True)
                begun += 1
                self._keep(listing, begun)
                with open(listing, "w") as out:
                    self._write_manifest(out, rows)
                placed += 1
        except BaseException:
            if self.atomic or not self.overwrite:
                for k, t in enumerate(self._targets(rows(), listing), 1):
                    if k > begun:
                        break
                    if k <= placed:
                        os.remove(t)
                    if os.path.lexists(self._aside(k)):
                        shutil.move(self._aside(k), t)
            raise

    def _keep(self, target: str, k: int) -> None:
        if self.atomic and os.path.lexists(target):
            os.makedirs(self.stage, exist_ok=True)
            shutil.move(target, self._aside(k))

    def _write_manifest(self, out, rows: Callable[[], Iterator[dict]]) -> None:
        """As json.dump with an indent of 2 writes it, one artifact at a time."""
        written = size = skipped = 0
        for f in rows():
            if "staged" in f:
                written, size = written + 1, size + f["size"]
            else:
                skipped += 1
        out.write(f'{{\n  "files_written": {written},\n  "bytes_written": {size},\n  "skipped": {skipped}')
        listed = ("id", "artifact_path", "kind", "status", "size", "sha256", "ole_file_name", "ole_source_path", "ole_temp_path")
        files = ({"artifact_id": f["id"], "artifact_path": f["artifact_path"], "relative_path": f["relative_path"], "file_path": self._target(f), "size": f["size"]} for f in rows() if "staged" in f)
        artifacts = ({("path" if k == "artifact_path" else k): r[k] for k in listed if r[k] not in (None, "")} | {"has_raw": "staged" in r} for r in rows())
        for name, items in (("files", files), ("artifacts", artifacts)):
            out.write(f',\n  "{name}": [')
            more = ""
            for item in items:
                out.write(f"{more}\n    " + json.dumps(item, indent=2).replace("\n", "\n    "))
                more = ","
            out.write("\n  ]" if more else "]")
        out.write("\n}")

    def abort(self, messages) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


def planned(artifacts: DataFrame, tree: bool = False, prefer_file_name: bool = False, by_container: bool = False) -> DataFrame:
    """Rows for the sink from artifacts with raw: relative_path by the flat or the tree layout; with ``by_container`` below a directory named after the container."""
    name = (names.tree_name if tree else names.flat_name)(F.col("seq"), F.col("artifact_path"), F.col("kind"), F.col("media_type"), F.col("ole_file_name"), prefer_file_name)
    if by_container:
        name = F.concat(names.sanitize(F.col("path")), F.lit("/"), name)
    return artifacts.select(
        F.col("path").alias("container"), "seq", "id", "artifact_path", "kind", "status", "sha256", "ole_file_name", "ole_source_path", "ole_temp_path", name.alias("relative_path"), "raw"
    )


def manifest_totals(plan: DataFrame) -> DataFrame:
    has = F.octet_length("raw") > 0
    return plan.agg(F.count_if(has).alias("files_written"), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).cast("bigint").alias("bytes_written"), F.count_if(~F.coalesce(has, F.lit(False))).alias("skipped"))


def write(artifacts: DataFrame, path: str, overwrite: bool = False, atomic: bool = True, tree: bool = False, prefer_file_name: bool = False, manifest: bool = True, manifest_file: str = "", by_container: bool = False) -> None:
    manifest_name(manifest_file)
    artifacts.sparkSession.dataSource.register(ArtifactDir)
    out = planned(artifacts, tree, prefer_file_name, by_container).write.format("artifact_dir").mode("append").option("path", path)
    out.option("overwrite", str(overwrite).lower()).option("atomic", str(atomic).lower()).option("manifest", str(manifest).lower()).option("manifestName", manifest_file).save()


class _Scan:
    """A JSON text read value by value."""

    def __init__(self, file):
        self.file, self.text, self.at, self.decoder = file, "", 0, json.JSONDecoder()

    def _more(self) -> None:
        more = self.file.read(1 << 16)
        if not more:
            raise ValueError("unexpected end of JSON")
        self.text, self.at = self.text[self.at :] + more, 0

    def peek(self) -> str:
        while True:
            while self.at < len(self.text):
                if not self.text[self.at].isspace():
                    return self.text[self.at]
                self.at += 1
            self._more()

    def take(self, any_of: str) -> str:
        if (c := self.peek()) not in any_of:
            raise ValueError(f"unexpected {c!r} in JSON")
        self.at += 1
        return c

    def value(self):
        self.peek()
        while True:
            try:
                v, end = self.decoder.raw_decode(self.text, self.at)
                if end < len(self.text):  # else it may go on
                    self.at = end
                    return v
            except json.JSONDecodeError:
                pass
            self._more()


def _listed_files(path: str) -> Iterator[dict]:
    with open(path) as file:
        s = _Scan(file)
        s.take("{")
        while True:
            name = s.value()
            s.take(":")
            if name == "files":
                break
            s.value()
            if s.take(",}") == "}":
                return
        s.take("[")
        if s.peek() == "]":
            return
        while True:
            yield s.value()
            if s.take(",]") == "]":
                return


def manifest_files(spark: SparkSession, path: str) -> DataFrame:
    """The files that a manifest lists, read one by one."""
    from kistwerk.operators.containers import flat_map

    ddl = "artifact_id string, artifact_path string, relative_path string, file_path string, size bigint"
    return flat_map(spark.createDataFrame([(path,)], "path string"), ["path"], _listed_files, ddl)


def write_files(files: DataFrame, path: str, overwrite: bool = False) -> None:
    """Puts ``files(relative_path, raw)`` below the path by the same two phases, without a manifest; a row without bytes gives no file."""
    files.sparkSession.dataSource.register(ArtifactDir)
    rows = files.select(F.col("relative_path").alias("container"), F.lit(0).alias("seq"), "relative_path", "raw")
    rows.write.format("artifact_dir").mode("append").option("path", path).option("manifest", "false").option("overwrite", str(overwrite).lower()).save()
