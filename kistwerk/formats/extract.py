"""Extraction of all payloads of a container, nested ones too, as one ordered fold."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from . import fixed as X
from .container import Container, Limits, Node
from .embedded import detect, image_type, native_object
from .paths import Problem

HEAD = 64 * 1024
OBJECT_KINDS = ("ole10native", "compobj", "package")


@dataclass(frozen=True)
class Options:
    """Limits of 0 are taken from ``open``, else there is none (artifacts: 2^20). ``empty_objects``: a wrapped payload of no bytes is an artifact too."""

    strict: bool = False
    include_raw: bool = False
    images: bool = True
    objects: bool = True
    unwrap: bool = True
    empty_objects: bool = False
    deduplicate: bool = True
    max_depth: int = 16
    max_artifacts: int = 4096
    max_total_bytes: int = 64 << 20
    max_artifact_size: int = 32 << 20
    open: Limits = Limits()


@dataclass(slots=True)
class Artifact:
    kind: str
    path: str
    size: int
    depth: int
    parent_id: str
    source_node_id: int
    id: str = ""
    status: str = "ok"
    media_type: str = ""
    sha256: str = ""
    raw: bytes | None = None
    children: int = 0
    ole_file_name: str = ""
    ole_source_path: str = ""
    ole_temp_path: str = ""
    error: Problem | None = None
    note: str = ""


@dataclass
class Report:
    artifacts: list[Artifact] = field(default_factory=list)
    warnings: list[Problem] = field(default_factory=list)
    partial: bool = False
    dedup_hits: int = 0
    bytes_exported: int = 0

    def count(self, status: str) -> int:
        return sum(a.status == status for a in self.artifacts)


class _Stop(Exception):
    """A quota ends the whole walk."""


class _Fold:
    def __init__(self, options: Options):
        o = options
        self.o, self.report = o, Report()
        self.most = o.max_artifacts if o.max_artifacts > 0 else o.open.objects or 1 << 20
        self.quota = o.max_total_bytes if o.max_total_bytes > 0 else o.open.total_bytes
        self.largest = o.max_artifact_size if o.max_artifact_size > 0 else o.open.stream_bytes
        self.seen: set[str] = set()
        self.by_id: dict[str, Artifact] = {}
        self.ids = 0

    def warn(self, problem: Problem, partial: bool = True) -> None:
        self.report.warnings.append(problem)
        self.report.partial |= partial

    def fits(self, size: int, path: str, op: str) -> bool:
        """Checks the number of artifacts (the walk stops) and the size of this one (it is skipped)."""
        if len(self.report.artifacts) >= self.most:
            self.warn(Problem(X.LIMIT_EXCEEDED, "artifact count limit exceeded", op, path))
            raise _Stop
        if 0 < self.largest < size:
            self.warn(Problem(X.LIMIT_EXCEEDED, "artifact size limit exceeded", op, path))
            return False
        return True

    def too_deep(self, depth: int, path: str, op: str) -> bool:
        if 0 < self.o.max_depth <= depth:
            self.warn(Problem(X.DEPTH_EXCEEDED, "extract depth limit reached", op, path))
            return True
        return False

    def add(self, a: Artifact) -> None:
        self.report.artifacts.append(a)
        self.by_id[a.id] = a
        if a.parent_id and a.parent_id in self.by_id:
            self.by_id[a.parent_id].children += 1

    def classify(self, a: Artifact, payload: bytes, stream_path: str):
        """Hash, id, kind and media type; the kinds override one another in this order. The id is spent even if the artifact then is dropped."""
        self.ids += 1
        a.sha256, a.size = hashlib.sha256(payload).hexdigest(), len(payload)
        a.id = f"sha256:{a.sha256}#{self.ids}"
        head = payload[:HEAD]
        if payload.startswith(X.SIGNATURE):
            a.kind = "ole_file"
        if self.o.images and (media := image_type(head)):
            a.kind, a.media_type = "image", media
        found = detect(stream_path, head) if self.o.objects or self.o.unwrap else None
        if self.o.objects and found and found.kind in OBJECT_KINDS:
            a.kind = "ole_object"
            a.note = f"{a.note};detected={found.kind}" if a.note else f"oleds:{found.kind}"
        return found

    def admit(self, a: Artifact, payload: bytes, op: str) -> bool:
        """Drops a payload that came before; stops the walk ahead of one that would pass the quota; else adds it."""
        if self.o.deduplicate:
            if a.sha256 in self.seen:
                self.report.dedup_hits += 1
                return False
            self.seen.add(a.sha256)
        if 0 < self.quota < self.report.bytes_exported + a.size:
            self.warn(Problem(X.QUOTA_EXCEEDED, "total extracted bytes limit exceeded", op, a.path))
            raise _Stop
        if self.o.include_raw:
            a.raw = payload
        self.report.bytes_exported += a.size
        self.add(a)
        return True

    def inside(self, a: Artifact, payload: bytes, is_native: bool, op: str) -> None:
        """What an added artifact holds: a wrapped object, then a container."""
        if self.o.unwrap and is_native:
            self.native(a, payload)
        if not payload.startswith(X.SIGNATURE) or self.too_deep(a.depth, a.path, op):
            return
        try:
            nested = Container(payload, self.o.strict, self.o.open)
        except Problem as p:
            self.warn(p)
            return
        self.container(nested, a.path, a.id, a.depth + 1)

    def container(self, c: Container, prefix: str, parent_id: str, depth: int) -> None:
        for node in c.nodes.values():
            if node.entry.kind == X.STREAM:
                self.stream(c, node, prefix, parent_id, depth)

    def stream(self, c: Container, node: Node, prefix: str, parent_id: str, depth: int) -> None:
        if not self.fits(node.entry.size, node.path, "extract"):
            return
        a = Artifact("stream", f"{prefix}!{node.path}" if prefix else node.path, node.entry.size, depth, parent_id, node.entry.id)
        try:
            payload = c.read(node.path)
        except Problem as p:
            a.status, a.error = "failed", p
            self.add(a)
            self.warn(p, partial=False)
            return
        found = self.classify(a, payload, node.path)
        if self.o.objects and found and found.kind == "ole10native":
            whole = native_object(payload) if len(payload) > HEAD else None  # an object longer than the head shows its names only as a whole
            a.ole_file_name, a.ole_source_path = (whole.file_name, whole.source_path) if whole else (found.file_name, found.source_path)
        if self.admit(a, payload, "extract"):
            self.inside(a, payload, bool(found) and found.kind == "ole10native", "extract")

    def native(self, parent: Artifact, data: bytes) -> None:
        op = "extract.unwrap_ole10native"
        if self.too_deep(parent.depth, parent.path, op):
            return
        n = native_object(data)
        if n is None:
            self.warn(Problem(X.UNSUPPORTED, "parse Ole10Native payload failed", op, parent.path))
            return
        path = f"{parent.path}!$ole10native"
        if not (n.payload or self.o.empty_objects) or not self.fits(len(n.payload), path, op):
            return
        note = "ole10native" + (f";file={n.file_name}" if n.file_name else "") + (f";src={n.source_path}" if n.source_path else "")
        a = Artifact("stream", path, len(n.payload), parent.depth + 1, parent.id, parent.source_node_id, ole_file_name=n.file_name, ole_source_path=n.source_path, ole_temp_path=n.temp_path, note=note)
        found = self.classify(a, n.payload, path)
        if self.admit(a, n.payload, op):
            self.inside(a, n.payload, bool(found) and found.kind == "ole10native", op)


def extract(content: bytes | None, options: Options = Options()) -> Report:
    """Raises Problem only where the container can't be opened; a null content counts as not found."""
    if content is None:
        raise Problem(X.NOT_FOUND, "open file failed", "open_file")
    container = Container(content, options.strict, options.open)
    fold = _Fold(options)
    try:
        fold.container(container, "", "", 0)
    except _Stop:
        pass
    fold.report.warnings += container.warnings
    fold.report.partial |= container.partial
    return fold.report
