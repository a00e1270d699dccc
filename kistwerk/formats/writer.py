"""Building and editing of containers: a tree of names and payloads, and its serial form."""

from __future__ import annotations

import io
import struct
from array import array
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import BinaryIO

from . import fixed as X
from . import properties as P
from .container import Container, Entry, Limits, follow
from .paths import Problem, base_name, canonical, parent_of


@dataclass(slots=True)
class Stored:
    """A payload that lies in a file."""

    file: BinaryIO
    at: int
    size: int

    def __len__(self) -> int:
        return self.size

    def __bytes__(self) -> bytes:
        self.file.seek(self.at)
        return self.file.read(self.size)


@dataclass(slots=True)
class Item:
    """A node of a draft; data is None where the stream still is as in the base container."""

    entry: Entry
    path: str
    parent: Item | None = None
    children: list[Item] = field(default_factory=list)
    data: bytes | Stored | None = None


class Draft:
    """An editable copy of a container, or an empty one. Every method either does all it says or raises Problem."""

    def __init__(self, base: Container | None = None):
        self.base = base
        self.changed = base is None  # whether names, places or sizes have changed
        self.touched: dict[int, Item] = {}
        self.root = Item(Container._bare_root(), "/")
        self.version = base.header.major_version if base and base.header.major_version == 4 else 3
        if base:
            made = {}
            for number, n in base.nodes.items():
                made[number] = item = Item(replace(n.entry), n.path)
                if number:
                    item.parent = made[n.parent_id]
                    item.parent.children.append(item)
            self.root = made[0]
        self.next_id = 1 + max((i.entry.id for i in self.items()), default=0)
        self.by_path = {i.path.lower(): i for i in reversed(list(self.items()))}

    def items(self):
        """Depth first, siblings by lower-case path."""
        todo = [self.root]
        while todo:
            item = todo.pop()
            yield item
            todo += sorted(item.children, key=lambda c: (c.path.lower(), c.entry.id), reverse=True)

    def _parent(self, path: str, op: str, missing: str, wrong: str) -> Item:
        parent = self.by_path.get(parent_of(path).lower())
        if parent is None:
            raise Problem(X.NOT_FOUND, missing, op, parent_of(path))
        if parent.entry.kind == X.STREAM:
            raise Problem(X.INVALID_ARGUMENT, wrong, op, parent_of(path))
        return parent

    def _insert(self, path: str, kind: int, op: str) -> Item:
        parent = self._parent(path, op, "parent path not found", "parent is not a storage")
        if self.base and 0 < self.base.limits.objects < len(self.by_path) + 1:
            raise Problem(X.LIMIT_EXCEEDED, "object count exceeded limit", op, path)
        item = Item(Entry(self.next_id, base_name(path), kind), path, parent)
        self.next_id += 1
        self.changed = True
        parent.children.append(item)
        self.by_path[path.lower()] = item
        return item

    def put(self, path: str, data: bytes, declared: int | None = None) -> None:
        op = "tx.put_stream"
        if declared is not None and 0 <= declared != len(data):
            raise Problem(X.INVALID_ARGUMENT, "stream size does not match declared size", op, path)
        path = canonical(path)
        item = self.by_path.get(path.lower())
        if item is None:
            item = self._insert(path, X.STREAM, op)
        elif item.entry.kind != X.STREAM:
            raise Problem(X.CONFLICT, "path exists and is not a stream", op, path)
        else:
            self.changed |= item.entry.size != len(data)
            self.touched[item.entry.id] = item
        item.data, item.entry.size = data, len(data)

    def mkdir(self, path: str) -> None:
        path = canonical(path)
        if path == "/":
            return
        if path.lower() in self.by_path:
            raise Problem(X.CONFLICT, "path already exists", "tx.create_storage", path)
        self._insert(path, X.STORAGE, "tx.create_storage")

    def make(self, path: str, data: bytes) -> None:
        """put, with the storages above it."""
        above, at = [], canonical(path)
        while (at := parent_of(at)) != "/":
            above.append(at)
        for p in reversed(above):
            if p.lower() not in self.by_path:
                self.mkdir(p)
        self.put(path, data)

    def delete(self, path: str) -> None:
        op, path = "tx.delete", canonical(path)
        if path == "/":
            raise Problem(X.INVALID_ARGUMENT, "cannot delete root", op, path)
        item = self.by_path.get(path.lower())
        if item is None:
            raise Problem(X.NOT_FOUND, "path not found", op, path)
        item.parent.children.remove(item)
        self._changed_places()

    def rename(self, old: str, new: str) -> None:
        op, old, new = "tx.rename", canonical(old), canonical(new)
        if old == "/":
            raise Problem(X.INVALID_ARGUMENT, "cannot rename root", op, old)
        item = self.by_path.get(old.lower())
        if item is None:
            raise Problem(X.NOT_FOUND, "old path not found", op, old)
        if new.lower() in self.by_path:
            raise Problem(X.CONFLICT, "new path already exists", op, new)
        parent = self._parent(new, op, "new parent path not found", "new parent is not a storage")
        above: Item | None = parent
        while above is not None:
            if above is item:
                raise Problem(X.INVALID_ARGUMENT, "new path is inside the old one", op, new)
            above = above.parent
        item.parent.children.remove(item)
        item.parent, item.entry.name = parent, base_name(new)
        parent.children.append(item)
        todo = [(item, new)]
        while todo:
            i, i.path = todo.pop()
            todo += [(c, f"{i.path}/{c.path.rpartition('/')[2]}") for c in i.children]
        self._changed_places()

    def _changed_places(self) -> None:
        self.changed = True
        self.by_path = {i.path.lower(): i for i in reversed(list(self.items()))}

    def put_summary(self, which: str, new: P.PropertySet) -> None:
        """``which``: the format id, of the summary or the document summary; the set with it is replaced, others stay."""
        op = "property.put_named"
        paths = X.SUMMARY_STREAMS if which == X.SUMMARY else X.DOCUMENT_SUMMARY_STREAMS
        target = next((p for p in paths if p.lower() in self.by_path), paths[0])
        item = self.by_path.get(target.lower())
        stream = P.PropertyStream()
        if item is not None:
            if item.entry.kind != X.STREAM:
                raise Problem(X.CONFLICT, "target path exists and is not a stream", op, target)
            try:
                stream = P.parse(self.payload(item))
            except P.PropertyError:
                raise Problem(X.DIR_CORRUPT, "failed to parse existing property set stream", op, target) from None
            except Problem:
                raise Problem(X.BAD_FAT_CHAIN, "failed to read existing property set stream", op, target) from None
        new = replace(new, format_id=which)
        at = next((k for k, s in enumerate(stream.sets) if s.format_id == which), None)
        stream.sets = [*stream.sets, new] if at is None else [*stream.sets[:at], new, *stream.sets[at + 1 :]]
        try:
            self.put(target, P.marshal(stream))
        except P.PropertyError as e:
            raise Problem(X.INVALID_ARGUMENT, str(e), op, target) from None

    def payload(self, item: Item) -> bytes:
        if item.data is not None or self.base is None:
            return bytes(item.data or b"")
        return self.base.read_node(self.base.nodes[item.entry.id], item.path)


def table_sectors(others: int, per_sector: int) -> tuple[int, int]:
    """FAT and DIFAT sectors for a file with that many other sectors: the least numbers that hold each other."""
    fat = difat = 0
    while True:
        need_fat = max(1, -(-(others + fat + difat) // per_sector))
        need_difat = -(-max(0, need_fat - X.DIFAT_SLOTS) // (per_sector - 1))
        if (need_fat, need_difat) == (fat, difat):
            return fat, difat
        fat, difat = need_fat, need_difat


def serialize(draft: Draft) -> bytes:
    out = io.BytesIO()
    write(draft, out)
    return out.getvalue()


def write(draft: Draft, out: BinaryIO) -> None:
    """The container's bytes: streams, mini stream, mini FAT, directory, FAT, DIFAT, each a run of sectors."""
    shift = X.SECTOR_SHIFT[draft.version]
    size = 1 << shift
    items = list(draft.items())
    number = {id(item): k for k, item in enumerate(items)}
    fat = array("I")
    out.write(bytes(size))  # the header's place

    def run(length: int, parts: Iterable[bytes]) -> int:
        """Appends the parts, of that length in all, as a chain of their own; returns its first sector."""
        if not length:
            return X.END_OF_CHAIN
        first, n = len(fat), -(-length // size)
        fat.extend(range(first + 1, first + n))
        fat.append(X.END_OF_CHAIN)
        out.writelines(parts)
        out.write(bytes(-length % size))
        return first

    entries, minifat, mini = [], array("I"), []
    for item in items:
        e = replace(item.entry, left=X.NO_STREAM, right=X.NO_STREAM, child=X.NO_STREAM, start=X.END_OF_CHAIN)
        kids = sorted(item.children, key=lambda c: (c.path.lower(), number[id(c)]))
        e.child = number[id(kids[0])] if kids else X.NO_STREAM
        entries.append(e)
        if e.kind != X.STREAM:
            e.size = 0
            continue
        data = draft.payload(item)
        e.size = len(data)
        if 0 < len(data) < X.MINI_CUTOFF:
            e.start, n = len(minifat), -(-len(data) // 64)
            minifat.extend(range(e.start + 1, e.start + n))
            minifat.append(X.END_OF_CHAIN)
            mini.append(item.data if isinstance(item.data, Stored) else data)
        elif data:
            e.start = run(len(data), [data])
    for item in items:
        kids = sorted(item.children, key=lambda c: (c.path.lower(), number[id(c)]))
        for a, b in zip(kids, kids[1:], strict=False):
            entries[number[id(a)]].right = number[id(b)]
    entries[0].name, entries[0].kind = X.ROOT_NAME, X.ROOT
    entries[0].size = 64 * len(minifat)
    entries[0].start = run(entries[0].size, (bytes(m) + bytes(-len(m) % 64) for m in mini))
    first_minifat, minifat_sectors = run(4 * len(minifat), [minifat.tobytes()]), -(-len(minifat) * 4 // size)
    length = X.ENTRY_SIZE * len(entries)
    first_dir, dir_sectors = run(length, map(_entry_bytes, entries)), -(-length // size)

    fats, difats = table_sectors(len(fat), size // 4)
    fat_ids = list(range(len(fat), len(fat) + fats))
    difat_ids = list(range(len(fat) + fats, len(fat) + fats + difats))
    fat.extend([X.FAT_SECTOR] * fats + [X.DIFAT_SECTOR] * difats)
    fat.extend([X.FREE] * (fats * size // 4 - len(fat)))
    out.write(fat.tobytes())
    listed, per = fat_ids[X.DIFAT_SLOTS :], size // 4 - 1
    for k in range(difats):
        part = listed[k * per : (k + 1) * per]
        link = difat_ids[k + 1] if k + 1 < difats else X.END_OF_CHAIN
        out.write(array("I", part + [X.FREE] * (per - len(part)) + [link]).tobytes())
    slots = (fat_ids + [X.FREE] * X.DIFAT_SLOTS)[: X.DIFAT_SLOTS]
    header = struct.pack(
        f"<8s16s5H6s9I{X.DIFAT_SLOTS}I", X.SIGNATURE, bytes(16), X.MINOR_VERSION, draft.version, X.BYTE_ORDER, shift, X.MINI_SHIFT, bytes(6),
        dir_sectors if draft.version == 4 else 0, fats, first_dir, 0, X.MINI_CUTOFF, first_minifat, minifat_sectors, difat_ids[0] if difats else X.END_OF_CHAIN, difats, *slots,
    )
    out.seek(0)
    out.write(header)


def _entry_bytes(e: Entry) -> bytes:
    name = e.name.encode("utf-16-le", "surrogatepass")
    black = 1
    return struct.pack("<64sHBBIII16sIqqIq", name, len(name) + 2, e.kind, black, e.left, e.right, e.child, e.clsid, e.state_bits, e.created_at, e.modified_at, e.start, e.size)


def build(streams, version: int = 3) -> bytes:
    """A container of (path, data) pairs; storages come by themselves, of equal paths the last wins."""
    draft = Draft()
    draft.version = version
    for path, data in streams:
        draft.make(path, data or b"")
    return serialize(draft)


def build_file(streams: Iterable[tuple[str, bytes | None]], out: BinaryIO, spool: BinaryIO, version: int = 3) -> None:
    """As build, into a file; payloads wait in the spool file, so that memory holds the directory alone."""
    draft, at = Draft(), 0
    draft.version = version
    for path, data in streams:
        data = data or b""
        spool.write(data)
        draft.make(path, Stored(spool, at, len(data)))
        at += len(data)
    write(draft, out)
    for item in draft.by_path.values():
        item.parent = None  # else the items wait for the collector of cycles


@dataclass(frozen=True)
class Outcome:
    content: bytes
    bytes_written: int
    strategy: str


def commit(draft: Draft, incremental: bool = False) -> Outcome:
    """The new content. In place only where at most one stream changed and nothing else did; else a full rewrite."""
    if incremental and draft.base is not None and not draft.changed and len(draft.touched) <= 1:
        done = _in_place(draft)
        if done is not None:
            return done
    try:
        content = serialize(draft)
        Container(content, True)
    except Problem as p:
        raise Problem(X.COMMIT_FAILED, "serialize failed", "tx.commit", p.path) from p
    return Outcome(content, len(content), "full_rewrite")


def _in_place(draft: Draft) -> Outcome | None:
    base, out, written = draft.base, bytearray(draft.base.content), 0
    size = base.header.sector
    for item in draft.touched.values():
        data, e = item.data, base.nodes[item.entry.id].entry
        if data is None or len(data) != e.size:
            return None
        try:
            if not data:
                places = []
            elif e.size < X.MINI_CUTOFF:
                holder = follow(base.fat, base.entries[0].start, base.limits.chain)
                minis = follow(base.minifat, e.start, base.limits.chain)[: -(-len(data) // 64)]
                places = [((holder[m * 64 // size] + 1) * size + m * 64 % size, 64) for m in minis]
            else:
                places = [((s + 1) * size, size) for s in follow(base.fat, e.start, base.limits.chain)[: -(-len(data) // size)]]
        except (Problem, IndexError):
            return None
        if sum(n for _, n in places) < len(data) or any(at + n > len(out) for at, n in places):
            return None
        at_data = 0
        for at, n in places:
            part = data[at_data : at_data + n]
            out[at : at + len(part)] = part
            at_data += n
        written += len(data)
    return Outcome(bytes(out), written, "incremental")


def apply(content: bytes | None, operations, incremental: bool = False, limits: Limits = Limits()) -> Outcome:
    """One transaction: every operation (a mapping with op, path, new_path, data) or, on the first Problem, none.

    put, delete, rename, mkdir. A null content is an empty container.
    """
    draft = Draft(Container(content, True, limits) if content is not None else None)
    for o in operations or ():
        op, path = o["op"], o["path"] or ""
        if op == "put":
            draft.put(path, o["data"] or b"")
        elif op == "delete":
            draft.delete(path)
        elif op == "rename":
            draft.rename(path, o["new_path"] or "")
        elif op == "mkdir":
            draft.mkdir(path)
        else:
            raise Problem(X.INVALID_ARGUMENT, f"unknown operation: {op}", "tx.apply", path)
    return commit(draft, incremental)


__all__ = ["Draft", "Outcome", "apply", "build", "build_file", "commit", "serialize", "table_sectors", "write"]
