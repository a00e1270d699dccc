"""Reading of containers: header, allocation tables, directory and streams."""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from . import fixed as X
from .paths import Problem, canonical, join


@dataclass(frozen=True)
class Limits:
    """0 means no limit."""

    total_bytes: int = 0
    stream_bytes: int = 0
    objects: int = 0
    recursion: int = 0
    chain: int = 0


@dataclass(slots=True)
class Entry:
    id: int
    name: str
    kind: int
    left: int = X.NO_STREAM
    right: int = X.NO_STREAM
    child: int = X.NO_STREAM
    clsid: bytes = bytes(16)
    state_bits: int = 0
    created_at: int = 0
    modified_at: int = 0
    start: int = X.END_OF_CHAIN
    size: int = 0


@dataclass(slots=True)
class Node:
    entry: Entry
    path: str
    parent_id: int = 0
    depth: int = 0
    children: list[int] = field(default_factory=list)

    @property
    def type(self) -> str:
        return X.KIND_NAMES.get(self.entry.kind, "")


def wide_text(raw: bytes) -> str:
    """UTF-16LE; a surrogate without its partner becomes U+FFFD."""
    return re.sub("[\ud800-\udfff]", "�", raw[: len(raw) // 2 * 2].decode("utf-16-le", "surrogatepass"))


_HEADER = struct.Struct("<8s16s5H6s9I")


@dataclass(frozen=True)
class Header:
    signature: bytes
    clsid: bytes
    minor_version: int
    major_version: int
    byte_order: int
    sector_shift: int
    mini_shift: int
    reserved: bytes
    dir_sectors: int
    fat_sectors: int
    first_dir: int
    transaction: int
    mini_cutoff: int
    first_minifat: int
    minifat_sectors: int
    first_difat: int
    difat_sectors: int
    difat: tuple[int, ...] = ()

    @property
    def sector(self) -> int:
        return 1 << self.sector_shift


def read_header(content: bytes) -> Header:
    if len(content) < X.HEADER_SIZE:
        raise Problem(X.BAD_HEADER, "file is smaller than CFB header", "parse.header")
    h = Header(*_HEADER.unpack_from(content), difat=struct.unpack_from(f"<{X.DIFAT_SLOTS}I", content, 76))
    zero = next((i for i, b in enumerate(h.reserved) if b), None)
    # What is checked, in this order, with message and offset.
    checks = (
        (h.signature == X.SIGNATURE, "invalid CFB signature", 0),
        (h.byte_order == X.BYTE_ORDER, f"unexpected byte order: 0x{h.byte_order:04X}", 28),
        (h.mini_shift == X.MINI_SHIFT, f"unexpected mini sector shift: {h.mini_shift}", 32),
        (h.mini_cutoff == X.MINI_CUTOFF, f"unexpected mini stream cutoff: {h.mini_cutoff}", 56),
        (zero is None, "reserved bytes must be zero", 34 + (zero or 0)),
        (h.major_version in X.SECTOR_SHIFT, f"unsupported major version: {h.major_version}", 26),
        (h.major_version != 3 or h.sector_shift == 9, "v3 header must use 512-byte sectors", 30),
        (h.major_version != 3 or h.dir_sectors == 0, "v3 header must set directory sectors to zero", 40),
        (h.major_version != 4 or h.sector_shift == 12, "v4 header must use 4096-byte sectors", 30),
    )
    for ok, message, offset in checks:
        if not ok:
            raise Problem(X.BAD_HEADER, message, "parse.header.validate", "", offset)
    return h


def follow(table: array, start: int, most: int) -> list[int]:
    """The chain from start; every link is checked for limit, bounds and cycles, in this order."""
    if start == X.END_OF_CHAIN:
        return []
    if not table:
        raise Problem(X.BAD_FAT_CHAIN, "fat table is empty", "fat.walk")
    chain, seen, at = [], set(), start
    while at != X.END_OF_CHAIN:
        if chain and at in (X.FREE, X.FAT_SECTOR, X.DIFAT_SECTOR):
            raise Problem(X.BAD_FAT_CHAIN, "fat chain points to free sector" if at == X.FREE else "fat chain points to reserved sector type", "fat.walk")
        if 0 < most <= len(chain):
            raise Problem(X.LIMIT_EXCEEDED, "fat chain length exceeded limit", "fat.walk")
        if at >= len(table):
            raise Problem(X.OUT_OF_BOUNDS, f"fat entry out of bounds: {at}", "fat.walk")
        if at in seen:
            raise Problem(X.CYCLE_DETECTED, "cycle detected in fat chain", "fat.walk")
        seen.add(at)
        chain.append(at)
        at = table[at]
    return chain


def _name(raw: bytes, length: int) -> str:
    if length == 0:
        return ""
    if length > len(raw) or length < 2 or length % 2:
        raise ValueError(f"invalid directory name length: {length}")
    return wide_text(raw[: length - 2])


def read_entry(number: int, raw: bytes) -> Entry:
    length, kind, left, right, child = struct.unpack_from("<HBxIII", raw, 64)
    state, created, modified, start, size = struct.unpack_from("<IqqIq", raw, 96)
    return Entry(number, _name(raw[:64], length), kind, left, right, child, bytes(raw[80:96]), state, created, modified, start, size)


class Container:
    """A parsed container of bytes, or of a file's map. ``strict``: the first problem is raised; else it becomes a warning and the part is left out."""

    def __init__(self, content: bytes, strict: bool = False, limits: Limits = Limits()):
        if 0 < limits.total_bytes < len(content):
            raise Problem(X.QUOTA_EXCEEDED, "file size exceeds configured MaxTotalBytes", "open")
        self.content, self.strict, self.limits = content, strict, limits
        self.warnings: list[Problem] = []
        self.header = read_header(content)
        self.fat = self._or(self._load_fat, array("I"))
        root = self._or(self._load_root, self._bare_root())
        self.entries: list[Entry] = self._or(self._load_entries, [])
        self.nodes: dict[int, Node] = {0: Node(root, "/")}  # in depth-first order
        if self.entries:
            self.nodes = self._or(self._load_tree, self.nodes)
        self.minifat, self.mini = self._or(self._load_mini, (array("I"), b""))
        self._by_path: dict[str, Node] = {}
        for n in self.nodes.values():
            self._by_path.setdefault(n.path.lower(), n)

    @property
    def partial(self) -> bool:
        return bool(self.warnings)

    def _or(self, step: Callable, instead):
        try:
            return step()
        except Problem as p:
            if self.strict:
                raise
            self.warnings.append(p)
            return instead

    @staticmethod
    def _bare_root() -> Entry:
        return Entry(0, X.ROOT_NAME, X.ROOT)

    def _sector(self, number: int, what: str, op: str) -> memoryview:
        at, size = (number + 1) * self.header.sector, self.header.sector
        if at + size > len(self.content):
            raise Problem(X.OUT_OF_BOUNDS, what, op, "", at)
        return memoryview(self.content)[at : at + size]

    def _load_fat(self) -> array:
        table = array("I")
        if not self.header.fat_sectors:
            return table
        for number in self._fat_sectors():
            table.frombytes(self._sector(number, f"fat sector {number} out of bounds", "parse.fat"))
        return table

    def _fat_sectors(self) -> list[int]:
        h, op = self.header, "parse.fat"
        found = [x for x in h.difat if x != X.FREE][: h.fat_sectors]
        if len(found) < h.fat_sectors and (not h.difat_sectors or h.first_difat == X.END_OF_CHAIN):
            raise Problem(X.BAD_HEADER, "not enough FAT sector ids in DIFAT header", op)
        at, seen = h.first_difat, set()
        while len(found) < h.fat_sectors:
            if len(seen) == h.difat_sectors:
                raise Problem(X.BAD_HEADER, "difat chain does not provide enough fat sectors", op)
            if at == X.END_OF_CHAIN:
                raise Problem(X.BAD_HEADER, "difat chain ended early", op)
            if at in seen:
                raise Problem(X.CYCLE_DETECTED, "cycle detected in difat chain", op)
            seen.add(at)
            *ids, at = struct.unpack(f"<{h.sector // 4}I", self._sector(at, "difat sector out of bounds", op))
            found += [x for x in ids if x != X.FREE]
        return found[: h.fat_sectors]

    def _load_root(self) -> Entry:
        h, op = self.header, "parse.root"
        if h.first_dir == X.END_OF_CHAIN:
            return self._bare_root()
        at = (h.first_dir + 1) * h.sector
        if at + X.ENTRY_SIZE > len(self.content):
            raise Problem(X.OUT_OF_BOUNDS, "directory entry offset is out of file bounds", op, "/", at)
        try:
            root = read_entry(0, self.content[at : at + X.ENTRY_SIZE])
        except ValueError as e:
            raise Problem(X.DIR_CORRUPT, str(e), op, "/", at) from None
        if root.kind != X.ROOT:
            raise Problem(X.DIR_CORRUPT, f"unexpected root object type: {root.kind}", op, "/", at + 66)
        return replace(root, name=root.name or X.ROOT_NAME)

    def _load_entries(self) -> list[Entry]:
        h, op = self.header, "parse.dir.entries"
        if h.first_dir == X.END_OF_CHAIN:
            return []
        sectors = [h.first_dir]  # without a FAT the directory is one sector
        if self.fat:
            try:
                sectors = follow(self.fat, h.first_dir, self.limits.chain)
            except Problem:
                raise Problem(X.BAD_FAT_CHAIN, "failed to resolve directory chain", op) from None
        raw = b"".join(self._sector(s, "directory sector out of bounds", op) for s in sectors)
        out = []
        for at in range(0, len(raw), X.ENTRY_SIZE):
            try:
                out.append(read_entry(len(out), raw[at : at + X.ENTRY_SIZE]))
            except ValueError as e:
                raise Problem(X.DIR_CORRUPT, str(e), op, "", at) from None
        return out

    def _load_tree(self) -> dict[int, Node]:
        op, entries = "parse.dir.tree", self.entries
        if entries[0].kind != X.ROOT:
            raise Problem(X.DIR_CORRUPT, f"unexpected root object type: {entries[0].kind}", op, "/")
        nodes = {0: Node(replace(entries[0], name=entries[0].name or X.ROOT_NAME), "/")}
        # (entry, parent, siblings met so far, whether its left side is done); siblings in order, children before the right side
        todo: list[tuple[int, Node, set[int], bool]] = []

        def level(first: int, parent: Node) -> None:
            if first == X.NO_STREAM:
                return
            if 0 < self.limits.recursion < parent.depth + 1:
                raise Problem(X.DEPTH_EXCEEDED, "directory recursion depth exceeded", op, parent.path)
            todo.append((first, parent, set(), False))

        level(entries[0].child, nodes[0])
        while todo:
            number, parent, met, left_done = todo.pop()
            if not left_done:
                if number == X.NO_STREAM:
                    continue
                if number >= len(entries):
                    raise Problem(X.OUT_OF_BOUNDS, f"directory id out of bounds: {number}", op, parent.path)
                if number in met:
                    raise Problem(X.CYCLE_DETECTED, "cycle detected in directory siblings", op, parent.path)
                met.add(number)
                todo += [(number, parent, met, True), (entries[number].left, parent, met, False)]
                continue
            e = entries[number]
            todo.append((e.right, parent, met, False))
            if e.kind not in (X.STORAGE, X.STREAM):
                continue
            if number in nodes:
                raise Problem(X.CYCLE_DETECTED, "directory entry reused in tree", op, parent.path)
            try:
                path = join(parent.path, e.name)
            except Problem:
                raise Problem(X.DIR_CORRUPT, "failed to build node path", op, parent.path) from None
            nodes[number] = node = Node(e, path, parent.entry.id, parent.depth + 1)
            if 0 < self.limits.objects < len(nodes):
                raise Problem(X.LIMIT_EXCEEDED, "object count exceeded limit", op, parent.path)
            parent.children.append(number)
            if e.kind == X.STORAGE:
                level(e.child, node)
        return nodes

    def _load_mini(self) -> tuple[array, bytes | memoryview]:
        h, op, table = self.header, "parse.minifat", array("I")
        if not h.minifat_sectors or h.first_minifat == X.END_OF_CHAIN:
            return table, b""
        if not self.fat:
            raise Problem(X.BAD_FAT_CHAIN, "fat table is empty", op)
        try:
            chain = follow(self.fat, h.first_minifat, self.limits.chain)
        except Problem:
            raise Problem(X.BAD_FAT_CHAIN, "failed to resolve mini fat chain", op) from None
        if len(chain) < h.minifat_sectors:
            raise Problem(X.BAD_FAT_CHAIN, f"mini fat chain too short: have {len(chain)} need {h.minifat_sectors}", op)
        for s in chain[: h.minifat_sectors]:
            table.frombytes(self._sector(s, "mini fat sector out of bounds", op))
        if not self.entries:
            raise Problem(X.DIR_CORRUPT, "missing root entry for mini stream", "parse.ministream", "/")
        root = self.entries[0]
        if root.start == X.END_OF_CHAIN or root.size == 0:
            return table, b""
        try:
            return table, self._regular(root, view=True)
        except Problem:
            raise Problem(X.MINISTREAM_CORRUPT, "failed to read root mini stream", "parse.ministream", "/") from None

    def _regular(self, e: Entry, view: bool = False) -> bytes | memoryview:
        """The bytes; with ``view``, where its sectors follow one another, a view of the content instead of a copy."""
        op, sector = "stream.read", self.header.sector
        if e.size == 0:
            return b""
        try:
            chain = follow(self.fat, e.start, self.limits.chain)
        except Problem:
            raise Problem(X.BAD_FAT_CHAIN, "failed to resolve stream chain", op) from None
        if not chain:
            raise Problem(X.BAD_FAT_CHAIN, "stream chain is empty", op)
        need = -(-e.size // sector)
        if e.size < 0 or len(chain) < need:
            raise Problem(X.BAD_FAT_CHAIN, f"stream chain too short: have {len(chain)} need {need}", op)
        parts, at = [], 0
        while at < need:
            end = at + 1
            while end < need and chain[end] == chain[end - 1] + 1:
                end += 1
            if (chain[end - 1] + 2) * sector > len(self.content):
                for s in chain[at:end]:
                    self._sector(s, "stream sector out of bounds", op)
            parts.append(memoryview(self.content)[(chain[at] + 1) * sector : (chain[end - 1] + 2) * sector])
            at = end
        return parts[0][: e.size] if view and len(parts) == 1 else b"".join(parts)[: e.size]

    def _small(self, e: Entry) -> bytes:
        op, sector = "stream.read.mini", 1 << X.MINI_SHIFT
        for table, message in ((self.minifat, "mini fat table is empty"), (self.mini, "mini stream is empty")):
            if not table:
                raise Problem(X.MINISTREAM_CORRUPT, message, op)
        try:
            chain = follow(self.minifat, e.start, self.limits.chain)
        except Problem:
            raise Problem(X.MINISTREAM_CORRUPT, "failed to resolve mini stream chain", op) from None
        if not chain:
            raise Problem(X.MINISTREAM_CORRUPT, "mini stream chain is empty", op)
        need = -(-e.size // sector)
        if len(chain) < need:
            raise Problem(X.MINISTREAM_CORRUPT, f"mini chain too short: have {len(chain)} need {need}", op)
        parts = []
        for s in chain[:need]:
            if (s + 1) * sector > len(self.mini):
                raise Problem(X.OUT_OF_BOUNDS, "mini stream sector out of bounds", op, "", s * sector)
            parts.append(self.mini[s * sector : (s + 1) * sector])
        return b"".join(parts)[: e.size]

    def find(self, path: str) -> Node | None:
        """By path, whatever its case; the first in depth-first order."""
        return self._by_path.get(path.lower())

    def read(self, path: str) -> bytes:
        op = "open_stream"
        if not path:
            raise Problem(X.INVALID_ARGUMENT, "path is empty", op, path)
        path = canonical(path)
        node = self.find(path)
        if node is None:
            raise Problem(X.NOT_FOUND, "path not found", op, path)
        return self.read_node(node, path)

    def read_node(self, node: Node, path: str) -> bytes:
        op, e = "open_stream", node.entry
        if e.kind != X.STREAM:
            raise Problem(X.INVALID_ARGUMENT, "path is not a stream", op, path)
        if e.size < 0:
            raise Problem(X.DIR_CORRUPT, "negative stream size", op, path)
        if 0 < self.limits.stream_bytes < e.size:
            raise Problem(X.LIMIT_EXCEEDED, "stream size exceeds configured MaxStreamBytes", op, path)
        if e.size == 0:
            return b""
        if e.size < X.MINI_CUTOFF:
            return self._small(e)
        if not self.fat:
            raise Problem(X.BAD_FAT_CHAIN, "fat table is empty", op, path)
        if e.start == X.END_OF_CHAIN:
            raise Problem(X.BAD_FAT_CHAIN, "stream has data size but no sector chain", op, path)
        return self._regular(e)

    def breadth_first(self) -> list[int]:
        out = [0]
        for number in out:
            out += self.nodes[number].children
        return out
