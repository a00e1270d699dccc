"""Property-set streams: parse, change and marshal."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from . import fixed as X
from .container import wide_text


class PropertyError(ValueError):
    pass


@dataclass(frozen=True)
class Property:
    """value: int, bool, str, bytes, a FILETIME as ticks (int), or None. raw: tag, value and padding as read."""

    id: int
    type: int
    value: object = None
    raw: bytes = b""


@dataclass
class PropertySet:
    format_id: str = ""
    properties: dict[int, Property] = field(default_factory=dict)

    def put(self, pid: int, value: object, vt: int | None = None) -> None:
        """Without a type: str is LPWSTR, bool BOOL, int I8, datetime FILETIME."""
        if vt is None:
            vt = X.VT_BOOL if isinstance(value, bool) else X.VT_LPWSTR if isinstance(value, str) else X.VT_FILETIME if isinstance(value, datetime) else X.VT_I8
        if isinstance(value, datetime):
            value = filetime(value)
        self.properties[pid] = Property(pid, vt, value)

    def delete(self, pid: int) -> None:
        self.properties.pop(pid, None)


@dataclass
class PropertyStream:
    version: int = 0
    system_id: int = 0
    clsid: bytes = bytes(16)
    sets: list[PropertySet] = field(default_factory=list)
    byte_order: int = X.BYTE_ORDER

    def find(self, format_id: str) -> PropertySet | None:
        return next((s for s in self.sets if s.format_id == format_id.lower()), None)


_INTS = {X.VT_I2: ("<h", "VT_I2"), X.VT_I4: ("<i", "VT_I4"), X.VT_UI4: ("<I", "VT_UI4"), X.VT_I8: ("<q", "VT_I8"), X.VT_UI8: ("<Q", "VT_UI8"), X.VT_FILETIME: ("<Q", "VT_FILETIME")}


def guid_text(raw: bytes) -> str:
    a, b, c = struct.unpack_from("<IHH", raw)
    return f"{a:08x}-{b:04x}-{c:04x}-{raw[8:10].hex()}-{raw[10:16].hex()}"


def guid_bytes(text: str) -> bytes:
    a, b, c, d, e = text.split("-")
    return struct.pack("<IHH", int(a, 16), int(b, 16), int(c, 16)) + bytes.fromhex(d + e)


def filetime(t: datetime) -> int:
    """Ticks of 100 ns since 1601; a time without a zone is UTC."""
    t = t if t.tzinfo else t.replace(tzinfo=UTC)
    d = t - datetime(1970, 1, 1, tzinfo=UTC)
    return (d.days * 86400 + d.seconds + X.FILETIME_EPOCH) * 10_000_000 + d.microseconds * 10


def from_filetime(ticks: int) -> datetime | None:
    """To the microsecond; None beyond what datetime holds."""
    try:
        return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=ticks // 10_000_000 - X.FILETIME_EPOCH, microseconds=ticks % 10_000_000 // 10)
    except OverflowError:
        return None


def typed_value(raw: bytes) -> tuple[int, object]:
    if len(raw) < 4:
        raise PropertyError("typed value too small")
    (vt,) = struct.unpack_from("<H", raw)
    if vt == X.VT_EMPTY:
        return vt, None
    if vt in _INTS:
        fmt, name = _INTS[vt]
        if len(raw) < 4 + struct.calcsize(fmt):
            raise PropertyError(f"{name} too small")
        return vt, struct.unpack_from(fmt, raw, 4)[0]
    if vt == X.VT_BOOL:
        if len(raw) < 6:
            raise PropertyError("VT_BOOL too small")
        return vt, raw[4:6] != b"\0\0"
    if vt in (X.VT_LPSTR, X.VT_LPWSTR):
        name, unit = ("VT_LPSTR", 1) if vt == X.VT_LPSTR else ("VT_LPWSTR", 2)
        if len(raw) < 8:
            raise PropertyError(f"{name} too small")
        size = struct.unpack_from("<I", raw, 4)[0] * unit
        if 8 + size > len(raw):
            raise PropertyError(f"{name} length out of bounds")
        body = raw[8 : 8 + size]
        if unit == 1:
            return vt, body.rstrip(b"\0").decode("utf-8", "replace")
        return vt, wide_text(body[:-2] if body[-2:] == b"\0\0" else body)
    return vt, raw[4:]


def _set(data: bytes, at: int) -> PropertySet:
    if at + 8 > len(data):
        raise PropertyError(f"set offset out of bounds: {at}")
    size, count = struct.unpack_from("<II", data, at)
    if size < 8:
        raise PropertyError(f"invalid section size: {size}")
    if at + size > len(data):
        raise PropertyError("section size out of bounds")
    section = data[at : at + size]
    if 8 + count * 8 > size:
        raise PropertyError("property table truncated")
    table = [struct.unpack_from("<II", section, 8 + 8 * i) for i in range(count)]
    for pid, off in table:
        if not 8 <= off < size:
            raise PropertyError(f"property offset out of bounds: id={pid} off={off}")
    table.sort(key=lambda x: (x[1], x[0]))
    out = PropertySet()
    for (pid, off), end in zip(table, [*(o for _, o in table[1:]), size], strict=False):
        try:
            vt, value = typed_value(section[off:end])
        except PropertyError as e:
            raise PropertyError(f"property id {pid}: {e}") from None
        out.properties[pid] = Property(pid, vt, value, section[off:end])
    return out


def parse(data: bytes) -> PropertyStream:
    if len(data) < 28:
        raise PropertyError("property set stream too small")
    order, version, system, clsid, count = struct.unpack_from("<HHI16sI", data)
    if order != X.BYTE_ORDER:
        raise PropertyError(f"invalid byte order: 0x{order:04X}")
    if len(data) < 28 + count * 20:
        raise PropertyError("property set table truncated")
    out = PropertyStream(version, system, clsid)
    for i in range(count):
        fmtid, at = struct.unpack_from("<16sI", data, 28 + 20 * i)
        try:
            s = _set(data, at)
        except PropertyError as e:
            raise PropertyError(f"parse set[{i}] at {at}: {e}") from None
        s.format_id = guid_text(fmtid)
        out.sets.append(s)
    return out


def _typed_bytes(p: Property) -> bytes:
    if len(p.raw) >= 4:
        return p.raw
    tag, v = struct.pack("<HH", p.type, 0), p.value
    is_int = isinstance(v, int) and not isinstance(v, bool)
    if p.type == X.VT_EMPTY:
        return tag
    if p.type in _INTS:
        fmt, name = _INTS[p.type]
        try:
            return tag + struct.pack(fmt, v if is_int else None)
        except struct.error:
            raise PropertyError(f"{name} expects an integer in range") from None
    if p.type == X.VT_BOOL and isinstance(v, bool):
        return tag + (b"\xff\xff" if v else b"\0\0")
    if p.type == X.VT_LPSTR and isinstance(v, str):
        raw = v.encode() + b"\0"
        return tag + struct.pack("<I", len(raw)) + raw
    if p.type == X.VT_LPWSTR and isinstance(v, str):
        raw = v.encode("utf-16-le") + b"\0\0"
        return tag + struct.pack("<I", len(raw) // 2) + raw
    if isinstance(v, bytes) and p.type not in (X.VT_BOOL, X.VT_LPSTR, X.VT_LPWSTR):
        return tag + v
    raise PropertyError(f"unsupported type 0x{p.type:04X} without raw bytes")


def marshal(stream: PropertyStream) -> bytes:
    """Properties by id, each on a multiple of four bytes; raw bytes win over the typed value."""
    sections = []
    for i, s in enumerate(stream.sets):
        table, body, at = b"", b"", 8 + 8 * len(s.properties)
        for pid in sorted(s.properties):
            try:
                raw = _typed_bytes(s.properties[pid])
            except PropertyError as e:
                raise PropertyError(f"marshal set[{i}]: property {pid}: {e}") from None
            body += bytes(-(at + len(body)) % 4)
            table += struct.pack("<II", pid, at + len(body))
            body += raw
        sections.append(struct.pack("<II", 8 + len(table) + len(body), len(s.properties)) + table + body)
    head = struct.pack("<HHI16sI", stream.byte_order or X.BYTE_ORDER, stream.version, stream.system_id, stream.clsid, len(sections))
    at = 28 + 20 * len(sections)
    for s, raw in zip(stream.sets, sections, strict=True):
        head += guid_bytes(s.format_id) + struct.pack("<I", at)
        at += len(raw)
    return head + b"".join(sections)
