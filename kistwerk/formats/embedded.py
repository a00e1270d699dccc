"""Recognition of embedded objects and images."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from . import fixed as X


@dataclass(frozen=True)
class Native:
    file_name: str
    source_path: str
    temp_path: str
    payload: bytes


@dataclass(frozen=True)
class Detection:
    kind: str = "unknown"
    confidence: float = 0.0
    file_name: str = ""
    source_path: str = ""
    user_type: str = ""
    prog_id: str = ""
    payload_size: int = 0


def c_strings(data: bytes, at: int, most: int) -> tuple[list[str], int]:
    """Up to ``most`` zero-ended strings from ``at``, and where they end; invalid UTF-8 is replaced."""
    out = []
    while len(out) < most:
        end = data.find(b"\0", at) if at < len(data) else -1
        if end < 0:
            break
        out.append(data[at:end].decode("utf-8", "replace"))
        at = end + 1
    return out, at


def native_object(data: bytes) -> Native | None:
    """Total size (not zero), flag, three strings, payload size, payload."""
    if len(data) < 16 or data[:4] == b"\0\0\0\0":
        return None
    names, at = c_strings(data, 6, 3)
    if len(names) < 3 or at + 4 > len(data):
        return None
    (size,) = struct.unpack_from("<I", data, at)
    return Native(*names, data[at + 4 : at + 4 + size]) if size <= len(data) - at - 4 else None


def component_object(data: bytes) -> tuple[str, str] | None:
    """User type and program id, from the strings after 28 bytes."""
    names, _ = c_strings(data, 28, 3) if len(data) >= 28 else ([], 0)
    if len(names) < 2:
        return None
    ids = [s for s in [*names[2:], names[1], names[0]] if "." in s and " " not in s]
    return (names[0], ids[0] if ids else "") if names[0] or ids else None


def detect(path: str, head: bytes) -> Detection:
    """By the stream's base name, else by its first bytes."""

    def native(confidence: float) -> Detection | None:
        n = native_object(head)
        return n and Detection("ole10native", confidence, n.file_name, n.source_path, payload_size=len(n.payload))

    def component(confidence: float) -> Detection | None:
        c = component_object(head)
        return c and Detection("compobj", confidence, user_type=c[0], prog_id=c[1])

    base = path.rstrip("/").rpartition("/")[2].lower()
    if base == "\x01ole10native":
        return native(0.95) or Detection("ole10native", 0.5)
    if base in ("\x01compobj", "compobj"):
        return component(0.85) or Detection("compobj", 0.4)
    if base == "package":
        return Detection("package", 0.9)
    return native(0.8) or component(0.65) or (Detection("package", 0.4) if head.startswith(b"PK\x03\x04") else Detection())


def image_type(head: bytes) -> str:
    """Media type, or nothing."""
    for media, magic in X.IMAGE_MAGIC:
        if head.startswith(magic):
            return media
    return "image/webp" if head[:4] == b"RIFF" and head[8:12] == b"WEBP" else ""
