"""Paths inside a container: ``/`` between segments, ``~0`` for ``~`` and ``~1`` for ``/`` inside one."""

from __future__ import annotations

import re

from . import fixed as X


class Problem(Exception):
    """An error as data: code, message, op, path, offset (-1: none)."""

    def __init__(self, code: str, message: str, op: str, path: str = "", offset: int = -1):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.op, self.path, self.offset = code, message, op, path, offset

    def __str__(self) -> str:
        at = f" off={self.offset}" if self.offset >= 0 else ""
        return f"{self.code}: {self.message}" + (f" path={self.path}" if self.path else "") + at + (f" op={self.op}" if self.op else "")

    def row(self) -> dict:
        return {"code": self.code, "message": self.message, "path": self.path, "offset": self.offset, "op": self.op}


def encode_segment(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


def decode_segment(segment: str) -> str:
    """Raises ValueError on a tilde that starts no escape."""
    if re.search("~(?![01])", segment):
        raise ValueError("invalid escape")
    return re.sub("~[01]", lambda m: "~" if m[0] == "~0" else "/", segment)


def canonical(path: str) -> str:
    def bad(message: str) -> Problem:
        return Problem(X.INVALID_ARGUMENT, message, "path.parse", path)

    if path == "/":
        return path
    if not path:
        raise bad("path is empty")
    if path[0] != "/":
        raise bad("path must start with /")
    if path[-1] == "/":
        raise bad("path must not end with /")
    for segment in path[1:].split("/"):
        if not segment:
            raise bad("path has empty segment")
        try:
            name = decode_segment(segment)
        except ValueError:
            raise bad("invalid path escape") from None
        if len(name) > X.LONGEST_NAME:
            raise bad("path segment exceeds 31 chars")
    if len(path.encode("utf-8", "surrogatepass")) > X.LONGEST_PATH:
        raise bad("path exceeds 4096 bytes")
    return path


def join(parent: str, name: str) -> str:
    parent, name = canonical(parent), name.strip()
    if not name or len(name) > X.LONGEST_NAME:
        raise Problem(X.INVALID_ARGUMENT, "name exceeds 31 chars" if name else "name is empty", "path.join", parent)
    return canonical(("" if parent == "/" else parent) + "/" + encode_segment(name))


def parent_of(path: str) -> str:
    return path[: path.rfind("/")] or "/" if "/" in path[1:] else "/"


def base_name(path: str) -> str:
    if path == "/":
        return path
    try:
        return decode_segment(path[path.rfind("/") + 1 :]) if "/" in path else ""
    except ValueError:
        return ""
