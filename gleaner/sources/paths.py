"""Files behind paths and URIs, for sources and sinks that open them in Python; any file system that pyarrow knows."""

from __future__ import annotations

import os
import re

from pyarrow import fs


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it.  ``file:/x``, as Hadoop writes it, is ``file:///x``."""
    if not re.match(r"[a-z][a-z0-9+.-]*:", path):
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def listed(path: str, suffix: str = "") -> list[fs.FileInfo]:
    """Files below a folder (or the one file), by path; hidden ones and those of another ending don't count."""
    system, at = resolve(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    shown = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")) and f.path.endswith(suffix)]
    return sorted(shown, key=lambda f: f.path)


def packed(files: list[fs.FileInfo], most: int) -> list[list[tuple[str, int]]]:
    """(path, size) of files, in groups of about ``most`` bytes; a larger file is a group of its own."""
    out: list[list[tuple[str, int]]] = []
    room = 0
    for f in files:
        if not out or f.size > room:
            out.append([])
            room = most
        out[-1].append((f.path, f.size))
        room -= f.size
    return out
