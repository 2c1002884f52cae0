"""Files by path or URI, for readers that Spark has no format for.

A plain path or file:// is local; other schemes go to pyarrow's file systems (S3,
GCS, HDFS and what `register` adds).  Readers open files where their tasks run, read
the bytes that they need, and keep nothing.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Callable

from pyarrow import fs

_MADE: dict[str, Callable[[str], tuple[fs.FileSystem, str]]] = {}


def register(scheme: str, make: Callable[[str], tuple[fs.FileSystem, str]]) -> None:
    """Make the file system and the path in it for URIs of a scheme; call it where files are opened."""
    _MADE[scheme] = make


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path within it."""
    scheme, found, _ = str(uri).partition("://")
    if not found:
        plain = str(uri)
        return fs.LocalFileSystem(), plain.removeprefix("file:") if plain.startswith("file:/") else plain
    return _MADE[scheme](uri) if scheme in _MADE else fs.FileSystem.from_uri(uri)


def _named_like(uri: str, path: str) -> str:
    """The path as the caller wrote URIs: with the scheme and host it came with."""
    scheme, found, rest = str(uri).partition("://")
    if not found:
        return path
    inner = located(uri)[1]
    return f"{scheme}://{rest[: len(rest) - len(inner)]}{path}" if rest.endswith(inner) else f"{scheme}://{path}"


def opened(uri: str):
    """A seekable binary file."""
    system, path = located(uri)
    return system.open_input_file(path)


def exists(uri: str) -> bool:
    system, path = located(uri)
    return system.get_file_info(path).type != fs.FileType.NotFound


def listed(folder: str, pattern: str = "*") -> list[str]:
    """What lies in the folder under names of the pattern, sorted; nothing if there is no such folder."""
    system, path = located(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(_named_like(folder, x.path) for x in found if fnmatch.fnmatchcase(x.base_name, pattern))


def expanded(pattern: str) -> list[str]:
    """The pattern's files: * and ? in the last part of the path."""
    folder, _, name = str(pattern).rpartition("/")
    if not any(c in name for c in "*?["):
        return [str(pattern)]
    return listed(folder or ".", name)


def text_of(uri: str) -> bytes:
    """A small file, whole."""
    with opened(uri) as f:
        return f.read()
