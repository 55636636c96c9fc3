"""Files on any store that ``pyarrow.fs`` knows, by path or URI."""

from __future__ import annotations

from urllib.parse import urlparse

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri) if len(urlparse(uri).scheme) > 1 else (fs.LocalFileSystem(), uri)


def listed(uri: str, extensions: tuple[str, ...]) -> list[str]:
    """The files of a folder (not of those in it) that end so, by name; of anything else but a folder the path itself."""
    system, path = locate(uri)
    if system.get_file_info(path).type != fs.FileType.Directory:
        return [uri]
    found = system.get_file_info(fs.FileSelector(path))
    return [f"{uri.rstrip('/')}/{f.base_name}" for f in sorted(found, key=lambda f: f.base_name) if f.is_file and f.base_name.lower().endswith(extensions)]
