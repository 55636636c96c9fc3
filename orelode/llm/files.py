"""Binary files in the shared folder, written and read by tasks, on any store that ``pyarrow.fs`` knows.

A task writes under a name of its own and reports it in its result; only files that a finished task has reported are
ever read, so attempts that failed or ran twice leave nothing but unread files.
"""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    if not urlparse(uri).scheme:
        uri = "file://" + uri
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def write_file(folder: str, suffix: str, data: bytes) -> str:
    """Write ``data`` to a new file of ``folder``; returns its URI."""
    system, path = locate(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    with system.open_output_stream(f"{path}/{name}", compression=None) as out:
        out.write(data)
    return f"{folder}/{name}"


def open_file(uri: str):
    system, path = locate(uri)
    return system.open_input_file(path)
