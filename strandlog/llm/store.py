"""Files in the shared folder, written and read by tasks.

A task writes each file under a name of its own attempt and returns the name as a row; only rows of committed tasks
reach the manifest, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs


def _open(uri: str):
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _norm(uri: str) -> str:
    return "file://" + uri[len("file:") :] if uri.startswith("file:") and not uri.startswith("file://") else uri


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a file or folder, and its path there."""
    return _open(_norm(uri))


def put(folder: str, suffix: str, data: bytes) -> str:
    """Write a file of a new name into the folder; returns its URI."""
    folder = _norm(folder)
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    with system.open_output_stream(posixpath.join(path, name), compression=None) as out:
        out.write(data)
    return f"{folder}/{name}"


def get(uri: str) -> bytes:
    system, path = _open(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.read()
