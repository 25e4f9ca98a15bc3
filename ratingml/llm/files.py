"""Binary files in the shared folder, opened by tasks through Arrow's file systems.

A task writes to a name that no other attempt uses and returns it; only names that a
finished task returned are read. So a lost or repeated task leaves at most a file
that nothing refers to.
"""

from __future__ import annotations

import uuid
from typing import BinaryIO

from pyarrow import fs


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    # file:/a is how Hadoop writes a local path
    return fs.FileSystem.from_uri("file:///" + uri[6:].lstrip("/") if uri.startswith("file:/") else uri)


def new_name(folder: str, stem: str, ending: str) -> str:
    return f"{folder.rstrip('/')}/{stem}-{uuid.uuid4().hex}.{ending}"


def create(uri: str) -> BinaryIO:
    where, path = _place(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    return where.open_output_stream(path, compression=None, buffer_size=1 << 20)


def open_stream(uri: str) -> BinaryIO:
    where, path = _place(uri)
    return where.open_input_stream(path, compression=None, buffer_size=1 << 20)


def open_file(uri: str) -> BinaryIO:
    where, path = _place(uri)
    return where.open_input_file(path)
