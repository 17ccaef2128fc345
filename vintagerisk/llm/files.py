"""Files in the shared folder, written and read inside tasks through pyarrow's file systems (file://, hdfs://, s3://)."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def replacing(uri: str) -> Iterator[pa.NativeFile]:
    """Write under a name of this attempt's own and move it into place: a repeated task replaces the whole file."""
    system, path = locate(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with system.open_output_stream(own, compression=None) as out:
            yield out
    except BaseException:
        system.delete_file(own)
        raise
    system.move(own, path)


def opened(uri: str) -> pa.NativeFile:
    system, path = locate(uri)
    return system.open_input_file(path)


def whole(uri: str) -> bytes:
    with opened(uri) as f:
        return f.read()
