"""Binary files in the shared folder, written and read by executors."""

from __future__ import annotations

import mmap
import os
import tempfile
from urllib.parse import unquote, urlparse


def _local(uri: str) -> str | None:
    return unquote(urlparse(uri).path) if uri.startswith("file:") else uri if uri.startswith("/") else None


def write_file(uri: str, data: bytes) -> None:
    """Whole or not at all, so that a lost or doubled task leaves no half file."""
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(part := f"{path}.{os.getpid()}.part", "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as f:
        f.write(data)


def map_file(uri: str) -> mmap.mmap:
    """The file, memory-mapped without an open file of its own, of which a worker may have fewer than a model has files; one from a remote store goes
    through a nameless temporary file."""
    if path := _local(uri):
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as source, tempfile.TemporaryFile() as f:
        while chunk := source.read(1 << 24):
            f.write(chunk)
        f.flush()
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
