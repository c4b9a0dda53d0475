"""Files that tasks write to and read from the shared folder, through any file system Arrow knows."""

from __future__ import annotations

import os
import uuid

import pyarrow.fs as pafs


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI, and the folder's path on it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def commit(store: pafs.FileSystem, temporary: str, final: str) -> None:
    """Give a finished file its name. A task that runs again writes the same bytes, so the later
    rename changes nothing."""
    store.move(temporary, final)


def write_bytes(uri: str, name: str, data: bytes) -> None:
    store, root = open_store(uri)
    store.create_dir(root, recursive=True)
    temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary, compression=None) as out:
        out.write(data)
    commit(store, temporary, f"{root}/{name}")


def read_bytes(uri: str, name: str) -> bytes:
    store, root = open_store(uri)
    with store.open_input_stream(f"{root}/{name}", compression=None) as source:
        return source.read()
