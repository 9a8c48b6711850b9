"""Files of any store that executors reach themselves: a path without a scheme is a shared folder, others (hdfs, s3, gs, ...) name their file system."""

from __future__ import annotations

import hashlib

from pyarrow import fs

#: What is read, hashed or copied at once.
CHUNK = 1 << 20


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a URI."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri.rstrip("/")
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").strip("/")
    found, path = fs.FileSystem.from_uri(uri)
    return found, path.rstrip("/")


def parent(path: str) -> str:
    return path.rsplit("/", 1)[0]


def exists(store: fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != fs.FileType.NotFound


def read_all(store: fs.FileSystem, path: str) -> bytes:
    with store.open_input_stream(path) as f:
        return f.readall()


def write_whole(store: fs.FileSystem, path: str, *parts: bytes) -> int:
    store.create_dir(parent(path), recursive=True)
    with store.open_output_stream(path) as f:
        return sum(f.write(p) for p in parts)


def removed(store: fs.FileSystem, path: str) -> None:
    if exists(store, path):
        store.delete_dir(path)


def sha256_of(store: fs.FileSystem, path: str, chunk: int = CHUNK) -> tuple[int, str]:
    """Bytes and SHA-256 of a file, a chunk in memory at a time."""
    sha, size = hashlib.sha256(), 0
    with store.open_input_file(path) as f:
        while part := f.read(chunk):
            sha.update(part)
            size += len(part)
    return size, sha.hexdigest()
