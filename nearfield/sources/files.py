"""File access shared by the binary formats: local or mounted paths and URIs."""

from __future__ import annotations

import json
import os
import posixpath
from typing import BinaryIO

MANIFEST = "_manifest.json"


def _remote(path: str):
    """(file system, path inside it) for a URI, or None for a plain path."""
    if path.startswith("file:"):
        return None
    if "://" not in path:
        return None
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def plain(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path[len("file:") :].lstrip("/")
    return path


def open_read(path: str) -> BinaryIO:
    remote = _remote(path)
    return open(plain(path), "rb") if remote is None else remote[0].open_input_file(remote[1])


def write_bytes(path: str, content: bytes) -> None:
    remote = _remote(path)
    if remote is None:
        os.makedirs(os.path.dirname(plain(path)), exist_ok=True)
        with open(plain(path), "wb") as out:
            out.write(content)
        return
    filesystem, inner = remote
    filesystem.create_dir(posixpath.dirname(inner), recursive=True)
    with filesystem.open_output_stream(inner) as out:
        out.write(content)


def remove(path: str) -> None:
    remote = _remote(path)
    if remote is None:
        if os.path.exists(plain(path)):
            os.remove(plain(path))
        return
    remote[0].delete_file(remote[1])


def size_of(path: str) -> int:
    remote = _remote(path)
    if remote is None:
        return os.path.getsize(plain(path))
    return remote[0].get_file_info(remote[1]).size


def list_files(path: str) -> list[str]:
    """The file itself, the files a manifest lists, or all files below a folder by name."""
    from pyarrow import fs

    remote = _remote(path)
    filesystem, inner = (fs.LocalFileSystem(), plain(path)) if remote is None else remote
    info = filesystem.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    listed = read_manifest(path)
    if listed is not None:
        return [f"{path.rstrip('/')}/{entry['name']}" for entry in listed]
    found = filesystem.get_file_info(fs.FileSelector(inner, recursive=True))
    names = sorted(
        f.path[len(inner.rstrip("/")) + 1 :] for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))
    )
    return [f"{path.rstrip('/')}/{name}" for name in names]


def read_manifest(path: str) -> list[dict] | None:
    """One entry per file: its ``name`` and what its writer knew of it (``rows``, ``cols``, ``shard``)."""
    try:
        with open_read(f"{path.rstrip('/')}/{MANIFEST}") as source:
            listed = json.loads(source.read())["files"]
    except (FileNotFoundError, NotADirectoryError):
        return None
    return [{"name": x} if isinstance(x, str) else x for x in listed]


def write_manifest(path: str, entries: list[dict]) -> None:
    write_bytes(f"{path.rstrip('/')}/{MANIFEST}", json.dumps({"files": entries}).encode())


def qualified(path: str, default: str) -> str:
    """``path`` as every process reads it: one without a scheme belongs to the default file system.

    ``default`` is ``fs.defaultFS``; local paths become absolute.
    """
    if "://" in path or path.startswith("file:"):
        return path
    if default.startswith("file:"):
        return os.path.abspath(path)
    return f"{default.rstrip('/')}/{path.lstrip('/')}"
