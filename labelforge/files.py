"""Files that tasks open themselves, by pyarrow's filesystems (local and
mounted paths, and the schemes pyarrow knows, such as hdfs and s3)."""

from __future__ import annotations

import os
import re

from pyarrow import fs as pafs


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """(filesystem, path on it) of ``path``, with or without a scheme."""
    if match := re.match(r"file:/*(/.*)", path):
        return pafs.LocalFileSystem(), match[1].rstrip("/") or "/"
    if "://" in path:
        store, inner = pafs.FileSystem.from_uri(path)
        return store, inner.rstrip("/")
    return pafs.LocalFileSystem(), os.path.abspath(path)


def full_path(like: str, inner: str) -> str:
    """``inner``, a path on the filesystem of ``like``, as Spark writes it."""
    scheme = "file:" if "://" not in like or like.startswith("file:") else like.split("://")[0] + "://"
    return scheme + inner


def listed(store: pafs.FileSystem, folder: str, recursive: bool = False) -> list[pafs.FileInfo]:
    """What is in ``folder``, by name; nothing if it does not exist."""
    found = store.get_file_info(pafs.FileSelector(folder, allow_not_found=True, recursive=recursive))
    return sorted(found, key=lambda f: f.path)


def write_whole(store: pafs.FileSystem, path: str, parts) -> None:
    """Write byte strings to ``path`` under another name first, so that a file
    of this name is always whole."""
    folder, name = path.rsplit("/", 1)
    store.create_dir(folder, recursive=True)
    begun = f"{folder}/.{name}.{os.getpid()}.begun"
    with store.open_output_stream(begun) as out:
        for part in parts:
            out.write(part)
    store.move(begun, path)
