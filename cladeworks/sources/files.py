"""Files of the data sources: local paths, or any file system that Arrow knows by its URI (hdfs, s3, ...)."""

from __future__ import annotations

import fnmatch
import glob
import os
import posixpath
from typing import BinaryIO

from pyarrow import fs


def _remote(path: str) -> tuple[fs.FileSystem, str] | None:
    if "://" not in path or path.startswith("file://"):
        return None
    return fs.FileSystem.from_uri(path)


def open_file(path: str) -> BinaryIO:
    """A seekable binary stream."""
    where = _remote(path)
    return where[0].open_input_file(where[1]) if where else open(path.removeprefix("file://"), "rb")


def size_of(path: str) -> int:
    where = _remote(path)
    return where[0].get_file_info(where[1]).size if where else os.path.getsize(path.removeprefix("file://"))


def _hidden(name: str) -> bool:
    return name.startswith(("_", "."))


def list_files(path: str) -> list[str]:
    """The files that a file's, a folder's or a glob's path names, in order; hidden ones of a folder are left out."""
    where = _remote(path)
    if not where:
        path = path.removeprefix("file://")
        if os.path.isdir(path):
            return sorted(p for p in glob.glob(os.path.join(path, "*")) if os.path.isfile(p) and not _hidden(os.path.basename(p)))
        return sorted(glob.glob(path)) or [path]
    system, inner = where
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    folder, pattern = (inner, "*") if info.type == fs.FileType.Directory else posixpath.split(inner)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(prefix + x.path for x in found if x.type == fs.FileType.File and not _hidden(x.base_name) and fnmatch.fnmatch(x.base_name, pattern)) or [path]
