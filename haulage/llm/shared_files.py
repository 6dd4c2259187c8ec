"""Files in the shared folder, opened from tasks (local paths, hdfs, s3, gs by URI)."""

from __future__ import annotations

from pyarrow import fs as pafs


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and inner path of a folder or file name as Spark writes it."""
    local = path[len("file:"):] if path.startswith("file:") else path
    if local.startswith("/"):
        return pafs.LocalFileSystem(), "/" + local.lstrip("/")
    return pafs.FileSystem.from_uri(path)


def make_dir(path: str) -> None:
    filesystem, inner = open_fs(path)
    filesystem.create_dir(inner, recursive=True)
