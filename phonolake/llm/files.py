"""Files in the shared folder, reached through Arrow's file systems."""

from __future__ import annotations

from urllib.parse import unquote, urlparse


def file_system(path: str):
    """(file system, path in it) for a local path, a file: URI or any URI that Arrow knows."""
    from pyarrow import fs

    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(path)
