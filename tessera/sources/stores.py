"""Files by their own store, from tasks: local, hdfs, s3 and what else pyarrow's file systems open."""

from __future__ import annotations


def store_of(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("file:///", "/", 1).replace("file:/", "/", 1))
