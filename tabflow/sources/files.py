"""Files that the driver writes, by path or by URI."""

from __future__ import annotations

from typing import BinaryIO


def create(path: str) -> BinaryIO:
    """An open file to write, whose folder is made; URIs go to the store that they name."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    if "/" in at:
        system.create_dir(at.rpartition("/")[0], recursive=True)
    return system.open_output_stream(at, compression=None)
