"""Files under names of their own, written by executors to any file system that pyarrow opens."""

from __future__ import annotations

import uuid
from collections.abc import Iterable


def write_file(folder: str, name: str, parts: Iterable[bytes]) -> int:
    """Bytes written to folder/name. They go to a hidden file first, so a lost task leaves no half file and a repeated one replaces its own."""
    from pyarrow import fs

    where, base = fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)
    where.create_dir(base, recursive=True)
    hidden, size = f"{base}/.{uuid.uuid4().hex}", 0
    with where.open_output_stream(hidden) as out:
        for part in parts:
            size += out.write(part)
    where.move(hidden, f"{base}/{name}")
    return size
