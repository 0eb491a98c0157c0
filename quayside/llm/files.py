"""Files in the shared folder, opened inside tasks through Arrow file systems."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path there."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


@contextmanager
def published(path: str):
    """Write a file under a name of its own and rename it when it is whole: a
    task that runs again, or twice at once, leaves one whole file."""
    store, name = opened(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex[:8]}.part"
    try:
        with store.open_output_stream(part, compression=None) as out:
            yield out
    except BaseException:
        store.delete_file(part)
        raise
    store.move(part, name)
