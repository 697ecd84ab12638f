"""Files that tasks write to and read from a shared folder, by URI."""

from __future__ import annotations

import contextlib
import uuid

from pyarrow import fs


def written(folder: str, name: str, suffix: str, data: list[bytes]) -> str:
    """Writes the parts to a new file and gives its URI.

    Names are new for each attempt of a task; a file counts only if the manifest of the job lists it,
    so those of lost or repeated attempts are never read.
    """
    system, path = fs.FileSystem.from_uri(folder)
    with contextlib.suppress(OSError):  # object stores have no folders, others may make it at the same time
        system.create_dir(path, recursive=True)
    file = f"{name}-{uuid.uuid4().hex}{suffix}"
    with system.open_output_stream(f"{path.rstrip('/')}/{file}", compression=None) as out:
        for part in data:
            out.write(part)
    return f"{folder.rstrip('/')}/{file}"


def opened(uri: str):
    """The file as a stream of bytes."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path, compression=None)


def content(uri: str) -> bytes:
    with opened(uri) as f:
        return f.read()
