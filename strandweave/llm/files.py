"""Files that tasks write to and read from the shared folder, by its URI."""

from __future__ import annotations

import uuid

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (or plain path) and the path in it."""
    return fs.FileSystem.from_uri(uri)


def create(folder: str, name: str):
    """A stream to a new file. Each attempt of a task gets a name of its own: only what its result rows name counts."""
    system, path = at(folder)
    system.create_dir(path, recursive=True)
    full = f"{name}-{uuid.uuid4().hex}"
    return system.open_output_stream(f"{path}/{full}"), f"{folder}/{full}"


def open_random(uri: str):
    system, path = at(uri)
    return system.open_input_file(path)


def read_range(file, offset: int, length: int) -> bytes:
    file.seek(offset)
    return file.read(length)
