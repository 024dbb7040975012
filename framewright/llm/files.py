"""Byte files in the shared folder, for tasks: any file system that pyarrow opens by URI."""

from __future__ import annotations

import uuid

from pyarrow import fs


def split_uri(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path; a bare path is a local one."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def unique_name(folder: str, kind: str) -> str:
    """A name that no other attempt of the task uses: a lost or repeated attempt leaves a file
    that no index names."""
    return f"{folder}/{uuid.uuid4().hex}.{kind}"


class Writer:
    def __init__(self, uri: str):
        system, path = split_uri(uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(path, compression=None)
        self.at = 0

    def write(self, data) -> tuple[int, int]:
        start = self.at
        self.out.write(data)
        self.at += len(data)
        return start, len(data)

    def close(self) -> None:
        self.out.close()


class Reader:
    def __init__(self, uri: str):
        system, path = split_uri(uri)
        self.file = system.open_input_file(path)

    def read(self, start: int, length: int) -> bytes:
        return self.file.read_at(length, start)

    def size(self) -> int:
        return self.file.size()

    def close(self) -> None:
        self.file.close()
