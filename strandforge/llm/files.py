"""Files in the shared folder, from executors: any store that pyarrow knows (file, hdfs, s3, gcs)."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs


class Folder:
    def __init__(self, uri: str):
        self.fs, self.base = pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri.replace("file:/", "file:///", 1))
        self.fs.create_dir(self.base, recursive=True)

    def write(self, name: str, data: bytes) -> None:
        """Whole or not at all: written beside, then moved."""
        part = f"{self.base}/.{name}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as out:
            out.write(data)
        self.fs.move(part, f"{self.base}/{name}")

    def read(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.base}/{name}") as f:
            return f.read()

    def open(self, name: str):
        """A file to seek and read ranges of."""
        return self.fs.open_input_file(f"{self.base}/{name}")


_folders: dict[str, Folder] = {}


def filesystem(uri: str) -> Folder:
    if uri not in _folders:
        _folders[uri] = Folder(uri)
    return _folders[uri]
