"""Binary files in the shared folder, through the file system that its URI names."""

from __future__ import annotations

import hashlib
import os
import tempfile

from pyarrow import fs


def at(uri: str):
    """(file system, path) of a URI or a local path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class Writer:
    """A file that appears under its name only when it is whole; a retried task writes the same name again."""

    def __init__(self, uri: str):
        self.fs, self.path = at(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.temporary = f"{self.path}.{os.getpid()}-{os.urandom(4).hex()}.part"
        self.stream, self.size = self.fs.open_output_stream(self.temporary), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.temporary, self.path)


def read_at(uri: str):
    """An open file for random reads."""
    f, path = at(uri)
    return f.open_input_file(path)


def local_copy(uri: str) -> str:
    """A path that can be memory-mapped: the file itself where it is on a mounted file system, else a copy in the worker's temporary folder."""
    f, path = at(uri)
    if isinstance(f, fs.LocalFileSystem):
        return path
    own = os.path.join(tempfile.gettempdir(), f"lodestone-{hashlib.sha256(uri.encode()).hexdigest()[:32]}")  # one for each URI
    if not os.path.exists(own):
        with f.open_input_stream(path) as source, open(part := f"{own}.{os.getpid()}", "wb") as to:
            while block := source.read(1 << 20):
                to.write(block)
        os.replace(part, own)
    return own
