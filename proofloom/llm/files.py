"""Binary files in the shared folder, on a local mount or in any store that pyarrow can open."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

import pyarrow.fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    scheme = urlparse(uri).scheme
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(uri)


def local_path(uri: str) -> str | None:
    """The path to memory-map, where the store is a mount of this machine."""
    return urlparse(uri).path if urlparse(uri).scheme in ("", "file") else None


class AtomicFile:
    """Written under a name of its own and moved into place when whole, so that a retried task replaces its file."""

    def __init__(self, uri: str):
        self.fs, self.path = opened(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.temporary)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.path)
