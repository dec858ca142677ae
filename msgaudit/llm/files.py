"""Flat numpy arrays in the shared folder, memory-mapped by Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlsplit

import numpy as np


class ArrayFiles:
    """Arrays by name under one folder of the shared scratch space.

    A ``file:`` folder is mapped in place.  From any other store an array is
    fetched once per worker into an unlinked temporary file and mapped there,
    so nothing stays on the executor.  Writing ends with a rename: a task that
    runs twice leaves one whole file.
    """

    def __init__(self, root: str):
        self.root = root
        self._open: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return {"root": self.root, "_open": {}}

    def _store(self):
        """The local folder, or (file system, path) of another store."""
        parts = urlsplit(self.root)
        if parts.scheme in ("", "file"):
            return unquote(parts.path), None
        from pyarrow import fs
        system, path = fs.FileSystem.from_uri(self.root)
        return path, system

    def write(self, name: str, array: np.ndarray) -> None:
        folder, system = self._store()
        target, part = f"{folder}/{name}", f"{folder}/.{name}.{uuid.uuid4().hex}"
        data = memoryview(np.ascontiguousarray(array)).cast("B") if array.size else b""
        if system is None:
            os.makedirs(folder, exist_ok=True)
            with open(part, "wb") as f:
                f.write(data)
            os.replace(part, target)
        else:
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(part) as f:
                f.write(data)
            system.move(part, target)

    def map(self, name: str, dtype) -> np.ndarray:
        if name not in self._open:
            folder, system = self._store()
            if system is None:
                path = f"{folder}/{name}"
                self._open[name] = (np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype))
            else:
                with tempfile.TemporaryFile() as local:
                    with system.open_input_stream(f"{folder}/{name}") as f:
                        while block := f.read(1 << 22):
                            local.write(block)
                    size = local.tell()
                    self._open[name] = np.memmap(local, dtype, "r") if size else np.empty(0, dtype)
        return self._open[name]
