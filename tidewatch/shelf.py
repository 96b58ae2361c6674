"""Arrays in the shared folder, written by tasks and memory-mapped by workers."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
from collections import OrderedDict
from urllib.parse import unquote, urlparse

import numpy as np


class Shelf:
    """Named numpy arrays under one folder that all machines share.

    A file: folder is mapped in place. From any other store an array is fetched once per worker
    into a temporary file that is unlinked while it is mapped, so nothing is left behind.
    Files are written under a temporary name and renamed, and hold the same bytes whichever task
    attempt wrote them.
    """

    def __init__(self, base: str, most_open: int = 4096):
        self.base, self.most_open = base.rstrip("/"), most_open
        self.open: OrderedDict[str, np.ndarray] = OrderedDict()

    def __getstate__(self) -> dict:
        return {"base": self.base, "most_open": self.most_open, "open": OrderedDict()}

    def _local(self) -> str | None:
        parsed = urlparse(self.base)
        return unquote(parsed.path) if parsed.scheme in ("", "file") else None

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.base)

    def put(self, name: str, array: np.ndarray) -> None:
        folder = self._local()
        if folder is not None:
            os.makedirs(folder, exist_ok=True)
            part = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
            with open(part, "wb") as out:
                np.save(out, array)
            os.replace(part, os.path.join(folder, f"{name}.npy"))
            return
        store, folder = self._store()
        part = f"{folder}/.{name}-{uuid.uuid4().hex}"
        data = io.BytesIO()
        np.save(data, array)
        store.create_dir(folder)
        with store.open_output_stream(part) as out:
            out.write(data.getbuffer())
        store.move(part, f"{folder}/{name}.npy")

    def get(self, name: str) -> np.ndarray:
        if name in self.open:
            self.open.move_to_end(name)
            return self.open[name]
        folder = self._local()
        if folder is not None:
            found = np.load(os.path.join(folder, f"{name}.npy"), mmap_mode="r")
        else:
            store, folder = self._store()
            with tempfile.NamedTemporaryFile(suffix=".npy") as copy, store.open_input_stream(f"{folder}/{name}.npy") as source:
                while chunk := source.read(1 << 22):
                    copy.write(chunk)
                copy.flush()
                found = np.load(copy.name, mmap_mode="r")
        found = self.open[name] = np.asarray(found)
        while len(self.open) > self.most_open:
            self.open.popitem(last=False)
        return found
