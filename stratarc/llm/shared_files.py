"""Plain files in the shared folder that workers write whole and memory-map."""

from __future__ import annotations

import os
import uuid

import numpy as np


def _path(uri: str) -> str | None:
    """The path of a file: address, which every machine sees in the shared folder; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def put(uri: str, data: bytes) -> None:
    """Write a file at once: a task that runs twice leaves the same bytes."""
    if path := _path(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as f:
        f.write(data)


def mapped(uri: str, dtype) -> np.ndarray:
    """The file as a memory-mapped array; where the folder isn't mounted, read whole, a shard at a time."""
    if path := _path(uri):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    from pyarrow import fs

    store, far = fs.FileSystem.from_uri(uri)
    with store.open_input_file(far) as f:
        return np.frombuffer(f.read(), dtype)
