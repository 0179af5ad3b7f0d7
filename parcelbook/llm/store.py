"""Arrays in the shared folder: written whole by tasks, memory-mapped by tasks that read them."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyarrow import fs


def _local(uri: str) -> str | None:
    return uri.removeprefix("file://") if uri.startswith(("file:/", "/")) else None


def save(uri: str, array: np.ndarray) -> None:
    """Write under another name and rename, so a task that is run again leaves one whole file."""
    spare = f"{uri}.{uuid.uuid4().hex}"
    path = _local(spare)
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        array.tofile(path)
        os.replace(path, _local(uri))
        return
    system, at = fs.FileSystem.from_uri(spare)
    system.create_dir(os.path.dirname(at), recursive=True)
    with system.open_output_stream(at) as out:
        out.write(memoryview(np.ascontiguousarray(array)).cast("B"))
    system.move(at, fs.FileSystem.from_uri(uri)[1])


def mapped(uri: str, dtype: type) -> np.ndarray:
    """The array without reading it: pages are loaded as they are touched.

    From a store that is not mounted the file is copied first to a nameless local file,
    which goes with the mapping.
    """
    path = _local(uri)
    if path:
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    system, at = fs.FileSystem.from_uri(uri)
    with tempfile.TemporaryFile() as copy, system.open_input_stream(at) as source:
        while part := source.read(1 << 24):
            copy.write(part)
        copy.flush()
        return np.memmap(copy, dtype, "r") if copy.tell() else np.zeros(0, dtype)


def ranged(uri: str, dtype: type) -> Callable[[int, int], np.ndarray]:
    """A reader of stretches (from, to) of an array: mapped, or by range from a store that is not mounted."""
    if _local(uri):
        whole = mapped(uri, dtype)
        return lambda start, end: np.asarray(whole[start:end])
    system, at = fs.FileSystem.from_uri(uri)
    source, size = system.open_input_file(at), np.dtype(dtype).itemsize
    return lambda start, end: np.frombuffer(source.read_at((end - start) * size, start * size), dtype)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block, bytes of equal place side by side."""
    parts = []
    for a in arrays:
        planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T)
        raw = planes[: planes.shape[0]].tobytes()
        parts.append((a.dtype.str, len(a), len(raw), pa.compress(raw, "zstd", asbytes=True) if raw else b""))
    head = ";".join(f"{d},{n},{r},{len(z)}" for d, n, r, z in parts).encode()
    return len(head).to_bytes(4, "little") + head + b"".join(z for *_, z in parts)


def unpack(block: bytes) -> list[np.ndarray]:
    at = 4 + int.from_bytes(block[:4], "little")
    out = []
    for item in block[4:at].decode().split(";"):
        d, n, raw, size = item.split(",")
        data = pa.decompress(block[at : at + int(size)], int(raw), "zstd", asbytes=True) if int(raw) else b""
        at += int(size)
        kind = np.dtype(d)
        planes = np.frombuffer(data, np.uint8).reshape(kind.itemsize, int(n))
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
    return out


def runs(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys in the given order."""
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for k in keys:
        s = k[order]
        fresh[1:] |= s[1:] != s[:-1]
    return np.flatnonzero(fresh)
