"""Arrays that tasks make and workers map into memory: NPY files in the shared folder.

Where the shared folder is mounted (no scheme or file:), tasks write their arrays there and workers map those files.
In any other store the arrays go through Spark's Parquet writer, addFile ships them to the executors that need them,
and a worker unpacks them once beside the shipped files and maps its copy.
"""

from __future__ import annotations

import os
import urllib.parse
import uuid
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.common import local_path
from folioforge.sources.shared import shared_path

ROW = "name string, data binary"
#: Maps that a worker keeps open; each holds an open file.
OPEN_MAPS = 256
_open: OrderedDict[tuple[str, str], np.ndarray] = OrderedDict()


def pack(a: np.ndarray) -> bytes:
    """Bytes of an unsigned array by planes, compressed: small numbers and differences take little."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(data: bytes, kind) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    if not len(k):
        return k, c
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first)


def bundle(arrays: list[np.ndarray]) -> np.ndarray:
    """Arrays of unsigned numbers as one: their item sizes and lengths, then each from a place divisible by 8."""
    head = np.array([len(arrays), *[x for a in arrays for x in (a.itemsize, len(a))]], np.uint64).view(np.uint8)
    parts = [head]
    for a in arrays:
        raw = np.ascontiguousarray(a).view(np.uint8)
        parts += [raw, np.zeros(-len(raw) % 8, np.uint8)]
    return np.concatenate(parts)


def unbundled(raw: np.ndarray) -> list[np.ndarray]:
    n = int(raw[:8].view(np.uint64)[0])
    at, out = 8 + 16 * n, []
    for size, length in raw[8:at].view(np.uint64).reshape(n, 2).astype(np.int64).tolist():
        out.append(raw[at : at + size * length].view(f"u{size}"))
        at += -(-size * length // 8) * 8
    return out


@dataclass(frozen=True)
class Store:
    """Where a set of arrays is: a folder, and the shipped files if the folder can't be opened as one."""

    path: str
    shipped: tuple[str, ...] = ()

    @property
    def folder(self) -> str | None:
        return local_path(self.path)

    def put(self, name: str, a: np.ndarray) -> tuple[str, bytes | None]:
        """In a task: keeps the array, and returns the row (of ROW) that stands for it. A retried task writes the same file again."""
        if self.folder is None:
            return name, a.dtype.str.encode() + b"\n" + np.ascontiguousarray(a).tobytes()
        os.makedirs(self.folder, exist_ok=True)
        part = f"{self.folder}/.{name}-{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.save(f, a, allow_pickle=False)
        os.replace(part, f"{self.folder}/{name}.npy")
        return name, None

    def get(self, name: str) -> np.ndarray:
        """In a worker: the array, mapped into memory. The maps used last stay open."""
        key = (self.path, name)
        if key not in _open:
            _open[key] = np.asarray(np.load(f"{self.folder or self._unpacked()}/{name}.npy", mmap_mode="r"))
            if len(_open) > OPEN_MAPS:
                _open.popitem(last=False)
        _open.move_to_end(key)
        return _open[key]

    def _unpacked(self) -> str:
        import pyarrow.parquet as pq

        to = os.path.join(SparkFiles.getRootDirectory(), "arrays-" + self.path.rpartition("/")[2])
        if not os.path.isdir(to):
            part = f"{to}-{uuid.uuid4().hex}"
            os.makedirs(part)
            for f in self.shipped:
                for batch in pq.ParquetFile(SparkFiles.get(f)).iter_batches(batch_size=1, columns=["name", "data"]):
                    for name, data in zip(batch["name"].to_pylist(), batch["data"].to_pylist(), strict=True):
                        if data is not None:
                            kind, _, rest = data.partition(b"\n")
                            np.save(f"{part}/{name}.npy", np.frombuffer(rest, np.dtype(kind.decode())))
            try:
                os.rename(part, to)
            except OSError:  # another worker of this executor was first
                pass
        return to


def store(spark: SparkSession, name: str) -> Store:
    return Store(shared_path(spark, name))


def filled(spark: SparkSession, made: DataFrame, at: Store, name: str) -> tuple[DataFrame, Store]:
    """Runs the job that puts arrays into `at`: made has ROW's columns and maybe others. Returns its written rows, and the store to read from."""
    path = shared_path(spark, name)
    made.write.parquet(path)
    rows = spark.read.schema(made.schema).parquet(path)
    if at.folder is not None:
        return rows, at
    files = rows.inputFiles()
    for f in files:
        spark.sparkContext.addFile(f)
    return rows, Store(at.path, tuple(os.path.basename(urllib.parse.unquote(urllib.parse.urlparse(f).path)) for f in files))
