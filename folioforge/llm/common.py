"""What the operators of this subpackage share: tables, the shared folder, word arithmetic, mapped hash arrays."""

from __future__ import annotations

import urllib.parse
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioforge.sources import shared
from folioforge.sources.shipping import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch: texts are large rows, of which Spark's 10,000 would fill a worker's memory.
BATCH_ROWS = 1000


def prepared(spark: SparkSession) -> SparkSession:
    """The session with this package on its workers and, unless its configuration names a size, small Arrow batches."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000" and not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and lost executors cost no recomputation."""
    prepared(df.sparkSession)
    return shared.written(df, name)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as make it none of df's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_columns(df: DataFrame, source: str, make: Callable[[], Callable[[list], list[list | pa.Array]]], fields: str) -> DataFrame:
    """df with new columns computed from one column, batch by batch in workers; columns of these names are replaced.

    make() gives a worker the function from a batch's values to the values of each field (a DDL string). All other
    columns stay the Arrow columns that they are, so 64-bit numbers beside nulls stay exact.
    """
    prepared(df.sparkSession)
    more = T._parse_datatype_string(fields)
    base = df.drop(*more.names)
    kinds = [f.type for f in to_arrow_schema(more)]
    names = base.columns + more.names
    at = base.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for b in batches:
            made = step(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, *(v.cast(k) if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(made, kinds, strict=True))], names=names)

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *more.fields]))


def local_path(path: str) -> str | None:
    """The path that open() takes, if the shared folder is mounted everywhere; None for an object store."""
    parts = urllib.parse.urlparse(path)
    return urllib.parse.unquote(parts.path) if parts.scheme in ("", "file") else None


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8")) % n


# ---- word hashes, vectorised over a batch of texts -------------------------------------------------------------------

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _STEP)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes."""
    word = ~_SPACE[data]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of one whole text after lower-casing A-Z; null or blank text has none."""
    if not text:
        return np.empty(0, np.uint64)
    data = _FOLD[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    starts, ends = word_spans(data)
    if not len(starts):
        return np.empty(0, np.uint64)
    out, block = [], 1 << 20
    for k in range(0, len(starts), block):  # in blocks, so that very long texts need little memory
        s, e = starts[k : k + block], ends[k : k + block]
        lo, hi = int(s[0]), int(e[-1])
        up, down = _power(hi - lo)
        run = np.empty(hi - lo + 1, np.uint64)
        run[0] = 0
        np.cumsum(_BYTE[data[lo:hi]] * up, out=run[1:])
        out.append(mix64((run[e - lo] - run[s - lo]) * down[s - lo] + (e - s).astype(np.uint64) * _STEP))
    return out[0] if len(out) == 1 else np.concatenate(out)


def chain(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words."""
    h = words[: max(0, len(words) - n + 1)].copy()
    for k in range(1, n):
        h = mix64(h * _STEP + words[k : k + len(h)])
    return h


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; fewer words make one shingle, no words none."""
    w = word_hashes(text)
    return np.unique(chain(w, min(n, len(w)))) if len(w) else w


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.int64).view(np.uint64)
