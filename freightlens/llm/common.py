"""Helpers shared by the training-data operators: tables in the shared folder,
Arrow batches cut to a byte budget, and vectorised words over UTF-8 buffers.

Words are found on bytes.  Every separator used here is ASCII, so byte classes
and code-point classes agree, and no text is decoded to find a word.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

#: Bytes of text that one numpy step works on (a longer text is a step of its own).
STEP_BYTES = 1 << 20
#: Bytes hashed at a time; longer inputs are cut between words.
PIECE_BYTES = 1 << 20

WHITE = bytes([0x20, *range(0x09, 0x0E)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and
    survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    # small row groups: little heap per writer, and several tasks can read a file
    df.write.option("compression", "zstd").option("parquet.block.size", str(32 << 20)).parquet(path)
    _tables(spark).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._freightlens_path = path
    return out


def _tables(spark: SparkSession) -> list[str]:
    sc = spark.sparkContext
    if not hasattr(sc, "_freightlens_tables"):
        sc._freightlens_tables = []
    return sc._freightlens_tables


def _delete(spark: SparkSession, name: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete the tables that ``saved`` has written so far: for a caller whose
    results are written elsewhere by now."""
    tables = _tables(spark)
    while tables:
        _delete(spark, tables.pop())


def forget(*saved_tables: DataFrame) -> None:
    """Delete tables that ``saved`` gave, once what was made of them is written too."""
    for df in saved_tables:
        _tables(df.sparkSession).remove(df._freightlens_path)
        _delete(df.sparkSession, df._freightlens_path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a session (what
    ``--py-files`` does; the driver serves the file)."""
    sc = spark.sparkContext
    if getattr(sc, "_freightlens_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    path = Path(tempfile.mkdtemp(prefix="freightlens-py-")) / "freightlens_py.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "freightlens").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(path))
    sc._freightlens_shipped = True


def small_batches(df: DataFrame, rows: int = 256) -> DataFrame:
    """Keep the Arrow batches of this session small enough for long texts."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return df


# ---------------------------------------------------------------- byte buffers

def buffer_of(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def steps(col) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of rows of about STEP_BYTES: (first, last, bytes, offsets)."""
    buf, offs = buffer_of(col)
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + STEP_BYTES, side="right")) - 1)
        yield a, b, buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
        a = b
    trim(len(buf))


@functools.lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: nothing to trim
        return None


_since = [0]


def trim(done: int) -> None:
    """Give freed memory back after every 2 MB of text, so that reused Python workers stay small."""
    _since[0] += done
    if _since[0] < 2 << 20:
        return
    _since[0] = 0
    if _libc() is not None:
        _libc().malloc_trim(0)
    pa.default_memory_pool().release_unused()


# ---------------------------------------------------------------- hashing

_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inv = pow(int(_P), -1, 1 << 64)
    up = np.full(n, _P, np.uint64)
    down = np.full(n, np.uint64(inv), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(PIECE_BYTES, 1 << int(n).bit_length()))


def ranges_hash(vals: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of vals[start:end] of each range, from one prefix sum."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(vals))
    total = np.zeros(len(vals) + 1, np.uint64)
    np.cumsum((vals.astype(np.uint64) + np.uint64(1)) * up[:len(vals)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@functools.lru_cache(maxsize=8)
def byte_class(separators: bytes) -> np.ndarray:
    out = np.ones(256, bool)
    out[np.frombuffer(separators, np.uint8)] = False
    return out


@functools.lru_cache(maxsize=2)
def lower_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def word_ranges(buf, offs, separators: bytes = WHITE):
    """(starts, ends, row) of the words of each text."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = byte_class(separators)[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def word_hashes(buf, starts, ends, lower: bool = False) -> np.ndarray:
    """Hashes of the words; computed piece by piece, cut between words."""
    out, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + PIECE_BYTES, side="right")))
        lo, hi = starts[a], ends[b - 1]
        piece = buf[lo:hi]
        out[a:b] = ranges_hash(lower_table()[piece] if lower else piece, starts[a:b] - lo, ends[a:b] - lo)
        a = b
    return out


def counts_of(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n).astype(np.int64)


def windows_hash(words: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word index, hash) of each window of ``size`` words of one text."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(row[:n] == row[size - 1:])
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        h = h * _P + words[at + k]
    return at, mix(h + np.uint64(size))
