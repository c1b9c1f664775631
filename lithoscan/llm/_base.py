"""Shared helpers: checkpoint folder, table reading and numpy kernels over Arrow text buffers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel handles at once; one longer document is handled alone.
SLICE_BYTES = 1 << 20

_RNG = np.random.default_rng(20240229)
_BYTE_MIX = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a local master; on a cluster that is an error,
    as a folder of one machine would be lost with it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder (never a local checkpoint)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the driver drop what it no longer refers to, so that shuffle files behind a checkpoint are deleted now, not some time.

    It takes two rounds: the first frees what Python held of the JVM's objects, the second these.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df``, a checkpoint, marked for broadcast if it has at most ``rows`` rows; else it is left to a shuffle join."""
    return F.broadcast(df) if df.count() <= rows else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that the input doesn't have (compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return freed memory to the system where the C library can: a worker lives on between stages, and would keep it."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES, rows: int = 512) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes, and at most ``rows``."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), i + rows, n)
        yield i, j
        i = j


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        step = _BASE if kind == "up" else _BASE_INV
        p = np.full(max(n, SLICE_BYTES + 1), step, np.uint64)
        p[0] = 1
        have = np.cumprod(p, dtype=np.uint64)
        if n <= 4 * SLICE_BYTES:
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from prefix sums of a polynomial over mixed bytes."""
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    if n:
        np.cumsum(_BYTE_MIX[data] * _power("up", n), dtype=np.uint64, out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * _power("down", n + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64))


#: ASCII letters in lower case, digits, and every byte of a non-ASCII character; else 0.
WORD_BYTE = np.zeros(256, np.uint8)
for _b in range(256):
    if 48 <= _b <= 57 or 97 <= _b <= 122 or _b >= 128:
        WORD_BYTE[_b] = _b
    elif 65 <= _b <= 90:
        WORD_BYTE[_b] = _b + 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and the starts and ends of words (none crosses a row), and each row's first word."""
    low = WORD_BYTE[data]
    inside = low != 0
    start, end = inside.copy(), inside.copy()
    if len(data):
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        start[edge] |= inside[edge]
        end[edge - 1] |= inside[edge - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def text_batches(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for each slice of a batch's text column."""
    data, off = utf8(batch.column(batch.schema.get_field_index(column)))
    for i, j in slices(off):
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
    del data
    pa.default_memory_pool().release_unused()
    give_back()


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """An equi-join on which nulls match; the right side's keys are dropped."""
    mapped = right.select(*[F.col(k).alias(f"{k}__r") if k in keys else F.col(k) for k in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(mapped[f"{k}__r"])
        cond = c if cond is None else cond & c
    out = left.join(mapped, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"{k}__r" for k in keys])
