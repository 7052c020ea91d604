"""Shared helpers: staged tables in the shared folder, text buffers, hashing."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text handled at once inside a task; bounds the arrays made from it.
SLICE_BYTES = 1 << 20

_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_TABLE = np.random.default_rng(20260101).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; without one only a local master has its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return path or os.path.join(tempfile.gettempdir(), "checkpoints")


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage at a table that outlives any executor.  Shuffle files of
    the finished job are then unreferenced, so a collection lets Spark delete them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that are no longer read and let Spark drop old shuffle files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    gc.collect()
    jvm.System.gc()


def idle() -> None:
    """What a task has freed goes back to the system: its Python worker idles beside later stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "").cast(pa.large_binary())
    offs = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges of rows whose text is at most ``limit`` bytes, or one longer row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def power(e: int) -> np.uint64:
    return np.uint64(pow(int(_M), e, 2**64))


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """Hash of ``x[i:i+k]`` for every i, by doubling."""
    cur, width, acc, have = x, 1, None, 0
    while k:
        if k & 1:
            if acc is None:
                acc, have = cur, width
            else:
                m = min(len(acc), len(cur) - have)
                acc, have = acc[: max(m, 0)] * power(width) + cur[have : have + max(m, 0)], have + width
        k >>= 1
        if k:
            m = max(len(cur) - width, 0)
            cur, width = cur[:m] * power(width) + cur[width : width + m], width * 2
    return mix64(acc)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n + 1:
        inverse = np.uint64(pow(int(_M), -1, 2**64))
        _POWERS[:] = [np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(n, b, np.uint64)))) for b in (_M, inverse)]
    return _POWERS[0], _POWERS[1]


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the rows, and the offsets of the rows among them.

    A word is a run of bytes outside 0x20 and 0x09-0x0D; with ``lower``, A-Z count as a-z.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    ink = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    before = np.concatenate(([False], ink[:-1])) & ~cut[:-1]
    after = np.concatenate((ink[1:], [False])) & ~cut[1:]
    lo, hi = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    up, down = _powers(len(data))
    total = np.concatenate(([np.uint64(0)], np.cumsum(_TABLE[data] * up[: len(data)], dtype=np.uint64)))
    hashes = mix64((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(lo, offs)


def anchor_runs(tokens: np.ndarray, offs: np.ndarray, k: int, length: int):
    """Runs of consecutive windows that share their anchor.

    The anchor of a window of ``length`` tokens is its k-gram of least hash, the
    leftmost if several are least; it depends on the window's content only.
    Returns row, first window start, number of windows and anchor hash of each run.
    """
    n, w = len(tokens), length - k + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, np.zeros(0, np.uint64)
    grams = gram_hashes(tokens, k)
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: n - length + 1], least[w - span :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: n - length + 1]
    start = np.flatnonzero(np.arange(n - length + 1) + length <= offs[row + 1])
    if not len(start):
        return none, none, none, np.zeros(0, np.uint64)
    p = at[start]
    first = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (start[1:] != start[:-1] + 1))))
    size = np.diff(np.concatenate((first, [len(start)])))
    s = start[first]
    return row[s], s - offs[row[s]], size, grams[p[first]]
