"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast after it has been counted.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder of ``spark.checkpoint.dir``; a temporary one only where none is set (tests)."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="webloom-checkpoint-"))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (narrow ones), else as it is. ``df`` is counted: pass a checkpointed one."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def word_bytes(value: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8; none for null."""
    return value.lower().split() if value else []


class WordHashes(dict):
    """64-bit hash of a word, remembered for up to ``keep`` words."""

    def __init__(self, keep: int = 150_000) -> None:
        super().__init__()
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.keep:
            self.clear()
        self[word] = h
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (the finaliser of splitmix64), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the consecutive k-word shingles in text order; the whole sequence as one when it has fewer words; none without words."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(k, n)
    out = np.full(n - width + 1, 0x9E3779B97F4A7C15 * width % 2**64, np.uint64)
    for i in range(width):
        out = (out ^ hashes[i : n - width + 1 + i]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(28)
    return mixed(out)


def text_bytes(column: pa.Array, rows: int = 200) -> Iterator[bytes | None]:
    """The texts as UTF-8 bytes; so many rows are held as Python objects at once."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).cast(pa.binary()).to_pylist()


try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def release_memory() -> None:
    """Give memory that is not in use back to the system: workers live on between tasks, beside the JVM."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], after_bytes: int = 16_000_000):
    """``run`` for mapInArrow, releasing memory after so many bytes of input and at its end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            seen = 0
            for b in batches:
                seen += b.nbytes
                yield b
                if seen >= after_bytes:
                    del b
                    release_memory()
                    seen = 0

        yield from run(each())
        release_memory()

    return tidied
