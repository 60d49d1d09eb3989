"""Small helpers that the text operators share."""

from __future__ import annotations

import ctypes
import time
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwalk.session import discard, materialise

__all__ = ["U64", "WordIds", "discard", "held_out", "materialise", "mix", "release", "rolling", "rows_of", "sole", "table"]

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(column: str, modulus: int, remainder: int) -> F.Column:
    """crc32 of the id's decimal text, modulo: the split the contracts name."""
    return (F.crc32(F.col(column).cast("string").cast("binary")) % modulus) == remainder


_HELD: list = []  # the cache that this process fills
_RELEASED = [0.0]


def sole(cache):
    """The cache, after one that another operator left in this process is emptied: workers outlive the stages of a pipeline."""
    if not _HELD or _HELD[0] is not cache:
        for other in _HELD:
            other.clear()
        _HELD[:] = [cache]
        release(0)
    return cache


def release(every: float = 1) -> None:
    """Give freed memory back to the system, once in `every` seconds at most: an idle worker otherwise keeps the most it ever used."""
    if time.monotonic() - _RELEASED[0] >= every:
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # not every libc can
            ctypes.CDLL(None).malloc_trim(0)
        _RELEASED[0] = time.monotonic()


class WordIds(dict):
    """Stable 64-bit hashes of byte words; emptied when it has grown to `most` entries."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over an array of uint64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def rolling(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial hashes (mod 2**64) of all runs of k values, by doubling: len(h) - k + 1 of them."""
    if len(h) < k:
        return np.empty(0, U64)
    width, have, done, total = 1, h, None, 0
    while True:
        if k & width:
            if done is None:
                done, total = have, width
            else:
                n = len(h) - total - width + 1
                done = done[:n] * U64(pow(base, width, 1 << 64)) + have[total : total + n]
                total += width
        if total == k:
            return done
        have = have[:-width] * U64(pow(base, width, 1 << 64)) + have[width:]
        width *= 2


def rows_of(batches: Iterator[pa.RecordBatch], most: int = 512) -> Iterator[pa.RecordBatch]:
    """The same batches cut to at most `most` rows, so that what is decoded at once stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, most):
            yield batch.slice(i, most)
        del batch
        release()
    release(0)
