"""Helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.plans.lineage import cut

__all__ = ["cut"]

#: A word is a maximal run of characters other than ASCII white space.
WORD_SPACE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(taken, name: str) -> str:
    """``name``, with underscores before it until no column of ``taken`` has it, in either case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def even_keys(spark: SparkSession, n: int) -> DataFrame:
    """(slot, dest) of each of ``n`` partitions: a number that Spark's hash partitioning sends to it, so that rows dealt by
    ``dest`` fall one slot a partition, where a hash of the slot itself would let several meet."""
    at = F.pmod(F.hash("id"), F.lit(n))
    found = spark.range(n * (12 + n.bit_length())).groupBy(at.alias("slot")).agg(F.min("id").alias("dest"))
    return spark.range(n).select(F.col("id").cast("int").alias("slot")).join(found, "slot", "left").select(
        "slot", F.coalesce("dest", "slot").alias("dest")
    )


def give_back() -> None:
    """Hand memory that is free inside this process back to the system. A Python worker outlives its tasks, and what the
    allocators keep of large arrays counts against the executor as long as it does."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the GNU C library
        ctypes.CDLL(None).malloc_trim(0)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def fold_of(id_col: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; a null id has the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(n))


class WordHash(dict):
    """Word bytes -> signed 64-bit hash. Forgets all when full, so memory stays bounded."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        h = h - (1 << 64) if h >= 1 << 63 else h
        self[word] = h
        return h


def word_hashes(cache: WordHash, text: bytes) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 ``text`` after lower-casing A-Z.

    ``bytes.lower`` and ``bytes.split`` treat ASCII only, which is just the definition of a word here.
    """
    words = text.lower().split()
    return np.fromiter(map(cache.__getitem__, words), dtype=np.int64, count=len(words)).view(np.uint64)


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S32)) * _B
    h = (h ^ (h >> _S29)) * _A
    return h ^ (h >> _S32)


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; fewer words are one shingle; none give none."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(width, n)
    h = mix(words[: n - k + 1] + np.uint64(k))
    for i in range(1, k):
        h = mix(h * _A + words[i : n - k + 1 + i])
    return np.unique(h)


def int_column(col: pa.Array, null: int) -> np.ndarray:
    """An integer Arrow column as int64, nulls as ``null``."""
    return np.asarray(col.cast(pa.int64()).fill_null(null), dtype=np.int64)


def utf8_column(col: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes, nulls as empty."""
    return col.cast(pa.binary()).fill_null(b"").to_pylist()


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``: Arrow hands over up to 10,000 whole texts at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
