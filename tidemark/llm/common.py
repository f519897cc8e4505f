"""What the operators of this subpackage share: the cluster's shared folder, written tables, word arrays."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import new_path, shared_dir, written  # noqa: F401

#: A word is a longest run without space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this module made, once no later job reads it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def word_array(text: Column) -> Column:
    """The words of a text as an array; of null, an empty one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def parts_for(total: int, each: int) -> int:
    return max(1, math.ceil(total / each))


def byte_words(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of many UTF-8 texts: all bytes one after the other with a blank behind each text, the words' starts and ends in them, and for each text the number of its first word (with one more at the end)."""
    joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    blank = (joined == 32) | ((joined >= 9) & (joined <= 13))
    word = ~blank
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64)
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    return joined, starts, ends, first


def binary_values(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null gives an empty text."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def thrifty(made: pa.Table | None) -> pa.Table | None:
    """made, once memory that is free has gone back to the system: a Python worker outlives its task and serves later stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)
    return made


def thrifty_batches(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and the same at the end of its task."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        thrifty(None)

    return over
