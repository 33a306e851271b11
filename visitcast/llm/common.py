"""Shared helpers: tables, checkpoints, text blocks and word hashes.

The numpy helpers run inside tasks on Arrow batches.  Words are the maximal
runs of bytes outside ``[\\x20\\x09-\\x0D]``; none of those bytes occurs inside
a multi-byte UTF-8 character, so byte runs and character runs agree.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

WORD_BREAKS = " \t\n\x0b\x0c\r"
BLOCK_BYTES = 1 << 19

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in WORD_BREAKS]] = True
# Letters, digits and all bytes of non-ASCII characters.
ALNUM = np.array([chr(b).isalnum() or b > 127 for b in range(256)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint into the folder the cluster names."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def show_workers_the_package(spark: SparkSession) -> None:
    """Put the folder this package was imported from on the Python workers'
    path.  In local mode the driver may have it from ``sys.path`` only; on a
    cluster without that folder the entry has no effect."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def give_back_memory() -> None:
    """Hand freed memory back to the system: Python workers and the driver live
    on after a task or a fit, and the C library keeps what it once got."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """An Arrow task function that gives back its memory at its end."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back_memory()

    return wrapped


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0 (null id: false)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, inside the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_column(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; nulls are empty."""
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def text_blocks(column, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split a column into runs of whole texts of about ``limit`` bytes.

    Yields (first row, end row, bytes, offsets from 0).  A longer text is a
    block of its own, so memory is bounded by the longest text.
    """
    data, offsets = text_column(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, within: np.ndarray | None = None
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word of a block; no word crosses a text.

    ``within`` (one flag per byte value) replaces the usual definition.
    """
    inside = (~_BREAK if within is None else within)[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    before[first] = False
    after[last] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (three multiply-xor rounds)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Powers:
    """Powers of an odd hash base and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.bases = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK_BYTES + (BLOCK_BYTES >> 3))
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b)]))
                                  for b in self.bases)
        return self.up[:n], self.down[:n]


POWERS = Powers(0x9E3779B97F4A7C15)
OTHER_POWERS = Powers(0xD1342543DE82EF95)  # for a second, independent hash


def span_hasher(data: np.ndarray, powers: Powers = POWERS):
    """A function (start, end) -> 64-bit hash of every span of the block; equal
    bytes hash alike wherever they stand."""
    up, down = powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    return lambda start, end: mix((sums[end] - sums[start]) * down[start])


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hasher(data)(start, end)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; all other bytes stay."""
    upper = (data >= 65) & (data <= 90)
    return data + upper.astype(np.uint8) * np.uint8(32)
