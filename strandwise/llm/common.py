"""Shared pieces of the corpus operators: joins on hot keys, Arrow slices, byte hashing."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.staging import discard, stage

__all__ = ["discard", "stage"]

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
NON_SPACE_CLASS = r"[^\x20\x09-\x0D]"

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key with more than one row in so many is hot; there are at most so many such keys.
HOT = 10_000


def join_counted(rows: DataFrame, keys: DataFrame, on: Sequence[str], count: str, total: int) -> DataFrame:
    """``rows`` joined to ``keys`` (one row per key, ``count`` of them in ``rows``, which
    has ``total``), without a task that holds all rows of a common key.

    A key with more than a ``HOT``-th of all rows is hot: of these there can be no more
    than ``HOT``, whatever the size of the data, so they are broadcast; every other key
    has at most a ``HOT``-th of the rows and is joined by a shuffle, at every size.
    """
    on = list(on)
    common = F.col(count) * HOT > F.lit(total)
    hot, cold = F.broadcast(keys.where(common)), keys.where(~common)
    rest = rows.join(F.broadcast(keys.where(common).select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(cold.hint("merge"), on))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text, in order, as an array."""
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NON_SPACE_CLASS + "+")).cast("long")


# ---------------------------------------------------------------- Arrow and bytes


class Slice:
    """Some documents of an Arrow batch: their ids, and their bytes end to end."""

    def __init__(self, columns: list[pa.Array], texts: pa.Array):
        self.columns = columns
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        first = int(offsets[0])
        size = int(offsets[-1]) - first
        self.bytes = np.frombuffer(data, dtype=np.uint8, count=size, offset=first) if size else np.zeros(0, np.uint8)
        self.offsets = offsets - first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def doc(self, i: int) -> bytes:
        return self.bytes[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2 << 20) -> Iterator[Slice]:
    """Cut batches into slices of about ``most`` bytes; a longer text is a slice of its own."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(texts.cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            part = batch.slice(start, stop - start)
            yield Slice(
                [part.column(i) for i, n in enumerate(part.schema.names) if n != text],
                part.column(part.schema.get_field_index(text)),
            )
            start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to exponent n."""
    if len(_Powers.up) <= n:
        size = max(n + 1, 1 << 21)
        for attr, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            setattr(_Powers, attr, np.multiply.accumulate(out))
    return _Powers.up, _Powers.down


#: Ranges longer than this are hashed by a cryptographic hash: strings that meet under a
#: polynomial modulo 2**64, whatever its base, are known from some thousand bytes on.
LONG_RANGE = 512


class Hasher:
    """Hashes of any byte range of one buffer, after one pass over it."""

    def __init__(self, data: np.ndarray):
        up, _ = powers(len(data) + 1)
        self.data = data
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values()[data] * up[: len(data)], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, down = powers(len(self.sums))
        raw = (self.sums[ends] - self.sums[starts]) * down[starts]
        out = mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for i in np.flatnonzero(ends - starts > LONG_RANGE):
            out[i] = int.from_bytes(hashlib.blake2b(self.data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        return out


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each document's first word
    (one longer than the documents); words never cross documents."""
    n = len(data)
    inside = ~space[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
