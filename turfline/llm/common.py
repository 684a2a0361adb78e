"""Helpers the training-data operators share: row keys, ordered offsets and word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = r"[^\x20\x09-\x0D]+"
# Bytes of text that the numpy kernels take at once.
SLICE = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def row_key() -> Column:
    """Key of a row's document: rows equal in id and text share it, so joins on it stay whole."""
    return F.xxhash64(F.lit(7), F.col("doc_id"), F.col("text"), F.col("doc_id").isNull(), F.col("text").isNull())


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; null ids take the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def text_slices(texts, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of an Arrow string or binary array with their bytes.

    Yields (first row, end row, bytes, offsets). A run ends once it holds ``limit`` bytes, so a
    run is at most that plus one text. Nulls count as empty.
    """
    import pyarrow as pa

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if n == 0:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    if texts.null_count:
        lengths = np.diff(offsets)
        lengths = np.where(np.asarray(texts.is_null()), 0, lengths)
    else:
        lengths = np.diff(offsets)
    first = 0
    while first < n:
        end, total = first, 0
        while end < n and (total == 0 or total + lengths[end] <= limit):
            total += int(lengths[end])
            end += 1
        own = np.concatenate([[0], np.cumsum(lengths[first:end])]).astype(np.int64)
        if int(offsets[end] - offsets[first]) == total:
            part = data[offsets[first] : offsets[end]]
        else:
            part = np.concatenate([data[offsets[i] : offsets[i] + lengths[i]] for i in range(first, end)])
        yield first, end, part, own
        first = end


def _odd_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.full(n, base))
        down = np.multiply.accumulate(np.full(n, inverse))
    return up, down


_POWERS: list[np.ndarray] = []
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that end a term: all of ASCII but digits and letters.
NO_TERM = np.ones(256, bool)
NO_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def word_bounds(
    data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None, gap: np.ndarray = _IS_SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows) of the maximal runs without white space, or other bytes in ``gap``;
    words never cross rows. ``cuts`` marks the bytes, and the end, at which another word begins
    all the same."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~gap[data]
    begins = np.zeros(len(data) + 1, bool) if cuts is None else cuts.copy()
    begins[offsets[:-1]] = True
    before = np.concatenate([[False], solid[:-1]])
    starts = np.flatnonzero(solid & (~before | begins[:-1]))
    after = np.concatenate([solid[1:], [False]])
    stops = begins[1:].copy()
    stops[-1] = True
    ends = np.flatnonzero(solid & (~after | stops)) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: a polynomial over random byte values, then mixed."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    if not _POWERS or len(_POWERS[0]) < len(data):
        _POWERS[:] = _odd_powers(max(len(data), SLICE))
    up, down = _POWERS
    with np.errstate(over="ignore"):
        running = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[: len(data)], out=running[1:])
        plain = (running[ends] - running[starts]) * down[starts]
        return mix64(plain + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words_of(texts, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, rows relative to the first) of each slice of texts."""
    for first, end, data, offsets in text_slices(texts):
        folded = LOWER[data] if lower else data
        starts, ends, rows = word_bounds(folded, offsets)
        yield first, end, span_hashes(folded, starts, ends), rows


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start + length."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    base = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return base + np.arange(total)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
