"""Numpy views of Arrow text columns: words and their 64-bit hashes, without per-word Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Rows of one Arrow batch sent to Python: bounds a worker's memory when texts are long.
BATCH_ROWS = 500
#: Bytes of text hashed at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ODD = 0x9E3779B97F4A7C15
_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_CODES[65:91] = _CODES[97:123]  # A-Z hash as a-z
_POWERS: dict[int, np.ndarray] = {}


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of Arrow batches in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, PIECE_BYTES + 1), base % 2**64, np.uint64)
        held[0] = 1
        held = np.cumprod(held, dtype=np.uint64)
        if n <= PIECE_BYTES + 1:
            _POWERS[base] = held
    return held[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offset of each row; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of at most PIECE_BYTES (or one row): first, end, bytes, offsets."""
    body, offsets = text_bytes(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, "right")) - 1)
        yield first, end, body[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


def word_hashes(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order, the number of words of each row, and where words begin and end.

    Words are maximal runs without the six ASCII spaces; A-Z count as a-z. A
    word's hash is a polynomial of random byte codes, taken from prefix sums.
    """
    if not len(body):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64), none, none
    solid = ~_SPACE[body]
    inner = offsets[1:-1]
    inner = inner[inner < len(body)]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[inner] = solid[inner]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    cut = inner[inner > 0] - 1
    ends[cut] = solid[cut]
    start = np.flatnonzero(begins)
    stop = np.flatnonzero(ends) + 1
    hashes = run_hashes(_CODES[body], start, stop, _ODD)
    return hashes, np.diff(np.searchsorted(start, offsets)), start, stop


def run_hashes(codes: np.ndarray, start: np.ndarray, stop: np.ndarray, base: int) -> np.ndarray:
    """Hashes of codes[start:stop] for many runs, from prefix sums of a polynomial of an odd base."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _powers(base, len(codes)), out=sums[1:])
    hashes = (sums[stop] - sums[start]) * _powers(pow(base, -1, 2**64), len(codes) + 1)[start]
    return mixed(hashes + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length) for each pair."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + shift
