"""Words, shingles and batches shared by the operators.

Texts travel to Python as Arrow batches. ``pieces`` cuts a batch into slices of
bounded size, so that vectorized work on one slice has bounded memory whatever
the batch size of the session is; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SPACES = r"[\x20\x09-\x0D]+"
PIECE_BYTES = 1 << 20
SHINGLE = 5

_rng = np.random.Generator(np.random.PCG64(20240607))
# a random 64-bit value per byte; capital A-Z share the value of their lower-case form
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
# for alignment, everything of ASCII but letters and digits separates words
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def powers(name: str, base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        full = np.full(size, base, np.uint64)
        full[0] = 1
        have = _powers[name] = np.multiply.accumulate(full)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and where each text starts and the last ends."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch holding about ``PIECE_BYTES`` of text, at least one row each."""
    _, at = flat(batch.column(column))
    start, rows = 0, batch.num_rows
    while start < rows:
        end = int(np.searchsorted(at, at[start] + PIECE_BYTES, side="right")) - 1
        end = min(rows, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


def words(texts: pa.Array, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each lower-cased word, and where each text's words start and the last end."""
    data, at = flat(texts)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = at[1:-1][at[1:-1] < n]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = at[1:-1][at[1:-1] > 0]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers("base", _BASE, n), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * powers("inverse", _INVERSE, n)[starts])
    return hashes, np.searchsorted(starts, at)


def grams(hashes: np.ndarray, at: np.ndarray, n: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``n`` words, and window bounds per text.

    With ``whole``, a text of fewer words has one window over all its words;
    a text without words has none.
    """
    counts = np.diff(at)
    total = len(hashes)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    made = np.zeros(total, np.uint64)
    for k in range(n):
        made[:total - k] += mix(hashes[k:] + np.uint64(k + 1)) if total > k else 0
    n_windows = np.where(counts >= n, counts - n + 1, 0)
    keep = np.arange(total) - np.repeat(at[:-1], counts) < np.repeat(n_windows, counts)
    if whole:
        for i in np.flatnonzero((counts > 0) & (counts < n)):
            own = hashes[at[i]:at[i + 1]]
            made[at[i]] = np.add.reduce(mix(own + np.arange(1, len(own) + 1, dtype=np.uint64)))
            keep[at[i]] = True
            n_windows[i] = 1
    return mix(made[keep]), np.concatenate([[0], np.cumsum(n_windows)])


def distinct_by_text(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and their bounds per text."""
    sets, bounds = [], np.zeros(len(at), np.int64)
    for i in range(len(at) - 1):
        own = np.sort(values[at[i]:at[i + 1]])
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        sets.append(own)
        bounds[i + 1] = bounds[i] + len(own)
    return np.concatenate(sets) if sets else values, bounds


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``n``-word shingles of each text, sorted, and their bounds per text."""
    return distinct_by_text(*grams(*words(texts), n))


def documents(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def id_and_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and the named columns; whatever else the input holds stays out."""
    return docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"), *[F.col(f"`{c}`") for c in more])
