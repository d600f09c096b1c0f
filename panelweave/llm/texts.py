"""Texts inside tasks: Arrow string columns as byte arrays, and word hashes without a loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)  # fixed values: ASCII white space
BLOCK_BYTES = 1 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and where each text begins; a null text is empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def blocks(batches, column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``most`` bytes of text, one row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lengths)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, ASCII letters in lower case, and the text it stands in.

    A word is a run of bytes other than ASCII white space; it never crosses two texts.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    first[edge] = inside[edge]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.arange(n, dtype=np.int64)
    place -= np.repeat(starts, np.diff(np.append(starts, n))) if starts[0] == 0 else np.concatenate([place[: starts[0]], np.repeat(starts, np.diff(np.append(starts, n)))])
    place[~inside] = 0
    powers = np.cumprod(np.full(int(place.max()) + 1, _MULTIPLIER, np.uint64))
    value = (_LOWER[data].astype(np.uint64) + np.uint64(1)) * powers[place]
    value[~inside] = 0
    return mix(np.add.reduceat(value, starts)), np.searchsorted(offsets, starts, side="right") - 1


def runs_within(owner: np.ndarray, n_owners: int) -> np.ndarray:
    """Where the entries of each owner begin in a sorted array of owners, and its end."""
    return np.searchsorted(owner, np.arange(n_owners + 1))


def shingles(hashes: np.ndarray, owner: np.ndarray, n_owners: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` words in a row and their text; a shorter text gives one of all its words."""
    bounds = runs_within(owner, n_owners)
    counts = np.diff(bounds)
    total = np.zeros(len(hashes), np.uint64)
    left = np.arange(len(hashes)) - np.repeat(bounds[:-1], counts)
    short = np.repeat(counts < size, counts)
    for k in range(size):
        moved = np.zeros(len(hashes), np.uint64)
        moved[: len(hashes) - k] = hashes[k:]
        beyond = left + k >= np.repeat(counts, counts)
        moved[beyond] = 0
        total = mix(total + moved + _MULTIPLIER)
    keep = (left + size <= np.repeat(counts, counts)) | (short & (left == 0))
    return total[keep], owner[keep]


def occurrences(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number the repeats of a value inside its owner, and hash value and number together, so
    that sets of the results compare as multisets of the values. Sorted by owner."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    if not len(v):
        return v, o
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    where = np.flatnonzero(new)
    number = np.arange(len(v)) - np.repeat(where, np.diff(np.append(where, len(v))))
    return np.where(number == 0, v, mix(v + number.astype(np.uint64) * _MULTIPLIER)), o
