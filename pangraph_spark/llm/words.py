"""Words of whole Arrow batches, found and hashed with numpy.

A word is ``[^\\x20\\x09-\\x0D]+``.  All its separators are single bytes in UTF-8, so words can be found on
bytes.  A word's hash is a 64-bit polynomial over random values of its bytes, finished by a mixer; two
different words share one with a chance of about 2**-64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20  # bytes that are hashed at a time; bounds the memory of one step
U = np.uint64
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of plain words: all of ASCII but letters and digits.
SYMBOLS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[65:91] += 32
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def powers(base: int, n: int) -> np.ndarray:
    """``base ** k mod 2**64`` for k < n, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * U(pow(base, done, 1 << 64))
        done += step
    return out


_POWERS = [powers(_P, 1), powers(_P_INV, 1)]


def _powers(n: int) -> list[np.ndarray]:
    if n > len(_POWERS[0]):
        found = [powers(_P, n), powers(_P_INV, n)]
        if n > 4 * SLICE:
            return found
        _POWERS[:] = found
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, one to one."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans of one array."""
    p, inv = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """``starts``, ``ends``: byte places in ``data``; ``first[d]:first[d + 1]`` are document d's words."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, separators: np.ndarray = SPACES) -> Words:
    """Words of the documents ``data[offsets[d]:offsets[d + 1]]``."""
    size = len(data)
    starts, ends, hashes = [], [], []
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    at = 0
    while at < size:
        upto = min(size, at + SLICE)
        if upto < size:
            # cut where a word cannot be: after a separator or at a document's end
            window = upto
            while True:
                cut = np.flatnonzero(separators[data[at:window]] | edge[at + 1 : window + 1])
                if len(cut) or window == size:
                    break
                window = min(size, window + SLICE)
            upto = at + int(cut[-1]) + 1 if len(cut) else size
        part = data[at:upto]
        word = ~separators[part]
        e = edge[at : upto + 1]
        begin = word.copy()
        begin[1:] &= ~word[:-1] | e[1:-1]
        finish = word.copy()
        finish[:-1] &= ~word[1:] | e[1:-1]
        s, f = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        hashes.append(hash_spans(LOWER_BYTE[part] if lower else part, s, f))
        starts.append(s + at)
        ends.append(f + at)
        at = upto
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    begin = join(starts, np.int64)
    return Words(data, offsets, begin, join(ends, np.int64), join(hashes, np.uint64), np.searchsorted(begin, offsets))


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows that start at each word, and which of them lie in one document."""
    h = words.hashes
    out = np.zeros(len(h), np.uint64)
    for k in range(n):
        out[: max(0, len(h) - k)] += h[k:] * U(pow(_P, 3 * k + 1, 1 << 64))
    left = np.repeat(words.first[1:], np.diff(words.first)) - np.arange(len(h))
    return mix(out), left >= n


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = 8 << 20):
    """Row ranges of a batch with at most ``limit`` bytes of text each, or one row: ``(rows, data, offsets)``."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, len(offsets) - 1
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield slice(at, upto), data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at]
        at = upto


def per_document(words: Words, values: np.ndarray) -> np.ndarray:
    """Sums of a value per word over each document."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[words.first[1:]] - total[words.first[:-1]]
