"""Packed arrays that travel between ranges of documents.

Operators over words or shingles would shuffle billions of small rows.  Here a task packs what it sends to
one receiver into a single binary value, sorted by place so that places compress to almost nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CODEC = "zstd"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length each; sorted integers are kept as differences."""
    head = [len(arrays)]
    body = []
    for a in arrays:
        raw = a.tobytes()
        if a.dtype == np.int64 and len(a):
            small = pa.compress(np.diff(a, prepend=0).tobytes(), codec=_CODEC, asbytes=True)
            head += [1, len(raw), len(small)]
            body.append(small)
        else:
            head += [{"uint64": 0, "int64": 0, "uint8": 2, "int32": 3}[a.dtype.name], len(raw), len(raw)]
            body.append(raw)
    return np.array(head, np.int64).tobytes() + b"".join(body)


def unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 1 + 3 * n)[1:].reshape(n, 3)
    at, out = 8 * (1 + 3 * n), []
    for kind, raw, kept in head.tolist():
        part = data[at : at + kept]
        at += kept
        if kind == 1:
            out.append(np.cumsum(np.frombuffer(pa.decompress(part, decompressed_size=raw, codec=_CODEC, asbytes=True), np.int64)))
        else:
            out.append(np.frombuffer(part, {0: np.uint64, 2: np.uint8, 3: np.int32}[kind]))
    return out


def by_bucket(hashes: np.ndarray, buckets: int):
    """``(bucket, rows)`` for each receiver that some hash falls to; rows keep their order."""
    if not len(hashes):
        return
    if buckets == 1:
        yield 0, np.arange(len(hashes))
        return
    bucket = (hashes >> np.uint64(64 - (buckets - 1).bit_length())).astype(np.int64)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")  # 16 bits are sorted by radix
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield int(bucket[order[a]]), order[a:b]
