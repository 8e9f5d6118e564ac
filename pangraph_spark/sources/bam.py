"""BAM reads: the binary form of linear alignments, decoded without an index.

The region fetch that an index serves elsewhere is an interval join here.  Files of blocks are read in splits
(see :mod:`.blocks`), other gzip files whole, one a task.  Records are found in sequence, a file a task, and
dealt over all tasks before they are decoded.
"""

from __future__ import annotations

import gzip
import io
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..package import ship
from . import blocks

SCHEMA = "query_name string, contig string, start long, end long, cigar string, sequence string, mapping_quality int, is_reverse boolean"
RECORD = "file string, number long, contig string, body binary"
# Bases by 4-bit code and CIGAR operations by number, as the format defines them.
BASES = "=ACMGRSVTWYHKDBN"
OPERATIONS = "MIDNSHP=X"
ON_REFERENCE = "MDN=X"


class Stream:
    """Reads of exact sizes from an iterator of pieces."""

    def __init__(self, pieces):
        self.pieces, self.held = pieces, io.BytesIO()

    def read(self, size: int) -> bytes:
        out = self.held.read(size)
        while len(out) < size and (piece := next(self.pieces, None)) is not None:
            self.held = io.BytesIO(piece)
            out += self.held.read(size - len(out))
        return out


def bodies(stream):
    """``(number, contig, body)`` of an inflated BAM stream; reads without a contig are left out."""
    if stream.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    (size,) = struct.unpack("<i", stream.read(4))
    stream.read(size)
    (n,) = struct.unpack("<i", stream.read(4))
    names = []
    for _ in range(n):
        (size,) = struct.unpack("<i", stream.read(4))
        names.append(stream.read(size)[:-1].decode())
        stream.read(4)
    number = 0
    while len(head := stream.read(4)) == 4:
        (size,) = struct.unpack("<i", head)
        body = stream.read(size)
        if len(body) < size:
            raise ValueError("truncated record")
        (ref,) = struct.unpack_from("<i", body)
        if ref >= 0:
            yield number, names[ref], body
        number += 1


def decode(contig: str, body: bytes) -> dict:
    _, pos, l_name, mapq, _bin, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", body)
    at = 32
    name = body[at : at + l_name - 1].decode()
    at += l_name
    ops = [(x >> 4, OPERATIONS[x & 15]) for x in struct.unpack_from(f"<{n_cigar}I", body, at)]
    at += 4 * n_cigar
    packed = body[at : at + (l_seq + 1) // 2]
    bases = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq]
    span = sum(k for k, op in ops if op in ON_REFERENCE)
    return {
        "query_name": name, "contig": contig, "start": pos, "end": pos + max(1, span), "cigar": "".join(f"{k}{op}" for k, op in ops) or None,
        "sequence": bases or None, "mapping_quality": mapq, "is_reverse": bool(flag & 16),
    }


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of files that are one gzip stream."""
    from pyspark.sql.pandas.types import to_arrow_schema

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    target = to_arrow_schema(spark.createDataFrame([], RECORD).schema)

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = []
                for number, contig, body in bodies(gzip.GzipFile(fileobj=io.BytesIO(content))):
                    held.append({"file": file, "number": number, "contig": contig, "body": body})
                    if len(held) == 5000:
                        yield pa.RecordBatch.from_pylist(held, target)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, target)

    return files.mapInArrow(run, RECORD)


def bam(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(spark)
    if blocks.is_blocked(spark, path):
        rows = blocks.framed(spark, path, lambda pieces: bodies(Stream(pieces)), ["number", "contig", "body"], RECORD)
    else:
        rows = _whole_files(spark, path)
    target = to_arrow_schema(spark.createDataFrame([], SCHEMA).schema)

    def run(batches):
        for batch in batches:
            found = [decode(c, b) for c, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if found:
                yield pa.RecordBatch.from_pylist(found, target)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "file", F.floor(F.col("number") / 4096)).select("contig", "body").mapInArrow(run, SCHEMA)
