"""Block-compressed files, split at their blocks.

Such a file is small gzip members one after another, each of which names its own size in an extra field.  Their
common beginning serves as record separator of a text scan, so splits, file systems and sizes are Spark's.
Blocks are inflated in parallel; then each file's pieces, in order, run through one pass that finds where messages
begin, which holds no more than a few pieces at a time.
"""

from __future__ import annotations

import itertools
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..package import ship

# Fixed value: how the blocks of the usual writers begin, up to the field that holds their size.
MAGIC = bytes.fromhex("1f8b08040000000000ff060042430200")
PIECE = "file string, split long, row long, data binary, error string"


def begins(spark: SparkSession, path: str, start: bytes) -> bool:
    """Whether the first file of a path begins with some bytes."""
    first = spark.read.text(path).select(F.hex(F.substring(F.col("value").cast("binary"), 1, len(start))).alias("h")).first()
    return first is not None and first.h == start.hex().upper()


def is_blocked(spark: SparkSession, path: str) -> bool:
    # a line ends at the first byte 0x0A, which the beginning does not hold
    return begins(spark, path, MAGIC)


def inflate_block(rest: bytes) -> bytes:
    """What a block holds, given without its common beginning."""
    if len(rest) < 10 or struct.unpack_from("<H", rest)[0] + 1 != len(MAGIC) + len(rest):
        raise zlib.error("block of a wrong size")
    data = zlib.decompress(rest[2:-8], -15)
    check, size = struct.unpack("<II", rest[-8:])
    if len(data) != size or zlib.crc32(data) != check:
        raise zlib.error("damaged block")
    return data


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, split, row, data, error``: inflated blocks; by split and row they are in the file's order."""
    blocks = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    rows = blocks.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("b")).withColumn("row", F.monotonically_increasing_id())

    def run(batches):
        for batch in batches:
            out = {"file": [], "split": [], "row": [], "data": [], "error": []}
            for file, split, b, row in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if not b:
                    continue
                data, error = None, None
                try:
                    data = inflate_block(b)
                except zlib.error as e:
                    error = str(e)
                if data or error:
                    for name, value in zip(out, (file, split, row, data, error), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out["file"], pa.string()), pa.array(out["split"], pa.int64()), pa.array(out["row"], pa.int64()), pa.array(out["data"], pa.binary()), pa.array(out["error"], pa.string())], names=list(out))

    ship(spark)
    return rows.where(F.length("b") > 0).mapInArrow(run, PIECE)


def _in_order(batches):
    for batch in batches:
        for file, data, error in zip(*[batch.column(k) for k in (0, 3, 4)], strict=True):
            yield file.as_py(), data.as_py(), error.as_py()


def _data(rows):
    for _, data, error in rows:
        if error:
            raise zlib.error(error)
        yield data


def framed(spark: SparkSession, path: str, frame, names: list[str], schema: str, held_bytes: int = 4 << 20) -> DataFrame:
    """``file`` and what ``frame(pieces)`` yields for each file: tuples of the columns ``names``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(spark.createDataFrame([], schema).schema)
    ordered = pieces(spark, path).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file").sortWithinPartitions("file", "split", "row")

    def run(batches):
        for file, rows in itertools.groupby(_in_order(batches), key=lambda x: x[0]):
            held, size = [], 0
            for item in frame(_data(rows)):
                held.append({"file": file, **dict(zip(names, item, strict=True))})
                size += 100 + sum(len(x) for x in item if isinstance(x, bytes))
                if size > held_bytes:
                    yield pa.RecordBatch.from_pylist(held, target)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, target)

    return ordered.mapInArrow(run, schema)
