"""Binary graph reads, decoded by a small reader of the wire format.

Two containers hold alignment messages.  A frame file is a sequence of unsigned 32-bit little-endian lengths,
each with a message of that many bytes.  A ``.gam`` is gzip members one after another; inflated it is groups,
each a count of items and, for every item, a length and its bytes; the first item may be a tag that names the
kind of messages.  Lengths are only known in sequence, so framing is by file; a ``.gam`` of blocks is read and
inflated in splits before that (see :mod:`.blocks`), and messages are dealt over all tasks before they are
decoded.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..package import ship
from . import blocks, schemas

PATH = schemas.READ_JSON.split("path ", 1)[1]
SCHEMA = f"file string, file_no int, frame long, error string, name string, sequence string, mapping_quality int, score int, quality binary, path {PATH}"
FRAME = "file string, file_no int, frame long, error string, message binary"

# Field numbers of the messages that make up a read.
NUMBERS = {
    "Alignment": {"sequence": 1, "path": 2, "name": 3, "quality": 4, "mapping_quality": 5, "score": 6},
    "Path": {"name": 1, "mapping": 2},
    "Mapping": {"position": 1, "edit": 2, "rank": 5},
    "Position": {"node_id": 1, "offset": 2, "is_reverse": 4},
    "Edit": {"from_length": 1, "to_length": 2, "sequence": 3},
}
ZERO = {"string": "", "binary": b"", "long": 0, "int": 0, "boolean": False}
TAG = b"GAM"


def _fields_of(name: str) -> dict:
    """``number -> (field, type, repeated)`` of a message."""
    types = dict(x.split(":") for x in schemas.MESSAGES[name].split())
    return {n: (f, types[f].rstrip("*"), types[f].endswith("*")) for f, n in NUMBERS[name].items()}


FIELDS = {name: _fields_of(name) for name in NUMBERS}


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("truncated number")
        b = data[at]
        value |= (b & 0x7F) << shift
        at += 1
        if b < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at
        shift += 7


def fields(data: bytes):
    """``(number, value)`` of a message; numbers are unsigned, nested messages are bytes."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        if at > len(data):
            raise ValueError("truncated field")
        yield number, value


def signed(value: int, bits: int = 64) -> int:
    value &= (1 << bits) - 1
    return value - (1 << bits) if value >> (bits - 1) else value


def decode(data: bytes, name: str = "Alignment") -> dict:
    """A message by field name; absent scalars have their zero values, absent messages are None."""
    out = {f: [] if many else ZERO.get(kind) for f, kind, many in FIELDS[name].values()}
    for number, value in fields(data):
        if number not in FIELDS[name]:
            continue
        field, kind, many = FIELDS[name][number]
        if kind in FIELDS:
            value = decode(value, kind)
        elif kind == "string":
            value = value.decode()
        elif kind == "boolean":
            value = bool(value)
        elif kind != "binary":
            value = signed(value, 32 if kind == "int" else 64)
        if many:
            out[field].append(value)
        else:
            out[field] = value
    return out


def frames(data: bytes):
    """``(message, error)`` of each frame; what is cut off at the end is one error."""
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            yield None, "truncated frame header"
            return
        (size,) = struct.unpack_from("<I", data, at)
        at += 4
        if at + size > len(data):
            yield None, "truncated frame"
            return
        yield data[at : at + size], None
        at += size


def groups(inflated):
    """``(message, error)`` of each item of an inflated ``.gam``, given as an iterator of pieces; tags are left out."""
    held, at = bytearray(), 0

    def more() -> bool:
        nonlocal held, at
        piece = next(inflated, None)
        if piece is None:
            return False
        held = held[at:] + piece
        at = 0
        return True

    def number() -> int | None:
        nonlocal at
        while True:
            try:
                value, after = varint(held, at)
                at = after
                return value
            except ValueError:
                if len(held) - at > 10 or not more():
                    return None

    def take(size: int) -> bytes | None:
        nonlocal at
        while len(held) - at < size:
            if not more():
                return None
        out = bytes(held[at : at + size])
        at += size
        return out

    try:
        while True:
            count = number()
            if count is None:
                if len(held) > at:
                    yield None, "truncated group"
                return
            for k in range(count):
                size = number()
                item = None if size is None else take(size)
                if item is None:
                    yield None, "truncated message"
                    return
                if not (k == 0 and item == TAG):
                    yield item, None
    except zlib.error as e:
        yield None, f"damaged compression: {e}"


def inflate(data: bytes, step: int = 1 << 20):
    """Pieces of the gzip members of ``data``; bytes behind the last member that are none are an error."""
    at = 0
    while at < len(data):
        engine = zlib.decompressobj(31)
        while not engine.eof:
            if at >= len(data):
                raise zlib.error("truncated member")
            piece = data[at : at + step]
            at += len(piece)
            while True:
                out = engine.decompress(piece, step)
                if out:
                    yield out
                piece = engine.unconsumed_tail
                if not piece and len(out) < step:
                    break
        at -= len(engine.unused_data)


def _decoded(file: str, file_no: int, frame: int, error: str | None, message: bytes | None) -> dict:
    row = {"file": file, "file_no": file_no, "frame": frame, "error": error, "name": None, "sequence": None, "mapping_quality": None, "score": None, "quality": None, "path": None}
    if error is None:
        try:
            a = decode(message)
            row |= {c: a[c] for c in ("name", "sequence", "mapping_quality", "score", "quality")}
            steps = []
            for m in (a["path"] or {"mapping": []})["mapping"]:
                p = m["position"] or {"node_id": 0, "offset": 0, "is_reverse": False}
                steps.append({"position": {"node_id": str(p["node_id"]), "offset": str(p["offset"]), "is_reverse": p["is_reverse"]}, "edit": m["edit"], "rank": str(m["rank"])})
            row["path"] = {"name": (a["path"] or {"name": ""})["name"], "mapping": steps}
        except (ValueError, TypeError, AttributeError, UnicodeDecodeError) as e:
            row["error"] = f"undecodable frame: {e}"
    return row


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _messages(spark: SparkSession, path: str, split, held_bytes: int = 8 << 20) -> DataFrame:
    """All messages of the files, framed by ``split(content)`` and dealt over the tasks that decode them."""
    from .readers import file_numbers

    names = file_numbers(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file")), "file_no")
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content").join(names, "file")
    target = _arrow_schema(spark, FRAME)

    def cut(batches):
        for batch in batches:
            for file, content, number in zip(*[batch.column(k) for k in range(3)], strict=True):
                held, size = [], 0
                for k, (message, error) in enumerate(split(content.as_py())):
                    held.append({"file": file.as_py(), "file_no": number.as_py(), "frame": k, "error": error, "message": message})
                    size += len(message or b"") + 100
                    if size > held_bytes:
                        yield pa.RecordBatch.from_pylist(held, target)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, target)

    ship(spark)
    return files.select("file", "content", "file_no").mapInArrow(cut, FRAME)


def _reads(spark: SparkSession, messages: DataFrame) -> DataFrame:
    target = _arrow_schema(spark, SCHEMA)

    def run(batches):
        for batch in batches:
            rows = [_decoded(*x) for x in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, target)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return messages.repartition(parts, "file_no", F.floor(F.col("frame") / 1024)).mapInArrow(run, SCHEMA)


def gam_frames(spark: SparkSession, path: str) -> DataFrame:
    """All frames with ``error`` set where one could not be read."""
    return _reads(spark, _messages(spark, path, frames))


def gam_groups(spark: SparkSession, path: str) -> DataFrame:
    """All messages of ``.gam`` files with ``error`` set where one could not be read."""
    if not blocks.is_blocked(spark, path):
        return _reads(spark, _messages(spark, path, lambda content: groups(inflate(content))))
    from ..operators.visits import small
    from .readers import file_numbers

    found = blocks.framed(spark, path, lambda pieces: ((k, error, message) for k, (message, error) in enumerate(groups(pieces))), ["frame", "error", "message"], "file string, frame long, error string, message binary")
    names = file_numbers(spark.read.format("binaryFile").load(path).select(_plain(F.col("path")).alias("file")), "file_no")
    placed = found.withColumn("file", _plain(F.col("file"))).join(small(names), "file", "left")
    return _reads(spark, placed.select("file", "file_no", "frame", "error", "message"))


def _plain(path):
    """A path as both scans name it."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), "^file:/+", "file:/")


def is_compressed(spark: SparkSession, path: str) -> bool:
    """Whether a file begins as a gzip member does."""
    return blocks.begins(spark, path, b"\x1f\x8b")


def reads_of(frames_: DataFrame) -> DataFrame:
    """Readable frames in the shape of JSON reads, numbered in the order of file names and frames."""
    good = frames_.where(F.col("error").isNull())
    number = F.shiftleft(F.col("file_no").cast("long"), 40) + F.col("frame")
    return good.select(number.alias("read_id"), "name", "sequence", "mapping_quality", "score", F.base64("quality").alias("quality"), "path")
