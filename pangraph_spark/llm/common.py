"""What the operators share: reading tables, joins with lookup tables, steps over Arrow tables."""

from __future__ import annotations

import ctypes
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..package import ship
from ..scratch import cut, dropped

__all__ = ["FEW", "KEPT", "SALTS", "TOKENIZER", "among", "arrow", "attach", "begin", "cut", "dropped", "give_back", "grouped", "map_arrow", "pa", "rows_of", "ship", "table", "texts", "tokenizer_path"]

#: The tokenizer file that the queries use.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """The two columns that text operators read; others are left alone, whatever their names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def give_back() -> None:
    """Returns freed memory to the system, as worker processes live on from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: What the operator at work keeps in this worker process from task to task.
KEPT: dict = {}


def begin(owner: str) -> None:
    """A task of ``owner`` begins: what another operator has kept goes, as workers serve them all."""
    if KEPT.get("owner") != owner:
        KEPT.clear()
        KEPT["owner"] = owner
        pa.set_memory_pool(pa.system_memory_pool())


def grouped(f):
    """``f``, which makes a table of a group or of two cogroups, as a step that leaves nothing behind."""

    def run(*tables: pa.Table) -> pa.Table:
        begin(f.__module__)
        out = f(*tables)
        give_back()
        return out

    # Spark counts the arguments
    return (lambda a, b: run(a, b)) if f.__code__.co_argcount == 2 else (lambda a: run(a))


def map_arrow(df: DataFrame, step, schema: str) -> DataFrame:
    """``step(batch)`` yields Arrow batches for each batch of a partition."""

    def run(batches):
        begin(step.__module__)
        for batch in batches:
            yield from step(batch)
        give_back()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Rows of a lookup table that are broadcast; more are repeated for each of SALTS parts of the other side.
FEW, SALTS = 200_000, 32


def attach(left: DataFrame, right: DataFrame, keys: list[str], by: str = "doc_id") -> DataFrame:
    """``left`` with the columns of ``right``, which has at most one row a key, or nulls.

    A key that many rows of ``left`` hold is dealt over tasks by ``by``: either side's size decides nothing
    but how rows travel.
    """
    if right.limit(FEW + 1).count() <= FEW:
        return left.join(F.broadcast(right), keys, "left")
    part = F.pmod(F.xxhash64(by), F.lit(SALTS))
    salted = right.withColumn("salt_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.withColumn("salt_no", part).join(salted, [*keys, "salt_no"], "left").drop("salt_no")


BITS = 1 << 23


def among(ids: DataFrame, name: str):
    """A condition on ``name`` that holds for all of ``ids(name)`` and for few others.

    One bit for each hash of an id, 1 MB whatever the table's size, tested where the rows are; so a join
    with few ids moves few rows.
    """
    place = F.pmod(F.xxhash64(F.col(name).cast("long")), F.lit(BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(cast(`{name}` as bigint)), 64) as int))")
    word = F.shiftright(place, 6).cast("int")
    found = ids.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    bits = [0] * (BITS >> 6)
    for r in found:
        bits[r.w] = r.b
    return F.element_at(F.from_json(F.lit(json.dumps(bits)), "array<bigint>"), word + 1).bitwiseAND(bit) != 0


def arrow(**columns) -> pa.RecordBatch:
    """A record batch of numpy or Arrow columns."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def rows_of(batch: pa.RecordBatch, name: str, rows: slice) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name)).slice(rows.start, rows.stop - rows.start)
