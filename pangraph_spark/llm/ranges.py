"""Ranges of documents of like size, in DataFrame functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_ID = -(2**63)
CELLS = 1 << 14  # counts of bytes that the driver gets at a time
MOST_BUCKETS = 1 << 16


class Ranges:
    """Consecutive ranges of ``doc_id`` with about ``group_bytes`` of text each.

    A document's range is a function of its id alone.  ``column()`` computes it; ranges and the places of
    words inside them are ordered as ids are.  Null ids come before all others.

    Bytes are counted exactly over cells, aligned blocks of ids; cells that hold more than a range should
    are counted again by finer cells, down to single ids.  So ranges are even however ids are spread, and
    only rows of one id, or without one, are always together.
    """

    def __init__(self, docs: DataFrame, group_bytes: int = 8 << 20, least_rows: int = 50):
        spark = docs.sparkSession
        size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
        sized = docs.select(_id().alias("id"), size.alias("b"))
        row = sized.agg(F.count("*").alias("n"), F.sum("b").alias("b"), F.min("id").alias("low"), F.max("id").alias("high")).first()
        self.rows, self.bytes = row.n, row.b or 0
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        want = max(1, -(-self.bytes // group_bytes), min(self.rows // least_rows, parts))
        share = max(1, self.bytes // want)
        self.bounds = [] if want == 1 else _cuts(_cells(sized, row.low, row.high, share, 4 * want), share)
        self.count = len(self.bounds) + 1
        # receivers of packed arrays: a power of two, at most half as many as ranges, since the number of
        # packed values is the product of both
        self.buckets = min(MOST_BUCKETS, 1 << max(0, (self.count // 2).bit_length() - 1))

    def column(self) -> Column:
        """Range number of ``doc_id``: how many bounds lie below it.

        Looked up in two steps, first among every k-th bound and then among the k behind it, so a row
        compares its id with about twice the square root of their number.
        """
        if not self.bounds:
            return F.lit(0)
        step = max(1, int(len(self.bounds) ** 0.5))
        coarse = self.bounds[step - 1 :: step]
        fine = [self.bounds[k * step : k * step + step] for k in range(len(coarse) + 1)]
        below = lambda edges: F.size(F.filter(edges, lambda b: b < _id()))
        block = below(_literal(coarse, "array<bigint>"))
        return (block * step + below(F.element_at(_literal(fine, "array<array<bigint>>"), block + 1))).cast("int")


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID))


def _literal(values: list, kind: str) -> Column:
    """One constant, folded when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _cells(sized: DataFrame, low: int, high: int, share: int, least: int) -> list[tuple[int, int]]:
    """``(last id, bytes)`` of cells in order; none but single ids holds more than ``share``."""
    most = max(least, CELLS)
    shift = 0
    while (high >> shift) - (low >> shift) >= most:
        shift += 1
    found: list[tuple[int, int]] = []
    rows = sized
    while True:
        counted = rows.groupBy(F.shiftright("id", shift).alias("cell")).agg(F.sum("b").alias("b")).collect()
        heavy = [r.cell for r in counted if r.b > share] if shift else []
        again = set(heavy)
        found += [(((r.cell + 1) << shift) - 1, r.b) for r in counted if r.cell not in again]
        if not heavy:
            return sorted(found)
        # at most as many heavy cells as ranges, each cut so that all counts together stay few
        finer = max(0, shift - max(1, (most // len(heavy)).bit_length() - 1))
        rows = rows.where(F.shiftright("id", shift).isin(heavy))
        shift = finer


def _cuts(cells: list[tuple[int, int]], share: int) -> list[int]:
    """The last ids of all ranges but the last one."""
    out, held = [], 0
    for (last, size), follows in zip(cells, [*(b for _, b in cells[1:]), None], strict=True):
        held += size
        if follows is not None and held + follows / 2 > share:
            out.append(last)
            held = 0
    return out
