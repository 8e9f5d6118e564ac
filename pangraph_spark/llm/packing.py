"""Best-fit packing of documents into sequences of fixed length.

1. Documents become pieces of at most ``length`` tokens; the pieces are written once.
2. Pieces are range-sorted by length and ranked inside their length, in parallel: every partition numbers
   its own rows, and the partitions' counts give the offsets.
3. Rounds run in the driver, over counts of lengths, from the longest pieces to the shortest.  In a round the pieces of one length meet the
   sorted gaps; each takes its successor, the tightest gap that holds it.  Pieces of one length are
   alike and so are equal gaps, so a sweep matches a run of ranks with a run of sequences; the order of
   ranks resolves which piece gets which.  Gaps are updated in bulk, and the next round begins.
4. Every piece finds its place by its length and rank, again in parallel.

The sweeps see at most ``length`` piece sizes and as many gap sizes, whatever the corpus holds.  What the
driver gets is one count for each length and partition, which is at most ``length`` more rows than partitions.
Null and empty texts are one token, the end mark.  Repeated rows are packed as often as they come.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common
from .bpe_codec import token_ids
from .token_counts import encoder
from .words import text_slices

SLICE = 2 << 20  # bytes that are encoded at a time; two workers share an executor with what the JVM holds by then
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int) -> DataFrame:
    """Tokenize and cut; one row per piece."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe.automaton(tokenizer))

    def step(batch):
        enc = encoder(shared.value)
        for rows, data, offsets in text_slices(batch, limit=SLICE):
            ids, at = token_ids(enc, data, offsets)
            n = np.diff(at)
            # an end mark behind each document's ids
            marked = np.insert(ids, at[1:], end_id).astype("<u4")
            first = at[:-1] + np.arange(len(n))
            count = n // length + 1
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * length
            size = np.minimum(length, n[doc] + 1 - start)
            view = memoryview(marked).cast("B")
            low = ((first[doc] + start) * 4).tolist()
            crc = [zlib.crc32(view[a : a + 4 * k]) for a, k in zip(low, size.tolist(), strict=True)]
            yield common.arrow(doc_id=common.rows_of(batch, "doc_id", rows).take(common.pa.array(doc)), piece=piece.astype(np.int32), start=start, length=size, ids_crc32=np.array(crc, np.int64))

    return common.map_arrow(common.texts(docs), step, PIECES)


def plan(counts: dict[int, int], length: int) -> np.ndarray:
    """Best-fit rounds over counts of each piece length.

    Rows ``(size, first rank, first sequence, pieces per sequence, offset)``: from that rank on, up to the
    next row of the same size, pieces go to consecutive sequences.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    out, opened = [], 0

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            k = bisect.bisect_left(order, size)
            gap = order[k] if k < len(order) else length
            each = gap // size
            want = -(-left // each)
            if k < len(order):
                first, n = gaps[gap].pop()
                if n > want:
                    gaps[gap].append((first + want, n - want))
                elif not gaps[gap]:
                    del gaps[gap]
                    order.pop(k)
                n = min(n, want)
            else:
                first, n = opened, want
                opened += n
            out.append((size, rank, first, each, length - gap))
            taken = min(left, n * each)
            full, rest = divmod(taken, each)
            add(gap - each * size, first, full)
            if rest:
                add(gap - rest * size, first + full, 1)
            rank += taken
            left -= taken
    return np.array(out, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece, with its sequence and offset."""
    spark = docs.sparkSession
    cuts = common.cut(pieces(docs, tokenizer, length, end_id))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = cuts.repartitionByRange(parts, F.desc("length"), "doc_id", "piece").sortWithinPartitions(F.desc("length"), "doc_id", "piece")

    def number(batches):
        last, run = None, 0
        for batch in batches:
            size = batch.column(3).to_numpy()
            edge = np.flatnonzero(np.diff(size, prepend=-1 if last is None else last) != 0)
            local = np.arange(len(size))
            begin = np.zeros(len(size), np.int64)
            begin[edge] = edge
            np.maximum.accumulate(begin, out=begin)
            head = edge[0] if len(edge) else len(size)
            local -= begin
            local[:head] += run
            if len(size):
                last, run = size[-1], int(local[-1]) + 1
            yield common.pa.RecordBatch.from_arrays([*batch.columns, common.pa.array(local.astype(np.int64))], names=[*batch.schema.names, "local"])

    common.ship(spark)
    ranked = common.cut(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(number, PIECES + ", part int, local long"))
    counts = ranked.groupBy("length", "part").agg((F.max("local") + 1).alias("n")).orderBy("length", "part").collect()
    total: dict[int, int] = {}
    keys, before = [], []
    for r in counts:
        keys.append(r.length << 32 | r.part)
        before.append(total.get(r.length, 0))
        total[r.length] = before[-1] + r.n
    shared = spark.sparkContext.broadcast((np.array(keys, np.int64), np.array(before, np.int64), _sorted(plan(total, length))))

    def place(batch):
        keys, before, rows = shared.value
        size, part, local = (batch.column(k).to_numpy() for k in (3, 5, 6))
        rank = local + before[np.searchsorted(keys, size << 32 | part.astype(np.int64))]
        row = rows[np.searchsorted(rows[:, 0] << 40 | rows[:, 1], size << 40 | rank, "right") - 1]
        since = rank - row[:, 1]
        each = row[:, 3]
        yield common.pa.RecordBatch.from_arrays(
            [*batch.columns[:5], common.pa.array(row[:, 2] + since // each), common.pa.array(row[:, 4] + since % each * size)],
            names=[*batch.schema.names[:5], "sequence_id", "offset"],
        )

    return common.map_arrow(ranked, place, PIECES + ", sequence_id long, offset long")


def _sorted(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def query(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), common.tokenizer_path())
