"""Exact top-k by inner product with the threshold algorithm.

Components are turned into integers, floor(scale * x).  Rows are spread over blocks by a hash of their id,
so equal vectors spread too, and queries over tiles in the same way; each block meets each tile in a task of
its own, whose memory is bounded whatever the table's size.  In a block every dimension has a list of the
rows sorted by that component.  A query reads all its lists in step, from the top where its own component is
positive and from the bottom where it is negative.  Rows met for the first time are scored exactly; the sum
of the products at the current depth bounds every row not met yet.  A query stops once that bound is below
its k-th score, so rows that tie are all met and the smaller id wins.

The k-th score is shared: ``sample`` rows, the same for all, are scored first, and the k-th best of them
bounds a query's final k-th score from below in every block.  Each query keeps its k best of every block,
and these are merged.

Vectors that are null or empty, or hold null or non-finite components, take no part, neither as query nor
as candidate; nor do rows without id.  Vectors of different lengths have no product and never meet.  Rows that repeat an
id are candidates each, and a query skips all rows of its own id.  A query row that repeats is answered
once.  With fewer than k candidates all are returned.  Components of any finite size are scaled and
multiplied exactly; a score beyond the range of a long is given as that range's nearest end, and scores
there count as ties.  An empty table gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

RESULT = "query_id long, vec_id long, score long"
LARGEST = 1.7976931348623157e308
MOST, LEAST = 2**63 - 1, -(2**63)
SAMPLE = 4096  # rows that give the shared k-th scores


def quantize(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, v array<double>`` of the rows that take part; scaled components are whole numbers."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    good = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & good)
    # floor() gives longs, so whole numbers beyond 2**53, which have no fraction, pass as they are; those that
    # scaling would make infinite keep the largest double
    scaled = lambda e: F.least(F.greatest(e * F.lit(float(scale)), F.lit(-LARGEST)), F.lit(LARGEST))
    whole = lambda e: F.when(F.abs(e) < F.lit(2.0**53), F.floor(e).cast("double")).otherwise(e)
    return rows.select("vec_id", F.transform(F.transform("x", scaled), whole).alias("v"))


def exact(rows: np.ndarray) -> np.ndarray:
    """The same whole numbers as integers of any size."""
    return np.array([[int(x) for x in r] for r in rows.tolist()], object).reshape(rows.shape)


def start_bounds(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """A score that each query's final k-th score cannot be below: the k-th best of some rows."""
    bound = np.full(len(queries), -np.inf)
    for at in range(0, len(queries), 1024):
        part = slice(at, at + 1024)
        score = np.where(query_ids[part, None] == ids, -np.inf, queries[part] @ rows.T)
        if score.shape[1] >= k:
            bound[part] = np.partition(score, -k, axis=1)[:, -k]
    return bound


def block_search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, sample=None, step: int = 64):
    """Threshold algorithm of some queries over one block: ``(query, id, score)`` lists, k best each.

    Rows below what ``sample``, ``(ids, rows)``, shows to be a query's least k-th score are left out.
    """
    n, dims = rows.shape
    lists = np.argsort(-rows, axis=0, kind="stable").astype(np.int32)
    # sums of products below 2**53 are exact in double precision; beyond it they are made of big integers
    largest = max(float(np.abs(x).max(initial=0)) for x in (rows, *([sample[1]] if sample else [])))
    small = largest * float(np.abs(queries).max(initial=0)) * dims < 2**53
    floor = start_bounds(*sample, query_ids, queries, k) if sample and small else np.full(len(queries), -np.inf)
    if not small:
        rows, queries = exact(rows), exact(queries)
    ordered = np.take_along_axis(rows, lists, axis=0)
    out_q, out_id, out_s = [], [], []
    dim = np.arange(dims)
    for qid, q, least in zip(query_ids.tolist(), queries, floor.tolist(), strict=True):
        up = q >= 0
        seen = np.zeros(n, bool)
        seen[ids == qid] = True
        best_s, best_id = np.zeros(0, rows.dtype), np.zeros(0, np.int64)
        depth, width = 0, step
        while depth < n:
            end = min(n, depth + width)
            at = np.where(up, np.arange(depth, end)[:, None], n - 1 - np.arange(depth, end)[:, None])
            met = np.zeros(n, bool)
            met[lists[at, dim].ravel()] = True
            met &= ~seen
            new = np.flatnonzero(met)
            if len(new):
                seen[new] = True
                score = rows[new] @ q
                if small:
                    new, score = new[score >= least], score[score >= least]
                s, i = np.concatenate((best_s, score)), np.concatenate((best_id, ids[new]))
                order = np.lexsort((i, -s)) if small else np.array(sorted(range(len(s)), key=lambda j: (-min(max(s[j], LEAST), MOST), i[j])), np.int64)
                best_s, best_id = s[order[:k]], i[order[:k]]
            depth = end
            width = min(4096, 2 * width)
            last = depth - 1
            bound = (ordered[np.where(up, last, n - 1 - last), dim] * q).sum()
            if bound < least or (len(best_s) == k and min(max(bound, LEAST), MOST) < min(max(best_s[-1], LEAST), MOST)):
                break
        out_q += [qid] * len(best_s)
        out_id += best_id.tolist()
        out_s += [min(max(int(x), LEAST), MOST) for x in best_s]
    return out_q, out_id, out_s


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, block: int = 8192, tile: int = 8192) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of ``vectors`` that score highest for each query."""
    spark = vectors.sparkSession
    rows = common.cut(quantize(vectors, scale))
    asks = common.cut(quantize(queries, scale).dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")))
    blocks, asked = max(1, -(-rows.count() // block)), asks.count()
    # few blocks are met by smaller tiles, so that all tasks of the cluster have some
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles = max(1, -(-asked // tile), min(-(-asked // 128), -(-2 * parts // blocks)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = rows.withColumn("block", place("vec_id", blocks)).withColumn("tile", every(tiles))
    right = asks.withColumn("tile", place("query_id", tiles)).withColumn("block", every(blocks))
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    by_size: dict[int, list] = {}
    for r in some:
        by_size.setdefault(len(r.v), []).append(r)
    shared = spark.sparkContext.broadcast({n: (np.array([r.vec_id for r in x], np.int64), np.array([r.v for r in x])) for n, x in by_size.items()})

    @common.grouped
    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not a.num_rows or not b.num_rows:
            return empty
        sizes = a["v"].combine_chunks().value_lengths().to_numpy()
        q_sizes = b["q"].combine_chunks().value_lengths().to_numpy()
        found = ([], [], [])
        # vectors of different lengths have no product: each length is searched on its own
        for dims in np.intersect1d(sizes, q_sizes).tolist():
            mine, theirs = sizes == dims, q_sizes == dims
            flat = a["v"].combine_chunks().filter(pa.array(mine)).flatten().to_numpy().reshape(-1, dims)
            q = b["q"].combine_chunks().filter(pa.array(theirs)).flatten().to_numpy().reshape(-1, dims)
            for to, got in zip(found, block_search(a["vec_id"].to_numpy()[mine], flat, b["query_id"].to_numpy()[theirs], q, k, shared.value.get(dims)), strict=True):
                to += got
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), found, strict=True)})

    common.ship(spark)
    found = left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile")).applyInArrow(run, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH rows AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
  FROM rows q JOIN rows r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""


def query(spark, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))
