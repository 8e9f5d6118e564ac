"""The domain's tables, projected from general ones.

Parts are graph nodes on the path of their brand (and of their type), orders are reads, line items are
visits, events are linear reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import region_label, window_start
from ..operators import paths

FLANK = 100
EPOCH = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"


class Graph:
    """Lazily projected tables of one input folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def raw_nodes(self) -> DataFrame:
        strand = F.when(F.col("p_size") % 2 == 0, F.lit(">")).otherwise(F.lit("<"))
        return self.table("part").select(F.col("p_partkey").cast("long").alias("node_id"), F.col("p_name").alias("sequence"), F.length("p_name").cast("long").alias("length"), F.col("p_brand").alias("path"), strand.alias("strand"))

    def nodes(self) -> DataFrame:
        return paths.with_offsets(self.raw_nodes())

    def steps(self) -> DataFrame:
        part = self.table("part")
        one = lambda c, k: part.select(F.col(c).alias("path"), F.col("p_partkey").cast("long").alias("node_id"), F.lit(k).alias("ordinal"), F.col("p_size"))
        both = one("p_brand", 0).unionByName(one("p_type", 1))
        return both.withColumn("strand", F.when(F.col("p_size") % 2 == 0, F.lit(">")).otherwise(F.lit("<"))).drop("p_size")

    def edges(self) -> DataFrame:
        return paths.consecutive_edges(self.steps())

    def visits(self) -> DataFrame:
        """Ranks order a read's lines; a read has few lines, so its window is small."""
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
        rows = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
        return rows.select(F.col("l_orderkey").cast("long").alias("read_id"), F.row_number().over(order).cast("long").alias("rank"), F.col("l_partkey").cast("long").alias("node_id"), F.col("l_quantity").cast("long").alias("offset"))

    def plain_visits(self) -> DataFrame:
        """Visits with their line number, where ranks without gaps are not needed: no window, no shuffle."""
        return self.table("lineitem").select(F.col("l_orderkey").cast("long").alias("read_id"), F.col("l_linenumber").cast("long").alias("rank"), F.col("l_partkey").cast("long").alias("node_id"), F.col("l_quantity").cast("long").alias("offset"))

    def ordered_visits(self) -> DataFrame:
        """Visits whose rank is what orders them, for operators that only compare ranks: no window, no shuffle."""
        rows = self.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("rank"))
        return rows.select(F.col("l_orderkey").cast("long").alias("read_id"), "rank", F.col("l_partkey").cast("long").alias("node_id"), F.col("l_quantity").cast("long").alias("offset"))

    def reads(self) -> DataFrame:
        """Reads with their visits as a nested path; a read has few."""
        rows = self.plain_visits()
        step = F.struct("rank", F.struct(F.struct("node_id", "offset").alias("position")).alias("m"))
        found = rows.groupBy("read_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
        return found.select("read_id", F.struct(F.transform("steps", lambda x: x.m).alias("mapping")).alias("path"))

    def variants(self) -> DataFrame:
        """One variant at each node's start."""
        return self.nodes().select(F.col("node_id").alias("ordinal"), "path", F.col("start_offset").alias("pos"))

    def regions(self) -> DataFrame:
        v = self.variants().select("ordinal", "path", (F.col("pos") - FLANK).alias("lo"), (F.col("pos") + FLANK).alias("hi"))
        return v.withColumn("region", region_label(F.col("path"), F.col("lo"), F.col("hi"), "REF#0"))

    def region_segments(self) -> DataFrame:
        return paths.window_segments(self.nodes(), self.regions())

    def linear_reads(self) -> DataFrame:
        start = F.expr(EPOCH).cast("long")
        return self.table("events").select(F.col("event_id").cast("long").alias("read_id"), F.col("event_type").alias("contig"), start.alias("start"), (start + 150).alias("end"))

    def linear_windows(self, flank: int = 20_000) -> DataFrame:
        """The window of every event."""
        return self.linear_reads().select(F.col("read_id").alias("variant_id"), "contig", window_start(F.col("start"), flank).alias("lo"), (F.col("start") + flank).alias("hi"))


SQL_TABLES = f"""
nodes AS (
  SELECT CAST(p_partkey AS BIGINT) AS node_id, p_name AS sequence, CAST(length(p_name) AS BIGINT) AS length, p_brand AS path,
    CASE WHEN p_size % 2 = 0 THEN '>' ELSE '<' END AS strand,
    CAST(coalesce(sum(length(p_name)) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset
  FROM part),
steps AS (
  SELECT p_brand AS path, CAST(p_partkey AS BIGINT) AS node_id, CASE WHEN p_size % 2 = 0 THEN '>' ELSE '<' END AS strand FROM part
  UNION ALL
  SELECT p_type, CAST(p_partkey AS BIGINT), CASE WHEN p_size % 2 = 0 THEN '>' ELSE '<' END FROM part),
edges AS (
  SELECT DISTINCT a, b FROM (SELECT node_id AS a, lead(node_id) OVER (PARTITION BY path ORDER BY node_id) AS b FROM steps) WHERE b IS NOT NULL),
visits AS (
  SELECT CAST(l_orderkey AS BIGINT) AS read_id, CAST(l_partkey AS BIGINT) AS node_id, CAST(l_quantity AS BIGINT) AS "offset",
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rank
  FROM lineitem),
variants AS (SELECT node_id AS ordinal, path, start_offset AS pos FROM nodes),
regions AS (
  SELECT ordinal, path, pos - {FLANK} AS lo, pos + {FLANK} AS hi,
    'REF#0#' || path || ':' || CAST(pos - {FLANK} AS VARCHAR) || '-' || CAST(pos + {FLANK} AS VARCHAR) AS region
  FROM variants),
region_segments AS (
  SELECT r.region, r.ordinal, n.node_id FROM regions r JOIN nodes n ON n.path = r.path AND n.start_offset <= r.hi AND n.start_offset + n.length > r.lo),
last_region AS (SELECT node_id, arg_max(region, ordinal) AS region FROM region_segments GROUP BY node_id),
linear_reads AS (
  SELECT CAST(event_id AS BIGINT) AS read_id, event_type AS contig, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + 150 AS "end" FROM events)
"""
