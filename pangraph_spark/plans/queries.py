"""Named queries over the projected tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import paths, visits
from .projection import SQL_TABLES, Graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
IDS = [3, 14, 159, 265, 358, 979]
SPAN = 1 << 16  # read ids in one row of grouped reads


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Graph(spark, folder))
        SQL[f.__name__] = f"WITH RECURSIVE {SQL_TABLES}{sql}" if sql.lstrip().startswith(",") else f"WITH {SQL_TABLES} {sql}"
        return f

    return add


@_query("SELECT DISTINCT read_id FROM visits WHERE node_id IN (3, 14, 159, 265, 358, 979)")
def reads_hitting_ids(g: Graph) -> DataFrame:
    """Reads that visit any node of a literal list."""
    return visits.hitting_ids(g.reads(), IDS).select("read_id")


@_query("SELECT node_id, region FROM last_region")
def segment_region_last_wins(g: Graph) -> DataFrame:
    """Each segment's last region in document order."""
    return visits.last_region(g.region_segments())


@_query(
    """SELECT read_id, arg_min(region, rank) AS region, arg_min(node_id, rank) AS node_id, arg_min("offset", rank) AS mapping_position
    FROM visits JOIN last_region USING (node_id) GROUP BY read_id"""
)
def first_hit_region(g: Graph) -> DataFrame:
    """Each read's region by its first visit to a known segment."""
    hits = visits.first_hits(g.ordered_visits(), visits.last_region(g.region_segments()))
    return hits.withColumnRenamed("offset", "mapping_position")


@_query("SELECT region, count(DISTINCT read_id) AS reads FROM visits JOIN region_segments USING (node_id) GROUP BY region")
def distinct_reads_per_region(g: Graph) -> DataFrame:
    """Number of distinct reads of each region."""
    found = visits.reads_per_region(g.plain_visits(), g.region_segments())
    return found.groupBy("region").agg(F.count("*").alias("reads"))


@_query(
    """SELECT r.region, coalesce(c.reads, 0) AS reads FROM regions r LEFT JOIN (
      SELECT region, count(DISTINCT read_id) AS reads FROM visits JOIN region_segments USING (node_id) GROUP BY region) c ON c.region = r.region"""
)
def regions_with_empty(g: Graph) -> DataFrame:
    """All regions with their number of distinct reads, also where there are none."""
    found = visits.reads_per_region(g.plain_visits(), g.region_segments())
    return visits.keep_empty(g.regions().select("region"), found.groupBy("region").agg(F.count("*").alias("reads")), "reads")


@_query(
    f"""SELECT n.node_id, n.sequence, n.length, v.read_id // {SPAN} AS part, string_agg(CAST(v.read_id AS VARCHAR), ',' ORDER BY v.read_id) AS reads, count(*) AS n_reads
    FROM (SELECT DISTINCT read_id, node_id FROM visits) v JOIN nodes n USING (node_id) GROUP BY ALL"""
)
def reads_by_node_set(g: Graph) -> DataFrame:
    """Nodes with the reads that visit them, each read once."""
    rows = visits.by_node(g.plain_visits(), g.raw_nodes(), multiset=False)
    return _listed(visits.group_reads(rows, ["node_id", "sequence", "length"], [], SPAN))


@_query(
    f"""SELECT n.node_id, n.strand, n.length, v.read_id // {SPAN} AS part, string_agg(CAST(v.read_id AS VARCHAR), ',' ORDER BY v.read_id) AS reads, count(*) AS n_reads
    FROM visits v JOIN nodes n USING (node_id) GROUP BY ALL"""
)
def reads_by_node_multiset(g: Graph) -> DataFrame:
    """Nodes with the reads that visit them, once a visit."""
    rows = visits.by_node(g.plain_visits(), g.raw_nodes(), multiset=True)
    return _listed(visits.group_reads(rows, ["node_id", "strand", "length"], [], SPAN))


def _listed(grouped: DataFrame) -> DataFrame:
    """Grouped reads as text and their number."""
    ids = F.transform("reads", lambda r: r.read_id.cast("string"))
    return grouped.withColumns({"n_reads": F.size("reads").cast("long"), "reads": F.array_join(ids, ",")})


@_query(
    """, windows AS (SELECT read_id AS variant_id, contig, greatest(0, start - 20000) AS lo, start + 20000 AS hi FROM linear_reads)
    SELECT w.variant_id, r.read_id FROM windows w JOIN linear_reads r ON r.contig = w.contig AND r.start < w.hi AND r."end" > w.lo"""
)
def variant_read_overlap(g: Graph) -> DataFrame:
    """Linear reads that overlap the window of a variant."""
    return paths.overlaps(g.linear_windows(), g.linear_reads(), width=40_000).select("variant_id", "read_id")


@_query(
    """, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
    walk(node_id, hops) AS (SELECT CAST(500 AS BIGINT), 0 UNION SELECT b.b, w.hops + 1 FROM walk w JOIN both_ways b ON b.a = w.node_id WHERE w.hops < 5)
    SELECT node_id, min(hops) AS hops FROM walk GROUP BY node_id"""
)
def neighbourhood_khop(g: Graph) -> DataFrame:
    """Nodes within five edges of node 500."""
    seed = g.spark.range(500, 501).select(F.col("id").alias("node_id"))
    return paths.neighbourhood(g.edges(), seed, 5)


@_query(
    """, points AS (SELECT path, 1000 AS pos FROM nodes GROUP BY path)
    SELECT p.path, CAST(p.pos AS BIGINT) AS pos, arg_min(n.node_id, n.start_offset) AS node_id FROM points p
    LEFT JOIN nodes n ON n.path = p.path AND n.start_offset <= p.pos AND p.pos < n.start_offset + n.length GROUP BY p.path, p.pos"""
)
def locate_node_asof(g: Graph) -> DataFrame:
    """The node at position 1000 of each path."""
    nodes = g.nodes()
    points = nodes.select("path").distinct().withColumn("pos", F.lit(1000).cast("long"))
    return paths.locate(nodes, points)


@_query(
    """, ids AS (SELECT DISTINCT CAST(p_size AS VARCHAR) AS id FROM part)
    SELECT i.id, count(*) AS n, min(o.o_orderkey) AS first_read FROM orders o JOIN ids i ON contains(CAST(o.o_orderkey AS VARCHAR), i.id) GROUP BY i.id"""
)
def name_contains(g: Graph) -> DataFrame:
    """Reads whose name contains an id as text, by the historic substring rule."""
    ids = g.table("part").select(F.col("p_size").cast("string").alias("id")).distinct()
    names = g.table("orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("name"))
    hits = visits.containing(names, "name", ids)
    return hits.groupBy("id").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_read"))


@_query(
    "SELECT s.path, s.node_id, s.strand, n.sequence, n.length FROM steps s LEFT JOIN nodes n USING (node_id)"
)
def path_nodes_left_join_segments(g: Graph) -> DataFrame:
    """Path nodes with their segment lines; those without keep their strand."""
    steps = g.steps().select("path", "node_id", "strand")
    return paths.describe_path(steps, g.raw_nodes().select("node_id", "sequence", "length"))


@_query("SELECT node_id, sequence FROM nodes WHERE node_id IN (SELECT node_id FROM steps WHERE path = 'Brand#7')")
def segments_semi_path(g: Graph) -> DataFrame:
    """Segment lines of the nodes on one path."""
    on_path = g.steps().where(F.col("path") == "Brand#7")
    return g.raw_nodes().join(on_path, "node_id", "left_semi").select("node_id", "sequence")


@_query("SELECT node_id, count(DISTINCT path) AS n_paths, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM steps GROUP BY node_id")
def node_paths_distinct(g: Graph) -> DataFrame:
    """Distinct paths of each node."""
    found = paths.node_paths(g.steps())
    return found.select("node_id", F.size("paths").cast("long").alias("n_paths"), F.array_join(F.array_sort("paths"), ",").alias("paths"))


@_query(
    """SELECT node_id, 'batch ' || CAST(min(read_id % 2) AS VARCHAR) AS description, count(*) AS n,
      string_agg(CAST(read_id AS VARCHAR), ',' ORDER BY read_id % 2, read_id) AS reads FROM visits GROUP BY node_id"""
)
def merge_batches(g: Graph) -> DataFrame:
    """Two batches grouped by node and merged: even reads first, odd ones behind them; the first description stays."""
    rows = g.plain_visits()
    part = lambda k: visits.group_reads(rows.where(F.col("read_id") % 2 == k), ["node_id"], []).withColumn("description", F.lit(f"batch {k}"))
    merged = visits.merge_groups([part(0), part(1)])
    return merged.select("node_id", "description", F.size("reads").cast("long").alias("n"), F.array_join(F.transform("reads", lambda r: r.read_id.cast("string")), ",").alias("reads"))


@_query(
    """SELECT path, start_offset // 50 AS slot, max(node_id) AS node_id, arg_max(sequence, node_id) AS sequence FROM nodes GROUP BY ALL"""
)
def upsert_by_position(g: Graph) -> DataFrame:
    """The last node of each path position."""
    rows = g.nodes().select("path", F.floor(F.col("start_offset") / 50).cast("long").alias("slot"), F.col("node_id").alias("ordinal"), "node_id", "sequence")
    return visits.upsert(rows, ["path", "slot"], "ordinal").select("path", "slot", "node_id", "sequence")


@_query("SELECT path, arg_max(strand, node_id) AS strand FROM steps GROUP BY path")
def strand_last_wins(g: Graph) -> DataFrame:
    """The last strand of each path."""
    return paths.last_strand(g.steps(), ["path"], "node_id")


@_query(
    """, found AS (SELECT region, string_agg(CAST(read_id AS VARCHAR), ',' ORDER BY read_id) AS new, count(*) AS n
      FROM visits JOIN last_region USING (node_id) WHERE rank = 1 GROUP BY region)
    SELECT r.region, 'held' || coalesce(',' || f.new, '') AS reads, 1 + coalesce(f.n, 0) AS n FROM regions r LEFT JOIN found f USING (region)"""
)
def append_existing_reads(g: Graph) -> DataFrame:
    """Reads whose first visit is in a region, behind the one that the region already holds."""
    hits = g.visits().where("rank = 1").join(visits.last_region(g.region_segments()), "node_id")
    found = hits.groupBy("region").agg(F.transform(F.array_sort(F.collect_list("read_id")), lambda x: x.cast("string")).alias("new_reads"))
    held = g.regions().select("region").withColumn("aligned_reads", F.array(F.lit("held")))
    out = visits.append_reads(held, found)
    return out.select("region", F.array_join("aligned_reads", ",").alias("reads"), F.size("aligned_reads").cast("long").alias("n"))


@_query(
    """, named AS (SELECT node_id, CASE WHEN node_id % 2 = 0 THEN 'chr' ELSE '' END || substr(path, 7) AS label FROM nodes)
    SELECT node_id, CASE WHEN starts_with(label, 'chr') THEN label ELSE 'chr' || label END AS chrom,
      label IN ('3', 'chr3') AS wanted FROM named"""
)
def chromosome_filter_prefix(g: Graph) -> DataFrame:
    """All nodes' chromosome, named with and without its prefix, and whether it is the one asked for as ``3``."""
    label = F.concat(F.when(F.col("node_id") % 2 == 0, F.lit("chr")).otherwise(F.lit("")), F.expr("substr(path, 7)"))
    chrom = scalars.with_chr(label)
    return g.raw_nodes().select("node_id", chrom.alias("chrom"), (chrom == scalars.with_chr(F.lit("3"))).alias("wanted"))


@_query("SELECT ordinal, region, path || ':' || CAST(lo + 100 AS VARCHAR) AS key FROM regions")
def region_label(g: Graph) -> DataFrame:
    """Labels and keys of all regions."""
    return g.regions().select("ordinal", "region", scalars.position_key(F.col("path"), F.col("lo") + 100).alias("key"))


@_query(
    """, walks AS (SELECT l_orderkey AS walk_id, l_linenumber AS part, '>' || CAST(l_partkey AS VARCHAR) || '<' || CAST(l_suppkey AS VARCHAR) || '>' || CAST(l_orderkey AS VARCHAR) AS walk FROM lineitem)
    SELECT walk_id, part, array_to_string(regexp_extract_all(walk, '([><])([^><]+)', 1), '') AS strands,
      array_to_string(regexp_extract_all(walk, '([><])([^><]+)', 2), ',') AS nodes FROM walks"""
)
def walk_tokenise(g: Graph) -> DataFrame:
    """Strands and node ids of walks."""
    line = g.table("lineitem")
    walk = F.concat(F.lit(">"), F.col("l_partkey").cast("string"), F.lit("<"), F.col("l_suppkey").cast("string"), F.lit(">"), F.col("l_orderkey").cast("string"))
    walks = line.select(F.col("l_orderkey").alias("walk_id"), F.col("l_linenumber").alias("part"), walk.alias("walk"))
    return walks.select("walk_id", "part", F.array_join(scalars.walk_strands(F.col("walk")), "").alias("strands"), F.array_join(scalars.walk_nodes(F.col("walk")), ",").alias("nodes"))


@_query(
    """SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE starts_with(line, 'A') GROUP BY doc_id"""
)
def line_prefix_filter(g: Graph) -> DataFrame:
    """Lines that begin with a record letter, by document."""
    hits = F.size(F.filter(F.split("text", "\n"), lambda x: x.startswith("A"))).cast("long")
    return g.table("documents").select("doc_id", hits.alias("n")).where("n > 0")


@_query(
    """SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events"""
)
def json_default(g: Graph) -> DataFrame:
    """A JSON field as a number, 0 where it is missing or none."""
    return g.table("events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0)).alias("k"))


@_query("SELECT source, count(*) AS n FROM documents WHERE len(string_split(text, ' ')) >= 7 GROUP BY source")
def field_guard(g: Graph) -> DataFrame:
    """Rows with at least seven fields, by source."""
    rows = g.table("documents").where(F.size(F.split("text", " ")) >= 7)
    return rows.groupBy("source").agg(F.count("*").alias("n"))


@_query("SELECT path, node_id, start_offset FROM nodes")
def path_cumulative_offset(g: Graph) -> DataFrame:
    """Where each node starts on its path."""
    return g.nodes().select("path", "node_id", "start_offset")


@_query(
    """, near(node_id) AS (SELECT DISTINCT b FROM edges WHERE a = 500 UNION SELECT a FROM edges WHERE b = 500 UNION SELECT CAST(500 AS BIGINT))
    SELECT a, b FROM edges WHERE a IN (SELECT node_id FROM near) AND b IN (SELECT node_id FROM near)"""
)
def subgraph_edges(g: Graph) -> DataFrame:
    """Edges among node 500 and its neighbours."""
    seed = g.spark.range(500, 501).select(F.col("id").alias("node_id"))
    edges = g.edges()
    return paths.subgraph(g.raw_nodes(), edges, paths.neighbourhood(edges, seed, 1))[1].select("a", "b")


@_query(
    """SELECT r.region, string_agg(s.node_id || ':' || p.paths, ' ' ORDER BY s.node_id) AS segments FROM regions r
    JOIN region_segments s USING (region) JOIN (SELECT node_id, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM steps GROUP BY node_id) p USING (node_id) GROUP BY r.region"""
)
def region_document(g: Graph) -> DataFrame:
    """Regions with their segments and these segments' paths."""
    named = paths.node_paths(g.steps()).select("node_id", F.array_join(F.array_sort("paths"), ",").alias("paths"))
    rows = g.region_segments().join(named, "node_id")
    item = F.struct("node_id", F.concat_ws(":", F.col("node_id").cast("string"), "paths").alias("text"))
    return rows.groupBy("region").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.text), " ").alias("segments"))


@_query(
    """, windows AS (SELECT read_id AS variant_id, contig, greatest(0, start - 20000) AS lo, start + 20000 AS hi FROM linear_reads)
    SELECT w.contig || ':' || CAST(w.lo AS VARCHAR) AS key, count(r.read_id) AS n_reads FROM windows w
    LEFT JOIN linear_reads r ON r.contig = w.contig AND r.start < w.hi AND r."end" > w.lo GROUP BY w.variant_id, w.contig, w.lo"""
)
def pileup_counts(g: Graph) -> DataFrame:
    """Reads over each variant, variants without reads included; windows of one variant, contig and start count together."""
    counted = paths.coverage(g.linear_windows(), g.linear_reads().where("read_id IS NOT NULL"))
    found = counted.groupBy("variant_id", "contig", "lo").agg(F.sum("n_reads").alias("n_reads"))
    key = F.when(F.col("contig").isNotNull(), scalars.position_key(F.col("contig"), F.col("lo")))
    return found.select(key.alias("key"), "n_reads")
