"""Path geometry: coordinates, lookups by position, windows, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch

BLOCK = 4096
TILE, CHUNK = 168, 64  # windows and reads that meet at once; 168 a third of the 504 values after which Parquet begins a run of bits


def with_offsets(steps: DataFrame, path: str = "path", order: str = "node_id", length: str = "length") -> DataFrame:
    """Adds ``start_offset``: the summed length of what precedes on the path.

    Two levels, so that a long path is not one task: sums inside blocks of the order column, and the
    running total of the blocks before.
    """
    block = F.floor(F.col(order) / BLOCK).alias("block_no")
    rows = steps.withColumn("block_no", block)
    totals = rows.groupBy(path, "block_no").agg(F.sum(length).alias("block_sum"))
    before = Window.partitionBy(path).orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(path, "block_no", F.coalesce(F.sum("block_sum").over(before), F.lit(0)).alias("block_start"))
    inside = Window.partitionBy(path, "block_no").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start_offset", F.coalesce(F.sum(length).over(inside), F.lit(0)))
    rows = rows.join(totals, [path, "block_no"])
    return rows.withColumn("start_offset", (F.col("start_offset") + F.col("block_start")).cast("long")).select(*steps.columns, "start_offset")


def locate(nodes: DataFrame, points: DataFrame, width: int = 4096) -> DataFrame:
    """The node of each path position: ``points`` columns and ``node_id`` (null if none lies there).

    The first node in path order that covers the position; an interval join by bins of ``width``.
    """
    spans = nodes.select("path", "node_id", "start_offset", (F.col("start_offset") + F.col("length")).alias("end_offset"))
    spans = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start_offset") / width), F.floor((F.greatest(F.col("end_offset"), F.col("start_offset") + 1) - 1) / width))))
    asked = points.withColumn("bin", F.floor(F.col("pos") / width))
    hits = asked.join(spans, ["path", "bin"]).where((F.col("start_offset") <= F.col("pos")) & (F.col("pos") < F.col("end_offset")))
    found = hits.groupBy(*points.columns).agg(F.min_by("node_id", "start_offset").alias("node_id"))
    return points.join(found, points.columns, "left")


def window_segments(nodes: DataFrame, regions: DataFrame, width: int = 4096) -> DataFrame:
    """``region, ordinal, node_id``: nodes on a region's path with start <= hi and end > lo."""
    spans = nodes.select("path", "node_id", "start_offset", (F.col("start_offset") + F.col("length")).alias("end_offset"))
    first, last = F.floor(F.col("start_offset") / width), F.floor(F.col("end_offset") / width)
    spans = spans.withColumn("bin", F.explode(F.sequence(first, last)))
    lo, hi = F.floor(F.greatest(F.col("lo"), F.lit(0)) / width), F.floor(F.col("hi") / width)
    asked = regions.where("hi >= 0").withColumn("bin", F.explode(F.sequence(lo, hi)))
    hits = asked.join(spans, ["path", "bin"]).where((F.col("start_offset") <= F.col("hi")) & (F.col("end_offset") > F.col("lo")))
    # a pair meets in several bins; it counts in the first that both touch
    own = F.floor(F.greatest(F.col("start_offset"), F.col("lo"), F.lit(0)) / width)
    return hits.where(F.col("bin") == own).select("region", "ordinal", "node_id")


def overlaps(windows: DataFrame, reads: DataFrame, width: int = 4096) -> DataFrame:
    """Pairs of ``windows(contig, lo, hi)`` and ``reads(contig, start, end)`` with start < hi and end > lo.

    A bin's windows meet its reads in tiles: each read of a chunk with all windows of a tile.  Pairs come in that
    order, so a column-wise file repeats one side in runs and the other in short cycles, and stays small.
    """
    # an empty window or read still pairs with what reaches over it, which holds the greater of both lower ends
    bins = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.greatest(F.col(low), F.col(high) - 1) / width)))
    asked = windows.where("contig IS NOT NULL AND lo IS NOT NULL AND hi IS NOT NULL").withColumn("bin", bins("lo", "hi"))
    spans = reads.where("contig IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL").withColumn("bin", bins("start", "end"))
    met = _runs(asked, "lo", "hi", TILE, "window").join(_runs(spans, "start", "end", CHUNK, "read"), ["contig", "bin"])
    # only what can meet: this also ends the join's generated code, which else would hold all pairs of a tile at once
    near = F.filter("windows", lambda w: (w.lo < F.col("read_to")) & (w.hi > F.col("read_from")))
    met = met.where("read_from < window_to AND read_to > window_from").select("contig", (F.col("bin") * width).alias("base"), "reads", near.alias("windows"))
    each = met.select("contig", "base", "windows", F.explode("reads").alias("read"))
    each = each.select("contig", "base", "read", F.explode("windows").alias("window"))
    # a pair meets in several bins; it counts in the first that both touch, where one of them begins
    hits = each.where("read.start < window.hi AND read.end > window.lo AND (read.start >= base OR window.lo >= base)")
    return hits.select("contig", *(f"{side}.{c}" for side, df in (("window", windows), ("read", reads)) for c in df.columns if c != "contig"))


def _runs(spans: DataFrame, low: str, high: str, size: int, name: str) -> DataFrame:
    """A bin's rows in order of ``low``, ``size`` to a row: ``contig, bin, <name>s, <name>_from, <name>_to``."""
    place = F.row_number().over(Window.partitionBy("contig", "bin").orderBy(low, high))
    item = F.struct(*(c for c in spans.columns if c not in ("contig", "bin")))
    rows = spans.withColumn("run", F.floor((place - 1) / size))
    return rows.groupBy("contig", "bin", "run").agg(F.collect_list(item).alias(f"{name}s"), F.min(low).alias(f"{name}_from"), F.max(high).alias(f"{name}_to")).drop("run")


def coverage(windows: DataFrame, reads: DataFrame, width: int = 4096) -> DataFrame:
    """``windows`` with ``n_reads``: how many ``reads(contig, start, end)`` have start < hi and end > lo.

    Counted without pairs: the reads that start before ``hi`` less those that end by ``lo``, both from running
    sums over places, inside blocks of ``width`` and over the blocks before.  So work is that of sorting the
    places, however many reads a window holds.  Windows must not be empty, or reads be all of one length.
    """
    place = lambda pos, starts, ends: F.struct(F.col(pos).cast("long").alias("pos"), F.lit(starts).alias("starts"), F.lit(ends).alias("ends"))
    of = lambda df, *places: df.select("contig", F.inline(F.array(*places)))
    known = reads.where(F.col("start").isNotNull() & F.col("end").isNotNull())
    rows = of(known, place("start", 1, 0), place("end", 0, 1)).unionByName(of(windows, place("lo", 0, 0), place("hi", 0, 0)))
    rows = rows.where(F.col("contig").isNotNull() & F.col("pos").isNotNull())
    places = rows.groupBy("contig", "pos").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"))
    places = places.withColumn("block_no", F.floor(F.col("pos") / width))
    blocks = places.groupBy("contig", "block_no").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"))
    earlier = Window.partitionBy("contig").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda name, over: F.coalesce(F.sum(name).over(over), F.lit(0))
    blocks = blocks.select("contig", "block_no", total("starts", earlier).alias("starts_before"), total("ends", earlier).alias("ends_before"))
    inside = Window.partitionBy("contig", "block_no").orderBy("pos")
    before, upto = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    sums = places.select("contig", "block_no", "pos", total("starts", before).alias("begun"), total("ends", upto).alias("ended")).join(blocks, ["contig", "block_no"])
    begun = sums.select("contig", F.col("pos").alias("hi"), (F.col("begun") + F.col("starts_before")).alias("begun"))
    ended = sums.select("contig", F.col("pos").alias("lo"), (F.col("ended") + F.col("ends_before")).alias("ended"))
    found = windows.join(begun, ["contig", "hi"], "left").join(ended, ["contig", "lo"], "left")
    return found.select(*windows.columns, F.greatest(F.lit(0), F.coalesce(F.col("begun") - F.col("ended"), F.lit(0))).cast("long").alias("n_reads"))


def consecutive_edges(steps: DataFrame, path: str = "path", order: str = "node_id") -> DataFrame:
    """``a, b``: neighbours on a path, by blocks so that a long path is not one task."""
    rows = steps.select(path, order).distinct().withColumn("block_no", F.floor(F.col(order) / BLOCK))
    inside = Window.partitionBy(path, "block_no").orderBy(order)
    pairs = rows.select(path, F.col(order).alias("a"), F.lead(order).over(inside).alias("b")).where(F.col("b").isNotNull())
    ends = rows.groupBy(path, "block_no").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    across = Window.partitionBy(path).orderBy("block_no")
    bridges = ends.select(path, F.col("last").alias("a"), F.lead("first").over(across).alias("b")).where(F.col("b").isNotNull())
    return pairs.unionByName(bridges).select("a", "b").distinct()


def neighbourhood(edges: DataFrame, seeds: DataFrame, steps: int = 5) -> DataFrame:
    """``node_id, hops`` within ``steps`` undirected edges of ``seeds(node_id)``.

    One frontier a hop, each written once, until one is empty.  As edges go both ways, what lies behind a
    frontier is in it or in the one before, so a hop reads the edges and two frontiers and no more.
    """
    both = scratch.cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    levels = [scratch.cut(seeds.select("node_id").distinct())]
    while len(levels) <= steps:
        reached = both.join(levels[-1], both.a == levels[-1].node_id, "left_semi").select(F.col("b").alias("node_id")).distinct()
        for known in levels[-2:]:
            reached = reached.join(known, "node_id", "left_anti")
        front = scratch.cut(reached)
        if front.isEmpty():
            break
        levels.append(front)
    out = levels[0].withColumn("hops", F.lit(0))
    for k, front in enumerate(levels[1:], 1):
        out = out.unionByName(front.withColumn("hops", F.lit(k)))
    return out


def subgraph(nodes: DataFrame, edges: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges inside a neighbourhood."""
    inside = near.select("node_id")
    kept = edges.join(inside, edges.a == inside.node_id, "left_semi").join(inside, edges.b == inside.node_id, "left_semi")
    return nodes.join(inside, "node_id", "left_semi"), kept


def node_paths(steps: DataFrame) -> DataFrame:
    """``node_id, paths``: distinct path names in first-seen order; nodes on no path do not appear."""
    first = steps.groupBy("node_id", "path").agg(F.min("ordinal").alias("ordinal"))
    return first.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "path"))), lambda x: x.path).alias("paths"))


def last_strand(steps: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The strand of the last visit of a key."""
    return steps.groupBy(*keys).agg(F.max_by("strand", ordinal).alias("strand"))


def describe_path(steps: DataFrame, segments: DataFrame) -> DataFrame:
    """Path nodes with what segment lines say; nodes without a line keep their strand only."""
    on_path = segments.join(steps.select("node_id").distinct(), "node_id", "left_semi")
    return steps.join(on_path, "node_id", "left")
