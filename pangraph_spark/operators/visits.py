"""Operators over ``visits(read_id, rank, node_id, offset)``: which reads touch which nodes.

``rank`` is the place of a visit in its read's path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lookup sides up to this many rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a lookup side for broadcast only if it is known to have few rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def visits_of(reads: DataFrame, carry: list[str] = ()) -> DataFrame:
    """Explodes ``reads(read_id, path.mapping[])``; mappings without a node are left out, offset defaults to 0.

    ``carry`` names further columns of the reads to keep.
    """
    m = reads.select("read_id", *carry, F.posexplode("path.mapping").alias("rank", "m"))
    node = F.col("m.position.node_id").cast("string").try_cast("bigint")
    offset = F.coalesce(F.col("m.position.offset").cast("string").try_cast("bigint"), F.lit(0))
    return m.select("read_id", *carry, "rank", node.alias("node_id"), offset.alias("offset")).where(F.col("node_id").isNotNull())


def hitting_ids(reads: DataFrame, ids: list) -> DataFrame:
    """Reads of which any mapping has one of a literal list of nodes; each read once, without an explode."""
    wanted = [str(i) for i in ids]
    hit = F.exists("path.mapping", lambda m: F.coalesce(m.position.node_id.cast("string").isin(wanted), F.lit(False)))
    return reads.where(F.coalesce(hit, F.lit(False)))


def reads_with_nodes(visits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct reads that visit any of ``nodes(node_id)``."""
    return visits.join(nodes.select("node_id").distinct(), "node_id", "left_semi").select("read_id").distinct()


def last_region(segments: DataFrame) -> DataFrame:
    """``node_id, region``: of the regions that list a node, the last in document order."""
    return segments.groupBy("node_id").agg(F.max_by("region", "ordinal").alias("region"))


def first_hits(visits: DataFrame, regions: DataFrame, carry: list[str] = ()) -> DataFrame:
    """``read_id, region, node_id, offset`` and ``carry``: each read at most once, by its first visit to a known node.

    ``regions(node_id, region)`` has one row a node.  The earliest visit is a partial aggregate, so a read
    with many visits is reduced before the shuffle.
    """
    found = visits.join(regions, "node_id")
    first = found.groupBy("read_id").agg(F.min_by(F.struct("region", "node_id", "offset", *carry), "rank").alias("hit"))
    return first.select("read_id", "hit.region", "hit.node_id", "hit.offset", *[f"hit.{c}" for c in carry])


def reads_per_region(visits: DataFrame, segments: DataFrame) -> DataFrame:
    """``region, read_id``: distinct reads of every region; a read may be in many."""
    return visits.join(segments.select("region", "node_id").distinct(), "node_id").select("region", "read_id").distinct()


def keep_empty(regions: DataFrame, counted: DataFrame, count: str) -> DataFrame:
    """All regions with ``count``, 0 where none was counted."""
    return regions.join(counted, "region", "left").withColumn(count, F.coalesce(count, F.lit(0).cast("long")))


def by_node(visits: DataFrame, nodes: DataFrame, multiset: bool) -> DataFrame:
    """Visits joined to ``nodes(node_id, ...)``: one row a visit, or one a read and node."""
    if not multiset:
        visits = visits.groupBy("read_id", "node_id").agg(F.min("rank").alias("rank"), F.min_by("offset", "rank").alias("offset"))
    return visits.join(nodes, "node_id")


def group_reads(rows: DataFrame, keys: list[str], read: list[str], span: int | None = None) -> DataFrame:
    """One row a key with ``reads``, in the order of read id and rank.

    With ``span`` a key has one row for each range of so many read ids, numbered by ``part``: a hot node's
    reads are then spread over many rows, each of bounded size, which in the order of parts are its list.
    """
    keys = [*keys, "part"] if span else keys
    rows = rows.withColumn("part", F.floor(F.col("read_id") / F.lit(span))) if span else rows
    item = F.struct(*[F.col(c) for c in ("read_id", "rank", *[c for c in read if c not in ("read_id", "rank")])])
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("reads"))


def merge_groups(parts: list[DataFrame], key: str = "node_id") -> DataFrame:
    """Merges grouped batches: the first description of a key stays, reads are appended in batch order."""
    every = None
    for k, part in enumerate(parts):
        part = part.withColumn("batch", F.lit(k))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in (key, "reads", "batch")]
    merged = every.groupBy(key).agg(F.min_by(F.struct("batch", *rest), "batch").alias("first"), F.array_sort(F.collect_list(F.struct("batch", "reads"))).alias("parts"))
    return merged.select(key, *[f"first.{c}" for c in rest], F.flatten(F.col("parts.reads")).alias("reads"))


def append_reads(regions: DataFrame, found: DataFrame) -> DataFrame:
    """``regions(region, aligned_reads, ...)`` with ``found(region, new_reads)`` behind what they hold."""
    empty = F.array()
    new = F.coalesce(F.col("new_reads"), empty.cast(found.schema["new_reads"].dataType))
    old = F.coalesce(F.col("aligned_reads"), empty.cast(regions.schema["aligned_reads"].dataType))
    return regions.join(found, "region", "left").withColumn("aligned_reads", F.concat(old, new)).drop("new_reads")


def containing(rows: DataFrame, text: str, ids: DataFrame) -> DataFrame:
    """Pairs of ``rows`` and ``ids(id)`` where the text contains the id, each pair once; empty ids are in none.

    Every substring that is as long as some id is looked up by equality, so no row meets every id.  The
    lengths, at most as many as the longest id has characters, are literals of the plan.
    """
    lengths = sorted(r.n for r in ids.select(F.length("id").alias("n")).where("n > 0").distinct().collect())
    if not lengths:
        return rows.limit(0).withColumn("id", F.lit(None).cast("string"))
    cut_at = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(F.col(text), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    parts = F.array_distinct(F.flatten(F.array(*[cut_at(n) for n in lengths])))
    return rows.where(F.col(text).isNotNull()).withColumn("id", F.explode(parts)).join(ids.select("id").distinct(), "id")


def text_hits(gaf: DataFrame, segments: DataFrame, exact: bool = True) -> DataFrame:
    """``region, read_name`` of text alignments: whole node ids by default.

    ``exact=False`` keeps the historic rule that an id found anywhere in the path text counts, so 12 also
    matches 123.
    """
    if exact:
        from ..functions.scalars import node_id, walk_nodes

        steps = gaf.select("read_name", F.explode(F.array_distinct(walk_nodes(F.col("path")))).alias("raw"))
        hits = steps.select("read_name", node_id(F.col("raw")).alias("node_id")).join(segments, "node_id")
    else:
        listed = segments.select("region", F.col("node_id").cast("string").alias("id"))
        hits = containing(gaf.select("read_name", "path"), "path", listed).join(listed, "id")
    return hits.select("region", "read_name").distinct()


def upsert(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The last row of each key; as a partial aggregate, not a window."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordinal).alias("last")).select(*keys, *[f"last.{c}" for c in rest])
