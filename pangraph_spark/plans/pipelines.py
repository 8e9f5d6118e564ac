"""End-to-end plans: from files to the documents that users read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import position_key, region_label, window_start
from ..operators import paths, visits
from ..sinks import documents
from ..sources import readers


def extract_variants(spark: SparkSession, vcf: str, folder: str, chromosome: str | None = None) -> str:
    """A VCF's variants as a JSON array; returns the file's name."""
    from ..functions.scalars import with_chr

    name = chromosome
    if chromosome:
        name = spark.range(1).select(with_chr(F.lit(chromosome))).first()[0]
    target = f"{folder}/{documents.variants_name(vcf, name)}"
    documents.write_array(readers.vcf_alleles(spark, vcf, chromosome), target, order="ordinal")
    return target


def extract_variants_format(spark: SparkSession, vcf: str, target: str) -> list[str]:
    """A VCF's variants with FORMAT fields as a JSON array, and a preview of five."""
    found = readers.vcf_format(spark, vcf)
    documents.write_array(found, target, order="ordinal")
    return documents.report(found, "ordinal", 5)


def variant_regions(variants: DataFrame, nodes: DataFrame, steps: DataFrame, reference: str = "GRCh38#0", flank: int = 100) -> tuple[DataFrame, DataFrame]:
    """Regions with segments around each variant, and the variants that were skipped.

    ``nodes(path, node_id, start_offset, length)`` places nodes on reference paths named ``reference#chrom``.
    Of variants with one region, the last counts.
    """
    good, bad = readers.valid_variants(variants)
    lo, hi = F.col("position") - flank, F.col("position") + flank
    asked = good.select("ordinal", F.concat(F.lit(f"{reference}#"), "chromosome").alias("path"), lo.alias("lo"), hi.alias("hi"), region_label(F.col("chromosome"), lo, hi, reference).alias("region"), F.struct(*variants.columns).alias("variants"))
    asked = visits.upsert(asked, ["region"], "ordinal").select("ordinal", "path", "lo", "hi", "region", "variants")
    named = paths.node_paths(steps)
    inside = paths.window_segments(nodes, asked.select("ordinal", "path", "lo", "hi", "region")).join(named, "node_id")
    item = F.struct(F.col("node_id").alias("order_by"), F.struct(F.col("node_id").cast("string").alias("segment_id"), "paths").alias("s"))
    segments = inside.groupBy("region").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.s).alias("segments"))
    empty = F.array().cast(segments.schema["segments"].dataType)
    out = asked.join(segments, "region", "left").select("ordinal", "region", F.coalesce("segments", empty).alias("segments"), "variants")
    return out, bad


def region_reads(regions: DataFrame, reads: DataFrame) -> DataFrame:
    """Region documents with the reads whose first known node is theirs behind those that they hold."""
    segments = readers.region_segments(regions)
    carry = ["name", "sequence_length"]
    sized = reads.withColumn("sequence_length", F.coalesce(F.length("sequence"), F.lit(0)))
    hits = visits.first_hits(visits.visits_of(sized, carry), visits.last_region(segments), carry)
    item = F.struct("read_id", F.struct(F.col("name").alias("read_name"), "sequence_length", F.col("offset").alias("mapping_position")).alias("r"))
    found = hits.groupBy("region").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.r).alias("new_reads"))
    return visits.append_reads(regions, found)


def region_read_names(regions: DataFrame, alignments: DataFrame, exact: bool = True) -> DataFrame:
    """``region, read_names, n``: distinct read names of each region that lists segments, also when empty."""
    segments = readers.region_segments(regions)
    if "path" in alignments.columns and dict(alignments.dtypes)["path"] == "string":
        pairs = visits.text_hits(alignments, segments.select("region", "node_id"), exact)
    else:
        ids = visits.reads_per_region(visits.visits_of(alignments), segments)
        pairs = ids.join(alignments.select("read_id", F.col("name").alias("read_name")), "read_id").select("region", "read_name").distinct()
    grouped = pairs.groupBy("region").agg(F.array_sort(F.collect_set("read_name")).alias("read_names"))
    listed = regions.where(F.col("segments").isNotNull()).select("region")
    out = listed.join(grouped, "region", "left")
    return out.select("region", F.coalesce("read_names", F.array().cast("array<string>")).alias("read_names"), F.coalesce(F.size("read_names"), F.lit(0)).alias("n"))


def node_reads(reads: DataFrame, nodes: DataFrame, multiset: bool = True, span: int | None = None) -> DataFrame:
    """Reads grouped by the path nodes that they visit: once a visit, or once a node.

    A read has ``read_name, sequence, mapping_quality, score, quality, path``.  ``span`` spreads a node's
    reads over rows of bounded size, see :func:`visits.group_reads`.
    """
    detail = F.struct("read_name", "sequence", "mapping_quality", "score", "quality", "path")
    details = readers.read_details(reads).select("read_id", detail.alias("detail"))
    rows = visits.by_node(visits.visits_of(reads), nodes, multiset).join(details, "read_id")
    grouped = visits.group_reads(rows, ["node_id", *[c for c in nodes.columns if c != "node_id"]], ["detail"], span)
    return grouped.withColumn("reads", F.transform("reads", lambda x: x.detail))


def path_node_list(nodes: DataFrame, steps: DataFrame, path: str) -> DataFrame:
    """``node_id, sequence`` of the nodes on a named path; no such path is an error."""
    on_path = steps.where(F.col("path") == path).select("node_id").distinct()
    found = nodes.join(on_path, "node_id", "left_semi").select("node_id", "sequence")
    if found.isEmpty():
        raise readers.InputError(f"no path {path}")
    return found


def pileup(variants: DataFrame, reads: DataFrame, flank: int = 200) -> DataFrame:
    """``key, variant, pileup_reads``: reads over the window of each variant; of one position the last variant.

    The window uses the position as it stands, clamped at 0, half open.
    """
    rows = variants.where(F.col("pos").isNotNull()).withColumn("key", position_key(F.col("chrom"), F.col("pos")))
    last = visits.upsert(rows, ["key"], "ordinal")
    asked = last.select("key", F.col("chrom").alias("contig"), window_start(F.col("pos"), flank).alias("lo"), (F.col("pos") + flank).alias("hi"))
    hits = paths.overlaps(asked.where("hi > lo"), reads.where("end > start"))
    item = F.struct(F.col("start").alias("reference_start"), "query_name", "cigar", "sequence", "mapping_quality", "is_reverse")
    found = hits.groupBy("key").agg(F.array_sort(F.collect_list(item)).alias("pileup_reads"))
    variant = F.struct(F.col("chrom").alias("chromosome"), F.col("pos").alias("position"), F.col("ref").alias("reference"), F.col("alt").alias("alternate"))
    out = last.join(found, "key", "left")
    return out.select("key", variant.alias("variant"), F.coalesce("pileup_reads", F.array().cast(found.schema["pileup_reads"].dataType)).alias("pileup_reads"))


def position_neighbourhood(nodes: DataFrame, edges: DataFrame, path: str, position: int, context: int = 5) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges within ``context`` steps of the node at a path position; no node there, or none around it, is an error."""
    spark = nodes.sparkSession
    point = spark.createDataFrame([(path, position)], "path string, pos long")
    seed = paths.locate(nodes, point).where(F.col("node_id").isNotNull()).select("node_id")
    if seed.isEmpty():
        raise readers.InputError(f"no node at {path}:{position}")
    near, links = paths.subgraph(nodes, edges, paths.neighbourhood(edges, seed, context))
    if near.isEmpty():
        raise readers.InputError(f"no nodes around {path}:{position}")
    return near, links
