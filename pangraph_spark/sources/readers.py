"""Readers of the domain's text and JSON formats.

Text formats are read line by line with a plain text scan, so that splits, pruning and filters are Spark's.
Where order matters an ordinal is taken before any shuffle.  Malformed records do not stop a read: each
reader that can meet them has a quarantine of what it could not use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import node_id, strip, tabs, tag_value, walk_nodes, walk_strands, with_chr
from . import schemas


class InputError(ValueError):
    """An input that cannot be used at all."""


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, file, ordinal`` of text files, compressed or not; the ordinal grows with the place in a file."""
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    return rows.withColumn("ordinal", F.monotonically_increasing_id())


def _records(spark: SparkSession, path: str, least: int, comment: bool = True) -> DataFrame:
    rows = lines(spark, path)
    if comment:
        rows = rows.where(~F.col("line").startswith("#"))
    # tabs at the end separate empty columns, so only line ends go
    return rows.withColumn("c", tabs(F.regexp_replace("line", r"[\r\n]+$", ""))).where(F.size("c") >= least)


def _column(k: int):
    return F.get(F.col("c"), F.lit(k))


def sample_names(spark: SparkSession, path: str) -> list[str]:
    """Sample columns of a VCF header; none if it has no header line.

    Splits are looked at from the first on until a header is found.  Files of one pattern must share it.
    """
    head = lines(spark, path).where(F.col("line").startswith("#CHROM")).take(1)
    return head[0].line.rstrip("\r\n").split("\t")[9:] if head else []


def vcf_text(spark: SparkSession, path: str) -> DataFrame:
    """``ordinal, chrom, pos, ref, alt``; ``alt`` is the raw fifth column."""
    rows = _records(spark, path, 5)
    return rows.select("ordinal", strip(_column(0)).alias("chrom"), _column(1).try_cast("bigint").alias("pos"), _column(3).alias("ref"), _column(4).alias("alt")).where(F.col("pos").isNotNull())


def _variants(spark: SparkSession, path: str) -> DataFrame:
    alt = _column(4)
    missing = lambda c: F.when(c != ".", c)
    return _records(spark, path, 8).select(
        "ordinal", _column(0).alias("chromosome"), _column(1).try_cast("bigint").alias("position"), _column(3).alias("reference"),
        F.when(alt != ".", F.split(alt, ",")).alias("alternative"), missing(_column(2)).alias("id"), missing(_column(5)).try_cast("double").alias("quality"), "c",
    )


def vcf_alleles(spark: SparkSession, path: str, chromosome: str | None = None) -> DataFrame:
    """Variants with each sample's alleles, the bases that its genotype names; ``.`` is null."""
    names = sample_names(spark, path)
    rows = _variants(spark, path)
    if chromosome:
        rows = rows.where(F.col("chromosome") == with_chr(F.lit(chromosome)))
    bases = F.concat(F.array("reference"), F.coalesce("alternative", F.array().cast("array<string>")))
    rows = rows.withColumn("bases", bases).withColumn("gt_at", F.array_position(F.split(_column(8), ":"), "GT").cast("int"))
    called = lambda k: F.transform(F.split(F.get(F.split(_column(9 + k), ":"), F.col("gt_at") - 1), r"[/|]"), lambda g: F.get(F.col("bases"), g.try_cast("int")))
    samples = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[called(k) for k in range(len(names))])) if names else F.create_map().cast("map<string,array<string>>")
    return rows.select("ordinal", "chromosome", "position", "reference", "alternative", "id", "quality", samples.alias("samples"))


def vcf_format(spark: SparkSession, path: str) -> DataFrame:
    """Variants with each sample's FORMAT fields as a map of text."""
    names = sample_names(spark, path)
    keys = F.split(_column(8), ":")

    def fields(k: int):
        values = F.split(_column(9 + k), ":")
        # trailing fields may be left out
        return F.map_from_arrays(F.slice(keys, 1, F.least(F.size(keys), F.size(values))), F.slice(values, 1, F.least(F.size(keys), F.size(values))))

    samples = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[fields(k) for k in range(len(names))])) if names else F.create_map().cast("map<string,map<string,string>>")
    return _variants(spark, path).select("ordinal", "chromosome", "position", "reference", "alternative", samples.alias("samples"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Linear reads of SAM text; starts are 0-based, ends come from the CIGAR."""
    rows = lines(spark, path).where(~F.col("line").startswith("@")).withColumn("c", tabs(F.col("line"))).where(F.size("c") >= 11)
    cigar = _column(5)
    span = F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), 1), F.lit(0), lambda a, x: a + x.cast("int"))
    start = _column(3).cast("bigint") - 1
    return rows.select(
        "ordinal", _column(0).alias("query_name"), _column(2).alias("contig"), start.alias("start"), (start + F.greatest(span, F.lit(1))).alias("end"),
        F.when(cigar != "*", cigar).alias("cigar"), F.when(_column(9) != "*", _column(9)).alias("sequence"), _column(4).cast("int").alias("mapping_quality"), (_column(1).cast("int").bitwiseAND(16) != 0).alias("is_reverse"),
    ).where(F.col("contig") != "*")


def gam_json(spark: SparkSession, path: str) -> DataFrame:
    """Graph reads, one JSON object a line, with ``read_id`` in input order; malformed lines are left out."""
    return _gam(lines(spark, path)).where("ok").drop("ok", "line")


def gam(spark: SparkSession, path: str) -> DataFrame:
    """Graph reads of a ``.gam``: binary groups, or JSON lines under that name; told apart by the first bytes."""
    from . import frames

    return frames.reads_of(frames.gam_groups(spark, path)) if frames.is_compressed(spark, path) else gam_json(spark, path)


def gam_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """The lines that :func:`gam_json` leaves out."""
    return _gam(lines(spark, path)).where(~F.col("ok")).select("read_id", "line")


def _gam(rows: DataFrame) -> DataFrame:
    read = F.from_json("line", schemas.READ_JSON + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = rows.where(strip(F.col("line")) != "").select(F.col("ordinal").alias("read_id"), "line", read.alias("r"))
    return rows.select("read_id", "line", (F.col("r").isNotNull() & F.col("r._bad").isNull()).alias("ok"), "r.name", "r.sequence", "r.mapping_quality", "r.score", "r.quality", "r.path")


def read_details(reads: DataFrame) -> DataFrame:
    """Reads as a full record with defaults 0, null, empty text and no path."""
    return reads.select("read_id", F.col("name").alias("read_name"), "sequence", F.coalesce("mapping_quality", F.lit(0)).alias("mapping_quality"), "score", F.coalesce("quality", F.lit("")).alias("quality"), "path")


def gaf(spark: SparkSession, path: str) -> DataFrame:
    """``ordinal, read_name, path`` of text alignments with more than five columns."""
    return _records(spark, path, 6, comment=False).select("ordinal", _column(0).alias("read_name"), _column(5).alias("path"))


def gfa_walk(spark: SparkSession, path: str, reference: str, chromosome: str, strict: bool = True) -> DataFrame:
    """``ordinal, step, strand, node_id`` of the walks of a reference path.

    By default sample and contig columns must be equal; ``strict=False`` keeps the historic rule that both
    are patterns found anywhere in the line.
    """
    rows = _records(spark, path, 7, comment=False).where(F.col("line").startswith("W"))
    if strict:
        rows = rows.where((_column(1) == reference) & (_column(3) == chromosome))
    else:
        rows = rows.where(F.col("line").rlike(reference) & F.col("line").rlike(chromosome))
    walk = strip(_column(6))
    pairs = F.arrays_zip(walk_strands(walk).alias("strand"), walk_nodes(walk).alias("raw"))
    steps = rows.select("ordinal", F.posexplode(pairs).alias("step", "s"))
    return steps.select("ordinal", "step", "s.strand", node_id(F.col("s.raw")).alias("node_id"))


def gfa_segments(spark: SparkSession, path: str) -> DataFrame:
    """``node_id, sequence, length, start_offset`` of segment lines with six columns or more."""
    rows = _records(spark, path, 6, comment=False).where(F.col("line").startswith("S"))
    return rows.select(node_id(_column(1)).alias("node_id"), _column(2).alias("sequence"), F.length(_column(2)).alias("length"), tag_value(strip(_column(5))).try_cast("bigint").alias("start_offset"))


def gfa_path_nodes(spark: SparkSession, path: str, reference: str, chromosome: str, strict: bool = True) -> DataFrame:
    """Nodes of a walk with the strand of their last visit, and what segment lines say of them."""
    from ..operators.paths import describe_path, last_strand

    steps = gfa_walk(spark, path, reference, chromosome, strict)
    return describe_path(last_strand(steps, ["node_id"], F.struct("ordinal", "step")), gfa_segments(spark, path))


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document of one file as column ``d``; an unreadable one is an error."""
    # read whole: a document is one value, and its size is the producer's
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("d"))
    if rows.where(F.col("d").isNull()).limit(1).count():
        raise InputError(f"{path} holds no valid document")
    return rows


def variants_json(spark: SparkSession, path: str) -> DataFrame:
    """Variants of a JSON array with their ordinal; a truncated array is an error."""
    rows = _document(spark, path, f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in schemas.VARIANT_JSON.split(', ', 6))}>>")
    return rows.select(F.posexplode("d").alias("ordinal", "v")).select("ordinal", "v.*")


def regions_json(spark: SparkSession, path: str) -> DataFrame:
    """``region, ordinal, segments, variants, aligned_reads`` of a region document, in document order."""
    return _document(spark, path, schemas.REGION_JSON).select(F.posexplode("d").alias("ordinal", "region", "v")).select("ordinal", "region", "v.*")


def region_segments(regions: DataFrame) -> DataFrame:
    """``region, ordinal, node_id``; regions without segments have no row."""
    rows = regions.select("region", "ordinal", F.explode("segments").alias("s"))
    return rows.select("region", "ordinal", node_id(F.col("s.segment_id")).alias("node_id")).where(F.col("node_id").isNotNull())


def node_list_json(spark: SparkSession, path: str) -> DataFrame:
    rows = _document(spark, path, schemas.NODE_LIST_JSON).select(F.explode("d.nodes").alias("n"))
    return rows.select(node_id(F.col("n.id")).alias("node_id"), "n.sequence", F.length("n.sequence").alias("length"))


def node_map_json(spark: SparkSession, path: str) -> DataFrame:
    rows = _document(spark, path, schemas.NODE_MAP_JSON).select(F.explode("d.nodes").alias("id", "n"))
    return rows.select(node_id(F.col("id")).alias("node_id"), "n.*")


def file_numbers(rows: DataFrame, name: str) -> DataFrame:
    """Adds the place of each row's ``file`` in the order of names, from 0; only names are ranked, one row a file."""
    from ..operators.visits import small

    order = Window.orderBy("file")
    files = rows.select("file").distinct().withColumn(name, F.row_number().over(order) - 1)
    return rows.join(small(files), "file")


def batch_files(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """JSON lines of all files of a pattern with ``batch``, the place of a file in the order of names."""
    rows = spark.read.schema(schema).json(pattern).withColumn("file", F.col("_metadata.file_path"))
    return file_numbers(rows, "batch").drop("file")


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and path steps of graph JSON, one graph a line."""
    rows = spark.read.schema(schemas.GRAPH_JSON).json(path)
    nodes = rows.select(F.explode("node").alias("n")).select(node_id(F.col("n.id")).alias("node_id"), "n.sequence", F.length("n.sequence").alias("length"))
    edges = rows.select(F.explode("edge").alias("e")).select(node_id(F.col("e.from")).alias("a"), node_id(F.col("e.to")).alias("b"), F.coalesce("e.from_start", F.lit(False)).alias("from_start"), F.coalesce("e.to_end", F.lit(False)).alias("to_end"))
    steps = rows.select(F.posexplode("path").alias("path_no", "p")).select(F.col("p.name").alias("path"), "path_no", F.posexplode("p.mapping").alias("step", "m"))
    steps = steps.select("path", "path_no", "step", node_id(F.col("m.position.node_id")).alias("node_id"), F.struct("path_no", "step").alias("ordinal")).where(F.col("node_id").isNotNull())
    return nodes, edges, steps


def id_list(spark: SparkSession, ids: list) -> DataFrame:
    """Literal ids as a relation."""
    return spark.createDataFrame([(int(i),) for i in ids], "node_id long")


def valid_variants(variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Variants with a chromosome and a position, and the others with a message."""
    from ..functions.scalars import is_truthy

    good = is_truthy(F.col("chromosome"), F.col("position"))
    bad = variants.where(~good).withColumn("message", F.concat(F.lit("skipped record "), F.col("ordinal").cast("string"), F.lit(": chromosome or position is missing")))
    return variants.where(good), bad


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """``read_id, read_name, path`` text or graph reads by file name; other names are an error."""
    name = path.lower()
    if name.endswith(".gaf"):
        return gaf(spark, path)
    if name.endswith(".gam"):
        return gam(spark, path)
    if name.endswith((".json", ".jsonl")):
        return gam_json(spark, path)
    raise InputError(f"{path} is neither .gam nor .gaf")
