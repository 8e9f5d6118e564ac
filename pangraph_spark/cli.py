"""Command line: ``python -m pangraph_spark.cli COMMAND ...``; one command for each plan."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.scalars import joined
from .operators import paths, visits
from .plans import pipelines
from .sinks import documents
from .sources import bam, frames, readers


def session(threads: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("graph-genome").config("spark.sql.session.timeZone", "UTC")
    return (builder.master(f"local[{threads}]") if threads else builder).getOrCreate()


def _reads(spark, path):
    return frames.reads_of(frames.gam_frames(spark, path)) if path.endswith((".frames", ".pb")) else readers.gam(spark, path)


def _placed(spark, graph, reference, chromosome):
    """Nodes on a reference path with offsets, edges and steps of graph JSON."""
    nodes, edges, steps = readers.graph_json(spark, graph)
    placed = steps.select("path", "node_id", (F.col("path_no") * (1 << 32) + F.col("step")).alias("step_order")).join(nodes, "node_id")
    return paths.with_offsets(placed.withColumn("length", F.col("length").cast("long")), order="step_order"), edges, steps


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pangraph_spark")
    p.add_argument("-t", "--threads", type=int, default=4)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, *args):
        c = sub.add_parser(name)
        for flags, options in args:
            c.add_argument(*flags, **options)

    req = {"required": True}
    command("variants", (["vcf_path"], {}), (["--chromosome"], {}), (["-o"], {"default": "."}))
    command("variants-format", (["vcf_path"], {}), (["-o"], {"default": "variants.json"}))
    command("regions", (["-j"], req), (["-x"], req), (["-o"], {"default": "output_seg.json"}), (["--reference"], {"default": "GRCh38#0"}), (["--window"], {"type": int, "default": 100}))
    command("hits", (["gam_file"], {}), (["segment_ids"], {"nargs": "+"}))
    command("region-names", (["json_file"], {}), (["alignment_file"], {}), (["--substring"], {"action": "store_true"}))
    command("region-reads", (["json_file"], {}), (["gam_file"], {}), (["output_json"], {}))
    command("node-reads", (["-g", "--gam"], req), (["-n"], req), (["-j"], req), (["--set"], {"action": "store_true"}), (["--span"], {"type": int, "default": 1 << 16}))
    command("path-nodes", (["--gfa"], req), (["-r"], req), (["-c"], req), (["-n"], req), (["--substring"], {"action": "store_true"}))
    command("path-node-list", (["-x"], req), (["-p"], req), (["-n"], req))
    command("pileup", (["-b"], req), (["-v"], req), (["-o"], req), (["--flank"], {"type": int, "default": 200}))
    command("neighbourhood", (["path"], {}), (["position"], {"type": int}), (["graph"], {}), (["--context"], {"type": int, "default": 5}))
    a = p.parse_args(argv)
    spark = session(a.threads)
    began = time.time()
    try:
        if a.command == "variants":
            print(pipelines.extract_variants(spark, a.vcf_path, a.o, a.chromosome))
        elif a.command == "variants-format":
            print("\n".join(pipelines.extract_variants_format(spark, a.vcf_path, a.o)))
        elif a.command == "regions":
            nodes, _, steps = _placed(spark, a.x, a.reference, None)
            found, skipped = pipelines.variant_regions(readers.variants_json(spark, a.j), nodes, steps, a.reference, a.window)
            documents.write_object(found, a.o, "region", order="ordinal")
            for r in skipped.orderBy("ordinal").toLocalIterator():
                print(r.message)
        elif a.command == "hits":
            rows = visits.hitting_ids(readers.gam(spark, a.gam_file), a.segment_ids).orderBy("read_id")
            print(", ".join(r.name for r in rows.select("name").toLocalIterator()))
        elif a.command == "region-names":
            found = pipelines.region_read_names(readers.regions_json(spark, a.json_file), readers.alignments(spark, a.alignment_file), not a.substring)
            for r in found.orderBy("region").select("region", "n", joined(F.col("read_names")).alias("names")).toLocalIterator():
                print(f"{r.region}: {r.n} reads: {r.names}")
        elif a.command == "region-reads":
            regions = readers.regions_json(spark, a.json_file)
            documents.write_object(pipelines.region_reads(regions, _reads(spark, a.gam_file)), a.output_json, "region", order="ordinal")
        elif a.command == "node-reads":
            nodes = readers.node_list_json(spark, a.n) if a.set else readers.node_map_json(spark, a.n)
            documents.write_parts(pipelines.node_reads(_reads(spark, a.gam), nodes, not a.set, span=a.span), a.j, "node_id", "reads")
        elif a.command == "path-nodes":
            documents.write_node_map(readers.gfa_path_nodes(spark, a.gfa, a.r, a.c, not a.substring), a.n)
        elif a.command == "path-node-list":
            nodes, _, steps = readers.graph_json(spark, a.x)
            documents.write_node_list(pipelines.path_node_list(nodes, steps, a.p), a.n)
        elif a.command == "pileup":
            reads = bam.bam(spark, a.b) if a.b.endswith(".bam") else readers.sam(spark, a.b).withColumnRenamed("ordinal", "read_no")
            documents.write_object(pipelines.pileup(readers.vcf_text(spark, a.v), reads, a.flank), a.o, "key")
        elif a.command == "neighbourhood":
            nodes, edges, _ = _placed(spark, a.graph, None, None)
            near, links = pipelines.position_neighbourhood(nodes, edges, a.path, a.position, a.context)
            documents.write_graph(near, links, sys.stdout.write)
    except (readers.InputError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(f"{time.time() - began:.2f} seconds", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
