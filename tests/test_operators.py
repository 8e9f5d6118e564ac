"""Semantics of operators, one rule a test."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pangraph_spark.functions import scalars
from pangraph_spark.operators import paths, visits
from pangraph_spark.plans import pipelines
from pangraph_spark.sinks import documents
from pangraph_spark.sources import readers


@pytest.fixture
def walks(spark):
    rows = [(1, 0, 10, 5), (1, 1, 20, 0), (2, 0, 99, 0), (2, 1, 20, 1), (3, 0, 99, 0), (4, 0, 10, 0), (4, 1, 10, 9)]
    return spark.createDataFrame(rows, "read_id long, rank int, node_id long, offset long")


@pytest.fixture
def segments(spark):
    return spark.createDataFrame([("a", 0, 10), ("a", 0, 20), ("b", 1, 20), ("c", 2, 77)], "region string, ordinal int, node_id long")


def test_first_hit_and_last_wins(walks, segments):
    last = visits.last_region(segments)
    assert {(r.node_id, r.region) for r in last.collect()} == {(10, "a"), (20, "b"), (77, "c")}
    hits = {r.read_id: (r.region, r.node_id, r.offset) for r in visits.first_hits(walks, last).collect()}
    assert hits == {1: ("a", 10, 5), 2: ("b", 20, 1), 4: ("a", 10, 0)}


def test_read_may_be_in_many_regions(walks, segments):
    found = {(r.region, r.read_id) for r in visits.reads_per_region(walks, segments).collect()}
    assert found == {("a", 1), ("b", 1), ("a", 2), ("b", 2), ("a", 4)}


def test_set_and_multiset(spark, walks):
    nodes = spark.createDataFrame([(10, "AC")], "node_id long, sequence string")
    assert visits.by_node(walks, nodes, multiset=False).count() == 2
    assert visits.by_node(walks, nodes, multiset=True).count() == 3


def test_merge_appends_in_batch_order(spark):
    part = lambda reads: spark.createDataFrame([(1, "AC", reads)], "node_id long, sequence string, reads array<string>")
    assert visits.merge_groups([part(["x"]), part(["a"])]).first().reads == ["x", "a"]


def test_substring_rule_is_only_on_request(spark):
    gaf = spark.createDataFrame([("r", ">123")], "read_name string, path string")
    segments = spark.createDataFrame([("a", 12)], "region string, node_id long")
    assert visits.text_hits(gaf, segments).count() == 0
    assert visits.text_hits(gaf, segments, exact=False).count() == 1


def test_upsert_keeps_last(spark):
    rows = spark.createDataFrame([("k", 0, "x"), ("k", 1, "y")], "key string, ordinal int, v string")
    assert visits.upsert(rows, ["key"], "ordinal").first().v == "y"


def test_broadcast_only_below_a_size(spark):
    plan = lambda n: spark.range(9).join(visits.small(spark.range(100).withColumn("x", F.rand()), n), "id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(1000).lower() and "broadcast" not in plan(10).lower()


def test_interval_edges_are_half_open(spark):
    w = spark.createDataFrame([(1, "c", 100, 200)], "id int, contig string, lo long, hi long")
    r = spark.createDataFrame([(1, "c", 50, 100), (2, "c", 50, 101), (3, "c", 200, 300), (4, "c", 199, 300), (5, "d", 100, 200)], "rid int, contig string, start long, end long")
    assert {x.rid for x in paths.overlaps(w, r, 10).collect()} == {2, 4}


def test_binned_join_equals_plain_join(spark):
    rng = random.Random(3)
    w = [(k, rng.choice("ab"), (s := rng.randrange(5000)), s + rng.randrange(1, 900)) for k in range(60)]
    r = [(k, rng.choice("ab"), (s := rng.randrange(5000)), s + rng.randrange(1, 900)) for k in range(80)]
    wd = spark.createDataFrame(w, "id int, contig string, lo long, hi long")
    rd = spark.createDataFrame(r, "rid int, contig string, start long, end long")
    found = sorted((x.id, x.rid) for x in paths.overlaps(wd, rd, 128).collect())
    assert found == sorted((a[0], b[0]) for a in w for b in r if a[1] == b[1] and b[2] < a[3] and b[3] > a[2])


def test_coverage_counts_without_pairs(spark):
    rng = random.Random(5)
    w = [(k, rng.choice(["a", "b", None]), (s := rng.randrange(-300, 900)), s + rng.randrange(1, 300)) for k in range(80)]
    w += [(80, "a", None, 40), (81, "a", 40, None), (82, "c", 0, 9)]
    r = [(rng.choice(["a", "b", None]), (s := rng.randrange(-300, 900)), s + rng.randrange(200)) for _ in range(120)] + [("a", None, None)]
    wd = spark.createDataFrame(w, "id int, contig string, lo long, hi long")
    rd = spark.createDataFrame(r, "contig string, start long, end long")
    plain = {a[0]: sum(a[1] == b[0] and None not in (*a, *b) and b[1] < a[3] and b[2] > a[2] for b in r) for a in w}
    out = paths.coverage(wd, rd, 64)
    assert {x.id: x.n_reads for x in out.collect()} == plain
    same = paths.coverage(wd.limit(0).unionByName(spark.createDataFrame([(k, "a", 0, 9) for k in range(20_000)], wd.schema)), spark.createDataFrame([("a", 1, 5)], rd.schema).crossJoin(spark.range(20_000)).drop("id"))
    assert [tuple(x) for x in same.groupBy("n_reads").count().collect()] == [(20_000, 20_000)]


def test_offsets_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(paths, "BLOCK", 4)
    rows = [("p", k, 1 + k % 3) for k in range(40)]
    steps = spark.createDataFrame(rows, "path string, node_id long, length long")
    found = {r.node_id: r.start_offset for r in paths.with_offsets(steps).collect()}
    assert found == {k: sum(1 + j % 3 for j in range(k)) for k in range(40)}
    edges = {(r.a, r.b) for r in paths.consecutive_edges(steps).collect()}
    assert edges == {(k, k + 1) for k in range(39)}


def test_neighbourhood_grows(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(9)], "a long, b long")
    seed = spark.createDataFrame([(4,)], "node_id long")
    near = lambda k: {r.node_id for r in paths.neighbourhood(edges, seed, k).collect()}
    assert near(0) == {4} and near(1) == {3, 4, 5} and near(1) <= near(2) == {2, 3, 4, 5, 6}


def test_locate(spark):
    nodes = spark.createDataFrame([("p", 1, 0, 10), ("p", 2, 10, 5)], "path string, node_id long, start_offset long, length long")
    points = spark.createDataFrame([("p", 9), ("p", 10), ("p", 15)], "path string, pos long")
    assert {r.pos: r.node_id for r in paths.locate(nodes, points, 4).collect()} == {9: 1, 10: 2, 15: None}


def test_node_on_no_path_is_not_reported(spark):
    steps = spark.createDataFrame([(1, "q", 1), (1, "p", 0), (1, "q", 2)], "node_id long, path string, ordinal int")
    assert [(r.node_id, r.paths) for r in paths.node_paths(steps).collect()] == [(1, ["p", "q"])]


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.with_chr(F.lit("1")).alias("a"), scalars.with_chr(F.lit("chr1")).alias("b"), scalars.region_label(F.lit("chr1"), F.lit(-50), F.lit(150)).alias("c"),
        scalars.window_start(F.lit(50), 200).alias("d"), scalars.tag_value(F.lit("SO:i:12")).alias("e"), scalars.base_name(F.lit("/x/HG.v4.vcf")).alias("f"),
        scalars.strip(F.lit("\t a \n")).alias("g"), scalars.extension(F.lit("A/B.GAM")).alias("h"), scalars.graph_file(F.lit("a.xg")).alias("i"), scalars.node_id(F.lit("x")).alias("j"),
    ).first()
    assert tuple(row) == ("chr1", "chr1", "GRCh38#0#chr1:-50-150", 0, "12", "HG", "a", "gam", "a.vg", None)


READS = "\n".join(
    json.dumps({"name": n, "sequence": "ACGT", "path": {"mapping": [{"position": {"node_id": k}} for k in nodes]}})
    for n, nodes in (("r1", ["5", 7]), ("r2", [7, 5]), ("r3", [1]))
)
REGIONS = json.dumps({"x": {"segments": [{"segment_id": "5", "paths": ["p"]}], "aligned_reads": [{"read_name": "old", "sequence_length": 1, "mapping_position": 0}]}, "y": {"segments": [{"segment_id": 7, "paths": []}]}, "z": {}})


def test_region_reads_document(spark, write, tmp_path):
    regions = readers.regions_json(spark, write("r.json", REGIONS))
    target = str(tmp_path / "out.json")
    documents.write_object(pipelines.region_reads(regions, readers.gam_json(spark, write("a.gam", READS))), target, "region", order="ordinal")
    out = json.loads(open(target).read())
    assert list(out) == ["x", "y", "z"]
    assert [r["read_name"] for r in out["x"]["aligned_reads"]] == ["old", "r1"]
    assert [r["read_name"] for r in out["y"]["aligned_reads"]] == ["r2"] and out["z"]["aligned_reads"] == []


def test_region_read_names_keep_empty_regions(spark, write):
    regions = readers.regions_json(spark, write("r.json", REGIONS))
    rows = {r.region: r.read_names for r in pipelines.region_read_names(regions, readers.gam_json(spark, write("a.gam", READS))).collect()}
    assert rows == {"x": ["r1", "r2"], "y": ["r1", "r2"]}
    gaf = readers.gaf(spark, write("a.gaf", "g\t\t\t\t\t>57\n"))
    assert all(r.n == 0 for r in pipelines.region_read_names(regions, gaf).collect())
    assert all(r.n == 1 for r in pipelines.region_read_names(regions, gaf, exact=False).collect())


def test_hitting_ids_keeps_input_order(spark, write):
    rows = visits.hitting_ids(readers.gam_json(spark, write("a.gam", READS)), ["7"]).orderBy("read_id").collect()
    assert [r.name for r in rows] == ["r1", "r2"]


def test_node_reads(spark, write):
    nodes = spark.createDataFrame([(5, "AC", ">")], "node_id long, sequence string, strand string")
    (row,) = pipelines.node_reads(readers.gam_json(spark, write("a.gam", READS)), nodes).collect()
    assert [r.read_name for r in row.reads] == ["r1", "r2"] and row.strand == ">"


def test_pileup_window(spark):
    variants = spark.createDataFrame([(0, "c", 50, "A", "C"), (1, "c", 50, "A", "G"), (2, "c", 5000, "A", "G")], "ordinal int, chrom string, pos long, ref string, alt string")
    reads = spark.createDataFrame([("q", "c", 249, 260), ("far", "c", 250, 260)], "query_name string, contig string, start long, end long")
    reads = reads.withColumns({"cigar": F.lit("5M"), "sequence": F.lit("A"), "mapping_quality": F.lit(1), "is_reverse": F.lit(False)})
    rows = {r.key: r for r in pipelines.pileup(variants, reads).collect()}
    assert rows["c:50"].variant.alternate == "G" and [x.query_name for x in rows["c:50"].pileup_reads] == ["q"]
    assert rows["c:5000"].pileup_reads == []


def test_variant_regions(spark):
    schema = "ordinal int, chromosome string, position long, reference string, alternative array<string>, id string, quality double, samples map<string,array<string>>"
    variants = spark.createDataFrame([(0, "chr1", 50, "A", ["C"], None, None, None), (1, "", 5, "A", None, None, None, None)], schema)
    nodes = spark.createDataFrame([("GRCh38#0#chr1", 1, 0, 100), ("GRCh38#0#chr1", 2, 100, 60), ("GRCh38#0#chr1", 3, 160, 9)], "path string, node_id long, start_offset long, length long")
    steps = nodes.select("path", "node_id", F.col("node_id").cast("int").alias("ordinal"))
    found, bad = pipelines.variant_regions(variants, nodes, steps)
    (row,) = found.collect()
    assert row.region == "GRCh38#0#chr1:-50-150" and [s.segment_id for s in row.segments] == ["1", "2"] and row.variants.position == 50
    assert bad.count() == 1


def test_documents_are_atomic(spark, tmp_path):
    target = tmp_path / "a.json"
    target.write_text("before")
    with pytest.raises(Exception):
        documents.write_array(spark.range(2).select(F.raise_error(F.lit("no")).alias("x")), str(target))
    assert target.read_text() == "before" and [p.name for p in tmp_path.iterdir()] == ["a.json"]
    documents.write_array(spark.range(2).withColumn("o", -F.col("id")), str(target), order="o")
    assert json.loads(target.read_text()) == [{"id": 1}, {"id": 0}]
    documents.write_array(spark.range(0), str(target))
    assert json.loads(target.read_text()) == []
    assert documents.variants_name("/a/HG.b.vcf", "chr1") == "HG_variants_chr1.json"


def test_stream_assigns_each_file_once(spark, tmp_path):
    from pangraph_spark.streaming import region_reads

    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(READS)
    regions = spark.createDataFrame([(5, "x"), (7, "y")], "node_id long, region string")
    for name in (None, "2.json"):
        if name:
            (tmp_path / "in" / name).write_text(READS.replace("r1", "r9"))
        region_reads.start(spark, source, regions, target, state).awaitTermination()
    assert {r.region: r.reads for r in region_reads.counts(spark, target).collect()} == {"x": 2, "y": 2}


def test_command_line(spark, write, tmp_path, capsys):
    from pangraph_spark import cli

    assert cli.main(["hits", write("a.gam", READS), "7"]) == 0
    assert capsys.readouterr().out.strip() == "r1, r2"
    assert cli.main(["region-names", write("r.json", REGIONS), write("a.txt", "")]) == 1
    out = str(tmp_path / "o.json")
    assert cli.main(["region-reads", write("r.json", REGIONS), write("a.gam", READS), out]) == 0
    assert set(json.loads(open(out).read())) == {"x", "y", "z"}


def test_overlaps_of_many_tiles(spark):
    """More windows and reads in a bin than meet at once, of all lengths, some empty, some in several bins, some repeated."""
    rng = random.Random(5)
    windows = [(k, rng.choice("ab"), lo, lo + rng.choice((0, 1, 40, 300))) for k in range(1200) for lo in [rng.randrange(-50, 400)]] + [(7, "a", 5, 60)] * 2
    reads = [(k, rng.choice("ab"), at, at + rng.choice((0, 1, 15, 150))) for k in range(500) for at in [rng.randrange(-50, 400)]] + [(7, "a", 9, 9), (None, "b", 20, 40), (8, None, 20, 40), (9, "a", None, 40)]
    w = spark.createDataFrame(windows, "id long, contig string, lo long, hi long")
    r = spark.createDataFrame(reads, "rid long, contig string, start long, end long")
    pairs = [(i, q) for i, c, lo, hi in windows for q, d, b, e in reads if c == d and b is not None and b < hi and e > lo]
    assert Counter(map(tuple, paths.overlaps(w, r, 128).select("id", "rid").collect())) == Counter(pairs)


def test_overlaps_are_small_when_written(spark, tmp_path):
    """Pairs come in an order that Parquet stores in a fraction of a byte each."""
    rng = random.Random(5)
    at = [rng.randrange(80_000) for _ in range(2000)]
    w = spark.createDataFrame([(k, "a", x - 20_000, x + 20_000) for k, x in enumerate(at)], "id long, contig string, lo long, hi long")
    r = spark.createDataFrame([(k, "a", x, x + 150) for k, x in enumerate(at)], "rid long, contig string, start long, end long")
    paths.overlaps(w, r, 40_000).select("id", "rid").write.parquet(f"{tmp_path}/pairs")
    pairs = spark.read.parquet(f"{tmp_path}/pairs").count()
    assert pairs == sum(y < x + 20_000 and y + 150 > x - 20_000 for x in at for y in at)
    assert sum(f.stat().st_size for f in tmp_path.glob("pairs/*.parquet")) < 0.25 * pairs
