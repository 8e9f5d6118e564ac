"""Readers: usual, empty, malformed and short input."""

import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F

from pangraph_spark.sources import bam, frames, readers, schemas

VCF = (
    "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tHG1\tHG2\n"
    "chr1\t100\trs1\tA\tC,G\t50\tPASS\t.\tGT:DP\t0/2:7\t.\n"
    "chr10\t5\t.\tT\t.\t.\tPASS\t.\tGT\t0|0\t./.\n"
    "chr1\tbad\n"
)


def test_vcf_alleles(spark, write):
    rows = readers.vcf_alleles(spark, write("a.vcf", VCF)).orderBy("ordinal").collect()
    assert [r.position for r in rows] == [100, 5]
    assert rows[0].alternative == ["C", "G"] and rows[0].samples == {"HG1": ["A", "G"], "HG2": [None]}
    assert rows[1].alternative is None and rows[1].id is None and rows[1].quality is None
    assert rows[1].samples == {"HG1": ["T", "T"], "HG2": [None, None]}


def test_vcf_chromosome_is_exact_and_prefixed(spark, write):
    path = write("a.vcf", VCF)
    assert [r.position for r in readers.vcf_alleles(spark, path, "1").collect()] == [100]
    assert readers.vcf_alleles(spark, path, "").count() == 2


def test_vcf_format_fields_gzipped(spark, write):
    rows = readers.vcf_format(spark, write("a.vcf.gz", gzip.compress(VCF.encode()))).orderBy("ordinal").collect()
    assert rows[0].samples == {"HG1": {"GT": "0/2", "DP": "7"}, "HG2": {"GT": "."}}


def test_vcf_text_keeps_raw_alternative(spark, write):
    rows = readers.vcf_text(spark, write("a.vcf", VCF)).orderBy("ordinal").collect()
    assert [(r.chrom, r.pos, r.alt) for r in rows] == [("chr1", 100, "C,G"), ("chr10", 5, ".")]
    assert readers.vcf_text(spark, write("none.vcf", "##x\n")).count() == 0


def test_sam(spark, write):
    text = "@HD\nr1\t16\tchr1\t11\t60\t3S5M2D1M\t*\t0\t0\tACGTACGTA\t*\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*\nshort\t1\n"
    (row,) = readers.sam(spark, write("a.sam", text)).collect()
    assert (row.query_name, row.start, row.end, row.is_reverse, row.mapping_quality) == ("r1", 10, 18, True, 60)


def read(name, *nodes, **more):
    mapping = [{"position": {"node_id": n} if n is not None else {}} for n in nodes]
    return json.dumps({"name": name, "sequence": "ACGT", "path": {"mapping": mapping}} | more)


def test_gam_json_quotes_and_malformed_lines(spark, write):
    from pangraph_spark.operators.visits import visits_of

    path = write("a.gam", "\n".join([read("a", "12", 12, None), "{broken", read("b"), "", json.dumps({"name": "c", "sequence": "A"})]))
    reads = readers.gam_json(spark, path)
    assert {r.name for r in reads.collect()} == {"a", "b", "c"}
    assert [r.line for r in readers.gam_quarantine(spark, path).collect()] == ["{broken"]
    assert [(r.node_id, r.offset) for r in visits_of(reads).collect()] == [(12, 0), (12, 0)]
    details = readers.read_details(reads).where("read_name = 'c'").first()
    assert (details.mapping_quality, details.score, details.quality) == (0, None, "")


def test_gaf_needs_more_than_five_columns(spark, write):
    rows = readers.gaf(spark, write("a.gaf", "r1\t1\t2\t3\t+\t>12>7\nr2\t1\t2\t3\t+\n")).collect()
    assert [(r.read_name, r.path) for r in rows] == [("r1", ">12>7")]


GFA = (
    "H\tVN\nW\tGRCh38\t0\tchr1\t0\t9\t>1<2>1\nW\tGRCh38\t0\tchr10\t0\t9\t>9\nW\tshort\t0\tchr1\n"
    "S\t1\tACGT\tSN:Z:x\tSR:i:0\tSO:i:100\nS\t9\tA\tx\ty\tSO:i:5\nS\t3\tA\n"
)


def test_gfa_path_nodes(spark, write):
    path = write("a.gfa", GFA)
    rows = {r.node_id: r for r in readers.gfa_path_nodes(spark, path, "GRCh38", "chr1").collect()}
    assert set(rows) == {1, 2} and rows[1].start_offset == 100 and rows[1].length == 4
    assert (rows[2].strand, rows[2].sequence) == ("<", None)  # on the path, but no segment line
    loose = readers.gfa_path_nodes(spark, path, "GRCh38", "chr1", strict=False)
    assert {r.node_id for r in loose.collect()} == {1, 2, 9}


def test_gfa_last_strand_wins(spark, write):
    path = write("a.gfa", "W\tG\t0\tc\t0\t9\t>1<1\n")
    assert readers.gfa_path_nodes(spark, path, "G", "c").first().strand == "<"


def test_documents(spark, write):
    nodes = readers.node_list_json(spark, write("n.json", '{"nodes":[{"id":7,"sequence":"AC"},{"id":"8","sequence":"A"}]}'))
    assert [(r.node_id, r.length) for r in nodes.orderBy("node_id").collect()] == [(7, 2), (8, 1)]
    nodes = readers.node_map_json(spark, write("m.json", '{"nodes":{"7":{"strand":">"}}}')).first()
    assert (nodes.node_id, nodes.strand, nodes.sequence) == (7, ">", None)
    regions = readers.regions_json(spark, write("r.json", '{"b":{"segments":[{"segment_id":1,"paths":[]}]},"a":{"aligned_reads":[]}}'))
    assert [r.region for r in regions.orderBy("ordinal").collect()] == ["b", "a"]
    assert [r.node_id for r in readers.region_segments(regions).collect()] == [1]


def test_truncated_document_is_rejected(spark, write):
    with pytest.raises(readers.InputError):
        readers.variants_json(spark, write("v.json", '[{"chromosome":"chr1","alternative":["A"')).collect()


def test_variants_without_position_are_skipped(spark, write):
    path = write("v.json", '[{"chromosome":"chr1","position":5},{"chromosome":null,"position":5},{"chromosome":"chr1","position":0}]')
    good, bad = readers.valid_variants(readers.variants_json(spark, path))
    assert [r.ordinal for r in good.collect()] == [0] and sorted(r.ordinal for r in bad.collect()) == [1, 2]


def test_batch_files_in_name_order(spark, tmp_path):
    for name, k in (("b.json", 1), ("a.json", 2)):
        (tmp_path / name).write_text(json.dumps({"x": k}))
    rows = readers.batch_files(spark, f"{tmp_path}/*.json", "x int").orderBy("batch").collect()
    assert [r.x for r in rows] == [2, 1]


def test_graph_json(spark, write):
    graph = {"node": [{"id": "1", "sequence": "AC"}], "edge": [{"from": 1, "to": "2"}], "path": [{"name": "p", "mapping": [{"position": {"node_id": 1}}]}]}
    nodes, edges, steps = readers.graph_json(spark, write("g.json", json.dumps(graph)))
    assert (nodes.first().node_id, edges.first().b, steps.first().path) == (1, 2, "p")


def test_unknown_alignment_format(spark):
    with pytest.raises(readers.InputError):
        readers.alignments(spark, "reads.txt")


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number: int, value) -> bytes:
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_frames(spark, write):
    mapping = field(1, field(1, 12) + field(2, 3))
    message = field(1, "ACGT") + field(2, field(2, mapping) + field(2, b"")) + field(3, "r1") + field(5, 60) + field(6, -2)
    data = struct.pack("<I", len(message)) + message + struct.pack("<I", 0) + struct.pack("<I", 3) + b"\x0f\xff\xff" + struct.pack("<I", 99) + b"xx"
    rows = frames.gam_frames(spark, write("a.frames", data)).orderBy("frame").collect()
    assert [r.error is None for r in rows] == [True, True, False, False]
    assert (rows[0].name, rows[0].sequence, rows[0].mapping_quality, rows[0].score) == ("r1", "ACGT", 60, -2)
    # a mapping without position is node 0 in this form
    assert [(m.position.node_id, m.position.offset) for m in rows[0].path.mapping] == [("12", "3"), ("0", "0")]
    assert rows[1].name == "" and rows[3].error == "truncated frame"
    assert frames.reads_of(frames.gam_frames(spark, write("b.frames", b"\x01"))).count() == 0


def test_bam(spark, write):
    def record(ref, pos, flag):
        name, cigar, seq = b"q1\x00", [(5 << 4) | 0, (2 << 4) | 2], bytes([0x12, 0x48, 0x10])
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), 60, 0, len(cigar), flag, 5, -1, -1, 0) + name + struct.pack("<2I", *cigar) + seq + b"\xff" * 5
        return struct.pack("<i", len(body)) + body

    data = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\x00" + struct.pack("<i", 1000)
    (row,) = bam.bam(spark, write("a.bam", gzip.compress(data + record(0, 10, 16) + record(-1, -1, 4)))).collect()
    assert (row.contig, row.start, row.end, row.cigar, row.sequence, row.is_reverse) == ("chr1", 10, 17, "5M2D", "ACGTA", True)


@pytest.mark.parametrize("name", sorted(schemas.MESSAGES))
def test_every_message_is_a_spark_type(spark, name):
    assert spark.createDataFrame([], schemas.message(name)).count() == 0


def test_snarl_types():
    assert schemas.SNARL_TYPES.index("UNARY") == 2


def test_literal_ids(spark):
    assert readers.id_list(spark, ["3", 4]).agg(F.sum("node_id")).first()[0] == 7
