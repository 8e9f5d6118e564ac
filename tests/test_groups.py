"""Whole groups, snapshots, binary reads and neighbourhoods."""

import gzip
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from pangraph_spark import cli, scratch
from pangraph_spark.functions import scalars
from pangraph_spark.functions.progress import Progress, counted
from pangraph_spark.operators import paths, visits
from pangraph_spark.plans import pipelines
from pangraph_spark.sinks import documents
from pangraph_spark.sources import bam, blocks, frames, readers
from pangraph_spark.streaming import node_reads
from test_sources import field, read, varint


def message(name, *nodes):
    steps = b"".join(field(2, field(1, field(1, n) + field(2, 3) + field(4, 1)) + field(2, field(1, 4) + field(2, 5) + field(3, "A")) + field(5, k + 1)) for k, n in enumerate(nodes))
    return field(1, "ACGT") + field(2, field(1, "walk") + steps) + field(3, name) + field(5, 60)


def gam_bytes(*groups, tag=True):
    """Groups as gzip members of their own."""
    out = b""
    for messages in groups:
        items = [b"GAM", *messages] if tag else list(messages)
        out += gzip.compress(varint(len(items)) + b"".join(varint(len(m)) + m for m in items))
    return out


@pytest.mark.parametrize("tag", [True, False])
def test_gam_groups(spark, write, tag):
    path = write("a.gam", gam_bytes([message("r1", 12, 7), message("r2", 7)], [message("r3")], tag=tag))
    rows = readers.alignments(spark, path).orderBy("read_id").collect()
    assert [(r.name, r.sequence, r.mapping_quality) for r in rows] == [(n, "ACGT", 60) for n in ("r1", "r2", "r3")]
    step = rows[0].path.mapping[1]
    assert rows[0].path.name == "walk" and (step.position.node_id, step.position.offset, step.position.is_reverse) == ("7", "3", True)
    assert (step.edit[0].from_length, step.edit[0].to_length, step.edit[0].sequence, step.rank) == (4, 5, "A", "2")
    assert [(r.read_id, r.node_id) for r in visits.visits_of(readers.gam(spark, path)).orderBy("read_id", "rank").collect()] == [(0, 12), (0, 7), (1, 7)]


def test_damaged_gam_keeps_what_is_readable(spark, write):
    whole = gam_bytes([message("r1", 1)], [message("r2", 2)])
    found = frames.gam_groups(spark, write("a.gam", whole[:-12])).orderBy("frame").collect()
    assert found[0].name == "r1" and found[-1].error
    assert list(frames.groups(iter([b""]))) == [] and readers.gam(spark, write("none.gam", "")).count() == 0
    big = message("x" * 5_000_000, 1)
    assert [m for m, _ in frames.groups(frames.inflate(gam_bytes([big, big]), step=4096))] == [big, big]


def test_frame_reads_are_numbered_by_file_and_frame(spark, tmp_path):
    for name, reads in (("b.frames", ["r3"]), ("a.frames", ["r1", "r1"])):
        (tmp_path / name).write_bytes(b"".join(struct.pack("<I", len(m)) + m for m in (message(r, 1) for r in reads)))
    rows = frames.reads_of(frames.gam_frames(spark, str(tmp_path))).orderBy("read_id").collect()
    assert [r.name for r in rows] == ["r1", "r1", "r3"] and len({r.read_id for r in rows}) == 3


def test_first_description_stays_on_merge(spark):
    part = lambda d, reads: spark.createDataFrame([(1, d, reads)], "node_id long, sequence string, reads array<string>")
    (row,) = visits.merge_groups([part("first", ["x"]), part(None, ["a"]), part("last", [])]).collect()
    assert (row.sequence, row.reads) == ("first", ["x", "a"])


@pytest.mark.parametrize("columns", ["node_id long", "node_id long, sequence string"])
def test_node_reads_have_the_documented_fields(spark, write, columns):
    nodes = spark.createDataFrame([(7, "AC")[: columns.count(",") + 1]], columns)
    reads = readers.gam_json(spark, write("a.json", read("r1", "7", 7) + "\n" + read("r2", 7, score=5)))
    (row,) = pipelines.node_reads(reads, nodes).collect()
    assert [r.read_name for r in row.reads] == ["r1", "r1", "r2"]
    assert list(row.reads[0].asDict()) == ["read_name", "sequence", "mapping_quality", "score", "quality", "path"]
    assert (row.reads[2].sequence, row.reads[2].score, row.reads[2].quality) == ("ACGT", 5, "")
    assert [len(r.reads) for r in pipelines.node_reads(reads, nodes, multiset=False).collect()] == [2]


def test_hot_node_is_spread_over_rows_and_written_as_one_list(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("read_id"), F.lit(0).alias("rank"), F.when(F.col("id") < 95, 1).otherwise(2).alias("node_id"))
    grouped = visits.group_reads(rows, ["node_id"], [], span=10)
    assert max(len(r.reads) for r in grouped.collect()) == 10
    path = str(tmp_path / "parts.json")
    documents.write_parts(grouped.withColumn("sequence", F.lit("A")), path, "node_id", "reads")
    found = json.loads(open(path).read())
    assert [r["read_id"] for r in found["1"]["reads"]] == list(range(95)) and found["2"]["sequence"] == "A" and len(found["2"]["reads"]) == 5
    documents.write_parts(grouped.limit(0), path, "node_id", "reads")
    assert json.loads(open(path).read()) == {}


def test_containing_equals_nested_loop(spark):
    names = ["123", "1", "", None, "3123", "55"]
    ids = ["12", "3", "123", "3", "999999", ""]
    df = spark.createDataFrame(list(enumerate(names)), "k int, name string")
    found = visits.containing(df, "name", spark.createDataFrame([(i,) for i in ids], "id string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted((r.k, r.id) for r in found.collect()) == sorted((k, i) for k, n in enumerate(names) if n for i in {x for x in ids if x} if i in n)
    assert visits.containing(df, "name", spark.createDataFrame([], "id string")).count() == 0


def test_neighbourhood_matches_brute_force_and_reads_each_frontier(spark):
    pairs = [(k, (7 * k + 3) % 50) for k in range(50)] + [(k, k) for k in range(5)] + [(90, 91)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    near, front = {0: 0, 90: 0}, {0, 90}
    for hop in range(1, 6):
        front = {y for a, b in pairs for x, y in ((a, b), (b, a)) if x in front} - set(near)
        near |= dict.fromkeys(front, hop)
    found = paths.neighbourhood(edges, spark.createDataFrame([(0,), (90,), (0,)], "node_id long"), 5)
    assert {r.node_id: r.hops for r in found.collect()} == near
    scans = found._jdf.queryExecution().optimizedPlan().toString().count("parquet")
    assert scans <= 6


def test_graph_commands(spark, write, tmp_path, capsys):
    graph = {"node": [{"id": k, "sequence": "AC"} for k in range(1, 300)], "edge": [{"from": k, "to": k + 1} for k in range(1, 299)], "path": [{"name": "p", "mapping": [{"position": {"node_id": k}} for k in range(1, 300)]}]}
    path = write("g.json", json.dumps(graph))
    assert cli.main(["neighbourhood", "p", "300", path, "--context", "120"]) == 0
    found = json.loads(capsys.readouterr().out)
    assert len(found["node"]) == 241 and len(found["edge"]) == 240 and found["node"][0]["sequence"] == "AC"
    assert cli.main(["neighbourhood", "p", "99999", path]) == 1
    out = str(tmp_path / "n.json")
    assert cli.main(["path-node-list", "-x", path, "-p", "p", "-n", out]) == 0
    assert len(json.loads(open(out).read())["nodes"]) == 299
    assert cli.main(["path-node-list", "-x", path, "-p", "q", "-n", out]) == 1
    reads = write("r.gam", gam_bytes([message("r1", 5), message("r2", 6)]))
    assert cli.main(["node-reads", "-g", reads, "-n", out, "-j", str(tmp_path / "o.json"), "--set"]) == 0
    assert {k: [r["read_name"] for r in v["reads"]] for k, v in json.loads(open(tmp_path / "o.json").read()).items()} == {"5": ["r1"], "6": ["r2"]}


def test_progress_and_observed_counts(spark):
    seen = []
    p = Progress(1000, seen.append)
    assert [p.add(n) for n in (400, 600, 2500, 1)] == [False, True, True, False] and seen == [1000, 3500]
    df, observed = counted(spark.range(30))
    df.collect()
    assert observed.get["rows"] == 30
    assert [r[0] for r in spark.range(7).select(scalars.every(F.col("id"), 3)).collect()] == [False, False, False, True, False, False, True]


def test_stream_groups_reads_and_renews_its_snapshot(spark, tmp_path):
    source, target, state, snapshot = (str(tmp_path / n) for n in ("in", "out", "state", "snapshot.json"))
    (tmp_path / "in").mkdir()
    nodes = spark.createDataFrame([(5, "AC"), (7, "G")], "node_id long, sequence string")
    for k, lines in enumerate([[read("r1", 5), read("r1", 5)], [read("r2", 5, 7), "{broken"]]):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(lines))
        node_reads.start(spark, source, nodes, target, state, snapshot, every=1).awaitTermination()
    found = json.loads(open(snapshot).read())
    assert {k: sorted(r["read_name"] for r in v["reads"]) for k, v in found.items()} == {"5": ["r1", "r1", "r2"], "7": ["r2"]}
    assert found["7"]["sequence"] == "G" and {r.node_id: len(r.reads) for r in node_reads.groups(spark, target, nodes).collect()} == {5: 3, 7: 1}


def test_scratch_tables_go(spark, monkeypatch):
    from pathlib import Path

    with scratch.dropped() as keep:
        a, b = scratch.cut(spark.range(3)), keep(scratch.cut(spark.range(4)))
    folder = lambda df: Path(df.inputFiles()[0].removeprefix("file:")).parent
    assert b.count() == 4 and folder(b).exists()
    with pytest.raises(Exception):
        a.count()

    class Far:
        conf = spark.conf
        sparkContext = type("C", (), {"master": "spark://far:7077", "getConf": staticmethod(lambda: {})})

    with pytest.raises(RuntimeError):
        scratch.folder(Far) if not spark.conf.get("spark.checkpoint.dir", None) else scratch.folder(type("S", (), {"conf": {}, "sparkContext": Far.sparkContext}))


def test_documents_go_to_any_file_system_at_once(spark, tmp_path):
    target = f"file://{tmp_path}/deep/a.json"
    documents.write_array(spark.range(2), target)
    documents.write_array(spark.range(3), target)
    assert json.loads((tmp_path / "deep" / "a.json").read_text()) == [{"id": 0}, {"id": 1}, {"id": 2}]
    with pytest.raises(Exception):
        documents.write_array(spark.range(2).select(F.raise_error(F.lit("no")).alias("x")), target)
    assert [p.name for p in (tmp_path / "deep").iterdir() if not p.name.startswith(".")] == ["a.json"]
    assert len(json.loads((tmp_path / "deep" / "a.json").read_text())) == 3


def blocked(data: bytes, size: int = 700) -> bytes:
    """Blocks as the usual tools write them, with the empty one at the end."""
    out = b""
    for part in [*(data[k : k + size] for k in range(0, len(data), size)), b""]:
        engine = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = engine.compress(part) + engine.flush()
        out += blocks.MAGIC + struct.pack("<H", len(blocks.MAGIC) + 2 + len(body) + 8 - 1) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def test_blocked_gam_is_read_in_splits(spark, tmp_path):
    names = [f"r{k}" for k in range(2000)]
    plain = b"".join(varint(len(items)) + b"".join(varint(len(m)) + m for m in items) for items in ([b"GAM", *(message(n, k) for k, n in enumerate(names[a : a + 37], a))] for a in range(0, 2000, 37)))
    (tmp_path / "b.gam").write_bytes(blocked(plain))
    (tmp_path / "a.gam").write_bytes(blocked(gzip.decompress(gam_bytes([message("first", 1)]))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        path = f"{tmp_path}/*.gam"
        assert blocks.is_blocked(spark, path) and blocks.pieces(spark, path).rdd.getNumPartitions() > 3
        rows = readers.gam(spark, path).orderBy("read_id").collect()
        assert [r.name for r in rows] == ["first", *names]
        assert rows[5].path.mapping[0].position.node_id == "4"
        damaged = bytearray(blocked(plain))
        damaged[len(damaged) // 2] ^= 0xFF
        (tmp_path / "c.bin").write_bytes(bytes(damaged))
        found = frames.gam_groups(spark, f"{tmp_path}/c.bin").orderBy("frame").collect()
        assert found[0].name == "r0" and found[-1].error and len(found) < 2000 and all(r.error is None for r in found[:-1])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_blocked_bam_is_read_in_splits(spark, tmp_path):
    def record(k):
        name, cigar = f"q{k}".encode() + b"\x00", [(5 << 4) | 0]
        body = struct.pack("<iiBBHHHiiii", k % 2, k, len(name), 60, 0, len(cigar), 16 * (k % 3 == 0), 5, -1, -1, 0) + name + struct.pack("<I", *cigar) + bytes([0x12, 0x48, 0x10]) + b"\xff" * 5
        return struct.pack("<i", len(body)) + body

    head = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 2) + b"".join(struct.pack("<i", 5) + n + struct.pack("<i", 9000) for n in (b"chr1\x00", b"chr2\x00"))
    (tmp_path / "a.bam").write_bytes(blocked(head + b"".join(record(k) for k in range(3000))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = {r.query_name: r for r in bam.bam(spark, str(tmp_path / "a.bam")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 3000
    assert all((r.contig, r.start, r.end, r.sequence, r.is_reverse) == (f"chr{k % 2 + 1}", k, k + 5, "ACGTA", k % 3 == 0) for k, r in ((int(n[1:]), r) for n, r in rows.items()))
