"""Graph queries do the whole job: brute force over small tables, without SQL."""

import datetime

import pytest

from pangraph_spark.operators import paths
from pangraph_spark.plans.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Fifty nodes of 30 characters on one path, reads far beyond id 200, nodes of the far end unread."""
    to = str(tmp_path_factory.mktemp("whole"))
    part = [(k, "x" * 30, "Brand#11" if k <= 40 else "Brand#22", f"TYPE {k % 3}", k) for k in range(1, 51)]
    spark.createDataFrame(part, "p_partkey int, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{to}/part.parquet")
    items = [(100_000 + r, 1 + (7 * r + j) % 30, 1, j, 5) for r in range(60) for j in range(3)] + [(5, 25, 1, 1, 5)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey int, l_suppkey int, l_linenumber int, l_quantity int").write.parquet(f"{to}/lineitem.parquet")
    return to


def spans(spark, folder):
    """``path, node, begin, end`` of every node."""
    at, out = {}, []
    for r in spark.read.parquet(f"{folder}/part.parquet").orderBy("p_partkey").collect():
        begin = at.get(r.p_brand, 0)
        at[r.p_brand] = begin + len(r.p_name)
        out.append((r.p_brand, r.p_partkey, begin, at[r.p_brand]))
    return out


def test_regions_count_all_reads_and_stay_when_empty(spark, folder):
    nodes = spans(spark, folder)
    visits = [(r.l_orderkey, r.l_partkey) for r in spark.read.parquet(f"{folder}/lineitem.parquet").collect()]
    got = {r.region: r.reads for r in QUERIES["regions_with_empty"](spark, folder).collect()}
    for region, reads in got.items():
        path, lo, hi = region.split("#", 2)[2].rsplit(":", 1)[0], *map(int, region.rsplit(":", 1)[1].rsplit("-", 1))
        inside = {n for p, n, b, e in nodes if p == path and b <= hi and e > lo}
        assert reads == len({r for r, n in visits if n in inside})
    assert len(got) == len(nodes) and 0 in got.values() and max(got.values()) > 1


def test_every_node_has_a_region(spark, folder):
    nodes = spans(spark, folder)
    labels = {r.ordinal: (r.region, r.key) for r in QUERIES["region_label"](spark, folder).collect()}
    assert labels == {n: (f"REF#0#{p}:{b - 100}-{b + 100}", f"{p}:{b}") for p, n, b, _ in nodes}
    inside = {labels[n][0]: {m for q, m, c, e in nodes if q == p and c <= b + 100 and e > b - 100} for p, n, b, _ in nodes}
    visits = [(r.l_orderkey, r.l_partkey) for r in spark.read.parquet(f"{folder}/lineitem.parquet").collect()]
    reads = {g: len({r for r, n in visits if n in held}) for g, held in inside.items()}
    assert {r.region: r.reads for r in QUERIES["regions_with_empty"](spark, folder).collect()} == reads
    assert {r.region: r.reads for r in QUERIES["distinct_reads_per_region"](spark, folder).collect()} == {g: n for g, n in reads.items() if n}
    last = {m: labels[max(n for n in labels if m in inside[labels[n][0]])][0] for _, m, *_ in nodes}
    assert {r.node_id: r.region for r in QUERIES["segment_region_last_wins"](spark, folder).collect()} == last


def test_every_event_has_a_window(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    events = [(k, "ab"[k % 2], base + datetime.timedelta(seconds=1500 * k + 7 * (k % 5))) for k in range(1, 61)]
    spark.createDataFrame(events, "event_id long, event_type string, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    at = {k: (c, int((t - datetime.datetime(1970, 1, 1)).total_seconds())) for k, c, t in events}
    pairs = sorted((v, r) for v, (c, x) in at.items() for r, (d, y) in at.items() if c == d and y < x + 20_000 and y + 150 > max(0, x - 20_000))
    assert sorted(map(tuple, QUERIES["variant_read_overlap"](spark, str(tmp_path)).collect())) == pairs
    counts = sorted((f"{c}:{x - 20_000}", sum(v == w for w, _ in pairs)) for v, (c, x) in at.items())
    assert sorted(map(tuple, QUERIES["pileup_counts"](spark, str(tmp_path)).collect())) == counts


def test_all_path_nodes_get_their_segments(spark, tmp_path):
    """Also nodes from 500 on and paths of any name."""
    part = [(k, f"seq{k}", f"Brand#{k % 4}", f"TYPE {k % 3}", k) for k in (1, 499, 500, 501, 20_000)]
    spark.createDataFrame(part, "p_partkey int, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    rows = QUERIES["path_nodes_left_join_segments"](spark, str(tmp_path)).select("path", "node_id", "strand", "sequence", "length").collect()
    assert sorted(map(tuple, rows)) == sorted((p, k, "<>"[k % 2 == 0], s, len(s)) for k, s, *both, _ in part for p in both)


def test_path_nodes_without_segment_line_keep_their_strand(spark):
    steps = spark.createDataFrame([("p", 1, ">"), ("p", 700, "<"), ("q", 700, ">")], "path string, node_id long, strand string")
    lines = spark.createDataFrame([(1, "acgt", 4), (9, "a", 1)], "node_id long, sequence string, length long")
    rows = paths.describe_path(steps, lines).select("path", "node_id", "strand", "sequence", "length").collect()
    assert sorted(map(tuple, rows), key=repr) == [("p", 1, ">", "acgt", 4), ("p", 700, "<", None, None), ("q", 700, ">", None, None)]
