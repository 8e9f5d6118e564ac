"""Secrets, licences, toxicity, fingerprints, top-k."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pangraph_spark.llm import fingerprints, licenses, secret_model, secrets, topk, toxicity

SCHEMA = "doc_id long, text string"
FOLDER = "/root/testdata/sf0.001"


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA)


def sql_rows(sql, **frames):
    con = duckdb.connect()
    for name, frame in frames.items():
        con.register(name, frame)
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return [dict(zip(names, r, strict=True)) for r in found.fetchall()]


def same(df, expected, digits=6):
    clean = lambda d: tuple(sorted((k, round(v, digits) if isinstance(v, float) else v) for k, v in d.items()))
    assert sorted(map(clean, (r.asDict() for r in df.collect())), key=repr) == sorted(map(clean, expected), key=repr)


@pytest.fixture(scope="module")
def network():
    return secret_model.trained()


def test_network_recall_and_calibration(network):
    found = secret_model.labelled_findings(1500, seed=77)
    p = network.probability(np.array([secret_model.window(*f[1:4]) for f in found]))
    y, kind = np.array([f[4] for f in found]), np.array([f[0] for f in found])
    for k in secret_model.KINDS:
        hit = p[kind == k] >= network.thresholds[k]
        assert hit[y[kind == k] == 1].mean() > 0.9 and hit[y[kind == k] == 0].mean() < 0.1
    high, low = y[p > 0.9].mean(), y[p < 0.1].mean()
    assert high > 0.9 and low < 0.1


BASE = {
    "assign": re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"(AKIA[A-Z0-9]+)"),
    "hex": re.compile(r"([0-9a-f]+)"),
}
LEAST = {"assign": 6, "access": 20, "hex": 24}


def plain_base(text):
    found = [(m.start(), n, k, m.end()) for n, (k, p) in enumerate(BASE.items()) for m in p.finditer(text or "") if len(m.group(1)) >= LEAST[k]]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def secret_texts():
    rng = random.Random(4)
    bits = ["password=", "Secret : ", "token=token:abcdefgh", "api_key='", "AKIA", "AKIAAKIA", "abc123" * 5, "deadbeef" * 4, " é ", "\n", '"', "x" * 30 + "1", "ABCDEFGH12345678", "ſecret=abcdefgh", "=", ":", "passwd==abcdef", "0" * 23]
    return [None, "", *["".join(rng.choice(bits) for _ in range(rng.randrange(1, 9))) for _ in range(300)]]


def test_base_findings(spark, network):
    texts = secret_texts()
    for r in secrets.scan(table(spark, texts), network).collect():
        base = plain_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), texts[r.doc_id]
        assert {x for x in base.split(",") if x} <= set(r.spans.split(","))
        assert r.n_assign == base.count("assign:") and r.n_hex == base.count("hex:") and r.n_access == base.count("access:")


def test_network_adds_spans_and_redaction_takes_them(spark, network):
    token = "ghp_q8Zk2mNv7Xw4Lr9Ty3Bc6Hd1Jf5Ps0Ga2Ue"
    texts = [f'export GITHUB_AUTH="{token}"\n', "plain words only, 2024", 'password: "hunter22hunter"']
    rows = {r.doc_id: r for r in secrets.scan(table(spark, texts), network).collect()}
    assert rows[0].n_added == 1 and rows[0].spans == f"token:{texts[0].index(token)}:{texts[0].index(token) + len(token)}"
    assert rows[1].spans == "" and rows[1].max_score is None
    clean = {r.doc_id: r for r in secrets.redact(table(spark, texts).withColumn("n_assign", F.lit(1)), network).collect()}
    assert token not in clean[0].text and clean[1].text == texts[1] and "hunter22" not in clean[2].text and clean[1].n_assign == 1
    assert secrets.scan(spark.createDataFrame([], SCHEMA), network).count() == 0


def test_license_scan(spark):
    full = dict(reversed(licenses.KNOWN))["MIT"] if False else next(t for n, t in licenses.KNOWN if n == "MIT" and len(t) > 500)
    texts = [None, "", "Copyright (c) 2020 A\n" + full.upper().replace("LICENSE", "LICENCE"), "x\nLicensed under  CC BY-NC 4.0.\nlicensed under the MIT Licence", "no licence here", "Copyright MIT License\nMIT License"]
    df = table(spark, texts).withColumn("license", F.lit(1))
    rows = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert rows[2].text_license == "MIT" and rows[5].text_license == "MIT" and rows[4].text_license is None
    assert rows[3].notice_licenses == "CC-BY-NC-4.0,MIT" and rows[3].n_notices == 2
    same(licenses.scan(df), sql_rows(licenses.sql(), documents=df.toPandas()))


def test_fingerprints_against_sql(spark):
    rng = random.Random(8)
    texts = [None, "", "one. two. three\nfour", "four\nthree. two. one", "same", "same", *[". ".join(rng.choice("abcdefg") * 5 for _ in range(rng.randrange(9))) + "é\U0001f600" for _ in range(60)]]
    df = spark.createDataFrame([(3 * k, t) for k, t in enumerate(texts)] + [(None, "no id"), (9, "twice")], SCHEMA).withColumn("place", F.lit(1))
    same(fingerprints.compare(df), sql_rows(fingerprints.sql(), documents=df.toPandas().astype({"doc_id": "Int64"})), 4)
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(table(spark, texts)).collect()}
    assert got[2] == got[3] and got[4] == got[5] and got[2] != got[4] and got[0] == got[1]
    assert fingerprints.compare(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fingerprints_are_homomorphic(spark):
    df = spark.createDataFrame([("a\nb\nc", "a\nc", "b")], "x string, y string, z string")
    for name in "xyz":
        df = fingerprints.with_lanes(df, name, f"l{name}")
    row = df.select((fingerprints.combine(F.col("ly"), F.col("lz")) == F.col("lx")).alias("put"), (fingerprints.combine(F.col("lx"), F.col("lz"), -1) == F.col("ly")).alias("taken")).first()
    assert row.put and row.taken


def test_topk_against_sql_and_edge_rows(spark):
    rng = np.random.default_rng(1)
    vectors = [(k, rng.normal(size=6).tolist()) for k in range(300)] + [(300 + k, [1.0] * 6) for k in range(40)]
    odd = [(350, None), (351, [1.0] * 5 + [None]), (352, [float("nan")] * 6), (353, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (354, [])]
    df = spark.createDataFrame([*vectors, *odd], "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    found = topk.search(df, df.where("vec_id % 50 = 0"), block=64)
    frame = df.toPandas().astype({"vec_id": "Int64"})
    frame["embedding"] = frame.embedding.map(lambda v: None if v is None else [None if x is None else float(x) for x in v])
    expected = sql_rows(topk.SQL, embeddings=frame.drop(columns="score"))
    same(found, expected)
    assert topk.search(df.limit(0), df.limit(0)).count() == 0
    few = topk.search(df.where("vec_id < 3"), df.where("vec_id = 0"))
    assert [r.rank for r in few.orderBy("rank").collect()] == [1, 2]


def plain_segments(scores):
    """All maximal scoring segments by recursion over the best one."""
    if not scores or max(scores) <= 0:
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    best = max(((total[j] - total[i], -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    _, _, i, j = best
    return [*plain_segments(scores[:i]), (i, j, best[0]), *[(a + j, b + j, s) for a, b, s in plain_segments(scores[j:])]]


def test_segments_are_the_maximal_ones():
    rng = random.Random(6)
    for _ in range(200):
        scores = [rng.choice([-3.0, -1.25, -0.5, 1.0, 2.5, 4.75]) + rng.random() / 1000 for _ in range(rng.randrange(18))]
        total = np.concatenate(([0.0], np.cumsum(scores)))
        got = toxicity.segments(np.flatnonzero(np.array(scores) > 0), total)
        want = plain_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def test_monotone_fit():
    fit = toxicity.monotone(np.array([2.0, 0, 2, 2]), np.array([1.0, 0, 0, 2]))
    assert (np.diff(fit) >= 0).all() and fit[0] == 0.25 and fit[-1] == 1


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    rank = got.score.rank().to_numpy()
    positive = got.toxic.to_numpy() == 1
    n, p = len(got), positive.sum()
    assert (rank[positive].sum() - p * (p + 1) / 2) / (p * (n - p)) > 0.93
    assert got.predicted[positive].mean() > 0.85 and got.predicted[~positive].mean() < 0.03


def test_toxicity_edge_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (1, None), (2, ""), (2, "")], SCHEMA).withColumn("score", F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score(docs, none).collect()
    assert len(rows) == 4 and all(r.score == 0 and r.predicted == 0 for r in rows)
    assert toxicity.reject(docs, none).count() == 4
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_held_out_is_crc(spark):
    import zlib

    rows = spark.range(50).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)
