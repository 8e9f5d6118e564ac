"""Odd rows for every operator: nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pangraph_spark.llm import bpe_codec, common, corpus_stages, fingerprints, licenses, packing, ranges, secret_model, secrets, similarity, substrings, token_counts, topk, toxicity
from pangraph_spark.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def network():
    return secret_model.trained()


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize(
    "ids",
    [list(range(3000)), [k * k * k for k in range(3000)], [2**63 - 1 - k * 2**50 for k in range(1500)] + [-(2**63) + k for k in range(1500)], [7] * 2000 + list(range(1000)), [None] * 1000 + [5]],
)
def test_ranges_follow_ids_and_are_even(spark, monkeypatch, ids):
    monkeypatch.setattr(ranges, "CELLS", 16)
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "x" * rng.randrange(40)) for i in ids], SCHEMA)
    found = ranges.Ranges(docs, group_bytes=1000)
    rows = docs.select("doc_id", found.column().alias("part"), F.length("text").alias("b")).collect()
    key = lambda i: -(2**63) if i is None else i
    assert all(r.part == int(np.searchsorted(np.array(found.bounds, np.int64), key(r.doc_id), "left")) for r in rows)
    sizes, heaviest = {}, {}
    for r in rows:
        sizes[r.part] = sizes.get(r.part, 0) + r.b
        heaviest.setdefault(r.part, {}).setdefault(r.doc_id, 0)
        heaviest[r.part][r.doc_id] += r.b
    assert all(n <= 2100 or n - max(heaviest[p].values()) <= 2100 for p, n in sizes.items())
    assert len(set(ids)) < 10 or found.count > 15


def test_lookups_and_id_filter(spark, monkeypatch):
    left = spark.createDataFrame([(k, k % 3) for k in range(200)] + [(900, 77), (None, 1)], "doc_id long, key long")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (5, "c")], "key long, v string")
    want = ordered([(i, k, {0: "a", 1: "b"}.get(k)) for i, k in [*((k, k % 3) for k in range(200)), (900, 77), (None, 1)]])
    for few in (100, 0):
        monkeypatch.setattr(common, "FEW", few)
        assert ordered(common.attach(left, right, ["key"]).select("doc_id", "key", "v").collect()) == want
    ids = spark.createDataFrame([(k,) for k in (3, -5, 2**62, 180)], "doc_id long")
    held = {r.doc_id for r in left.where(common.among(ids, "doc_id")).collect()}
    assert {3, 180} <= held and len(held) < 5
    assert left.where(common.among(ids.limit(0), "doc_id")).count() == 0


def test_secrets_of_edge_rows(spark, network):
    long = "plain words " * 60_000 + 'password = "q8Zk2mNv7Xw4"' + " more" * 10_000
    docs = spark.createDataFrame([(1, long), (1, long), (None, 'token="abcdef12"'), (2, None), (3, "")], SCHEMA).withColumn("spans", F.lit(5)).withColumn("n_hex", F.lit("x"))
    found = secrets.scan(docs, network)
    assert found.columns[:2] == ["doc_id", "n_assign"] and len(set(found.columns)) == len(found.columns)
    rows = ordered(found.select("doc_id", "n_assign", "spans").collect())
    at = long.index("password")
    assert rows == ordered([(1, 1, f"assign:{at}:{at + 24}")] * 2 + [(None, 1, "assign:0:15"), (2, 0, ""), (3, 0, "")])
    clean = secrets.redact(docs, network)
    assert clean.columns == docs.columns
    by = {(r.doc_id, r.spans): r.text for r in clean.collect()}
    assert by[2, 5] is None and by[3, 5] == "" and "q8Zk2mNv7Xw4" not in by[1, 5] and by[1, 5].endswith(" more")
    assert secrets.redact(docs.limit(0), network).count() == 0


def test_network_is_trained_on_a_given_table(spark):
    rows = [(k, a, b, c, y) for k, a, b, c, y in secret_model.labelled_findings(1600, seed=3)]
    table = spark.createDataFrame([*rows, (None, "", "", "", 1)], "kind string, left_text string, candidate string, right_text string, label int")
    net = secret_model.train_on(table, most=1500, epochs=5)
    assert set(net.thresholds) == set(net.held_out) == set(secret_model.KINDS) and all(net.held_out[k][0] >= 0.95 for k in secret_model.KINDS)
    with pytest.raises(ValueError):
        secret_model.train_on(table.where("label = 1"))


def test_licences_of_edge_rows(spark):
    isc = next(t for n, t in licenses.KNOWN if n == "ISC")
    wrapped = "\n".join(line for p in isc.split("\n\n") for line in [*textwrap.wrap(p, 70), ""]).replace("above copyright", "above\ncopyright")
    assert any(line.startswith("copyright notice") for line in wrapped.lower().split("\n"))
    bsd = next(t for n, t in licenses.KNOWN if n == "BSD-3-Clause" and len(t) > 500)
    texts = [wrapped, "Copyright (c) 2019-2024, The Somebody Authors. All rights reserved.\n\nBSD 3-Clause License\n\n" + bsd, "x " * 300_000 + "\nReleased under the MIT License." + " " * 5000 + "\nend", None, ""]
    docs = spark.createDataFrame([*enumerate(texts), (1, texts[1]), (None, texts[0])], SCHEMA).withColumn("digest", F.lit(1)).withColumn("row_no", F.lit(2))
    rows = ordered(licenses.scan(docs).select("doc_id", "text_license", "n_notices", "notice_licenses").collect())
    assert rows == ordered([(0, "ISC", 0, ""), (1, "BSD-3-Clause", 0, ""), (1, "BSD-3-Clause", 0, ""), (2, None, 1, "MIT"), (3, None, 0, ""), (4, None, 0, ""), (None, "ISC", 0, "")])
    assert licenses.scan(docs.limit(0)).count() == 0
    assert licenses.canonical("Licence licence LICENCE") == "license license license"
    assert licenses.canonical("© 2020 A\n(c) 1999 B\nCopyright: (C) C\ncopyright law holds") == "copyright law holds"


def test_licence_table_of_the_caller(spark):
    own = licenses.digest_table(spark.createDataFrame([("House-1", "You may look, but not touch."), ("House-0", "you MAY look but not touch"), (None, None)], "license string, text string"))
    docs = spark.createDataFrame([(1, "You may look; but not touch!"), (2, "Intro\nyou may look but not touch\nMIT License")], SCHEMA)
    rows = ordered(licenses.scan(docs, own).select("doc_id", "text_license", "notice_licenses").collect())
    assert rows == [(1, "House-0", "House-0"), (2, None, "House-0")]


def test_very_long_texts_link_and_lose_passages(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120_000)]
    near = [w if rng.random() > 0.005 else "changed" for w in base]
    other = [word() for _ in range(90_000)] + base[500:540]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(other))], "doc_id int, text string")
    docs = docs.withColumn("range_no", F.lit("x")).withColumn("part", F.lit(1)).withColumn("data", F.lit(b"y")).withColumn("block", F.lit(2))
    assert {r.doc_id: r.component_id for r in similarity.groups(docs).collect()} == {1: 1, 2: 1, 3: 3}
    kept = similarity.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3}
    clean = substrings.dedup(docs)
    assert clean.dtypes == docs.dtypes
    by = {r.doc_id: r for r in clean.collect()}
    assert by[1].text == " ".join(base) and by[3].text == " ".join(other[:-40]) and by[3].range_no == "x"
    assert {r.doc_id: r.n_removed for r in substrings.digest(docs).collect()}[3] == 40


def test_components_of_any_size_multiply_exactly(spark):
    rows = [(0, [1e30, 1.0]), (50, [1e300, -1e300]), (1, [1e30, 2.0]), (2, [-1e308, 1e308]), (3, [0.5, 0.25]), (4, [2.0**60, 3.0]), (5, [2.0**60, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit(1)).withColumn("tile", F.lit(1)).withColumn("v", F.lit(1))
    got = {}
    for r in topk.search(df, df.where("vec_id % 50 = 0"), k=6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = lambda x: int(min(max(x * 256.0, -topk.LARGEST), topk.LARGEST) // 1)
    for q, x in ((0, rows[0][1]), (50, rows[1][1])):
        scores = [(i, min(max(sum(whole(a) * whole(b) for a, b in zip(x, v, strict=True)), topk.LEAST), topk.MOST)) for i, v in rows if i != q]
        assert got[q] == sorted(scores, key=lambda t: (-t[1], t[0]))


def test_topk_in_tiles_with_shared_bounds(spark, monkeypatch):
    monkeypatch.setattr(topk, "SAMPLE", 20)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(400, 8))
    vectors[:80] = vectors[0]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    whole = np.floor(256 * vectors).astype(np.int64)
    got = {}
    for r in topk.search(df, df.where("vec_id % 5 = 0"), block=64, tile=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, 400, 5):
        score = whole @ whole[q]
        want = sorted(((int(-score[i]), i) for i in range(400) if i != q))[:5]
        assert got[q] == [(i, -s) for s, i in want]


def test_text_operators_ignore_clashing_columns(spark):
    long = "wort, " * 60_000
    docs = spark.createDataFrame([(1, long), (1, "a b"), (None, None), (2, "")], SCHEMA)
    for name in ("n_tokens", "ids_sha256", "piece", "length", "offset", "part", "local", "score", "lanes", "fingerprint", "place"):
        docs = docs.withColumn(name, F.lit("x"))
    plain = docs.select("doc_id", "text")
    path = tokenizer_path()
    for f in (lambda d: token_counts.count_tokens(d, path, report=True), lambda d: bpe_codec.round_trip(d, path), fingerprints.compare, lambda d: packing.pack(d, path).drop("sequence_id", "offset")):
        assert ordered(f(docs).collect()) == ordered(f(plain).collect())
    assert packing.pack(docs, path).groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_long_texts_are_counted_by_chunks(spark):
    """Chunks are spliced, overlaps without a boundary are widened, and counts stay those of whole texts."""
    texts = ["wort, und mehr " * 4000, "x" * 30_000 + " y", "kurz", "é" * 9000 + " ende " * 900, None]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    found = {r.doc_id: r for r in token_counts.count_tokens(docs, tokenizer_path(), report=True).collect()}
    whole = {r.doc_id: r.n_tokens for r in bpe_codec.round_trip(docs, tokenizer_path()).collect()}
    assert {k: r.n_tokens for k, r in found.items()} == whole
    assert found[0].n_chunks > 5 and found[0].n_widened == 0 and found[1].n_widened > 0 and found[3].n_widened > 0
    assert found[2].n_chunks == found[4].n_chunks == 1


def test_plain_chunks_are_encoded_as_any_others():
    """Arrays and texts give the same ids, with words held from batch to batch or not."""
    from tokenizers import Tokenizer

    from pangraph_spark.llm import bpe
    from pangraph_spark.llm.words import text_bytes

    library = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(12)
    letters = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x250), *range(0x370, 0x530), 0x1F600, 0x4E2D, 0x301, 0x2161]]
    texts = ["".join(rng.choice([*"aeinrst" * 60, *letters, " ", " "]) for _ in range(rng.randrange(80))) for _ in range(1500)]
    texts += ["it's we'll o'clock 'tis", "A1b2 -- ... !? (x)", "<|endoftext|>a<|b", "ÀÉÎ ŠŽ ΣΑΣ ДОМ", "x,y.z;", "é" * 50]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    for limit in (300_000, 50, 0):
        enc = bpe.Encoder(bpe.automaton(tokenizer_path()), limit=limit)
        for part in (slice(0, 700), slice(500, None), slice(0, None)):
            ids, at = bpe_codec.token_ids(enc, *text_bytes(pa.array(texts[part])))
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want[part]


def test_packing_of_ties(spark):
    """Equal lengths take distinct places, whatever the order of rows."""
    docs = spark.createDataFrame([(k % 7, "the the the") for k in range(500)], SCHEMA)
    rows = packing.pack(docs.repartition(5), tokenizer_path(), length=9).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 500 and len({r.sequence_id for r in rows}) == 250


def test_fingerprints_of_very_many_paragraphs(spark):
    """Lanes do not reach into each other, and likeness still means something."""
    n = (1 << 20) + 70_000
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.concat_ws("\n", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: (k + F.when(F.col("id") == 2, n // 2).when(F.col("id") == 1, 3).otherwise(0)).cast("string"))).alias("text"))
    made = fingerprints.with_lanes(docs, "text", "lanes").withColumn("centred", fingerprints._centred(F.col("lanes")))
    one, two = made.where("doc_id = 0").select(F.col("lanes").alias("a"), F.col("centred").alias("ca")), made.where("doc_id > 0").select("doc_id", F.col("lanes").alias("b"), F.col("centred").alias("cb"))
    near = {r.doc_id: r.near for r in two.join(F.broadcast(one)).select("doc_id", fingerprints.likeness(F.col("a"), F.col("b"), F.col("ca"), F.col("cb")).alias("near")).collect()}
    assert near[1] > 0.99 and 0.1 < near[2] < 0.9


def test_stages_of_edge_rows(spark):
    folder = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(None, None, "en", "s", 5), (None, "", "en", "s", 0), (900_001, None, None, None, 7), (900_002, "few words", "en", "s", 9), (900_002, "few words", "en", "s", 9)], given.schema)
    docs = given.unionByName(odd).withColumn("range_no", F.lit(1)).withColumn("weight", F.lit(2.0)).withColumn("spans", F.lit("x")).withColumn("row_no", F.lit(3))
    stages = [corpus_stages.drop_toxic, corpus_stages.drop_near_duplicates, corpus_stages.drop_repeated_passages, corpus_stages.redact_secrets]
    for stage in stages:
        after = stage(spark, docs, folder)
        assert after.dtypes == docs.dtypes
        rows = after.collect()
        assert {r.n_chars for r in rows if r.doc_id == 900_001} == {7} and sum(r.doc_id is None for r in rows) == 2
        assert sum(r.doc_id == 900_002 for r in rows) == (1 if stage is corpus_stages.drop_near_duplicates else 2)
        assert stage(spark, docs.limit(0), folder).count() == 0
    packed = corpus_stages.pack_sequences(spark, docs, folder).collect()
    assert sum(r.doc_id is None for r in packed) == 2 and all(r.length == 1 for r in packed if r.doc_id is None)
    assert corpus_stages.pack_sequences(spark, docs.limit(0), folder).count() == 0


def test_whole_pipeline(spark):
    """``run`` gives what its stages give one after another, and every piece once."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, folder))
    encoded = {r.doc_id: [*r.ids, 1] for r in bpe_codec.encode(docs, tokenizer_path()).collect()}
    rows = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.doc_id for r in rows if r.piece == 0) == sorted(encoded)
    for r in rows:
        part = encoded[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    assert sum(r.length for r in rows) == sum(map(len, encoded.values()))
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and len(ends) <= -(-sum(map(len, encoded.values())) // 4096) + 1


def test_contradictory_labels_and_long_texts(spark):
    rng = random.Random(3)
    word = lambda k: "".join(rng.choice("abcdefghijklmnop") for _ in range(k))
    usual = [word(5) for _ in range(300)]
    rows, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        rows.append((k, " ".join([*rng.choices(usual, k=60), *(["vilebad", "awfulbad"] * 3 if toxic else [])])))
        labels.append((k, int(toxic)))
    long = " ".join(rng.choices(usual, k=200_000))
    rows += [(1000, long), (1001, f"{long} vilebad awfulbad vilebad awfulbad vilebad awfulbad vilebad awfulbad"), (None, None), (1002, "")]
    labels += [(k, 1) for k in range(4, 12)] + [(None, 1), (3, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("toxic", F.lit(0)).withColumn("evidence", F.lit("x"))
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    use = {r.doc_id: r.toxic for r in toxicity._usable(table).collect()}
    assert None not in use and all(use.get(k, 1) == 1 for k in range(4, 12))
    found = {r.doc_id: r for r in toxicity.score(docs, table).collect()}
    assert found[1001].predicted == 1 and found[1000].predicted == 0 and found[1002].score == found[None].score
    assert all(found[k].predicted == 1 for k in range(0, 400, 4))
    assert not any(found[k].predicted for k in range(101, 400, 4))
    assert toxicity.score(docs.limit(0), table).count() == 0 and toxicity.score(docs, table.limit(0)).where("score > 0").count() == 0


def test_digests_of_code_points(spark):
    text = "\U0001f600é" * 3 + "x"
    (row,) = fingerprints.compare(spark.createDataFrame([(1, text)], SCHEMA)).collect()
    assert row.n_chars == 7 and row.edited_sha256 == hashlib.sha256((text[:4] + text[:3]).encode()).hexdigest()
