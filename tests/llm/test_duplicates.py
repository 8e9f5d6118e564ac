"""Similarity join, passages, components and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pangraph_spark.llm import components, grouped, prefix_tree, similarity, substrings

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mutated(rng, words, rate):
    return [rng.choice("pqrs") * 3 if rng.random() < rate else w for w in words]


def corpus(seed=3, groups=12, lone=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    common = [word() for _ in range(30)]
    texts = [None, "", " \n", "One two", "one  TWO", "a b c d", "a b c d e"]
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(20, 200))]
        texts += [" ".join(mutated(rng, base, rng.choice([0, 0.005, 0.01, 0.03, 0.1]))) for _ in range(rng.randrange(2, 9))]
    texts += [" ".join([word() for _ in range(rng.randrange(60))] + common * rng.randrange(2)) for _ in range(lone)]
    return texts


def plain_groups(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("chunk", [1024, 2])
def test_groups_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(similarity, "CHUNK", chunk)
    monkeypatch.setattr(similarity, "LEADERS", 1)
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumn("part", F.lit("x"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity.groups(df).collect()}
    assert got == plain_groups(texts)


def test_groups_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SEMI_ROWS", 0)
    texts = corpus(seed=9, groups=4, lone=5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity.groups(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert got == plain_groups(texts)


def test_groups_of_edge_rows(spark):
    words = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(None, words), (4, words), (4, words), (2, words), (7, "other words"), (4, "other words")], SCHEMA)
    rows = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in similarity.groups(df).collect())
    assert rows == [("2", 26, "2"), ("4", 1, "2"), ("4", 26, "2"), ("4", 26, "2"), ("7", 1, "2"), ("None", 26, "None")]
    kept = similarity.keep_one(df.withColumn("n", F.lit(1)))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None"]
    assert similarity.groups(df.limit(0)).count() == 0 and similarity.keep_one(df.limit(0)).count() == 0


def test_prefix_tree_finds_all_links():
    rng = np.random.default_rng(4)
    for _ in range(30):
        base = [rng.choice(2**40, size=int(rng.integers(1, 40)), replace=False) for _ in range(4)]
        sets = []
        for _ in range(25):
            b = base[int(rng.integers(4))]
            extra = rng.choice(2**40, size=int(rng.integers(0, 3)))
            sets.append(np.unique(np.concatenate((b[rng.random(len(b)) > 0.06], extra))).astype(np.uint64))
        sets = [s for s in sets if len(s)]
        plain = [(a, b) for a in range(len(sets)) for b in range(a) if 180 * len(np.intersect1d(sets[a], sets[b])) >= 80 * (len(sets[a]) + len(sets[b]))]
        roots = lambda edges: components_of(len(sets), edges)
        found = prefix_tree.link(sets, np.arange(len(sets)))
        assert roots(found) == roots(plain) and {(max(e), min(e)) for e in found} <= set(plain)
        probes = rng.random(len(sets)) < 0.5
        found = prefix_tree.link(sets, np.arange(len(sets)), probes)
        assert roots(found) == roots([e for e in plain if probes[e[0]] or probes[e[1]]])


def test_probes_walk_a_tree_together(monkeypatch):
    rng = np.random.default_rng(8)
    base = np.arange(100, dtype=np.uint64)
    sets = []
    for k in range(300):
        own = base.copy()
        at = rng.permutation(100)[: int(rng.integers(0, 20))]
        own[at] = 1000 * (k + 1) + np.arange(len(at))
        sets.append(np.unique(own))
    plain = [(a, b) for a in range(300) for b in range(a) if 180 * len(np.intersect1d(sets[a], sets[b])) >= 80 * (len(sets[a]) + len(sets[b]))]
    calls, walk = [], prefix_tree.Tree.walk
    monkeypatch.setattr(prefix_tree.Tree, "walk", lambda self, probes, *rest: calls.append(len(probes)) or walk(self, probes, *rest))
    for cells, most in ((1 << 22, 2), (50_000, 30), (1, 300)):
        monkeypatch.setattr(prefix_tree, "CELLS", cells)
        calls.clear()
        found = prefix_tree.link(sets, np.arange(300))
        assert len(calls) <= most and sum(calls) == 300
        assert components_of(300, found) == components_of(300, plain) and {(max(e), min(e)) for e in found} <= set(plain)


def test_texts_with_ids_are_split_with_their_prefixes(spark, monkeypatch):
    plain, asked = similarity.set_table, []
    monkeypatch.setattr(similarity, "set_table", lambda docs: asked.append(docs) or plain(docs))
    texts = corpus(seed=2, groups=3, lone=6)
    df = spark.createDataFrame([*enumerate(texts), (None, "a b c")], SCHEMA)
    rows = [(r.doc_id, r.n_shingles, r.component_id) for r in similarity.groups(df).collect()]
    assert sorted(r for r in rows if r[0] is not None) == sorted((i, *x) for i, x in plain_groups(texts).items())
    assert [r for r in rows if r[0] is None] == [(None, 1, None)] and [d.count() for d in asked] == [1]


def components_of(n, edges):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + k) for k in range(1, 60)] + [(2000 + k, 2001 + k) for k in range(40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components_of(2100, edges)
    touched = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {k: want[k] for k in touched}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_removal(texts, n):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if key in seen:
                gone[k : k + n] = [True] * n
            seen.add(key)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("window", [20, 3])
def test_passages_match_brute_force(spark, window):
    rng = random.Random(7)
    texts = [*corpus(seed=11), "a " * 90, " ".join(str(k % 25) for k in range(200))]
    passage = " ".join(f"p{k}" for k in range(35))
    texts += [" ".join([*(str(rng.random()) for _ in range(rng.randrange(40))), passage, "end"]) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    want = plain_removal(texts, window)
    for r in substrings.digest(df, window).collect():
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
    for r in substrings.dedup(df.withColumn("range_no", F.lit("x")).withColumnRenamed("range_no", "data"), window).collect():
        n, gone, kept = want[r.doc_id]
        assert r.text == (kept if gone else texts[r.doc_id]) and r.data == "x"


def test_passages_of_edge_rows(spark):
    words = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(2, words), (2, words), (None, words), (1, None), (3, "few")], SCHEMA)
    rows = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substrings.digest(df).collect())
    assert rows == [("1", 0, 0), ("2", 30, 30), ("2", 30, 30), ("3", 1, 0), ("None", 30, 0)]
    assert substrings.digest(df.limit(0)).count() == 0 and substrings.dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("v", [3, 7, 13, 21, 31])
def test_covers(v):
    cover = substrings.COVERS[v]
    assert all(any((i + s) % v in cover and (j + s) % v in cover for s in range(v)) for i in range(v) for j in range(v))


def test_packed_arrays_come_back():
    arrays = [np.array([5, 1, 2**63], np.uint64), np.array([-3, 7, 7], np.int64), np.array([1, 2, 3], np.uint8), np.array([1, -2, 3], np.int32)]
    back = grouped.unpack(grouped.pack(*arrays))
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, back, strict=True))
    assert [len(x) for x in grouped.unpack(grouped.pack(*[a[:0] for a in arrays]))] == [0] * 4


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from pangraph_spark.llm.common import cut

        after = cut(stage(spark, before, folder))
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        kept, given = after.toPandas().set_index("doc_id"), before.toPandas().set_index("doc_id")
        assert set(kept.index) <= set(given.index)
        if name == "ngram_jaccard_join":
            texts = given.text.sort_index()
            groups = plain_groups(list(texts))
            assert {texts.index[r] for _, r in groups.values()} == set(kept.index)
        elif name == "substring_dedup":
            texts = given.text.sort_index()
            for k, (_, gone, text) in plain_removal(list(texts), 20).items():
                assert kept.text[texts.index[k]] == (text if gone else texts.iloc[k])
        elif name == "secret_scan":
            assert set(kept.index) == set(given.index) and not kept.text.str.contains(r"token = \"[0-9a-f]{40}").any()
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, folder)
    assert packed.select("doc_id").distinct().count() == before.count()
