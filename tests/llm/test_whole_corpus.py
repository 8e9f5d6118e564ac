"""Corpus operators do the whole job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pangraph_spark.llm import licenses, secret_model, secrets, toxicity

SCHEMA = "doc_id long, text string"


def test_toxicity_model_keeps_all_significant_words(spark):
    """Words beyond those broadcast are joined, and all results stay the same."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    texts = toxicity.common.texts(docs)
    labelled = toxicity._labelled(texts, toxicity._usable(labels))
    whole, few = toxicity.fit(labelled), toxicity.fit(labelled, max_words=4)
    assert whole.rest is None and len(whole.words) > 10 and len(few.words) == 4
    assert len(few.words) + few.rest.count() == len(whole.words)
    assert few.drift == pytest.approx(whole.drift) and few.rate == pytest.approx(whole.rate) and few.k == pytest.approx(whole.k)
    twice = texts.unionByName(texts.limit(20)).unionByName(spark.createDataFrame([(None, None), (None, "")], SCHEMA))
    rows = lambda model: sorted((str(r.doc_id), round(r.evidence, 6), r.n_passages) for r in toxicity.evidence(twice, model).collect())
    assert rows(few) == rows(whole) and any(n for *_, n in rows(whole))
    places = lambda model: sorted((r.doc_id, r.start, r.end, round(r.score, 6)) for r in toxicity.passages(texts, model).collect())
    assert places(few) == places(whole)


def test_toxicity_rejects_alike_with_joined_words(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    left = lambda: sorted(r.doc_id for r in toxicity.reject(docs.withColumn("extra", F.lit(1)), labels).collect())
    whole, fit = left(), toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda labelled: fit(labelled, max_words=4))
    assert left() == whole and len(whole) < docs.count()


def test_only_copies_share_their_weight(spark):
    """A passage in common is no copy, wherever its least window hash lies."""
    passage = " ".join(f"shared{k}" for k in range(60))
    texts = [f"{passage} own{k} tail{k}" for k in range(24)] + [f"Lone text {passage}"] * 4 + ["two words", "two words", "two", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    use = docs.select("doc_id", F.lit(1).alias("toxic"))
    got = {r.doc_id: r.weight for r in toxicity.copy_weights(docs, use).collect()}
    assert [got[k] for k in range(len(texts))] == [1.0] * 24 + [0.25] * 4 + [0.5, 0.5, 1.0, 0.5, 0.5]


@pytest.fixture(scope="module")
def network():
    return secret_model.trained()


def added(network, text):
    return [text[a:b] for _, _, spans, _ in secrets.scan_texts([(0, text, True)], network) for a, b in spans]


def test_secret_far_inside_a_candidate_is_seen(network):
    """A candidate is judged by all of its characters, and a harmless one of that length stays."""
    secret = "ghp_q8Zk2mNv7Xw4Lr9Ty3Bc6Hd1Jf5Ps0Ga2Ue"
    path = "//hooks.example.com/services/T00000000/B00000000/"
    for filler in (path, path * 3):
        found = added(network, f'const webhook = "https:{filler}{secret}"\n')
        assert len(found) == 1 and found[0].endswith(secret)
    assert added(network, 'see https://docs.example.com/services/area1/page20/documents/of_the_other_season\n') == []
    text = path * 200 + secret
    every = np.array([secret_model.window("", text[k : k + 40], "") for k in range(len(text) - 39)])
    assert network.largest([("short", 0, 5), (text, 0, len(text))])[1] == pytest.approx(network.probability(every).max())


def test_short_values_behind_credential_names_are_candidates(network):
    for name in ("auth", "BEARER", "private_key", "credential", "access_key"):
        text = f'the one {name} = "q8Zk2mNv7Xw4"\n'
        assert added(network, text) == ["q8Zk2mNv7Xw4"]
    assert added(network, 'see credential: changeme and auth: none') == []
    values = secrets.named_values('password=hunter22 bearer: Zq81kd', secrets.base_spans('password=hunter22 bearer: Zq81kd'))
    assert values == [(26, 32)]


def test_notices_of_any_length_are_found(spark):
    full = next(t for n, t in licenses.KNOWN if n == "MIT" and len(t) > 500).replace("\n", " ")
    padded = "Licensed under the" + " " * 1500 + "MIT License" + "." * 5000
    texts = [f"first line\n{full}\nlast line", f"first line\n{padded}", "no license " * 300]
    assert len(full) > 1000
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert [(rows[k].n_notices, rows[k].notice_licenses) for k in range(3)] == [(1, "MIT"), (1, "MIT"), (0, "")]
