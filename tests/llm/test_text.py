"""Words, tokenization, packing and pass-through rules of text operators."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pangraph_spark.llm import bpe, bpe_codec, common, packing, token_counts
from pangraph_spark.llm.words import split_words, text_bytes, windows

PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    alphabet = "abcdéßΣİ '\x1cćdst19  .,#<|>\U0001f600中文  \n"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]
    made += ["".join(rng.choice("abethinos") for _ in range(rng.randrange(1, 30))) for _ in range(n)]
    return [*made, "", " ", "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>", "Σ<|endoftext|>Σ", "don't we'll", "a" * 3000, "é é"]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA)


def test_words_match_the_pattern(monkeypatch):
    monkeypatch.setattr("pangraph_spark.llm.words.SLICE", 64)
    texts = [*odd_texts(200), None, "x" * 500 + " y"]
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    w = split_words(data, offsets)
    found = [data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends, strict=True)]
    assert found == [x for t in texts for x in WORD.findall(t or "")]
    assert np.diff(w.first).tolist() == [len(WORD.findall(t or "")) for t in texts]
    by_hash = {}
    for h, x in zip(w.hashes.tolist(), found, strict=True):
        assert by_hash.setdefault(h, x) == x
    assert len(set(found)) == len(by_hash)


def test_windows_stay_inside_documents():
    data, offsets = text_bytes(pa.array(["a b c", "a b", "a b c"]))
    h, whole = windows(split_words(data, offsets), 3)
    assert whole.tolist() == [True, False, False, False, False, True, False, False]
    assert h[0] == h[5]


def test_automaton_equals_library(library):
    enc = bpe.Encoder(bpe.automaton(PATH), limit=2000)
    texts = odd_texts(400)
    ids, at = bpe_codec.token_ids(enc, *text_bytes(pa.array(texts)))
    for k, x in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        mine = ids[at[k] : at[k + 1]].tolist()
        assert mine == x.ids, texts[k]
        assert enc.automaton.decode(mine) == library.decode(x.ids, skip_special_tokens=False)


def test_gadgets_on_a_tiny_merge_list():
    # a a -> aa; aa a -> aaa: runs merge from the left
    names = ["a", "b", "aa", "aab"]
    state, arc, table = bpe.compile_table(np.array([0, 2]), np.array([0, 1]), np.array([2, 3]), 4, np.zeros(4, bool))
    blocked = lambda s, x: bool(table[state[names.index(s)], arc[names.index(x)] >> 3] >> (arc[names.index(x)] & 7) & 1)
    assert blocked("a", "a") and blocked("a", "aa") and blocked("aa", "b") and blocked("a", "aab")
    assert not blocked("aa", "a") and not blocked("aa", "aa") and not blocked("a", "b")


def test_counts_and_splices(spark, library):
    texts = [None, *odd_texts(60), "wort " * 400, "w" * 900 + " x", ("é" * 7 + " ") * 300]
    df = rows(spark, texts).selectExpr("*", "'x' AS n_tokens")
    whole = {r.doc_id: r for r in token_counts.count_tokens(df, PATH, limit=100).collect()}
    cut = {r.doc_id: r for r in token_counts.count_tokens(df, PATH, limit=100, chunk=64, overlap=4).collect()}
    assert whole == cut and len(whole) == len(texts)
    for k, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert tuple(whole[k])[1:] == (len((t or "").encode()), n, n > 100)


def test_round_trip_digests(spark, library):
    texts = [None, *odd_texts(40)]
    for r in bpe_codec.round_trip(rows(spark, texts), PATH).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe_codec.encode(rows(spark, texts), PATH)
    assert {r.doc_id: r.text for r in bpe_codec.decode(encoded, PATH).collect()}[3] == library.decode(library.encode(texts[3], add_special_tokens=False).ids, skip_special_tokens=False)


def check_packing(found, ids, length):
    sequences = {}
    for r in found:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == length * r.piece and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in sequences.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= length
    assert sum(r.length for r in found) == sum(map(len, ids.values()))
    return len(sequences)


def test_packing(spark, library):
    rng = random.Random(5)
    texts = [None, "", *[" ".join(["the"] * rng.randrange(150)) for _ in range(200)], *["same text"] * 30]
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}
    used = check_packing(packing.pack(rows(spark, texts), PATH, length=64).collect(), ids, 64)
    assert used <= 1.02 * sum(map(len, ids.values())) / 64 + 2


def test_packing_plan_against_plain_best_fit():
    rng = random.Random(2)
    for _ in range(30):
        sizes = sorted((rng.randrange(1, 50) for _ in range(rng.randrange(300))), reverse=True)
        gaps = []
        for n in sizes:
            fits = [g for g in gaps if g >= n]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - n)
            else:
                gaps.append(50 - n)
        plan = packing.plan({n: sizes.count(n) for n in set(sizes)}, 50)
        ends = {}
        for size, rank, first, each, _ in plan.tolist():
            later = [r[1] for r in plan.tolist() if r[0] == size and r[1] > rank]
            count = (min(later) if later else sizes.count(size)) - rank
            for k in range(count):
                ends[first + k // each] = ends.get(first + k // each, 0) + size
        assert max(ends.values(), default=0) <= 50 and len(ends) == len(gaps)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert token_counts.count_tokens(none, PATH).count() == 0
    assert bpe_codec.round_trip(none, PATH).count() == 0
    assert packing.pack(none, PATH).count() == 0


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], SCHEMA)
    assert sorted(str(r.doc_id) for r in token_counts.count_tokens(df, PATH).collect()) == ["1", "1", "None"]
    assert packing.pack(df, PATH).count() == 3
    assert common.texts(df.selectExpr("*", "1 AS data")).columns == ["doc_id", "text"]


def test_packing_encodes_small_slices(spark, monkeypatch):
    """What a worker holds is bounded by slices of 2 MB, whatever a batch holds; a longer text is one slice."""
    rows = [(k, f"word{k} other words, " * 30_000) for k in range(6)] + [(6, "one " * 600_000), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, packing.pieces(df, common.tokenizer_path(), 4096, 1).collect()))
    held, encode = [], packing.token_ids
    monkeypatch.setattr(common, "map_arrow", lambda docs, step, schema: step)
    monkeypatch.setattr(packing, "token_ids", lambda enc, data, offsets: held.append((len(data), len(offsets) - 1)) or encode(enc, data, offsets))
    step = packing.pieces(df, common.tokenizer_path(), 4096, 1)
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in rows])
    found = [tuple(x.values()) for b in step(batch) for x in b.to_pylist()]
    assert all(size <= 2 << 20 or n == 1 for size, n in held) and sum(n for _, n in held) == len(rows)
    assert sorted(found) == plain
