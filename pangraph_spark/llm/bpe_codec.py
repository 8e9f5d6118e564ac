"""Encoding and decoding with the tokenization automaton of :mod:`.bpe`.

``encode`` gives each document's ids, ``round_trip`` also what they decode to.  Null and empty texts have
no ids and decode to the empty text.  Rows are independent of each other, so repeated rows, null ids and
very long texts need no special case; an empty table gives an empty table.  Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe, common
from .token_counts import encoder
from .words import per_document, split_words, text_slices

DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def token_ids(enc: bpe.Encoder, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of some documents, and where each document's begin."""
    words = split_words(data, offsets)
    inverse, ids, starts, counts = enc.batch(words)
    found, n = bpe.take(ids, starts[inverse], counts[inverse])
    return found, np.concatenate(([0], np.cumsum(per_document(words, n))))


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, ids array<int>`` for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe.automaton(tokenizer))

    def step(batch):
        enc = encoder(shared.value)
        for rows, data, offsets in text_slices(batch):
            ids, at = token_ids(enc, data, offsets)
            yield common.arrow(doc_id=common.rows_of(batch, "doc_id", rows), ids=pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))

    return common.map_arrow(common.texts(docs), step, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, text``: the arc labels of ``ids`` joined by spaces."""
    shared = docs_broadcast(encoded, tokenizer)

    def step(batch):
        names = shared.value.names
        found = [None if x is None else " ".join([names[i] for i in x]) for x in batch.column(1).to_pylist()]
        yield common.arrow(doc_id=batch.column(0), text=pa.array(found, pa.string()))

    return common.map_arrow(encoded.select("doc_id", "ids"), step, "doc_id long, text string")


def docs_broadcast(df: DataFrame, tokenizer: str):
    return df.sparkSession.sparkContext.broadcast(bpe.automaton(tokenizer))


def _digests(ids: np.ndarray, at: np.ndarray, labels: list[bytes]) -> list[str]:
    """Digest of each document's labels joined by spaces; about a million labels are laid out at a time."""
    out: list[str] = []
    d, n = 0, len(at) - 1
    while d < n:
        upto = max(d + 1, int(np.searchsorted(at, at[d] + (1 << 20), "right")) - 1)
        text, sizes = bpe.spread(ids[at[d] : at[upto]], labels)
        ends = np.concatenate(([0], np.cumsum(sizes)))[at[d : upto + 1] - at[d]]
        view = memoryview(text)
        out += [hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        d = upto
    return out


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of each row's ids and of the text they decode to."""
    shared = docs_broadcast(docs, tokenizer)

    def step(batch):
        automaton = shared.value
        enc = encoder(automaton)
        numbers, names = automaton.labels()
        for rows, data, offsets in text_slices(batch):
            ids, at = token_ids(enc, data, offsets)
            yield common.arrow(doc_id=common.rows_of(batch, "doc_id", rows), n_tokens=np.diff(at), ids_sha256=_digests(ids, at, numbers), decoded_sha256=_digests(ids, at, names))

    return common.map_arrow(common.texts(docs), step, DIGEST)


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"), common.tokenizer_path())
