"""Token counts by overlap resynchronisation.

A text of more than ``chunk`` bytes is encoded in chunks, each of which runs on into the next one by
``overlap`` bytes.  Two neighbours are spliced at the first place in their overlap where both see a word
begin behind white space.  Such a boundary is proven stable: no token holds white space, and what precedes
it does not change how the rest is split.  Left of it the left chunk's tokens count, from it on the right
chunk's.  Where an overlap holds no such place (a word longer than the overlap), it is widened until it
does, up to the whole chunk.  All chunks of a batch are encoded together.

Null and empty texts have no tokens.  Texts of any length are counted whole.  Repeated rows and null ids
are counted row by row; an empty table gives an empty table; other columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import bpe, common
from .words import Words, split_words, text_slices

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
REPORT = ", n_chunks long, n_widened long"


def encoder(automaton: bpe.Automaton) -> bpe.Encoder:
    """The encoder of this worker process; its memo outlives tasks, but not the operator."""
    key = ("encoder", automaton.key)
    if key not in common.KEPT:
        common.KEPT[key] = bpe.Encoder(automaton)
    return common.KEPT[key]


def _whole_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places, moved back so that none splits a code point."""
    at = at.copy()
    for _ in range(3):
        at -= (at > 0) & (at < len(data)) & (data[np.minimum(at, len(data) - 1)] & 0xC0 == 0x80)
    return at


def chunk_bounds(data: np.ndarray, offsets: np.ndarray, chunk: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, begin, end)`` of each chunk; all but a document's last run on by the overlap."""
    sizes = np.diff(offsets)
    count = np.where(sizes > chunk + overlap, -(-(sizes - overlap) // chunk), 1)
    doc = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[doc] + k * chunk
    end = np.minimum(begin + chunk + overlap, offsets[doc + 1])
    if len(data):
        begin, end = _whole_points(data, begin), _whole_points(data, end)
    return doc, begin, end


def seams(words: Words, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts in the documents, and where each chunk hands over to the next.

    ``hand[c]`` is the first place where chunks c and c + 1 both see a word begin behind white space; -1
    where there is none, and beyond all places for a document's last chunk.
    """
    mine = words.owner()
    at = words.starts - words.offsets[mine] + begin[mine]
    last = np.append(doc[1:] != doc[:-1], True)
    # a word at a chunk's very beginning may have begun before it
    after = np.append(begin[1:], 0)
    left = np.flatnonzero(~last[mine] & (at > after[mine]))
    right = np.flatnonzero((mine > 0) & ~last[mine - 1] & (at > begin[mine]) & (at < end[mine - 1]))
    wide = int(end.max(initial=0)) + 1
    shared = np.intersect1d(mine[left] * wide + at[left], (mine[right] - 1) * wide + at[right])
    hand = np.where(last, wide, -1)
    seam, first = np.unique(shared // wide, return_index=True)
    hand[seam] = shared[first] % wide
    return at, hand


def spliced_counts(data: np.ndarray, offsets: np.ndarray, encode, chunk: int, overlap: int):
    """Tokens, chunks and widenings of each document; ``encode(words)`` gives the tokens of each word."""
    doc, begin, end = chunk_bounds(data, offsets, chunk, overlap)
    parts = data if len(doc) == len(offsets) - 1 else np.concatenate([data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
    words = split_words(parts, np.concatenate(([0], np.cumsum(end - begin))))
    at, hand = seams(words, doc, begin, end)
    mine = words.owner()
    first = np.append(True, doc[1:] != doc[:-1])[: len(doc)]
    low = np.where(first, -1, np.append(-1, hand[:-1])[: len(doc)])
    kept = (at >= low[mine]) & (at < hand[mine])
    tokens = np.bincount(doc[mine[kept]], weights=encode(words)[kept], minlength=len(offsets) - 1).astype(np.int64)
    chunks, widened = np.bincount(doc, minlength=len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
    for d in np.unique(doc[hand < 0]).tolist():
        text = data[offsets[d] : offsets[d + 1]]
        # an overlap as wide as the text leaves one chunk, so this ends
        tokens[d], chunks[d], widened[d] = (int(x[0]) for x in spliced_counts(text, np.array([0, len(text)]), encode, max(chunk, overlap), 2 * overlap))
        widened[d] += 1
    return tokens, chunks, widened


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, chunk: int = 1 << 13, overlap: int = 1 << 8, report: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``report`` adds ``n_chunks`` and ``n_widened``, how often a document's overlaps were widened.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bpe.automaton(tokenizer))

    def step(batch):
        enc = encoder(shared.value)

        def encode(words):
            inverse, _, _, counts = enc.batch(words)
            return counts[inverse]

        for rows, data, offsets in text_slices(batch, limit=4 << 20):
            tokens, chunks, widened = spliced_counts(data, offsets, encode, chunk, overlap)
            more = {"n_chunks": chunks.astype(np.int64), "n_widened": widened} if report else {}
            yield common.arrow(doc_id=common.rows_of(batch, "doc_id", rows), n_bytes=np.diff(offsets).astype(np.int64), n_tokens=tokens, over_limit=tokens > limit, **more)

    return common.map_arrow(common.texts(docs), step, SCHEMA + (REPORT if report else ""))


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"), common.tokenizer_path(), report=True)
