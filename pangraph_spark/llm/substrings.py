"""Removal of repeated passages, found by difference-cover anchors.

Words are white-space delimited and compared as they are.  A window of ``n`` words is repeated if its word
sequence also starts earlier, in a smaller ``doc_id`` or before it in the same document; every word that a
repeated window covers goes.

1. Anchors.  D is a difference cover modulo v: for any two positions some shift below v brings both to
   positions that D holds.  Windows of n - v + 1 words are hashed only at such positions, so two equal
   windows of n words share an aligned anchor.  Anchors that occur once in all of the corpus go.
2. Extension.  Windows of n words that hold a shared anchor are hashed whole, to 128 bits, so that at no
   size of corpus unequal windows are likely to be taken for equal.  Each range of documents
   sends the first place of every such hash; the least place over all ranges is where it starts earliest.
3. Removal.  Places that are not the earliest go back to their range, and covered words are dropped.

What travels are packed arrays with one entry for each hash and range, so a passage that many documents
hold is sent once a range, and no receiver gets more entries of one hash than there are ranges.

Null and empty texts have no words.  Rows that share a ``doc_id`` count as documents one after another,
ordered by text; rows without id come before all others.  A document shorter than a window loses nothing,
an empty table gives an empty table.  A text is read whole however long it is, by one task.  Other columns,
whatever their names, are kept by :func:`dedup` and ignored by :func:`digest`; ``doc_id`` may be any integer.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .grouped import by_bucket, pack, unpack
from .ranges import Ranges
from .words import Words, U, mix, split_words, text_bytes, text_slices, windows

# Perfect difference covers, by modulus.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
ENTRY = "bucket int, part int, data binary"
DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def modulus(window: int) -> int:
    """The largest cover that leaves anchors of at least 8 words, or the smallest one."""
    fits = [v for v in COVERS if window - v + 1 >= min(8, window)]
    return max(fits) if fits else 1


def anchor_places(words: Words, window: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """Word places of anchors and their hashes, in documents that have a window."""
    size = window - v + 1
    h, whole = windows(words, size)
    n = np.diff(words.first)
    inside = np.arange(len(words)) - np.repeat(words.first[:-1], n)
    cover = np.zeros(v, bool)
    cover[list(COVERS.get(v, (0,)))] = True
    at = np.flatnonzero(whole & cover[inside % v] & np.repeat(n >= window, n))
    return at, h[at]


def window_hashes(words: Words, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits, in two arrays, of the n-word windows that start at some places."""
    out = []
    for odd in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95):
        h = np.zeros(len(places), np.uint64)
        for k in range(n):
            h += words.hashes[places + k] * U(pow(odd, 3 * k + 1, 1 << 64))
        out.append(mix(h))
    return out[0], out[1]


def _send(hashes: np.ndarray, buckets: int, columns, part: int = 0):
    """One packed row for each receiver; ``columns(rows)`` gives what travels with the hashes."""
    found = [(b, pack(hashes[rows], *columns(rows))) for b, rows in by_bucket(hashes, buckets)]
    return common.arrow(bucket=pa.array([b for b, _ in found], pa.int32()), part=pa.array([part] * len(found), pa.int32()), data=pa.array([d for _, d in found], pa.binary()))


def shared_anchors(docs: DataFrame, ranges: Ranges, window: int) -> DataFrame:
    """``part, data``: for each range the hashes of its anchors that occur more than once."""
    v, buckets = modulus(window), ranges.buckets

    def emit(batch):
        part_of = batch.column(0).to_numpy()
        for rows, data, offsets in text_slices(batch):
            w = split_words(data, offsets)
            at, h = anchor_places(w, window, v)
            part = part_of[rows][np.searchsorted(w.first, at, "right") - 1].astype(np.int64)
            # one entry for each range and hash, marked if the hash came twice; sorted by range
            order = np.lexsort((h, part))
            h, part = h[order], part[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (part[1:] != part[:-1])
            entry = np.flatnonzero(new)
            twice = (np.diff(entry, append=len(h)) > 1).astype(np.uint8)
            h, part = h[entry], part[entry]
            yield _send(h, buckets, lambda r, part=part, twice=twice: (part[r], twice[r]))

    @common.grouped
    def meet(table: pa.Table) -> pa.Table:
        found = [unpack(x) for x in table["data"].to_pylist()]
        h, part, twice = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(h, kind="stable")
        h, part, twice = h[order], part[order], twice[order]
        edge = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0)
        n = np.diff(edge, append=len(h))
        often = (n > 1) | (np.maximum.reduceat(twice, edge) > 0)
        keep = np.repeat(often, n)
        h, part = h[keep], part[keep]
        order = np.lexsort((h, part))
        h, part = h[order], part[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (part[1:] != part[:-1])
        return _by_part(part[new], h[new])

    sent = common.map_arrow(docs.select(ranges.column().alias("part"), "text"), emit, ENTRY)
    return sent.select("bucket", "data").groupBy("bucket").applyInArrow(meet, "part int, kind int, data binary")


def _by_part(part: np.ndarray, *columns: np.ndarray, kind: int = 0) -> pa.Table:
    """A packed row for each range; ``part`` is sorted."""
    cuts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else np.zeros(0, np.int64)
    ends = [*cuts[1:].tolist(), len(part)]
    data = [pack(*[c[a:b] for c in columns]) for a, b in zip(cuts.tolist(), ends, strict=False)]
    return pa.table({"part": pa.array(part[cuts].astype(np.int32)), "kind": pa.array([kind] * len(cuts), pa.int32()), "data": pa.array(data, pa.binary())})


def ordered(table: pa.Table) -> pa.Table:
    """A range's rows in document order."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if table.num_rows else table


def _ordered_words(table: pa.Table) -> Words:
    # ids sort with nulls last in Arrow, but they come first here
    data, offsets = text_bytes(table["text"])
    return split_words(data, offsets)


def _sorted_docs(table: pa.Table) -> pa.Table:
    ids = table["doc_id"].combine_chunks()
    if not ids.null_count:
        return ordered(table)
    none = ids.is_null()
    return pa.concat_tables([ordered(table.filter(none)), ordered(table.filter(pa.compute.invert(none)))])


def repeated_windows(docs: DataFrame, ranges: Ranges, window: int) -> DataFrame:
    """``part, kind, data``: for each range the word places where a repeated window starts."""
    v, buckets = modulus(window), ranges.buckets
    anchors = shared_anchors(docs, ranges, window)
    placed = docs.select(ranges.column().alias("part"), "doc_id", "text")

    @common.grouped
    def extend(table: pa.Table, marks: pa.Table) -> pa.Table:
        empty = pa.table({"bucket": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
        if not table.num_rows or not marks.num_rows:
            return empty
        part = table["part"][0].as_py()
        w = _ordered_words(_sorted_docs(table))
        shared = np.unique(np.concatenate([unpack(x)[0] for x in marks["data"].to_pylist()]))
        at, h = anchor_places(w, window, v)
        hit = at[np.isin(h, shared, kind="sort")]
        # windows that hold a shared anchor start up to v - 1 words before it
        near = np.zeros(len(w) + 1, np.int64)
        np.add.at(near, np.maximum(hit - v + 1, 0), 1)
        np.add.at(near, hit + 1, -1)
        whole = np.repeat(w.first[1:], np.diff(w.first)) - np.arange(len(w)) >= window
        places = np.flatnonzero((np.cumsum(near[:-1]) > 0) & whole)
        h, g = window_hashes(w, places, window)
        order = np.lexsort((g, h))
        lead = np.ones(len(places), bool)
        lead[order[1:]] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
        again, lead = ~lead, np.flatnonzero(lead)
        out = [_send(h[lead], buckets, lambda r: (g[lead][r], places[lead][r].astype(np.int64)), part)]
        if again.any():
            # repeats inside the range are settled; they pass through, spread over the receivers
            out.append(common.arrow(bucket=pa.array([-1 - part % buckets], pa.int32()), part=pa.array([part], pa.int32()), data=pa.array([pack(places[again].astype(np.int64))], pa.binary())))
        return pa.Table.from_batches(out)

    @common.grouped
    def meet(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            return pa.table({"part": table["part"], "kind": pa.array([1] * table.num_rows, pa.int32()), "data": table["data"]})
        found = [(p, *unpack(x)) for p, x in zip(table["part"].to_pylist(), table["data"].to_pylist(), strict=True)]
        h, g, place = (np.concatenate([x[k] for x in found]) for k in (1, 2, 3))
        part = np.repeat(np.array([x[0] for x in found], np.int64), [len(x[1]) for x in found])
        order = np.lexsort((place, part, g, h))
        later = np.zeros(len(h), bool)
        later[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (g[order[1:]] == g[order[:-1]])
        place, part = place[later], part[later]
        order = np.lexsort((place, part))
        return _by_part(part[order], place[order].astype(np.int64), kind=1)

    common.ship(docs.sparkSession)
    sent = placed.groupBy("part").cogroup(anchors.groupBy("part")).applyInArrow(extend, ENTRY)
    return sent.groupBy("bucket").applyInArrow(meet, "part int, kind int, data binary")


def _kept(w: Words, starts: np.ndarray, window: int) -> np.ndarray:
    """Which words no repeated window covers."""
    near = np.zeros(len(w) + 1, np.int64)
    np.add.at(near, starts, 1)
    np.add.at(near, starts + window, -1)
    return np.cumsum(near[:-1]) == 0


def _joined(w: Words, keep: np.ndarray, docs: slice) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words of some documents, a space behind each, and these documents' bounds."""
    words = slice(w.first[docs.start], w.first[docs.stop])
    kept = keep[words]
    s, n = w.starts[words][kept], (w.ends[words] - w.starts[words])[kept] + 1
    ends = np.cumsum(n)
    at = np.repeat(s - (ends - n), n)
    at += np.arange(len(at))
    np.minimum(at, max(0, len(w.data) - 1), out=at)
    out = w.data[at] if len(at) else np.zeros(0, np.uint8)
    out[ends - 1] = 0x20
    count = np.concatenate(([0], np.cumsum(kept)))[w.first[docs.start : docs.stop + 1] - words.start]
    return out, np.concatenate(([0], ends))[count]


def _kept_texts(w: Words, keep: np.ndarray, limit: int = 1 << 20):
    """The kept text of each document as bytes; about ``limit`` bytes are laid out at a time."""
    d, n = 0, len(w.first) - 1
    while d < n:
        upto = max(d + 1, int(np.searchsorted(w.offsets, w.offsets[d] + limit, "right")) - 1)
        text, at = _joined(w, keep, slice(d, upto))
        view = memoryview(text)
        yield from (view[a : max(a, b - 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
        d = upto


def _apply(docs: DataFrame, window: int, finish, schema: str) -> DataFrame:
    """``finish(table, words, keep)`` over each range with its marks."""
    ranges = Ranges(docs)
    marks = repeated_windows(docs.select("doc_id", "text"), ranges, window)
    key = "range_no"
    while key in {c.lower() for c in docs.columns}:
        key += "_"
    placed = docs.select(ranges.column().alias(key), *[F.col(f"`{c}`") for c in docs.columns])

    @common.grouped
    def run(table: pa.Table, marks: pa.Table) -> pa.Table:
        if not table.num_rows:
            return finish(table.drop_columns([key]), None, None)
        table = _sorted_docs(table.drop_columns([key]))
        w = _ordered_words(table)
        starts = [unpack(x)[0] for x in marks["data"].to_pylist()]
        return finish(table, w, _kept(w, np.concatenate(starts) if starts else np.zeros(0, np.int64), window))

    return placed.groupBy(key).cogroup(marks.withColumnRenamed("part", key).groupBy(key)).applyInArrow(run, schema)


def digest(docs: DataFrame, window: int = 20) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each row."""

    def finish(table: pa.Table, w: Words | None, keep) -> pa.Table:
        if w is None:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string())})
        sha = [hashlib.sha256(x).hexdigest() for x in _kept_texts(w, keep)]
        n = np.diff(w.first)
        kept = np.diff(np.concatenate(([0], np.cumsum(keep)))[w.first])
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(n.astype(np.int64)), "n_removed": pa.array((n - kept).astype(np.int64)), "kept_sha256": sha})

    return _apply(common.texts(docs), window, finish, DIGEST)


def dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``; texts without any stay as they are.

    All rows and columns stay.  A changed text is its kept words joined by single spaces.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(docs.schema)

    def finish(table: pa.Table, w: Words | None, keep) -> pa.Table:
        if w is None:
            return target.empty_table()
        gone = np.diff(np.concatenate(([0], np.cumsum(~keep)))[w.first]) > 0
        if not gone.any():
            return table
        place = table.schema.get_field_index("text")
        kind = table.schema.field(place).type
        changed = [_joined(w, keep, slice(d, d + 1))[0][:-1].tobytes().decode() for d in np.flatnonzero(gone).tolist()]
        column = pa.compute.replace_with_mask(table.column(place).combine_chunks(), pa.array(gone), pa.array(changed, kind))
        return table.set_column(place, table.schema.field(place), column)

    return _apply(docs, window, finish, docs.schema)


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text NULLS FIRST) AS r, CAST(doc_id AS BIGINT) AS doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (
  SELECT r, unnest(range(1, len(w) - 18)) AS p, unnest(list_transform(range(1, len(w) - 18), lambda p: sha256(array_to_string(w[p:p + 19], ' ')))) AS seq FROM docs),
later AS (SELECT s.r, s.p FROM starts s JOIN (SELECT seq, min((r, p)) AS first FROM starts GROUP BY seq HAVING count(*) > 1) f ON s.seq = f.seq AND (s.r, s.p) <> f.first),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 20)) AS i FROM later),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""


def query(spark, sf_dir: str) -> DataFrame:
    return digest(common.table(spark, sf_dir, "documents"))
