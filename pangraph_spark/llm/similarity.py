"""Near-duplicate documents: exact join of word 5-shingle sets at Jaccard 0.8 over prefix trees.

1. Weights.  Every shingle is counted over all texts.  The global order puts shingles of one text first, by
   hash, then shared ones, by how common they are.  Any order gives the same result; this one keeps
   boilerplate out of prefixes, and with it texts out of blocks.
2. Candidates.  Two sets at the threshold share an element of their prefixes.  Texts that share a prefix
   element are joined into blocks.  Per element that takes a star of edges, not its pairs.
3. Trees.  A block's sets meet in one task, which builds a prefix tree over them and walks it with all
   sets (see :mod:`.prefix_tree`).  Large blocks are cut into trees by bands of set size, and by hash where
   a band is still large.  Similar sets are in one band or in neighbouring ones.  First some leaders visit
   the trees around theirs; then whatever is not in its block's largest component visits them as a probe.
4. Components of the verified links, together with equal sets, name the groups.

Rows with one ``doc_id`` are one document: a link of any of them counts for all.  Rows without id link
with nothing.  Null texts and texts without words have an empty set and link with nothing.  A text of fewer
than 5 words has one shingle, its whole sequence.  A text is read whole however long it is, by one task; an
empty table gives an empty table.  Other columns, whatever their names, are kept by :func:`keep_one` and
ignored by :func:`groups`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import EDGES, components, forest
from .grouped import by_bucket, pack, unpack
from .prefix_tree import link
from .ranges import Ranges
from .words import U, mix, powers, split_words, text_bytes, text_slices, windows

SHINGLE = 5
HEAVY = 2  # texts that share a shingle before it goes behind the others
SPLIT = 4  # receivers of counts for each receiver of prefixes: all shingles are counted, few are in prefixes
CHUNK = 1024  # sets in one tree
LEADERS = 8  # of each band of a large block
BAND = 1.25  # similar sets differ in size by no more
SALTS = 64  # parts of a group of equal sets
SEMI_ROWS = 2_000_000  # ids that are broadcast to leave out texts no tree needs; beyond that all are sent
PACK = 2048  # sets of small blocks in one task
_POW = powers(0x9E3779B97F4A7C15, 8)


def _distinct(h: np.ndarray) -> np.ndarray:
    """Sorted values once each; for short arrays much faster than ``np.unique``."""
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h if new.all() else h[new]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each document's distinct shingle hashes, ascending."""
    w = split_words(data, offsets, lower=True)
    h, whole = windows(w, SHINGLE)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(_distinct(np.sort(h[a : b - SHINGLE + 1])))
        elif b > a:
            out.append(mix((w.hashes[a:b] * _POW[: b - a]).sum(keepdims=True) + U(b - a)))
        else:
            out.append(h[:0])
    return out


def prefix_size(n: int) -> int:
    """Elements of which two similar sets share one: a set of n overlaps similar ones by 0.8 n at least."""
    return n - -(-4 * n // 5) + 1


def signature(s: np.ndarray) -> int:
    return int(mix((mix(s ^ U(0x5851F42D4C957F2D))).sum(keepdims=True, dtype=np.uint64) + U(len(s)))[0].astype(np.int64)) if len(s) else 0


def _short(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash's upper 48 bits in two arrays of 4 and 2 bytes."""
    return (h >> U(32)).astype(np.uint32).view(np.int32), ((h >> U(16)) & U(0xFFFF)).astype(np.uint16).view(np.uint8)


def _long(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return high.view(np.uint32).astype(np.uint64) << U(32) | low.view(np.uint16).astype(np.uint64) << U(16)


SETS = "doc_id long, n_shingles long, sig long"
OWN = -1  # in place of a receiver: what a range says of its own rows


def set_table(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, sig`` of each row."""

    def step(batch):
        for rows, data, offsets in text_slices(batch, "text", 4 << 20):
            sets = shingle_sets(data, offsets)
            yield common.arrow(doc_id=common.rows_of(batch, "doc_id", rows), n_shingles=np.array([len(s) for s in sets], np.int64), sig=np.array([signature(s) for s in sets], np.int64))

    return common.map_arrow(docs, step, SETS)


def _entries(bucket, part, data) -> pa.RecordBatch:
    return common.arrow(bucket=pa.array(bucket, pa.int32()), part=pa.array(part, pa.int32()), data=pa.array(data, pa.binary()))


def heavy_shingles(docs: DataFrame, ranges: Ranges) -> DataFrame:
    """``part, data``: for each range its heavy shingles and how heavy they are."""

    def emit(batch):
        part_of = batch.column(0).to_numpy()
        for rows, data, offsets in text_slices(batch, "text", 4 << 20):
            sets = shingle_sets(data, offsets)
            seen, picked = set(), {}
            for p, x in zip(part_of[rows].tolist(), sets, strict=True):
                key = (p, signature(x))
                if len(x) and key not in seen:  # copies count once
                    seen.add(key)
                    picked.setdefault(p, []).append(x)
            if not picked:
                continue
            hashes, parts, times = [], [], []
            for p in sorted(picked):
                h = np.sort(np.concatenate(picked[p]) & ~U(0xFFFF))
                at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                hashes.append(h[at])
                times.append(np.minimum(np.diff(at, append=len(h)), 65535).astype(np.uint16))
                parts.append(np.full(len(at), p, np.int32))
            h, part, n = np.concatenate(hashes), np.concatenate(parts), np.concatenate(times)
            # places and counts are runs of few values, which the shuffle's own compression takes out
            found = [(b, pack(*_short(h[r]), part[r], n[r].view(np.uint8))) for b, r in by_bucket(h, SPLIT * ranges.buckets)]
            yield _entries([b for b, _ in found], [0] * len(found), [d for _, d in found])

    @common.grouped
    def meet(table: pa.Table) -> pa.Table:
        found = [unpack(x) for x in table["data"].to_pylist()]
        h = np.concatenate([_long(x[0], x[1]) for x in found])
        part, n = np.concatenate([x[2] for x in found]), np.concatenate([x[3].view(np.uint16) for x in found])
        del found
        order = np.argsort(h)
        h, part, n = h[order], part[order], n[order]
        edge = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0)
        total = np.add.reduceat(n.astype(np.int64), edge)
        times = np.diff(edge, append=len(h))
        keep = np.repeat(total >= HEAVY, times)
        level = np.repeat(np.log2(total).astype(np.uint8), times)[keep]
        h, part = h[keep], part[keep]
        order = np.lexsort((h, part))
        h, part, level = h[order], part[order], level[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else np.zeros(0, np.int64)
        ends = [*cuts[1:].tolist(), len(part)]
        return pa.table({"part": pa.array(part[cuts].astype(np.int32)), "data": pa.array([pack(h[a:b], level[a:b]) for a, b in zip(cuts.tolist(), ends, strict=False)], pa.binary())})

    sent = common.map_arrow(docs.select(ranges.column().alias("part"), "text"), emit, "bucket int, part int, data binary")
    return sent.select("bucket", "data").groupBy("bucket").applyInArrow(meet, "part int, data binary")


def _range_sets(table: pa.Table):
    """Ids and sets of a range's rows, in the order of ids."""
    table = table.sort_by("doc_id")
    data, offsets = text_bytes(table["text"])
    at, n, ids = 0, len(offsets) - 1, table["doc_id"].to_numpy()
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (4 << 20), "right")) - 1)
        sets = shingle_sets(data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at])
        yield from zip(ids[at:upto].tolist(), sets, strict=True)
        at = upto


def candidate_edges(docs: DataFrame, ranges: Ranges) -> tuple[DataFrame, DataFrame]:
    """``a, b``: edges that connect all documents that share a prefix element; and the sets of all rows.

    Every row has an id.  The sets are a by-product of the prefixes, so texts are split once less.
    """
    placed = docs.select(ranges.column().alias("part"), "doc_id", "text")
    heavy = heavy_shingles(docs, ranges)

    @common.grouped
    def post(table: pa.Table, marks: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_batches([_entries([], [], [])])
        known = [unpack(x) for x in marks["data"].to_pylist()]
        h = np.concatenate([x[0] for x in known]) if known else np.zeros(0, np.uint64)
        level = np.concatenate([x[1] for x in known]) if known else np.zeros(0, np.uint8)
        order = np.argsort(h)
        h, level = h[order], level[order]
        seen, ids, parts, own = set(), [], [], []
        for i, s in _range_sets(table):
            own.append((i, len(s), sig := signature(s)))
            if not len(s) or sig in seen:
                continue
            seen.add(sig)
            p = prefix_size(len(s))
            short = s & ~U(0xFFFF)
            if len(h):
                at = np.minimum(np.searchsorted(h, short), len(h) - 1)
                weight = np.where(h[at] == short, level[at], 0)
                light = np.flatnonzero(weight == 0)
                short = short[light[:p] if len(light) >= p else np.argsort(weight, kind="stable")[:p]]
            else:
                short = short[:p]
            ids.append(i)
            parts.append(short)
        all_h = np.concatenate([h[:0], *parts])
        doc = np.repeat(np.array(ids, np.int64), [len(x) for x in parts])
        found = [(b, pack(*_short(all_h[r]), doc[r])) for b, r in by_bucket(all_h, ranges.buckets)]
        found.append((OWN, pack(*np.array(own, np.int64).T.copy())))
        return pa.Table.from_batches([_entries([b for b, _ in found], [0] * len(found), [d for _, d in found])])

    @common.grouped
    def meet(table: pa.Table) -> pa.Table:
        found = [unpack(x) for x in table["data"].to_pylist()]
        h, doc = np.concatenate([_long(x[0], x[1]) for x in found]), np.concatenate([x[2] for x in found])
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        same = np.flatnonzero(h[1:] == h[:-1])
        node, root = forest(doc[same + 1], doc[same])
        return pa.table({"a": pa.array(node, pa.int64()), "b": pa.array(root, pa.int64())})

    def rows(batch):
        for x in batch.column(0).to_pylist():
            ids, n, sig = unpack(x)
            yield common.arrow(doc_id=ids, n_shingles=n, sig=sig)

    sent = common.cut(placed.groupBy("part").cogroup(heavy.groupBy("part")).applyInArrow(post, "bucket int, part int, data binary").select("bucket", "data"))
    sets = common.map_arrow(sent.where(F.col("bucket") == OWN).select("data"), rows, SETS)
    return sent.where(F.col("bucket") != OWN).groupBy("bucket").applyInArrow(meet, EDGES), sets


def _wanted(docs: DataFrame, visits: DataFrame) -> DataFrame:
    """The documents that some tree needs, where their ids are few enough to broadcast; else all of them."""
    ids = visits.select("doc_id").distinct()
    if ids.limit(SEMI_ROWS + 1).count() > SEMI_ROWS:
        return docs
    return docs.join(F.broadcast(ids), "doc_id", "left_semi")


def verified_links(docs: DataFrame, ranges: Ranges, visits: DataFrame, only_probes: bool) -> DataFrame:
    """``a, b``: links found in the trees of ``visits(doc_id, n, part, task, tree, probe, component)``."""
    placed = _wanted(docs, visits).select(ranges.column().alias("part"), "doc_id", "text")

    @common.grouped
    def deliver(table: pa.Table, wanted: pa.Table) -> pa.Table:
        to: dict[tuple, list] = {}
        for i, n, *row in zip(*[wanted[c].to_pylist() for c in ("doc_id", "n", "task", "tree", "probe", "component")], strict=True):
            to.setdefault((i, n), []).append((i, *row))
        out = []
        if to and table.num_rows:
            seen = set()
            for i, s in _range_sets(table):
                if (i, len(s)) not in to or (i, sig := signature(s)) in seen:
                    continue
                seen.add((i, sig))
                data = pack(*_short(s))
                out += [(*row, data) for row in to[i, len(s)]]
        cols = list(zip(*out, strict=True)) or [[]] * 6
        return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "task": pa.array(cols[1], pa.int64()), "tree": pa.array(cols[2], pa.int64()), "probe": pa.array(cols[3], pa.bool_()), "component": pa.array(cols[4], pa.int64()), "data": pa.array(cols[5], pa.binary())})

    @common.grouped
    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by("tree")
        ids, tree = table["doc_id"].to_numpy(), table["tree"].to_numpy()
        probe, known = table["probe"].to_numpy(zero_copy_only=False), table["component"].to_numpy()
        data = table["data"].to_pylist()
        cuts = [*np.flatnonzero(np.diff(tree, prepend=~tree[:1]) != 0).tolist(), len(tree)]
        a, b = [], []
        for low, high in zip(cuts, cuts[1:], strict=False):
            if high - low < 2:
                continue
            sets = [_long(*unpack(x)) for x in data[low:high]]
            for x, y in link(sets, known[low:high], probe[low:high] if only_probes else None):
                a.append(ids[low + x])
                b.append(ids[low + y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sent = placed.groupBy("part").cogroup(visits.groupBy("part")).applyInArrow(deliver, "doc_id long, task long, tree long, probe boolean, component long, data binary")
    return sent.groupBy("task").applyInArrow(grow, EDGES)


PLACE = ["doc_id", "n", "block", "band", "sub", "large"]


def _trees(blocks: DataFrame) -> DataFrame:
    """Adds ``band``, ``subs``, ``sub`` and ``large`` to ``doc_id, n, block``: the tree that each set is in.

    Only large blocks are looked up, and there are few of them; their rows stay where they are.
    """
    large = common.cut(blocks.groupBy("block").agg(F.count("*").alias("members")).where(F.col("members") > CHUNK).select("block", F.lit(True).alias("large")))
    rows = common.attach(blocks, large, ["block"]).withColumn("large", F.coalesce("large", F.lit(False)))
    band = F.when(F.col("large"), F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND))).cast("int")).otherwise(F.lit(0))
    rows = rows.withColumn("band", band)
    bands = rows.where("large").groupBy("block", "band").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("subs")).where("subs > 1")
    rows = common.attach(rows, common.cut(bands), ["block", "band"]).withColumn("subs", F.coalesce("subs", F.lit(1)))
    return rows.withColumn("sub", F.pmod(F.xxhash64("doc_id"), F.col("subs")).cast("int"))


def _neighbours(rows: DataFrame, trees: DataFrame) -> DataFrame:
    """A row for each other tree of the same block in a set's own band or in one next to it."""
    there = trees.where("large").select("block", "band", "subs").distinct()
    away = rows.withColumnRenamed("sub", "own_sub").withColumnRenamed("band", "own_band").drop("subs")
    away = away.withColumn("band", F.explode(F.array(*[F.col("own_band") + k for k in (-1, 0, 1)])))
    away = away.join(there, ["block", "band"]).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    return away.where((F.col("band") != F.col("own_band")) | (F.col("sub") != F.col("own_sub"))).drop("own_band", "own_sub", "subs")


def _visits(rows: DataFrame, ranges: Ranges, packs: int) -> DataFrame:
    """Small blocks share tasks; each tree of a large one has a task of its own."""
    own = F.xxhash64("block", "band", "sub")
    task = F.when(F.col("large"), own).otherwise(F.pmod(F.xxhash64("block"), F.lit(packs)))
    return rows.select("doc_id", "n", ranges.column().alias("part"), task.alias("task"), own.alias("tree"), "probe", "component")


def similar_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, b``: verified links between different texts, enough to connect every group; and the sets of all rows."""
    ranges = Ranges(docs)
    common.ship(docs.sparkSession)
    edges, sets = candidate_edges(docs, ranges)
    sets = common.cut(sets)
    blocks = components(edges).select(F.col("node").alias("doc_id"), F.col("root").alias("block"))
    sizes = sets.where("n_shingles > 0").select("doc_id", F.col("n_shingles").alias("n")).distinct()
    blocks = common.cut(blocks.join(sizes, "doc_id"))
    trees = common.cut(_trees(blocks))
    total = trees.agg(F.count("*").alias("n"), F.coalesce(F.max("large"), F.lit(False)).alias("large")).first()
    packs = max(1, -(-total.n // PACK), min(total.n // 64, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    marks = [F.lit(False).alias("probe"), F.col("doc_id").alias("component")]
    rows = trees.select(*PLACE, *marks)
    if total.large:
        large = trees.where("large")
        counts = large.groupBy("block", "band").agg(F.count("*").alias("members"))
        some = large.join(counts, ["block", "band"]).where(F.pmod(F.xxhash64("doc_id", F.lit("lead")), F.greatest(F.lit(1).cast("long"), (F.col("members") / (4 * LEADERS)).cast("long"))) == 0)
        first = Window.partitionBy("block", "band").orderBy(F.xxhash64("doc_id", F.lit("order")), "doc_id", "n")
        leaders = some.withColumn("k", F.row_number().over(first)).where(F.col("k") <= LEADERS)
        rows = rows.unionByName(_neighbours(leaders.select(*PLACE), trees).select(*PLACE, *marks))
    links = common.cut(verified_links(docs, ranges, _visits(rows, ranges, packs), False))
    if not total.large:
        return links, sets
    found = components(links).withColumnRenamed("node", "doc_id")
    known = common.cut(trees.where("large").join(found, "doc_id", "left").select(*PLACE, F.coalesce("root", "doc_id").alias("component")))
    main = known.groupBy("block", "component").agg(F.count("*").alias("members")).groupBy("block").agg(F.max(F.struct("members", "component")).alias("top"))
    marked = known.join(main.select("block", F.col("top.component").alias("main")), "block").withColumn("probe", F.col("component") != F.col("main")).drop("main")
    probes = _neighbours(marked.where("probe"), trees)
    visited = probes.select("block", "band", "sub").distinct()
    stay = marked.join(visited, ["block", "band", "sub"], "left_semi").withColumn("probe", F.lit(False))
    again = common.cut(stay.select(*PLACE, "probe", "component").unionByName(probes.select(*PLACE, "probe", "component")))
    if again.isEmpty():
        return links, sets
    return links.unionByName(common.cut(verified_links(docs, ranges, _visits(again, ranges, packs), True))), sets


def _equal_sets(sets: DataFrame) -> DataFrame:
    """``a, b``: stars of documents with equal sets, by salted parts and then over their centres.

    A large group of copies is spread over SALTS parts, and what joins by set alone is a row a part.
    """
    same = ["sig", "n_shingles"]
    rows = sets.select("doc_id", *same, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    parts = rows.groupBy(*same, "salt").agg(F.min("doc_id").alias("b"), F.count("*").alias("n"))
    inside = rows.join(parts.where("n > 1"), [*same, "salt"]).select(F.col("doc_id").alias("a"), "b")
    centres = parts.groupBy(*same).agg(F.min("b").alias("centre"), F.count("*").alias("n")).where("n > 1")
    across = parts.drop("n").join(centres, same).select(F.col("b").alias("a"), F.col("centre").alias("b"))
    return inside.unionByName(across).where("a <> b")


def groups(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``docs(doc_id, text)``."""
    docs = common.texts(docs)
    links, named = similar_links(docs.where(F.col("doc_id").isNotNull()))
    found = components(links.unionByName(_equal_sets(named.where(F.col("n_shingles") > 0))))
    sets = named.unionByName(set_table(docs.where(F.col("doc_id").isNull())))
    return sets.join(found, sets.doc_id == found.node, "left").select(sets.doc_id, "n_shingles", F.coalesce("root", sets.doc_id).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group, the one of the smallest id; rows repeated whole go too.

    Documents that are like no other stay, and so do rows without id.
    """
    found = groups(docs)
    first = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


SQL = r"""
WITH RECURSIVE docs AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS p FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM shingles p JOIN shingles q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY ALL) x
  JOIN sizes y ON y.doc_id = x.a JOIN sizes z ON z.doc_id = x.b WHERE 100 * x.n >= 80 * (y.n + z.n - x.n)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM docs d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) USING (doc_id)
"""


def query(spark, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents"))
