"""Toxic passages as maximum-scoring segments, and a calibrated score per document.

Words (letters and digits, A-Z in lower case) get log-odds between toxic and other labelled texts under an
informative Dirichlet prior taken from all of the labelled words; words whose log-odds are not significant
cost a small constant, so that the mean score of ordinary text is negative.  A linear scan then finds every
maximal scoring segment of a text.  By extreme-value statistics a segment of score S in a text of n words
is expected K * n * exp(-lambda * S) times in ordinary text, lambda being the root of
E[exp(lambda * score)] = 1 over ordinary words.  A document's evidence is the sum over its segments of how
far that expectation falls below one; a monotone fit turns evidence into a probability.

Word counts and the calibration use all labelled training rows; the curve is fitted on evidence that each
row gets of a model made without it.  The model keeps every significant word.  The ``max_words`` commonest
are broadcast; if there are more, the rest stays a table, and texts get the scores of their rarer words by
a join.

Null and empty texts have no words and no evidence; they get the score of texts without evidence.  Rows
are scored one by one, whole, however long, so repeats and ties need no rule.  Of contradictory labels of
one id the larger counts; labels without id or value are left out.  Without labelled rows of both kinds every
score is the share of toxic rows among the labelled, or 0.  An empty table gives an empty table; other
columns, whatever their names, are kept by :func:`reject` and ignored by :func:`score`.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import SYMBOLS, split_words, text_slices, windows

LEVELS = 64  # evidence is counted on a logarithmic scale, STEPS levels for each doubling of 1 + evidence
STEPS = 6
NO_SIGNIFICANCE = 0.2
FOLDS = 3


@dataclass
class Model:
    """Sorted word hashes with their scores; ``drift`` is the cost of any word without one."""

    words: np.ndarray
    scores: np.ndarray
    drift: float
    rate: float  # lambda
    k: float
    curve: np.ndarray | None = None  # probability at each evidence level
    rest: DataFrame | None = None  # ``h, score, share`` of the significant words beyond these

    def score_words(self, hashes: np.ndarray, more: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        out = np.full(len(hashes), -self.drift)
        for words, scores in [(self.words, self.scores), *([more] if more else [])]:
            at, hit = _lookup(words, hashes)
            out[hit] = scores[at[hit]]
        return out


def _lookup(words: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``hashes`` in sorted ``words``, and which of them are there."""
    if not len(words):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return at, words[at] == hashes


def held_out(doc_id):
    """Rows whose labels are never used: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _words(data, offsets):
    return split_words(data, offsets, lower=True, separators=SYMBOLS)


def copy_weights(docs: DataFrame, use: DataFrame) -> DataFrame:
    """``use`` with ``weight`` and ``key``: copies weigh one text together, every other text weighs 1.

    Copies have the same windows of 5 words, each as often (texts of fewer words: the same words), told by
    the sum of all window hashes.  Keys are made where the texts are; what travels are small rows, and a key
    that many texts share stays dealt over tasks.
    """

    def step(batch):
        for rows, data, offsets in text_slices(batch, "text", 8 << 20):
            w = _words(data, offsets)
            h, whole = windows(w, 5)
            short = np.repeat(np.diff(w.first) < 5, np.diff(w.first))
            h = np.where(whole, h, np.where(short, w.hashes, np.uint64(0)))
            key = np.zeros(len(offsets) - 1, np.uint64)
            some = np.diff(w.first) > 0
            if len(h):
                key[some] = np.add.reduceat(h, w.first[:-1][some])
            yield common.arrow(doc_id=common.rows_of(batch, "doc_id", rows), key=key.view(np.int64))

    keys = common.map_arrow(docs.where(common.among(use, "doc_id")), step, "doc_id long, key long").groupBy("doc_id").agg(F.min("key").alias("key"))
    keyed = common.cut(keys.join(use.hint("merge"), "doc_id"))
    shared = common.cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    return common.attach(keyed, shared, ["key"]).select("doc_id", "toxic", (1.0 / F.coalesce("n", F.lit(1))).alias("weight"), "key")


def count_words(labelled: DataFrame) -> DataFrame:
    """``h, toxic, other``: weighted numbers of texts of either label that hold a word."""

    def step(batch):
        for rows, data, offsets in text_slices(batch, "text", 8 << 20):
            w = _words(data, offsets)
            label = common.rows_of(batch, "toxic", rows).to_numpy(zero_copy_only=False)
            weight = common.rows_of(batch, "weight", rows).to_numpy(zero_copy_only=False)
            h, inverse = np.unique(w.hashes, return_inverse=True)
            once = np.unique(inverse.astype(np.int64) << 32 | w.owner())
            word, doc = once >> 32, once & 0xFFFFFFFF
            mine = np.bincount(word, weights=weight[doc] * (label[doc] == 1), minlength=len(h))
            both = np.bincount(word, weights=weight[doc], minlength=len(h))
            yield common.arrow(h=h.view(np.int64), toxic=mine, other=both - mine)

    return common.map_arrow(labelled.select("text", F.col("toxic").cast("int").alias("toxic"), F.col("weight").cast("double").alias("weight")), step, "h long, toxic double, other double").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def fit(labelled: DataFrame, prior: float = 500.0, least_z: float = 2.6, max_words: int = 1 << 16) -> Model:
    """Log-odds of ``labelled(text, toxic, weight)`` and their extreme-value constants.

    Each word counts once a text, so a word that one text repeats says no more than any other.
    """
    counts = common.cut(count_words(labelled))
    n = counts.agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).first()
    nt, no = n.t or 0, n.o or 0
    if not nt or not no:
        return Model(np.zeros(0, np.uint64), np.zeros(0), NO_SIGNIFICANCE, 1.0, 1.0)
    a = F.lit(prior) * (F.col("toxic") + F.col("other")) / float(nt + no) + 0.5
    t, o = F.col("toxic") + a, F.col("other") + a
    delta = F.log(t / (nt + prior - t)) - F.log(o / (no + prior - o))
    z = delta / F.sqrt(1 / t + 1 / o)
    score = F.least(F.greatest(delta, F.lit(-1.0)), F.lit(8.0))
    kept = counts.select("h", (F.col("toxic") + F.col("other")).alias("n"), score.alias("score"), (F.col("other") / float(no)).alias("share"), z.alias("z")).where(F.abs("z") >= least_z)
    top = kept.orderBy(F.desc("n"), "h").limit(max_words + 1).collect()
    rest = None
    if len(top) > max_words:
        top, last = top[:max_words], top[max_words]
        rest = common.cut(kept.where((F.col("n") < last.n) | ((F.col("n") == last.n) & (F.col("h") >= last.h))).select("h", "score", "share"))
    h = np.array([r.h for r in top], np.int64).view(np.uint64)
    scores, share = np.array([r.score for r in top], float), np.array([r.share for r in top], float)
    cost = float((share * np.maximum(scores, 0)).sum())
    if rest is not None:
        cost += rest.agg(F.sum(F.col("share") * F.greatest("score", F.lit(0.0)))).first()[0]
    drift = max(NO_SIGNIFICANCE, 2 * cost)
    order = np.argsort(h)
    model = Model(h[order], scores[order], drift, 1.0, 1.0, rest=rest)
    model.rate, model.k = extreme_value(model.scores, share[order], drift, rest)
    return model


def extreme_value(scores: np.ndarray, share: np.ndarray, drift: float, more: DataFrame | None = None) -> tuple[float, float]:
    """Lambda by repeated sections, and an upper bound of K for independent words; ``more`` holds further words."""

    def sums(xs, ups: bool = False) -> np.ndarray:
        use = scores > 0 if ups else np.ones(len(scores), bool)
        found = np.array([(share[use] * np.exp(x * scores[use])).sum() for x in xs])
        if more is not None:
            rows = more.where("score > 0") if ups else more
            found += np.array([v or 0.0 for v in rows.agg(*[F.sum(F.col("share") * F.exp(F.lit(float(x)) * F.col("score"))) for x in xs]).first()])
        return found

    other = max(0.0, 1 - float(sums([0.0])[0]))

    def below(xs: np.ndarray) -> np.ndarray:
        return sums(xs) + other * np.exp(-xs * drift) - 1 < 0

    low, high = 1e-6, 1.0
    powers = 2.0 ** np.arange(7)
    over = np.flatnonzero(~below(powers))
    high = float(powers[over[0] if len(over) else -1])
    for _ in range(12):
        xs = np.linspace(low, high, 34)
        over = np.flatnonzero(~below(xs[1:-1]))
        k = int(over[0]) if len(over) else len(xs) - 2
        low, high = float(xs[k]), float(xs[k + 1])
    rate = (low + high) / 2
    return rate, max(1e-6, min(1.0, float(sums([rate], ups=True)[0])))


def segments(places: np.ndarray, total: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first word, end word, score)`` in one linear scan.

    ``places`` are the words of positive score, ``total[i]`` is the sum of scores before word i.
    """
    kept: list[tuple[int, int, float, float]] = []  # begin, end, sum before, sum at end
    for i in places.tolist():
        begin, end, low, high = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j -= 1
            if j < 0 or kept[j][3] >= high:
                kept.append((begin, end, low, high))
                break
            begin, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, high - low) for a, b, low, high in kept]


def _with_rest(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``; with ``more_words``, each row's words of ``model.rest`` and their scores, if there is one."""
    if model.rest is None:
        return docs
    rows = common.cut(docs.withColumn("scan_row", F.monotonically_increasing_id()))
    held = docs.sparkSession.sparkContext.broadcast(model.words)

    def step(batch):
        for part, data, offsets in text_slices(batch, "text", 8 << 20):
            w = _words(data, offsets)
            new = ~_lookup(held.value, w.hashes)[1]
            h, owner = w.hashes[new], w.owner()[new]
            order = np.lexsort((h, owner))
            h, owner = h[order], owner[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            yield common.arrow(scan_row=common.rows_of(batch, "scan_row", part).take(pa.array(owner[first])), h=h[first].view(np.int64))

    found = common.map_arrow(rows.select("scan_row", "text"), step, "scan_row long, h long").join(model.rest.select("h", "score").hint("merge"), "h")
    more = found.groupBy("scan_row").agg(F.collect_list(F.struct("h", "score")).alias("more_words"))
    return rows.join(more.hint("merge"), "scan_row", "left").drop("scan_row")


def _more(batch, rows: slice) -> tuple[np.ndarray, np.ndarray] | None:
    """Sorted hashes and scores that ``_with_rest`` gave to these rows."""
    if "more_words" not in batch.schema.names:
        return None
    h, score = common.rows_of(batch, "more_words", rows).flatten().flatten()
    h, at = np.unique(h.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), return_index=True)
    return h, score.to_numpy(zero_copy_only=False)[at]


def _shared(spark, model: Model):
    return spark.sparkContext.broadcast(replace(model, rest=None))


def _scan(model: Model, data, offsets, more=None):
    """For each document with a positive word: its index, words, and significant segments."""
    w = _words(data, offsets)
    s = model.score_words(w.hashes, more)
    total = np.concatenate(([0.0], np.cumsum(s)))
    up = np.flatnonzero(s > 0)
    first = np.searchsorted(up, w.first)
    for d in np.flatnonzero(np.diff(first)).tolist():
        n = int(w.first[d + 1] - w.first[d])
        found = []
        for a, b, score in segments(up[first[d] : first[d + 1]], total):
            evidence = model.rate * score - np.log(model.k * n)
            if evidence > 0:
                found.append((a, b, score, float(evidence)))
        yield d, w, found


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every significant passage: byte range, score, and minus the log of its expected number."""
    shared = _shared(docs.sparkSession, model)

    def step(batch):
        for rows, data, offsets in text_slices(batch, "text", 8 << 20):
            out = [(d, int(w.starts[a] - offsets[d]), int(w.ends[b - 1] - offsets[d]), s, e) for d, w, found in _scan(shared.value, data, offsets, _more(batch, rows)) for a, b, s, e in found]
            d, a, b, s, e = zip(*out, strict=True) if out else ((), (), (), (), ())
            ids = common.rows_of(batch, "doc_id", rows).take(pa.array(d, pa.int64()))
            yield common.arrow(doc_id=ids, start=pa.array(a, pa.int64()), end=pa.array(b, pa.int64()), score=pa.array(s, pa.float64()), evidence=pa.array(e, pa.float64()))

    return common.map_arrow(_with_rest(common.texts(docs), model), step, "doc_id long, start long, end long, score double, evidence double")


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, evidence, n_passages`` of every row."""
    shared = _shared(docs.sparkSession, model)

    def step(batch):
        for rows, data, offsets in text_slices(batch, "text", 8 << 20):
            sums, n = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
            for d, _, found in _scan(shared.value, data, offsets, _more(batch, rows)):
                sums[d], n[d] = sum(x[3] for x in found), len(found)
            yield common.arrow(doc_id=common.rows_of(batch, "doc_id", rows), evidence=sums, n_passages=n)

    return common.map_arrow(_with_rest(common.texts(docs), model), step, "doc_id long, evidence double, n_passages long")


def monotone(weight: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """The closest non-decreasing rates to ``positive / weight``; levels without rows take the one below."""
    blocks: list[list[float]] = []
    for w, p in zip(weight.tolist(), positive.tolist(), strict=True):
        blocks.append([w, p, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, p2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + p2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), p / w if w else 0.0) for w, p, n in blocks])


def _level(column):
    return F.least(F.floor(F.log2(1 + column) * STEPS), F.lit(LEVELS - 1))


def calibrate(scored: DataFrame, labels: DataFrame) -> np.ndarray:
    """Probability at each evidence level, from at most LEVELS counts."""
    rows = scored.join(labels.hint("merge"), "doc_id").groupBy(_level(F.col("evidence")).alias("level")).agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("double")).alias("p")).collect()
    n, p = np.zeros(LEVELS), np.zeros(LEVELS)
    for r in rows:
        n[r.level], p[r.level] = r.n, r.p
    if not n.sum():
        return np.zeros(LEVELS)
    return monotone(n, p)


def cross_fitted(labelled: DataFrame, use: DataFrame, folds: int = FOLDS) -> np.ndarray:
    """The calibration curve from evidence that each labelled row gets of a model fitted without it.

    Rows are dealt to folds by their copies' key, so no copy of a row helps to judge it.
    """
    fold = F.pmod(F.col("key"), F.lit(folds))
    parts = [evidence(labelled.where(fold == k), fit(labelled.where(fold != k))) for k in range(folds)]
    return calibrate(reduce(DataFrame.unionByName, parts), use)


def _usable(labels: DataFrame) -> DataFrame:
    """Labels that may be learnt from, one a document."""
    use = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    return use.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def _labelled(docs: DataFrame, use: DataFrame) -> DataFrame:
    """``doc_id, text, toxic, weight, key`` of the labelled rows: the only step that moves texts.

    Always a merge join, which suits any size; rows without a label mostly stay where they are.
    """
    some = docs.where(common.among(use, "doc_id"))
    return common.cut(some.join(copy_weights(docs, use).hint("merge"), "doc_id").select("doc_id", "text", "toxic", "weight", "key"))


def _probability(curve: np.ndarray, found: np.ndarray) -> np.ndarray:
    place = np.minimum(np.log2(1 + found) * STEPS, LEVELS - 1)
    # inside a level more evidence still ranks higher, by at most 0.001
    return curve[place.astype(np.int64)] * 0.999 + 0.001 * found / (1 + found)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence, n_passages`` of every row of ``docs``.

    ``labels(doc_id, toxic)`` may cover some of them; held-out rows' labels are not read.
    """
    docs, use = common.texts(docs), _usable(labels)
    labelled = _labelled(docs, use)
    scored = common.cut(evidence(docs, fit(labelled)))
    shared = docs.sparkSession.sparkContext.broadcast(cross_fitted(labelled, use))

    def step(batch):
        p = _probability(shared.value, batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32)), batch.column(1), batch.column(2)], names=["doc_id", "score", "predicted", "evidence", "n_passages"])

    out = common.map_arrow(scored, step, "doc_id long, score double, predicted int, evidence double, n_passages long")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence", "n_passages")


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay."""
    plain, use = common.texts(docs), _usable(labels)
    labelled = _labelled(plain, use)
    model = fit(labelled)
    curve = cross_fitted(labelled, use)
    shared = docs.sparkSession.sparkContext.broadcast((replace(model, rest=None), curve))
    width = len(docs.columns)

    def step(batch):
        model, curve = shared.value
        for rows, data, offsets in text_slices(batch, "text", 8 << 20):
            sums = np.zeros(len(offsets) - 1)
            for d, _, found in _scan(model, data, offsets, _more(batch, rows)):
                sums[d] = sum(x[3] for x in found)
            yield batch.slice(rows.start, rows.stop - rows.start).select(list(range(width))).filter(pa.array(_probability(curve, sums) < threshold))

    return common.map_arrow(_with_rest(docs, model), step, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
