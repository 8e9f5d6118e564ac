"""The whole toxicity score against a plain version: dictionaries, recursion and bisection."""

import math
import re
import zlib
from collections import Counter

import pytest

from pangraph_spark.llm import toxicity

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def weights_of(texts):
    """A text shares its weight with those of the same windows, each as often."""
    form = {}
    for i, w in texts.items():
        form[i] = frozenset(Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)).items()) if len(w) >= 5 else ("short", frozenset(Counter(w).items()))
    same = Counter(form.values())
    return {i: 1 / same[f] for i, f in form.items()}


def fitted(texts, toxic, weight, prior=500.0, least_z=2.6):
    t, o = Counter(), Counter()
    for i, w in texts.items():
        for x in set(w):
            (t if toxic[i] else o)[x] += weight[i]
    nt, no = sum(t.values()), sum(o.values())
    if not nt or not no:
        return {}, 0.2, 1.0, 1.0
    score, share = {}, {}
    for x in {*t, *o}:
        a = prior * (t[x] + o[x]) / (nt + no) + 0.5
        p, q = t[x] + a, o[x] + a
        delta = math.log(p / (nt + prior - p)) - math.log(q / (no + prior - q))
        if abs(delta) / math.sqrt(1 / p + 1 / q) >= least_z:
            score[x], share[x] = min(8.0, max(-1.0, delta)), o[x] / no
    drift = max(0.2, 2 * sum(share[x] * max(0.0, s) for x, s in score.items()))
    other = max(0.0, 1 - sum(share.values()))
    over = lambda v: sum(share[x] * math.exp(v * s) for x, s in score.items()) + other * math.exp(-v * drift) >= 1
    low, high = 1e-6, 64.0
    for v in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0):
        if over(v):
            high = v
            break
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (low, middle) if over(middle) else (middle, high)
    k = sum(share[x] * math.exp(low * s) for x, s in score.items() if s > 0)
    return score, drift, low, max(1e-6, min(1.0, k))


def best_segments(s, at=0):
    """All maximal segments by recursion: the best one of highest sum and least length, then both sides."""
    total, best = [0.0], None
    for x in s:
        total.append(total[-1] + x)
    for a in range(len(s)):
        if s[a] > 0:
            b = max(range(a + 1, len(s) + 1), key=lambda b: (total[b], -b))
            if best is None or total[b] - total[a] > best[0] + 1e-12:
                best = (total[b] - total[a], a, b)
    if best is None:
        return []
    value, a, b = best
    return [*best_segments(s[:a], at), value, *best_segments(s[b:], at + b)]


def evidence_of(w, model):
    score, drift, rate, k = model
    s = [score.get(x, -drift) for x in w]
    return sum(max(0.0, rate * v - math.log(k * len(w))) for v in best_segments(s)) if any(x > 0 for x in s) else 0.0


def curve_of(evidence, toxic):
    n, p = [0] * toxicity.LEVELS, [0] * toxicity.LEVELS
    for i, e in evidence.items():
        level = min(toxicity.LEVELS - 1, math.floor(math.log2(1 + e) * toxicity.STEPS))
        n[level] += 1
        p[level] += toxic[i]
    # the closest non-decreasing rates: at each level the largest over beginnings of the least mean over ends
    rate = []
    for k in range(toxicity.LEVELS):
        found = [min(sum(p[a : b + 1]) / sum(n[a : b + 1]) for b in range(k, toxicity.LEVELS) if sum(n[a : b + 1])) for a in range(k + 1) if sum(n[a:])]
        rate.append(max(found) if found else rate[-1])
    return rate


def test_scores_equal_a_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    words = {r.doc_id: words_of(r.text) for r in docs.collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in words and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    use = toxicity._usable(labels)
    # folds follow the keys; weights are made anew
    fold = {r.doc_id: r.key % toxicity.FOLDS for r in toxicity.copy_weights(docs.select("doc_id", "text"), use).collect()}
    assert set(fold) == set(toxic)
    texts = {i: words[i] for i in toxic}
    weight = weights_of(texts)
    part = lambda keep: {i: w for i, w in texts.items() if keep(fold[i])}
    crossed = {}
    for k in range(toxicity.FOLDS):
        model = fitted(part(lambda f, k=k: f != k), toxic, weight)
        crossed |= {i: evidence_of(w, model) for i, w in part(lambda f, k=k: f == k).items()}
    curve, model = curve_of(crossed, toxic), fitted(texts, toxic, weight)
    some = 0
    for r in toxicity.score(docs, labels).collect():
        e = evidence_of(words[r.doc_id], model)
        want = curve[min(toxicity.LEVELS - 1, math.floor(math.log2(1 + e) * toxicity.STEPS))] * 0.999 + 0.001 * e / (1 + e)
        assert r.evidence == pytest.approx(e, abs=1e-6) and r.score == pytest.approx(want, abs=1e-6)
        assert r.predicted == int(want >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        some += e > 0
    assert some
