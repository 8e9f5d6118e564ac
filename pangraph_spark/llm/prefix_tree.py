"""Similarity join of sets over a prefix tree.

Sets are ordered by one global order of their elements and stored in a path-compressed tree, so sets that
begin alike share nodes.  A probe walks the tree and carries its overlap with the path, counted once for
all sets below.  A subtree is left when even its longest remainder cannot reach the needed overlap, and
when all its sets are known to be in the probe's component.  Probes that are neighbours in the tree walk it
together, so a node costs a few array steps for all of them; each leaves where it would alone.
"""

from __future__ import annotations

import numpy as np

# |x & y| / |x | y| >= 80 / 100 is the same as 180 * |x & y| >= 80 * (|x| + |y|)
NEED, HAVE = 4, 9
CELLS = 1 << 22  # elements times probes that walk together


class Tree:
    """``sets``: sorted int arrays, in lexicographic order; ``sizes``: the whole sets' sizes."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sets, self.sizes = sets, sizes
        self.begin, self.end, self.low, self.high = [0], [0], [0], [len(sets)]
        self.children: list[list[int]] = [[]]
        self.owner = [0]
        lengths = np.array([len(s) for s in sets], np.int64)
        shared = np.zeros(len(sets), np.int64)
        for k in range(1, len(sets)):
            a, b = sets[k - 1], sets[k]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            shared[k] = differ[0] if len(differ) else n
        self._grow(0, 0, len(sets), 0, shared, lengths)
        self.least = [int(sizes[a:b].min()) if b > a else 0 for a, b in zip(self.low, self.high, strict=True)]
        self.longest = [int(lengths[a:b].max()) if b > a else 0 for a, b in zip(self.low, self.high, strict=True)]

    def _grow(self, node: int, low: int, high: int, depth: int, shared: np.ndarray, lengths: np.ndarray) -> None:
        todo = [(node, low, high, depth)]
        while todo:
            node, low, high, depth = todo.pop()
            while low < high and lengths[low] == depth:
                low += 1  # sets that end here
            if low == high:
                continue
            cuts = low + 1 + np.flatnonzero(shared[low + 1 : high] <= depth)
            edges = [low, *cuts.tolist(), high]
            for a, b in zip(edges, edges[1:], strict=False):
                upto = int(lengths[a]) if b - a == 1 else min(int(lengths[a]), int(shared[a + 1 : b].min()))
                new = len(self.begin)
                self.begin.append(depth)
                self.end.append(upto)
                self.owner.append(a)
                self.low.append(a)
                self.high.append(b)
                self.children.append([])
                self.children[node].append(new)
                todo.append((new, a, b, upto))

    def walk(self, probes: np.ndarray, component: np.ndarray, row: np.ndarray, later: bool):
        """``(probe, set)`` for each link that joins two components, which ``component`` then holds as one.

        ``row`` has a zero for each element and is left so.  With ``later`` a probe meets only the sets behind it.
        """
        values = np.unique(np.concatenate([self.sets[k] for k in probes.tolist()]))
        row[values] = np.arange(1, len(values) + 1)
        held = np.zeros((len(values) + 1, len(probes)), bool)
        for j, k in enumerate(probes.tolist()):
            held[row[self.sets[k]], j] = True
        upto = np.cumsum(held, axis=0, dtype=np.int32)
        total, sizes = upto[-1], self.sizes[probes]
        all_ = np.arange(len(probes))
        todo = [(c, all_, np.zeros(len(probes), np.int64)) for c in self.children[0]]
        while todo:
            node, who, have = todo.pop()
            low, high = self.low[node], self.high[node]
            stay = probes[who] < high - 1 if later else np.ones(len(who), bool)
            if (component[low:high] == component[low]).all():
                stay &= component[probes[who]] != component[low]
            if not stay.all():
                who, have = who[stay], have[stay]
                if not len(who):
                    continue
            part = self.sets[self.owner[node]][self.begin[node] : self.end[node]]
            known = row[part]
            known = known[known > 0]
            if len(known):
                have = have + np.count_nonzero(held[known] if len(who) == len(probes) else held[known[:, None], who], axis=0)
            rest = total[who] - upto[np.searchsorted(values, part[-1], "right"), who]
            best = have + np.minimum(rest, self.longest[node] - self.end[node])
            stay = HAVE * best >= NEED * (sizes[who] + self.least[node])
            if not stay.all():
                who, have = who[stay], have[stay]
                if not len(who):
                    continue
            k = low
            while k < high and len(self.sets[k]) == self.end[node]:
                near = (HAVE * have >= NEED * (sizes[who] + int(self.sizes[k]))) & (component[probes[who]] != component[k])
                for x in probes[who[near]].tolist():
                    if component[x] != component[k] and (x < k or not later):
                        yield x, k
                        component[component == component[k]] = component[x]
                k += 1
            todo += [(c, who, have) for c in self.children[node]]
        row[values] = 0


def link(sets: list[np.ndarray], component: np.ndarray, probes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the components of similar sets: enough for connectivity, each verified.

    ``component`` holds what is known already.  With ``probes`` (booleans) only pairs with one of them count.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # rarest first; elements of one set only can match nothing and stay out of the tree
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, counts))] = np.arange(len(values))
    alone = int((counts == 1).sum())
    ranks = rank[inverse] - alone
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    ordered = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        r = ranks[a:b]
        ordered.append(np.sort(r[r >= 0]))
    order = sorted(range(len(sets)), key=lambda k: ordered[k].astype(">i8").tobytes())
    tree = Tree([ordered[k] for k in order], sizes[order])
    component = component[order].copy()
    asked = np.ones(len(sets), bool) if probes is None else probes[order]
    row = np.zeros(max(1, len(values) - alone), np.int32)
    asked = np.array([k for k in np.flatnonzero(asked).tolist() if len(tree.sets[k])], np.int64)
    out, at = [], 0
    while at < len(asked):
        # as many as surely fit: n sets of m elements make n * n * m cells at most
        longest = np.maximum.accumulate([len(tree.sets[k]) for k in asked[at : at + 256].tolist()])
        upto = at + max(1, int(np.searchsorted(longest * np.arange(1, len(longest) + 1) ** 2, CELLS, "right")))
        out += [(order[x], order[k]) for x, k in tree.walk(asked[at:upto], component, row, probes is None)]
        at = upto
    return out
