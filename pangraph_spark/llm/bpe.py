"""Tokenization automaton for a merge-list tokenizer with word-end symbols.

The automaton reads *tokens*: its arcs are vocabulary entries, and a path that spells a word is the one
segmentation that the merge list gives that word.  It is compiled merge by merge.  At first every base
symbol may follow every other.  The gadget of merge ``u v -> w`` then changes three things:

* ``w`` becomes an arc wherever ``u`` is one (in the merge ``a a``, not right after ``a`` itself, since
  runs merge from the left);
* what may follow ``w`` is what may follow ``v`` just now;
* ``v`` may no longer follow ``u``.

Tokens that allow the same continuations share one state, tokens that are allowed in the same states share
one arc class, so the compiled table is ``states x classes`` bits.  Because a prefix of a word has exactly
one accepted path too, encoding keeps one token per position: the longest vocabulary entry that ends there
and whose arc leaves the state reached at its beginning.  Words are encoded many at a time with numpy
gathers.  Decoding emits arc labels.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib

import numpy as np
import regex

from .words import LOWER_BYTE, Words, hash_spans

SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
END = "</w>"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte value in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def compile_table(left: np.ndarray, right: np.ndarray, made: np.ndarray, n_tokens: int, final: np.ndarray):
    """Run the merge gadgets in order.

    ``final`` marks tokens that end a word and so have no continuation.  Returns ``(state, arc, table)``:
    the state behind each token (-1 for final ones), the arc class of each token, and the packed bits
    ``table[state, class >> 3]`` of *blocked* arcs.  State 0 blocks nothing and is where words start.
    """
    inner = np.flatnonzero(~final)
    slot = np.full(n_tokens, -1, np.int64)
    slot[inner] = np.arange(len(inner))
    # a token's row is written when it is made, so each gadget looks only at the rows made so far
    row = np.full(n_tokens, -1, np.int64)
    base = np.setdiff1d(np.arange(n_tokens), made)
    row[base] = np.arange(len(base))
    row[made] = len(base) + np.arange(len(made))
    blocked = np.zeros((n_tokens, (len(inner) + 7) // 8), np.uint8)
    for u, v, w in zip(left.tolist(), right.tolist(), made.tolist(), strict=True):
        su, rw, rv = slot[u], row[w], row[v]
        bit = np.uint8(1 << (su & 7))
        blocked[rw] = blocked[row[u]]
        if (sw := slot[w]) >= 0:
            sv = slot[v]
            column = (blocked[: rw + 1, sv >> 3] >> np.uint8(sv & 7)) & np.uint8(1)
            if column.any():
                blocked[: rw + 1, sw >> 3] |= column << np.uint8(sw & 7)
        if u == v:
            blocked[rw, su >> 3] |= bit
        blocked[rv, su >> 3] |= bit
    # minimise: equal rows are one arc class, equal columns are one state
    keys: dict[bytes, int] = {}
    arc = np.array([keys.setdefault(blocked[r].tobytes(), len(keys)) for r in row], np.int32)
    del blocked
    classes = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), -1)
    width = (len(keys) + 7) // 8
    states = {bytes(width): 0}
    state = np.full(n_tokens, -1, np.int32)
    for at in range(0, classes.shape[1], 64):
        bits = np.unpackbits(classes[:, at : at + 64], axis=1, bitorder="little").T
        for k, c in enumerate(np.packbits(bits, axis=1, bitorder="little")):
            if at * 8 + k < len(inner):
                state[inner[at * 8 + k]] = states.setdefault(c.tobytes(), len(states))
    return state, arc, np.frombuffer(b"".join(states), np.uint8).reshape(len(states), width)


def double_array(edges: dict[tuple[int, int], int], n_nodes: int):
    """Pack trie edges ``(node, symbol) -> node`` so that ``base[node] + symbol`` is their place."""
    children: dict[int, list[tuple[int, int]]] = {}
    for (a, c), b in edges.items():
        children.setdefault(a, []).append((c, b))
    base = np.full(n_nodes, 0, np.int32)
    size = 3 * len(edges) + 70_000
    owner, target = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    taken = bytearray(size)
    cursor = 0

    def put(a: int, at: int) -> None:
        base[a] = at
        for c, b in children[a]:
            taken[at + c] = 1
            owner[at + c], target[at + c] = a, b

    forks = [a for a, found in children.items() if len(found) > 1]
    for a in sorted(forks, key=lambda a: -len(children[a])):
        tries, at = 0, cursor
        while any(taken[at + c] for c, _ in children[a]):
            at += 1
            tries += 1
        put(a, at)
        if tries > 20:
            cursor += tries // 2
    free = (k for k in range(256, size) if not taken[k])
    for a, found in children.items():
        if len(found) == 1:
            put(a, next(free) - found[0][0])
    return base, owner, target


class Automaton:
    """Compiled form of one tokenizer file; plain arrays only, so it pickles and broadcasts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            source = f.read()
        spec = json.loads(source)
        self.key = zlib.crc32(source.encode())
        model = spec["model"]
        if model.get("end_of_word_suffix") != END or model.get("dropout") or model.get("byte_fallback"):
            raise ValueError("only merge lists with word-end symbols are supported")
        vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.names = [""] * n
        for k, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = k
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64)
        if len(np.unique(ids[:, 2])) != len(ids):
            raise ValueError("two merges make one token")
        final = np.array([x.endswith(END) for x in self.names])
        self.state, self.arc, self.table = compile_table(ids[:, 0], ids[:, 1], ids[:, 2], n, final)
        self._trie(vocab)

    def _trie(self, vocab: dict[str, int]) -> None:
        """Reversed spellings in a trie: walking back from a position meets every token that ends there.

        Edge symbols are byte values; the word-end symbol is carried by which root the walk starts at.
        """
        code = {c: b for b, c in enumerate(byte_symbols())}
        nodes: dict[tuple[int, int], int] = {}
        token, count = [-1, -1], 2
        for name, i in vocab.items():
            end = name.endswith(END)
            at = int(end)
            for c in reversed(name[: -len(END)] if end else name):
                nxt = nodes.get((at, code[c]))
                if nxt is None:
                    nxt = nodes[(at, code[c])] = count
                    token.append(-1)
                    count += 1
                at = nxt
            token[at] = i
        self.base, self.owner, self.target = double_array(nodes, count)
        self.ends = np.array(token, np.int32)

    def encode_words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words ``data[start:start + length]``, one after another, and how many each word has."""
        n = len(starts)
        order = np.argsort(lengths, kind="stable")
        sizes = lengths[order]
        words, ids, steps = [], [], []
        at = int(np.searchsorted(sizes, 1))
        while at < n:
            # words of like length together; bounded cells, so one very long word stays cheap
            top = int(sizes[at])
            top = top + 4 if top < 64 else top * 2
            upto = min(int(np.searchsorted(sizes, top, "right")), at + max(1, 4_000_000 // top))
            part = order[at:upto]
            for step, (who, got) in enumerate(self._encode(data, starts[part], lengths[part])):
                words.append(part[who])
                ids.append(got)
                steps.append(np.full(len(who), step, np.int32))
            at = upto
        if not words:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        word, token, step = np.concatenate(words), np.concatenate(ids), np.concatenate(steps)
        # words are read off from their ends
        place = np.lexsort((-step, word))
        return token[place], np.bincount(word, minlength=n)

    def _encode(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Yields the last tokens of all words, then those before them, and so on: ``(word, token)`` arrays."""
        n = len(starts)
        width = int(lengths.max())
        # last[i, j]: the last token of the one segmentation of the first j bytes, -1 where there is none
        last = np.full((n, width + 1), -1, np.int32)
        back = np.zeros((n, width + 1), np.int32)
        state = np.full((n, width + 1), -1, np.int32)
        state[:, 0] = 0
        table, ends, arc, behind = self.table, self.ends, self.arc, self.state
        base, owner, target = self.base, self.owner, self.target
        rows = np.arange(n)
        # a prefix and the whole word differ in their last symbol, so the end of a word has its own walk
        for j in range(1, width + 1):
            for whole in (False, True):
                who = rows[lengths == j] if whole else rows[lengths > j]
                if not len(who):
                    continue
                node = np.full(len(who), int(whole), np.int32)
                best, size = np.full(len(who), -1, np.int32), np.zeros(len(who), np.int32)
                live = np.arange(len(who))
                for k in range(1, j + 1):
                    place = base[node] + flat[starts[who[live]] + j - k]
                    some = owner[place] == node
                    live, node = live[some], target[place[some]]
                    if not len(live):
                        break
                    token = ends[node]
                    before = state[who[live], j - k]
                    fits = (token >= 0) & (before >= 0)
                    to = arc[token[fits]]
                    fits[fits] = (table[before[fits], to >> 3] >> (to & 7).astype(np.uint8)) & 1 == 0
                    best[live[fits]], size[live[fits]] = token[fits], k
                last[who, j], back[who, j] = best, size
                if not whole:
                    state[who, j] = np.where(best >= 0, behind[best], -1)
        pos, live = lengths.astype(np.int64), rows
        while len(live):
            got = last[live, pos[live]]
            if (got < 0).any():
                raise ValueError("a word has no path; the vocabulary lacks a base symbol")
            yield live, got
            pos[live] -= back[live, pos[live]]
            live = live[pos[live] > 0]

    def pieces(self, chunk: str) -> list[bytes | int]:
        """Pre-split words (bytes) and special tokens (ids) of a text of any kind."""
        if "<|" in chunk:
            parts = self._specials().split(chunk)
            if len(parts) > 1:
                found: list[bytes | int] = []
                for k, part in enumerate(parts):
                    found += [self.special[part]] if k % 2 else self.pieces(part)
                return found
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        chunk = chunk.lower()
        if chunk.isalpha():
            return [chunk.encode()]
        if chunk[-1:] in (",", ".") and chunk[:-1].isalpha():
            return [chunk[:-1].encode(), chunk[-1:].encode()]
        return [w.encode() for w in SPLIT.findall(chunk)]

    def _specials(self):
        return regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")

    def labels(self) -> tuple[list[bytes], list[bytes]]:
        """Each token's number and its arc label, with a space behind."""
        if not hasattr(self, "_labels"):
            self._labels = [b"%d " % i for i in range(len(self.names))], [x.encode() + b" " for x in self.names]
        return self._labels

    def decode(self, ids) -> str:
        """The arc labels of a path, as the library's decoder-less decode() joins them."""
        return " ".join([self.names[i] for i in ids])


# Byte classes of plain text: letters, digits, and what else stands in runs of its own.  Quotes that may
# begin a contraction, separators and whatever is not ASCII are 0.
LETTER, DIGIT, OTHER = 1, 2, 3
CLASS = np.zeros(256, np.uint8)
CLASS[[b for b in range(0x21, 0x7F) if b != 0x27]] = OTHER
CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
CLASS[[*range(0x30, 0x3A)]] = DIGIT


def _two_byte_letters() -> tuple[np.ndarray, np.ndarray]:
    """For code points of two bytes: whether one is a letter that stays one when normalised, and what it becomes."""
    good, to = np.zeros(0x800, bool), np.arange(0x800)
    for c in range(0x80, 0x800):
        low = unicodedata.normalize("NFC", chr(c)).replace("Σ", "σ").lower()
        if len(low) == 1 and 0x80 <= ord(low) < 0x800 and unicodedata.category(low)[0] == "L" and unicodedata.normalize("NFC", low) == low:
            good[c], to[c] = True, ord(low)
    return good, to


class Encoder:
    """Encodes Arrow batches of texts, each distinct white-space delimited chunk once.

    White space is never part of a token and nothing before it changes what follows, so a chunk's ids
    depend on the chunk alone.  Chunks are told apart by 64-bit hashes.  Plain chunks, of letters of one or
    two bytes, digits and signs, are normalised and split into words as arrays; the others one by one, as
    texts.  Distinct words meet the automaton together.  Ids of up to ``limit`` words, and of as many other
    chunks, are kept from batch to batch, or those of one batch; that saves time and never changes results.
    """

    def __init__(self, automaton: Automaton, limit: int = 300_000):
        self.automaton, self.limit = automaton, limit
        self.memo: dict[int, np.ndarray] = {}
        self.known, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.letter, self.low = _two_byte_letters()

    def batch(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(inverse, ids, starts, counts)``: word k has the ids from ``starts[inverse[k]]`` on, ``counts[...]`` of them."""
        distinct, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        size = (words.ends - words.starts)[first]
        data, _ = take(words.data, words.starts[first], size)
        bounds = np.concatenate(([0], np.cumsum(size)))
        plain, data, kind = self._classes(data, bounds)
        keep = np.repeat(plain, size)
        ids, n = self._plain(data[keep], kind[keep], size[plain])
        counts = np.zeros(len(distinct), np.int64)
        counts[plain] = n
        odd = np.flatnonzero(~plain)
        texts = [words.data[a:b].tobytes().decode() for a, b in zip(words.starts[first[odd]].tolist(), words.ends[first[odd]].tolist(), strict=True)]
        more = self._others(distinct[odd].tolist(), texts)
        counts[odd] = [len(x) for x in more]
        starts = np.zeros(len(distinct), np.int64)
        starts[plain] = np.cumsum(n) - n
        starts[odd] = len(ids) + np.cumsum(counts[odd]) - counts[odd]
        return inverse, np.concatenate((ids, *more)).astype(np.int32), starts, counts

    def _classes(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which chunks are plain, and all bytes in lower case with their classes."""
        kind = CLASS[data]
        low = LOWER_BYTE[data]
        lead = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
        point = (data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63
        lead, point = lead[self.letter[point]], self.low[point[self.letter[point]]]
        kind[lead], kind[lead + 1] = LETTER, LETTER
        low[lead], low[lead + 1] = 0xC0 | point >> 6, 0x80 | point & 63
        # special tokens begin so
        mark = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        kind[mark] = 0
        bad = np.concatenate(([0], np.cumsum(kind == 0)))
        return bad[bounds[1:]] == bad[bounds[:-1]], low, kind

    def _plain(self, data: np.ndarray, kind: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain chunks, one after another, and how many each has."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
        new = kind == DIGIT
        new[1:] |= kind[1:] != kind[:-1]
        begin = np.cumsum(size) - size
        new[begin] = True
        at = np.flatnonzero(new)
        length = np.diff(at, append=len(data))
        distinct, first, inverse = np.unique(hash_spans(data, at, at + length), return_index=True, return_inverse=True)
        starts, n = self._words(distinct, data, at[first], length[first])
        out, each = take(self.ids, starts[inverse], n[inverse])
        return out, np.add.reduceat(each, np.searchsorted(at, begin))

    def _words(self, distinct: np.ndarray, data: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` each of some distinct words begins, given by sorted hashes, and how many ids it has."""
        place = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        held = self.known[place] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        ids, n = self.automaton.encode_words(data, at[~held], length[~held])
        starts, counts = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        starts[held], counts[held] = self.starts[place[held]], self.counts[place[held]]
        starts[~held], counts[~held] = len(self.ids) + np.cumsum(n) - n, n
        self.ids = np.concatenate((self.ids, ids))
        if len(self.known) + len(n) > self.limit:
            # what this batch has stays
            self.ids, _ = take(self.ids, starts, counts)
            starts = np.cumsum(counts) - counts
            self.known, self.starts, self.counts = distinct, starts, counts
        elif len(n):
            every = np.concatenate((self.known, distinct[~held]))
            order = np.argsort(every, kind="stable")
            self.known = every[order]
            self.starts, self.counts = (np.concatenate((x, y[~held]))[order] for x, y in ((self.starts, starts), (self.counts, counts)))
        return starts, counts

    def _others(self, keys: list[int], texts: list[str]) -> list[np.ndarray]:
        """Ids of each of some chunks of any kind."""
        if len(self.memo) + len(keys) > self.limit:
            self.memo = {}
        out = [self.memo.get(k) for k in keys]
        missed = [k for k, v in enumerate(out) if v is None]
        pieces = [self.automaton.pieces(texts[k]) for k in missed]
        fresh = list({p for x in pieces for p in x if isinstance(p, bytes)})
        size = np.fromiter(map(len, fresh), np.int64, len(fresh))
        ids, n = self.automaton.encode_words(np.frombuffer(b"".join(fresh), np.uint8), np.cumsum(size) - size, size)
        known = dict(zip(fresh, np.split(ids, np.cumsum(n)[:-1]), strict=True)) if fresh else {}
        for k, x in zip(missed, pieces, strict=True):
            found = [known[p] if isinstance(p, bytes) else np.array([p], np.int32) for p in x]
            out[k] = np.concatenate(found) if found else np.zeros(0, np.int32)
            self.memo[keys[k]] = out[k]
        return out


def take(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items ``flat[start:start + count]`` of all spans, one after another, and the counts."""
    total = int(counts.sum())
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    at += np.arange(total)
    return flat[at], counts


def spread(inverse: np.ndarray, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values one after another, and how many each has."""
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    return take(np.frombuffer(b"".join(values), np.uint8), (np.cumsum(lengths) - lengths)[inverse], lengths[inverse])


_KEPT: dict[tuple[str, int, int], Automaton] = {}


def automaton(path: str) -> Automaton:
    """The compiled automaton of a tokenizer file, compiled once a process."""
    st = os.stat(path)
    key = (path, st.st_size, st.st_mtime_ns)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Automaton(path)
    return _KEPT[key]
