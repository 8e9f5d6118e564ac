"""Secret scan: candidates by pattern, judged by a character convolutional network.

Base findings are three kinds of pattern match and always stay.  Candidates beside them, which the network
adds if their calibrated probability reaches the threshold of their kind and they overlap no base finding:

* tokens of 20 or more characters that mix letters and digits, or upper and lower case;
* quoted strings of 12 or more such characters, whatever they mix;
* values of 6 or more characters behind a credential name, and passwords in addresses.

All of them are reported as ``token``.  A candidate's probability is the largest over windows that cover all
of it.  The network scores base findings too; ``min_score`` and ``max_score`` report its range over a
document's spans.

Spans are counted in code points, the end exclusive.  Null and empty texts have none, and null texts stay
null when they are redacted.  Rows are scanned one by one, whole, however long; a repeated row gives the same
result again, and an empty table an empty table.  Other columns, whatever their names, are kept by
:func:`redact` and ignored by :func:`scan`.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .secret_model import KINDS, Network, trained
from .words import SPACES, split_words, text_slices

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=.-]{20,}")
VALUE = re.compile(r"""(?ai:password|passwd|secret|token|api_?key|auth|private_key|bearer|access_key|credential)["']?\x20*(?:=>|[:=])\x20*["']?([A-Za-z0-9+/_.=-]{6,})""")
QUOTED = re.compile(r"""["']([A-Za-z0-9+/_=.-]{12,})["']""")
ADDRESS = re.compile(r"://[^\s:/@\"']{1,64}:([^\s:/@\"']{4,})@")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
VALUE_NAMES = (*NAMES, "auth", "private_key", "bearer", "access_key", "credential")
SHORTEST = 20  # bytes of the shortest finding other than assignments
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long, min_score double, max_score double"


def base_spans(text: str, long_tokens: bool = True) -> list[tuple[int, int, str, int, int]]:
    """``(start, end, kind, value start, value end)`` of base findings, by start and then kind."""
    found = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(n in low for n in NAMES):
            found += [(m.start(), m.end(), "assign", m.start(1), m.end(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if long_tokens:
        if "AKIA" in text:
            found += [(m.start(), m.end(), "access", m.start(), m.end()) for m in ACCESS.finditer(text)]
        found += [(m.start(), m.end(), "hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _overlaps(span: tuple[int, int], base) -> bool:
    return any(a < span[1] and span[0] < b for a, b, *_ in base)


def extra_candidates(text: str, base) -> list[tuple[int, int]]:
    """Long mixed tokens and quoted strings that overlap no base finding."""
    out = []
    for m in TOKEN.finditer(text):
        s = m.group()
        mixed = any(c.isdigit() for c in s) and any(c.isalpha() for c in s)
        if (mixed or not (s[1:].islower() or s.isupper() or not s[1:].upper().lower().isalpha())) and not _overlaps(m.span(), base):
            out.append(m.span())
    if '"' in text or "'" in text:
        held = set(out)
        out += [m.span(1) for m in QUOTED.finditer(text) if m.span(1) not in held and not _overlaps(m.span(1), base)]
    return out


def named_values(text: str, base) -> list[tuple[int, int]]:
    """Values behind credential names, and passwords in addresses, that overlap no base finding."""
    if ":" not in text and "=" not in text:
        return []
    found = [m.span(1) for m in ADDRESS.finditer(text)] if "://" in text else []
    low = text.lower()
    if any(n in low for n in VALUE_NAMES):
        found += [m.span(1) for m in VALUE.finditer(text)]
    return [x for x in dict.fromkeys(found) if not _overlaps(x, base)]


def scan_texts(texts: list[tuple[int, str, bool]], net: Network):
    """``(row, base, added, scores)`` of each text that has candidates; the network runs once for all."""
    rows, asked = [], []
    for row, text, long_tokens in texts:
        base = base_spans(text, long_tokens)
        more = {s: "token" for s in extra_candidates(text, base)} if long_tokens else {}
        more = {**dict.fromkeys(named_values(text, base), "assign"), **more}
        if base or more:
            rows.append((row, base, more))
            asked += [(text, a, b) for a, b in [*[(s[0], s[1]) for s in base], *more]]
    p = net.largest(asked)
    at = 0
    for row, base, more in rows:
        scores = p[at : at + len(base) + len(more)]
        at += len(scores)
        kept = [(s, v) for (s, kind), v in zip(more.items(), scores[len(base) :], strict=True) if v >= net.thresholds[kind]]
        # a value inside a larger finding is part of it
        kept = sorted((s, v) for s, v in kept if not any(t != s and t[0] <= s[0] and s[1] <= t[1] for t, _ in kept))
        yield row, base, [s for s, _ in kept], np.concatenate((scores[: len(base)], [v for _, v in kept]))


def _candidates(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str, bool]]:
    """The rows that can hold findings, with whether they have a long enough token."""
    w = split_words(data, offsets, separators=SPACES)
    long_rows = np.zeros(len(offsets) - 1, bool)
    size = w.ends - w.starts
    quote = (data == 0x22) | (data == 0x27)
    # a quoted string that stands on its own is a word that begins with the quote, or with a bracket and it
    quoted = (size >= 14) & (quote[w.starts] | quote[np.minimum(w.starts + 1, max(0, len(data) - 1))]) if len(data) else size >= 14
    long_rows[np.searchsorted(offsets, w.starts[(size >= SHORTEST) | quoted], "right") - 1] = True
    marks = np.flatnonzero((data == 0x3A) | (data == 0x3D))
    marked = np.zeros(len(offsets) - 1, bool)
    marked[np.searchsorted(offsets, marks, "right") - 1] = True
    return [(d, data[offsets[d] : offsets[d + 1]].tobytes().decode(), bool(long_rows[d])) for d in np.flatnonzero(long_rows | marked).tolist()]


def scan(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """One row of counts, spans and digests for each row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(net or trained())
    empty = hashlib.sha256(b"").hexdigest()

    def step(batch):
        for rows, data, offsets in text_slices(batch, "text", 8 << 20):
            n = len(offsets) - 1
            counts = {k: np.zeros(n, np.int64) for k in (*KINDS[:3], "added")}
            digest, spans = [empty] * n, [""] * n
            low, high = [None] * n, [None] * n
            for d, base, added, scores in scan_texts(_candidates(data, offsets), shared.value):
                for s in base:
                    counts[s[2]][d] += 1
                counts["added"][d] = len(added)
                digest[d] = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k, *_ in base).encode()).hexdigest()
                both = sorted([(a, b, k) for a, b, k, *_ in base] + [(a, b, "token") for a, b in added], key=lambda x: (x[0], KINDS.index(x[2])))
                spans[d] = ",".join(f"{k}:{a}:{b}" for a, b, k in both)
                if len(scores):
                    low[d], high[d] = round(float(scores.min()), 6), round(float(scores.max()), 6)
            yield common.arrow(doc_id=common.rows_of(batch, "doc_id", rows), n_assign=counts["assign"], n_access=counts["access"], n_hex=counts["hex"], base_sha256=digest, spans=spans, n_added=counts["added"], min_score=pa.array(low, pa.float64()), max_score=pa.array(high, pa.float64()))

    return common.map_arrow(common.texts(docs), step, SCHEMA)


def redact(docs: DataFrame, net: Network | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding of its ``text`` replaced; all rows and columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(net or trained())
    schema = docs.schema

    def step(batch):
        place = batch.schema.get_field_index("text")
        for rows, data, offsets in text_slices(batch, "text", 8 << 20):
            part = batch.slice(rows.start, rows.stop - rows.start)
            texts = None
            found = _candidates(data, offsets)
            picked = {d: t for d, t, _ in found}
            for d, base, added, _ in scan_texts(found, shared.value):
                text, out, at = picked[d], [], 0
                for a, b in sorted([(a, b) for *_, a, b in base] + added):
                    if b > at:
                        out += [text[at:a], mark] if a >= at else []
                        at = max(at, b)
                texts = texts or part.column(place).to_pylist()
                texts[d] = "".join(out) + text[at:]
            if texts:
                part = part.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))
            yield part

    return common.map_arrow(docs, step, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
