"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A text is cut into paragraphs: its lines, and these at sentence ends.  Each paragraph has a wide vector of
48 numbers of 6 bits, taken from two SHA-256 digests, and the fingerprint is the vectors' sum.  Sums do
not depend on order, so equal multisets of paragraphs have equal fingerprints, and adding or taking away
a paragraph's vector inserts or deletes it (:func:`combine`).  The number of paragraphs is one more lane.

Two lanes share a long, 30 bits each and a spare bit above, so a vector is 24 longs whose lanes are summed
modulo 2**30 without reaching into each other, whatever the number of paragraphs.

Likeness is the cosine between two fingerprints' lanes after the mean of a random lane is taken away: it
estimates how much of the two multisets is shared.  What is left is small and so known in spite of the
modulus, unless one paragraph comes more than 2**24 times.  Equal fingerprints give 1, negative estimates 0.

Null is the empty text: no paragraph, all lanes 0.  Two empty texts are alike (1), an empty and another
text are not (0).  Of rows with one ``doc_id``, the smaller text comes first; null ids come last in
descending order.  Texts of any length are read whole; an empty table gives an empty table.  Other columns
are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.visits import small
from . import common
from .ranges import Ranges

DIGESTS = 2  # SHA-256 digests of a paragraph
WORDS = 4  # 60-bit words taken from a digest
SHIFTS = (0, 10, 20)  # each leaves two lanes of a word, at bits 0 and 30
LANE, HALF = 6, 31
TOP = (1 << LANE) - 1  # twice the mean of a lane
PAIR = TOP | TOP << HALF
LOW = (1 << (HALF - 1)) - 1
BOTH = LOW | LOW << HALF
SPARE = (LOW + 1) | (LOW + 1) << HALF
#: Bytes of text in one ordered group of the search for next documents.
GROUP = 16 << 20


def _digest(k: int):
    return lambda x: F.sha2(F.concat(F.lit(f"{k}:"), x), 256)


def _word(k: int):
    return lambda x: F.conv(F.substring(x, 1 + 15 * k, 15), 16, 10).cast("long")


def _add(shift: int):
    return lambda a, x: (a + F.shiftright(x, shift).bitwiseAND(F.lit(PAIR))).bitwiseAND(F.lit(BOTH))


def with_lanes(df: DataFrame, text: str, to: str) -> DataFrame:
    """Adds column ``to``: the number of paragraphs, then the summed longs."""
    # separate steps, so that digests and words are made once and not again for each lane
    names = [f"{to}_d{k}" for k in range(DIGESTS)]
    words = [f"{to}_w{k}" for k in range(DIGESTS * WORDS)]
    df = df.withColumn(to, F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\n|\. "), lambda x: x != ""))
    df = df.withColumns({n: F.transform(to, _digest(k)) for k, n in enumerate(names)})
    df = df.withColumns({w: F.transform(names[k // WORDS], _word(k % WORDS)) for k, w in enumerate(words)})
    sums = [F.aggregate(w, F.lit(0).cast("long"), _add(s)) for w in words for s in SHIFTS]
    return df.withColumn(to, F.array(F.size(to).cast("long"), *sums)).drop(*names, *words)


def render(vector):
    """Fixed-width hexadecimal text of a fingerprint."""
    return F.array_join(F.transform(vector, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def combine(a, b, sign: int = 1):
    """Fingerprint lanes of two multisets put together (``sign`` 1) or of ``a`` without ``b`` (-1)."""
    # spare bits lend to the lanes below them
    return F.zip_with(a, b, lambda x, y: (x + F.lit(SPARE if sign < 0 else 0) + F.lit(sign) * y).bitwiseAND(F.lit(BOTH)))


def _centred(a):
    """Twice all lanes, less what random lanes would have on average, as the nearest to 0 modulo 2**31."""
    mean = F.element_at(a, 1) * F.lit(TOP)
    near = lambda x: (F.pmod(2 * x - mean + (LOW + 1), F.lit(2 * (LOW + 1))) - (LOW + 1)).cast("double")
    longs = F.slice(a, 2, DIGESTS * WORDS * len(SHIFTS))
    low = F.transform(longs, lambda x: near(x.bitwiseAND(F.lit(LOW))))
    return F.concat(low, F.transform(longs, lambda x: near(F.shiftright(x, HALF))))


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a, b, ca, cb):
    """Likeness of fingerprints ``a`` and ``b`` with centred lanes ``ca`` and ``cb``."""
    size = F.sqrt(_dot(ca, ca) * _dot(cb, cb))
    cosine = F.when(size > 0, F.round(_dot(ca, cb) / size, 6)).otherwise(F.lit(0.0))
    none = (F.element_at(a, 1) == 0) | (F.element_at(b, 1) == 0)
    return F.when(a == b, F.lit(1.0)).when(none, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def with_next(docs: DataFrame) -> DataFrame:
    """Each row of ``docs(doc_id, text)`` with its ``lanes`` and ``next``: text and lanes of the next one.

    Next is descending by ``doc_id``, after the last the first.  Rows are grouped by ranges of ``doc_id`` that
    hold about ``GROUP`` bytes of text.  After a range's last row comes the first of the next lower range:
    range numbers are matched alone, then one text a range is sent to its neighbour.  Lanes are made once a
    row and travel with their text.
    """
    ranges = Ranges(docs, GROUP)
    rows = docs.withColumn("place", ranges.column())
    item = F.struct("text", "lanes")
    tops = rows.groupBy("place").agg(F.max("doc_id").alias("top"))
    first = rows.join(small(tops.withColumnRenamed("place", "top_place")), (F.col("place") == F.col("top_place")) & F.col("doc_id").eqNullSafe(F.col("top")))
    heads = with_lanes(first.groupBy("place").agg(F.min("text").alias("text")), "text", "lanes").select("place", item.alias("tail"))
    # numbers only, one a range
    down = Window.orderBy(F.desc("place"))
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = tops.select(F.col("place").alias("tail_place"), F.coalesce(F.lead("place").over(down), F.first("place").over(whole)).alias("place"))
    tails = heads.join(follows, "place").select("tail_place", "tail")
    inside = Window.partitionBy("place").orderBy(F.desc_nulls_last("doc_id"), F.asc("text"))
    led = with_lanes(rows, "text", "lanes").withColumn("next", F.lead(item).over(inside))
    joined = led.join(tails, F.col("place") == F.col("tail_place"))
    return joined.select("doc_id", "text", "lanes", F.coalesce("next", "tail").alias("next"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """``doc_id, n_paragraphs, fingerprint`` of each row."""
    made = with_lanes(common.texts(docs), "text", "lanes")
    return made.select("doc_id", F.element_at("lanes", 1).alias("n_paragraphs"), render(F.col("lanes")).alias("fingerprint"))


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form, and likeness to that and to the next text."""
    rows = common.texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    rows = with_next(rows).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next.text", F.lit(1), half))
    rows = with_lanes(rows.withColumn("edited", edited), "edited", "edited_lanes").withColumn("next_lanes", F.col("next.lanes"))
    rows = rows.withColumns({f"{n}centred": _centred(F.col(f"{n}lanes")) for n in ("", "edited_", "next_")})
    like = lambda n: likeness(F.col("lanes"), F.col(f"{n}_lanes"), F.col("centred"), F.col(f"{n}_centred"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        render(F.col("lanes")).alias("fingerprint"),
        render(F.col("edited_lanes")).alias("edited_fingerprint"),
        like("edited").alias("near_edited"),
        like("next").alias("near_next"),
    )


def _sql_lanes(parts: str) -> str:
    sums = []
    for k in range(DIGESTS * WORDS):
        word = f"CAST('0x' || substr(sha256('{k // WORDS}:' || x), {1 + 15 * (k % WORDS)}, 15) AS BIGINT)"
        lane = lambda s, word=word: f"coalesce(list_sum(list_transform({parts}, lambda x: (({word}) >> {s}) & {TOP})), 0) % {LOW + 1}"
        sums += [f"CAST({lane(s)} + ({lane(s + HALF)}) * {1 << HALF} AS BIGINT)" for s in SHIFTS]
    return f"[CAST(len({parts}) AS BIGINT), {', '.join(sums)}]"


def sql() -> str:
    n = DIGESTS * WORDS * len(SHIFTS)
    wide = 2 * (LOW + 1)
    near = lambda a, x: f"CAST(((2 * ({x}) - {a}[1] * {TOP} + {LOW + 1}) % {wide} + {wide}) % {wide} - {LOW + 1} AS DOUBLE)"
    centred = lambda a: f"list_concat(list_transform({a}[2:{n + 1}], lambda x: {near(a, f'x & {LOW}')}), list_transform({a}[2:{n + 1}], lambda x: {near(a, f'x >> {HALF}')}))"
    text = lambda a: f"array_to_string(list_transform({a}, lambda x: printf('%016x', x)), '')"
    like = lambda a, b, ca, cb: (
        f"CASE WHEN {a} = {b} THEN 1.0 WHEN {a}[1] = 0 OR {b}[1] = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, round("
        f"list_inner_product({ca}, {cb}) / sqrt(list_inner_product({ca}, {ca}) * list_inner_product({cb}, {cb})), 6))) END"
    )
    return f"""
WITH docs AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text FROM documents),
led AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST, text)) AS next_text
        FROM docs WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text)),
made AS (SELECT doc_id, text, length(text) AS n_chars, next_text,
         substr(text, 1, CAST(length(text) - length(text) // 2 AS BIGINT)) || substr(next_text, 1, CAST(length(text) // 2 AS BIGINT)) AS edited FROM led),
parts AS (SELECT doc_id, n_chars, edited, {", ".join(f"list_filter(string_split_regex({c}, '\\n|\\. '), lambda x: x <> '') AS {c}_parts" for c in ("text", "edited", "next_text"))} FROM made),
lanes AS (SELECT doc_id, n_chars, edited, {", ".join(f"{_sql_lanes(f'{c}_parts')} AS {c[0]}" for c in ("text", "edited", "next_text"))} FROM parts),
centred AS (SELECT *, {", ".join(f"{centred(c)} AS c{c}" for c in "ten")} FROM lanes)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, {text("t")} AS fingerprint, {text("e")} AS edited_fingerprint,
  CAST({like("t", "e", "ct", "ce")} AS DOUBLE) AS near_edited, CAST({like("t", "n", "ct", "cn")} AS DOUBLE) AS near_next
FROM centred
"""


def query(spark, sf_dir: str) -> DataFrame:
    return compare(common.table(spark, sf_dir, "documents"))
