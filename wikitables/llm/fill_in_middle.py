"""Fill-in-middle transformation: texts are cut at line ends into prefix, middle and suffix, and put in a new order.

A text's units are its lines, ``[^\\n]*\\n|[^\\n]+``.  Units are found by word
arithmetic: the UTF-8 bytes of many texts are seen as 64-bit words, in which
the high bit of each byte that ends a unit is set by carries that stay inside
their byte.  A bit count per word and its running sum give the number of units
before any byte; the word that holds the k-th unit end is found by binary
search in that sum, and the byte within it by clearing the lower marks.  Code
points are counted by the same means, as bytes that do not continue another.
Nothing is done per character, and at most one text or about 1 MB of texts is
held at a time.

Forms: ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` is
``<S>`` suffix ``<P>`` prefix ``<M>`` middle, ``plain`` is the text as it is.
Texts that are empty or hold a marker stay plain, so that the text can always
be rebuilt (``restored``).  The draws are the first four groups of eight
hexadecimal digits of sha256 of ``seed:doc_id``; nothing else is random.

Defined results: a null text is an empty text; a null id is drawn like an empty
one; rows with equal ids get equal draws and are rows of their own; an empty
table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, table, whole_text

SEED = 7
# Of 100 texts so many are transformed, and of these so many as spm.
RATE, SPM = 100, 50
MARKERS = (b"<P>", b"<S>", b"<M>")
_U = np.uint64
_ONES = _U(0x0101010101010101)
_LOW7 = _U(0x7F7F7F7F7F7F7F7F)
_NEWLINES = _U(0x0A0A0A0A0A0A0A0A)


def as_words(data: bytes | memoryview) -> np.ndarray:
    """The bytes as little-endian words, the last filled with zeros."""
    words = np.zeros((len(data) + 7) // 8 + 1, "<u8")
    words.view(np.uint8)[: len(data)] = np.frombuffer(data, np.uint8)
    return words


def newline_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is a newline; no carry leaves its byte, so there are no false marks."""
    x = words ^ _NEWLINES
    return ~(((x & _LOW7) + _LOW7) | x | _LOW7)


def continuation_marks(words: np.ndarray) -> np.ndarray:
    """The low bit of each byte 10xxxxxx."""
    return (words >> _U(7)) & ~(words >> _U(6)) & _ONES


class Marks:
    """Counts and places of marked bytes."""

    def __init__(self, marks: np.ndarray) -> None:
        self.marks = marks
        self.before = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks before the bytes ``at``."""
        word = at >> 3
        below = (_U(1) << ((at & 7).astype(_U) << _U(3))) - _U(1)
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The bytes of the marks numbered ``k`` from 0."""
        word = np.searchsorted(self.before, k, side="right") - 1
        left, held = k - self.before[word], self.marks[word]
        for _ in range(7):
            held = np.where(left > 0, held & (held - _U(1)), held)
            left = left - 1
        lowest = held & (~held + _U(1))
        return word * 8 + (np.bitwise_count(lowest - _U(1)) >> 3)


def cuts(data: bytes | memoryview, starts: np.ndarray, ends: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts at ``starts`` to ``ends``: units, the ends of prefix and middle by the draws, and their code points."""
    words = as_words(data)
    lines, inner = Marks(newline_marks(words)), Marks(continuation_marks(words))
    first = lines.rank(starts)
    last = words.view(np.uint8)[np.maximum(ends - 1, 0)]
    n = lines.rank(ends) - first + ((ends > starts) & (last != 10))
    ks = np.sort(np.stack([one % (n + 1), two % (n + 1)]), axis=0)
    stops = []
    for k in ks:
        inside = (k > 0) & (k < n)
        at = np.where(k > 0, ends, starts)
        at[inside] = lines.select((first + k - 1)[inside]) + 1
        stops.append(at)
    prefix, middle = (hi - lo - (inner.rank(hi) - inner.rank(lo)) for lo, hi in ((starts, stops[0]), (stops[0], stops[1])))
    return n, stops[0], stops[1], prefix, middle


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM
) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars and the output text of each document."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(drawn, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    plain = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"), *draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                texts = [t.as_buffer().to_pybytes() for t in part.column(1)]
                h1, h2, h3, h4 = (part.column(k).to_numpy() for k in range(2, 6))
                ends = np.cumsum([len(t) for t in texts])
                starts = np.concatenate([[0], ends[:-1]])
                n, *stops, prefix, middle = cuts(b"".join(texts), starts, ends, h1, h2)
                stops = [s - starts for s in stops]
                outputs, forms = [], []
                for k, t in enumerate(texts):
                    if not t or h3[k] % 100 >= rate or any(m in t for m in MARKERS):
                        forms.append("plain")
                        outputs.append(t)
                        continue
                    head, rest = stops[0][k], stops[1][k]
                    first, last = (b"<P>", t[:head]), (b"<S>", t[rest:])
                    forms.append("spm" if h4[k] % 100 < spm else "psm")
                    if forms[-1] == "spm":
                        first, last = last, first
                    outputs.append(b"".join((*first, *last, b"<M>", t[head:rest])))
                plain_rows = np.array([f == "plain" for f in forms])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(n, pa.int64()),
                        pa.array(forms, pa.string()),
                        pa.array(prefix, pa.int64(), mask=plain_rows),
                        pa.array(middle, pa.int64(), mask=plain_rows),
                        pa.array(outputs, pa.binary()).cast(pa.string()),
                    ],
                    ["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    kind = plain.schema["id"].dataType.simpleString()
    made = plain.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form.  A marked output holds each marker once, as its text holds none."""
    parts = F.split(output, "<[PSM]>")
    psm = F.concat(F.element_at(parts, 2), F.element_at(parts, 4), F.element_at(parts, 3))
    spm = F.concat(F.element_at(parts, 3), F.element_at(parts, 4), F.element_at(parts, 2))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
             ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
k AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
"""
