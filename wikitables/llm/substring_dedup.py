"""Substring deduplication by recompression: equal word sequences get equal interior symbols.

Words are hashed, and rounds of recompression give new symbols to maximal runs
of one symbol and to pairs whose first symbol is a left and whose second is a
right one (by a bit of the symbol).  A symbol's name is a hash of its parts, so
Spark names them globally without a dictionary, and each symbol knows the words
that decide it.  A window of WINDOW words therefore has the same decided
symbols wherever it occurs.  Each window chooses one of them, its anchor, by a
rule on the window's words alone: the highest round, then the least name, then
the leftmost.  Neighbouring windows mostly share an anchor and form a segment.

1. Parse: per segment a record with the anchor's name, a 128-bit hash of the
   segment's words and its place.  Copies inside a task are settled there: the
   earliest goes on, so even a passage in a third of all documents sends one
   record per task.
2. Reveal: records meet by anchor name.  A record whose words equal an earlier
   record's is a repeat as a whole.  If an anchor has records with different
   words, its earliest records are looked at window by window.
3. Verify: those windows, hashed to 128 bits, meet by hash; all but the
   earliest are repeats.
4. Remove the words of all repeated windows.

Long documents are parsed in sections that overlap by WINDOW - 1 words, which
changes no window's anchor.  Windows are compared by 128 bits of hash.

Defined results: a null text has no words; documents count as earlier by their
id, null ids last, and rows with equal ids by their place in the table; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table, whole_text, word_blocks

WINDOW = 20
# Rounds of recompression.  Symbols of the second round are decided by about 7 words, which leaves neighbouring windows
# a common anchor (one record per 6 words) and few anchors that different segments share.
ROUNDS = 2
# Words that are parsed together; a worker holds about 300 bytes for each.
CHUNK = 1 << 17
_U = np.uint64
_MIX = (_U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))
# Odd bases of the two rolling hashes and their inverses modulo 2**64.
_BASES = (0xD1342543DE82EF95, 0x2545F4914F6CDD1D)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX[1]
    x = (x ^ (x >> _U(27))) * _MIX[2]
    return x ^ (x >> _U(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """128 bits of each word as two columns."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), _U).reshape(-1, 2)


class Ranges:
    """128-bit hashes of ranges of a hashed word sequence."""

    _powers: list[np.ndarray] = []

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes) + 1
        if not Ranges._powers or len(Ranges._powers[0]) < n:
            ones = [np.full(n, b, _U) for pair in zip(_BASES, _INVERSES, strict=True) for b in pair]
            for x in ones:
                x[0] = 1
            Ranges._powers = [np.cumprod(x, dtype=_U) for x in ones]
        self.sums = []
        for lane in (0, 1):
            terms = np.zeros(n, _U)
            np.cumsum(hashes[:, lane] * Ranges._powers[2 * lane][: n - 1], out=terms[1:], dtype=_U)
            self.sums.append(terms)

    def lane(self, lane: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[lane][end] - self.sums[lane][start]) * Ranges._powers[2 * lane + 1][start]
        return _mixed(raw + (end - start).astype(_U) * _MIX[0])


def recompress(names: np.ndarray, rounds: int = ROUNDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per round, from round 0: the symbols' names and the range of words that decides each, ends excluded."""
    left = np.arange(len(names), dtype=np.int64)
    right = left + 1
    yield names, left, right
    for number in range(rounds):
        # Runs: a maximal run is decided by the neighbours that end it.
        edge = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
        length = np.diff(np.append(edge, len(names)))
        last = edge + length - 1
        run = names[edge]
        run = np.where(length > 1, _mixed(run + length.astype(_U) * _MIX[0]), run)
        # Beyond the ends of the sequence lies what no window may know.
        run_left = np.concatenate(([-1], left[edge[1:] - 1]))
        run_right = np.append(right[np.minimum(last + 1, len(names) - 1)][:-1], len(right) and right[-1] + 1)
        # Pairs: a left symbol before a right one; a symbol stays alone by what its side's neighbour is.
        side = (_mixed(run ^ _MIX[number % 3]) >> _U(7)) & _U(1) == 1  # true: a right symbol
        opens = np.append(~side[:-1] & side[1:], False)
        closes = np.concatenate(([False], opens[:-1]))
        stay = ~closes
        nxt = np.minimum(np.arange(len(run)) + 1, len(run) - 1)
        prv = np.maximum(np.arange(len(run)) - 1, 0)
        names = np.where(opens, _mixed(run * _MIX[0] + _mixed(run[nxt] + _U(1))), run)[stay]
        right_new = np.where(side, run_right, run_right[nxt])
        left_new = np.where(side, run_left[prv], run_left)
        # The outermost symbols depend on what lies beyond.
        if len(run):
            if side[0]:
                left_new[0] = -1
            if not side[-1]:
                right_new[-1] = run_right[-1] + 1
        left = np.where(opens, run_left, left_new)[stay]
        right = np.where(opens, run_right[nxt], right_new)[stay]
        yield names, left, right


def _least(names: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The leftmost index of the least name in each range [lo, hi), none of them empty."""
    span = hi - lo
    power = np.zeros(len(span), np.int64)
    best, tables = np.arange(len(names)), []
    step = 1
    while True:
        tables.append(best)
        if 2 * step > (span.max() if len(span) else 0):
            break
        other = best[step:]
        mine = best[: len(other)]
        best = np.where(names[other] < names[mine], other, mine)
        step *= 2
    for p in range(1, len(tables)):
        power[span >= 1 << p] = p
    out = np.empty(len(lo), np.int64)
    for p, best in enumerate(tables):
        at = np.flatnonzero(power == p)
        a, b = best[lo[at]], best[hi[at] - (1 << p)]
        out[at] = np.where(names[b] < names[a], b, a)
    return out


def anchors(names: np.ndarray, windows: np.ndarray, rounds: int = ROUNDS, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each window (its first word): the range of words that decides its anchor."""
    n = len(names)
    levels = list(recompress(names, rounds))
    begin, end = np.empty(len(windows), np.int64), np.empty(len(windows), np.int64)
    open_ = np.arange(len(windows))
    for level_names, left, right in reversed(levels):
        # Symbols decided inside window w: left >= w and right <= w + window; both ends rise with the symbol.
        before = np.cumsum(np.bincount(np.clip(left, -1, n) + 1, minlength=n + 2))  # before[w]: symbols with left < w
        upto = np.cumsum(np.bincount(np.clip(right, 0, n + 1), minlength=n + 2))  # upto[w]: symbols with right <= w
        w = windows[open_]
        lo, hi = before[w], upto[w + window]
        has = hi > lo
        if has.any():
            best = _least(level_names, lo[has], hi[has])
            begin[open_[has]], end[open_[has]] = left[best], right[best]
            open_ = open_[~has]
        if not len(open_):
            break
    return begin, end


def _sections(batch: pa.RecordBatch, chunk: int, window: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row of the batch, place of the first word, word hashes): each window of a text lies in one section."""
    for i, text in enumerate(batch.column("text")):
        held, place = np.empty((0, 2), _U), 0
        for words in word_blocks((text.as_py() or "").encode()):
            held = np.concatenate((held, word_hashes(words)))
            while len(held) >= chunk + window:
                yield i, place, held[: chunk + window - 1]
                held, place = held[chunk:], place + chunk
        if len(held) >= window:
            yield i, place, held


def _chunks(batch: pa.RecordBatch, chunk: int, window: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    held, size = [], 0
    for section in _sections(batch, chunk, window):
        held.append(section)
        size += len(section[2])
        if size >= chunk:
            yield held
            held, size = [], 0
    if held:
        yield held


def _joined(sections: list[tuple[int, int, np.ndarray]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One sequence of the sections' hashes with a mark between them; windows, and section and place of each."""
    mark = _mixed(np.arange(1, len(sections) + 1, dtype=_U) * _MIX[0]).repeat(2).reshape(-1, 1, 2)
    parts = [x for k, s in enumerate(sections) for x in (s[2], mark[k])]
    lengths = np.array([len(s[2]) for s in sections])
    first = np.cumsum(lengths + 1) - lengths - 1
    count = lengths - window + 1
    section = np.repeat(np.arange(len(sections)), count)
    nth = np.arange(len(section)) - np.repeat(np.cumsum(count) - count, count)
    place = np.array([s[1] for s in sections])[section] + nth
    return np.concatenate(parts), first[section] + nth, section, place


def _firsts(u0: np.ndarray, u1: np.ndarray, order: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the earliest record of each hash and of the others."""
    by = np.lexsort((place, row, order, u1, u0))
    new = np.concatenate(([True], (u0[by][1:] != u0[by][:-1]) | (u1[by][1:] != u1[by][:-1])))
    return by[new], by[~new]


def _merged(row: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of words united where they touch within a row."""
    by = np.lexsort((lo, row))
    row, order, lo, hi = row[by], order[by], lo[by], hi[by]
    if not len(row):
        return row, order, lo, hi
    # Ends rise with the starts here: a later range of the row never ends before an earlier one.
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (lo[1:] > hi[:-1])))
    at = np.flatnonzero(new)
    return row[at], order[at], lo[at], np.maximum.reduceat(hi, at)


# A record to compare (u0 is not null), or a range of words known to be repeated.
RECORDS = "name long, u0 long, u1 long, ord long, row long, lo long, hi long"


def _records(name, u0, u1, order, row, lo, hi) -> pa.RecordBatch:
    """One batch: the earliest records of each hash, then the merged ranges of the others."""
    first, rest = _firsts(u0, u1, order, row, lo)
    r, o, a, b = _merged(row[rest], order[rest], lo[rest], hi[rest])
    spread = _mixed(r.astype(_U) * _MIX[0] + a.astype(_U)).view(np.int64)  # ranges just pass through the shuffle
    none = np.zeros(len(r), np.int64)
    known = np.concatenate((np.zeros(len(first), bool), np.ones(len(r), bool)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate((name[first].view(np.int64), spread))),
            pa.array(np.concatenate((u0[first].view(np.int64), none)), mask=known),
            pa.array(np.concatenate((u1[first].view(np.int64), none)), mask=known),
            *(pa.array(np.concatenate(x)) for x in ((order[first], o), (row[first], r), (lo[first], a), (hi[first], b))),
        ],
        ["name", "u0", "u1", "ord", "row", "lo", "hi"],
    )


def _parse(window: int, rounds: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders, rows = batch.column("ord").to_numpy(), batch.column("row").to_numpy()
            for sections in _chunks(batch, chunk, window):
                hashes, windows, section, place = _joined(sections, window)
                begin, end = anchors(hashes[:, 0], windows, rounds, window)
                ranges = Ranges(hashes)
                new = np.concatenate(([True], (begin[1:] != begin[:-1]) | (end[1:] != end[:-1]) | (section[1:] != section[:-1])))
                at = np.flatnonzero(new)
                count = np.diff(np.append(at, len(windows)))
                start = windows[at]
                stop = start + count - 1 + window
                doc = np.array([s[0] for s in sections])[section[at]]
                name = ranges.lane(0, begin[at], end[at])
                yield _records(
                    name, ranges.lane(0, start, stop), ranges.lane(1, start, stop), orders[doc], rows[doc], place[at], place[at] + stop - start
                )

    return run


def _verify(window: int, chunk: int):
    """Hashes of the windows inside the asked ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders, rows = batch.column("ord").to_numpy(), batch.column("row").to_numpy()
            asked = [None] * batch.num_rows
            for i, spans in enumerate(batch.column("asked")):
                lo, hi = (np.asarray(spans.values.field(k).to_numpy()) for k in (0, 1))
                asked[i] = (lo, hi)
            for sections in _chunks(batch, chunk, window):
                hashes, windows, section, place = _joined(sections, window)
                wanted = np.zeros(len(windows) + 1, np.int64)
                for k, (i, at, words) in enumerate(sections):
                    lo, hi = asked[i]
                    base = int(np.searchsorted(section, k))
                    n = len(words) - window + 1
                    a, b = np.clip(lo - at, 0, n), np.clip(hi - window + 1 - at, 0, n)
                    np.add.at(wanted, base + a, 1)
                    np.add.at(wanted, base + b, -1)
                at = np.flatnonzero(np.cumsum(wanted[:-1]) > 0)
                if not len(at):
                    continue
                ranges, start = Ranges(hashes), windows[at]
                u0, u1 = ranges.lane(0, start, start + window), ranges.lane(1, start, start + window)
                doc = np.array([s[0] for s in sections])[section[at]]
                yield _records(u0, u0, u1, orders[doc], rows[doc], place[at], place[at] + window)

    return run


def _spans(ranges: DataFrame, name: str) -> DataFrame:
    """The ranges of each row as one array; a row has at most as many as its text has words."""
    return ranges.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias(name))


def repeated_ranges(texts: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, chunk: int = CHUNK) -> DataFrame:
    """Ranges (row, lo, hi) of words covered by windows that also start earlier; ``texts`` has ord, row and text at least."""
    records = texts.mapInArrow(_parse(window, rounds, chunk), RECORDS)
    by_name = W.partitionBy("name")
    ordered = by_name.orderBy("u0", "u1", "ord", "row", "lo")
    seen = F.lag("u0").over(ordered).eqNullSafe(F.col("u0")) & F.lag("u1").over(ordered).eqNullSafe(F.col("u1"))
    differ = (F.min("u0").over(by_name) != F.max("u0").over(by_name)) | (F.min("u1").over(by_name) != F.max("u1").over(by_name))
    decided = stored(
        records.withColumn("repeat", F.col("u0").isNull() | seen)
        .withColumn("differ", differ)
        .where(F.col("repeat") | F.col("differ"))
        .select("row", "lo", "hi", "repeat"),
        "segments",
    )
    asked = _spans(decided.where(~F.col("repeat")), "asked")
    # All columns go along, so that the shuffle of the texts is the one that the removal reads again.
    windows = texts.join(asked, "row").mapInArrow(_verify(window, chunk), RECORDS)
    number = F.row_number().over(W.partitionBy("name", "u0", "u1").orderBy("ord", "row", "lo"))
    later = windows.withColumn("nth", number).where(F.col("u0").isNull() | (F.col("nth") > 1)).select("row", "lo", "hi")
    return decided.where(F.col("repeat")).select("row", "lo", "hi").unionByName(later)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, total, removed = [], [], []
        for text, spans in zip(batch.column("text"), batch.column("gone"), strict=True):
            data = (text.as_py() or "").encode()
            lo, hi = (spans.values.field(k).to_numpy() for k in (0, 1)) if spans.is_valid else (np.empty(0, np.int64),) * 2
            parts, place, out = [], 0, 0
            by = np.argsort(lo)
            lo, hi = lo[by], np.maximum.accumulate(hi[by])
            for words in word_blocks(data):
                n = len(words)
                if len(lo):
                    # A word goes if a range that starts at or before it ends after it.
                    at = np.searchsorted(lo, np.arange(place, place + n), "right") - 1
                    gone = (at >= 0) & (hi[np.maximum(at, 0)] > np.arange(place, place + n))
                    out += int(gone.sum())
                    words = [words[k] for k in np.flatnonzero(~gone).tolist()]
                if words:
                    parts.append(b" ".join(words))
                place += n
            kept.append(b" ".join(parts))
            total.append(place)
            removed.append(out)
        yield pa.RecordBatch.from_arrays(
            [batch.column("carried"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            ["carried", "n_words", "n_removed", "kept_text"],
        )


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
    window: int = WINDOW,
    rounds: int = ROUNDS,
    chunk: int = CHUNK,
) -> DataFrame:
    """Per row of ``docs``, a stored table with integer ids: carried, n_words, n_removed and kept_text.

    ``carried`` is a struct of the columns ``carry``, by default the id;
    kept_text holds the words that stay, joined by one space.
    """
    last = (1 << 63) - 1
    carry = [id_col] if carry is None else carry
    texts = docs.select(
        F.struct(*(F.col(c) for c in carry)).alias("carried"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("ord"),
        F.monotonically_increasing_id().alias("row"),
        whole_text(text_col).alias("text"),
    )
    gone = _spans(repeated_ranges(texts, window, rounds, chunk), "gone")
    schema = T.StructType([texts.schema["carried"], *T._parse_datatype_string("n_words long, n_removed long, kept_text string").fields])
    return texts.join(gone, "row", "left").mapInArrow(_cut, schema)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, a stored table, with the words of repeated windows removed from the texts that have any."""
    out = remove_repeats(docs, id_col, text_col, carry=docs.columns)
    kept = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("carried")[text_col])
    return out.select(*(kept.alias(c) if c == text_col else F.col("carried")[c].alias(c) for c in docs.columns))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("carried.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM w),
q AS (SELECT doc_id, j, string_agg(x, ' ') OVER f AS s, count(*) OVER f AS n FROM p
      WINDOW f AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT doc_id, j FROM (SELECT doc_id, j, row_number() OVER (PARTITION BY s ORDER BY doc_id, j) AS nth FROM q WHERE n = 20) WHERE nth > 1),
c AS (SELECT p.doc_id, p.j, p.x, max(r.j) OVER (PARTITION BY p.doc_id ORDER BY p.j ROWS UNBOUNDED PRECEDING) AS latest
      FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.j = r.j)
SELECT d.doc_id, count(c.j) AS n_words, count(c.j) FILTER (WHERE c.j - c.latest < 20) AS n_removed,
       sha256(coalesce(string_agg(c.x, ' ' ORDER BY c.j) FILTER (WHERE c.latest IS NULL OR c.j - c.latest >= 20), '')) AS kept_sha256
FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id GROUP BY d.doc_id
"""
