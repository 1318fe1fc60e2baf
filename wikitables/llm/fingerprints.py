"""Document fingerprints by improbable features: rare byte windows in chained Bloom filters.

1. Every window of WINDOW bytes has an entropy, sorted into LEVELS levels.  A
   first pass counts the levels over all documents (at most LEVELS + 1 rows
   reach the driver); the rarer a level, the more improbable its windows.
   Windows of very low entropy, such as ruled lines, come last.
2. In each run of RUN neighbouring windows the most improbable, leftmost
   one gets a vote.  Windows with VOTES votes, or the most of their text, are
   the text's features.  All small pieces of a short text are features, too.
3. Features enter Bloom filters of BITS bits by HASHES hashes, FILL features to
   a filter; a fingerprint is the chain of its filters.
4. Two filters are alike by their common bits, less those that chance gives, as
   a share of what is possible.  Of two chains, each filter of the shorter one
   counts with its best match, weighted by its bits.

All steps are array operations over about a megabyte of text at a time, and a
window never crosses texts, so a text's fingerprint depends on nothing but the
text and the counted levels.

Neighbours in the order of ids come from a range partitioning: each task walks
its sorted rows, and only the first and last row of each partition are matched
afterwards.

Defined results: a null text is an empty text, with an empty fingerprint; two
empty fingerprints are alike (1), an empty and another one are not (0); rows
with equal ids follow each other in the order of their texts' hashes, null ids
come last; a single row is its own neighbour; an empty table gives an empty
table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, stored, table, whole_text

WINDOW = 32
# A text with fewer than SHORT bytes has no windows to choose from: all its pieces of PIECE bytes are its features.
# One with fewer than SMALL has few of them: its pieces are features as well as the chosen windows.
SHORT, SMALL, PIECE = 128, 512, 8
# Neighbouring windows that vote for one of them.
RUN = 64
LEVELS = 1000
# Levels below have too little in them to tell texts apart.
LOW_LEVELS = 100
VOTES = 16
BITS = 2048
HASHES = 5
FILL = 160
_BLOCK = 1 << 16
_U = np.uint64

# n log2 n in fixed point: sums are exact, whatever order they are made in.
_TERMS = np.array([0, *(round(n * np.log2(n) * 4096) for n in range(1, WINDOW + 1))], np.int32)
_GAINS = np.diff(_TERMS).astype(np.int32)  # _GAINS[n]: what the (n + 1)-th equal byte adds


def _neighbours(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: equal bytes among the WINDOW - 1 before and after it."""
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for at in range(0, len(data), _BLOCK):  # blocks that stay in the cache
        block = data[at : at + _BLOCK + WINDOW - 1]
        n = min(_BLOCK, len(data) - at)
        for d in range(1, WINDOW):
            if d >= len(block):
                break
            same = (block[:-d][:n] == block[d:][:n]).view(np.uint8)
            after[at : at + len(same)] += same
            before[at + d : at + d + len(same)] += same
    return before, after


def levels(data: np.ndarray) -> np.ndarray:
    """The entropy level of each window, by its first byte: 0 if all bytes are equal, LEVELS if all differ."""
    if len(data) < WINDOW:
        return np.empty(0, np.int64)
    before, after = _neighbours(data)
    counts = np.bincount(data[:WINDOW], minlength=256)
    total = np.empty(len(data) - WINDOW + 1, np.int64)
    total[0] = _TERMS[counts].sum()
    # The first byte goes, the next comes.
    np.cumsum(_GAINS[before[WINDOW:]] - _GAINS[after[: len(data) - WINDOW]], out=total[1:])
    total[1:] += total[0]
    return LEVELS - total * LEVELS // int(_TERMS[WINDOW])


def _joined(texts: list[bytes], least: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes with RUN zeros after each, where each text starts, and which windows lie inside one text of ``least`` bytes or more."""
    data = np.frombuffer(b"".join(x for t in texts for x in (t, bytes(RUN))), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths + RUN) - lengths - RUN
    mark = np.zeros(len(data) + 1, np.int32)
    long = lengths >= least
    mark[starts[long]] = 1
    mark[(starts + lengths - WINDOW + 1)[long]] = -1
    return data, starts, np.cumsum(mark[: len(data) - WINDOW + 1]) > 0


def count_levels(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many windows of all documents have each level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                texts = [t.as_buffer() for t in batch.column(0)[lo:hi] if t.is_valid]
                if not texts:
                    continue
                data, _, inside = _joined(texts)
                counts += np.bincount(levels(data)[inside], minlength=LEVELS + 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["level", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n"))
    out = np.zeros(LEVELS + 1, np.int64)
    for r in counted.collect():
        out[r["level"]] = r["n"]
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """The rank of each level: the rarest first, those of low entropy last."""
    order = sorted(range(LEVELS + 1), key=lambda k: (k < LOW_LEVELS, counts[k] if k >= LOW_LEVELS else -k, k))
    out = np.empty(LEVELS + 1, np.int64)
    out[order] = np.arange(LEVELS + 1)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _features(texts: list[bytes], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each feature in order."""
    owner, hashes = [np.empty(0, np.int64)], [np.empty(0, _U)]
    for k, text in enumerate(texts):
        if 0 < len(text) < SMALL:
            padded = np.frombuffer(text.ljust(PIECE, b"\0"), np.uint8)
            pieces = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, PIECE)).view(_U)[:, 0]
            owner.append(np.full(len(pieces), k))
            hashes.append(_mixed(pieces + _U(len(text) if len(text) < PIECE else 0)))
    data, starts, inside = _joined(texts, SHORT)
    # The place in the low bits makes the leftmost of equals the least.
    key = (np.where(inside, rank[levels(data)], LEVELS + 1) << 32) | np.arange(len(inside))
    least, step = np.append(key, np.full(RUN, np.iinfo(np.int64).max)), 1
    while step < RUN:  # minima of runs of 2, 4, ... RUN windows
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    winner = (least[: len(inside)] & 0xFFFFFFFF)[inside]
    if len(winner):
        new = np.flatnonzero(np.append(True, winner[1:] != winner[:-1]))
        place, votes = winner[new], np.diff(np.append(new, len(winner)))
        text = np.searchsorted(starts, place, "right") - 1
        most = np.zeros(len(texts), np.int64)
        np.maximum.at(most, text, votes)
        chosen = votes >= np.minimum(VOTES, most[text])
        place, text = place[chosen], text[chosen]
        words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, WINDOW)[place]).view(_U)
        mixed = np.zeros(len(place), _U)
        for k in range(WINDOW // 8):
            mixed = _mixed(mixed * _U(0x9E3779B97F4A7C15) + words[:, k] + _U(k + 1))
        owner.append(text)
        hashes.append(mixed)
    owner, hashes = np.concatenate(owner), np.concatenate(hashes)
    by = np.argsort(owner, kind="stable")
    return owner[by], hashes[by]


def fingerprints(texts: list[bytes], rank: np.ndarray) -> list[bytes]:
    """The chain of filters of each text."""
    if not texts:
        return []
    owner, hashes = _features(texts, rank)
    count = np.bincount(owner, minlength=len(texts))
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    chained = -(-count // FILL)
    first = np.cumsum(chained) - chained
    bits = np.zeros((int(chained.sum()), BITS), bool)
    for k in range(HASHES):
        bits[first[owner] + nth // FILL, (hashes >> _U(11 * k) & _U(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[a : a + c].tobytes() for a, c in zip(first.tolist(), chained.tolist(), strict=True)]


def likeness(one: bytes, other: bytes) -> float:
    """0 to 1."""
    if not one or not other:
        return float(one == other)
    if one == other:
        return 1.0
    if len(one) > len(other):
        one, other = other, one
    a, b = (np.unpackbits(np.frombuffer(x, np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.float32) for x in (one, other))
    in_a, in_b = a.sum(axis=1), b.sum(axis=1)
    total = 0.0
    for at in range(0, len(a), 256):
        mine = in_a[at : at + 256, None]
        chance, most = mine * in_b / BITS, np.minimum(mine, in_b)
        alike = (a[at : at + 256] @ b.T - chance) / np.maximum(most - chance, 1e-9)
        total += float((np.clip(alike, 0, 1).max(axis=1) * mine[:, 0]).sum())
    return total / float(in_a.sum())


def edited_text(text: str, following: str) -> str:
    """The last half of the text's code points replaced by as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
# Rows of the walk: finished ones; those that end a partition; and the first row of each partition once more.
_WALK = "kind string, part long, " + _RESULT + ", text string"
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


def _compared(rows: list[tuple], following: list[tuple], rank: np.ndarray) -> list[tuple]:
    """Finished rows from (id, text, fingerprint) and the like of the next documents."""
    edited = [edited_text(r[1], f[1]).encode() for r, f in zip(rows, following, strict=True)]
    out = []
    for r, f, e, chain in zip(rows, following, edited, fingerprints(edited, rank), strict=True):
        out.append((r[0], len(r[1]), hashlib.sha256(e).hexdigest(), r[2], chain, likeness(r[2], chain), likeness(r[2], f[2])))
    return out


def _batch(rows: list[tuple], kinds: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in kinds.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def fingerprint_chain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its fingerprint, that of its edited text, and its likeness to that and to the next document by falling id."""
    rank = ranks(count_levels(docs, text_col))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                ids, texts = (batch.column(k)[lo:hi].to_pylist() for k in (0, 1))
                chains = fingerprints([t.encode() for t in texts], rank)
                rows = list(zip(ids, texts, chains, strict=True))
                if last is None:
                    yield _batch([("first", part, *rows[0][:1], None, None, rows[0][2], None, None, None, rows[0][1])], _WALK)
                    known = rows
                else:
                    known = [last, *rows]
                yield _batch([("done", part, *r, None) for r in _compared(known[:-1], known[1:], rank)], _WALK)
                last = rows[-1]
        if last is not None:
            yield _batch([("last", part, last[0], None, None, last[2], None, None, None, last[1])], _WALK)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield _batch(_compared([(r["id"], r["text"], r["fingerprint"])], [(None, r["next_text"], r["next_fingerprint"])], rank), _RESULT)

    text = whole_text(text_col)
    order = [F.col("id").desc_nulls_last(), F.col("tie")]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    walked = stored(ordered.mapInArrow(walk, _WALK), "fingerprints")
    firsts = walked.where("kind = 'first'").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    # One row per partition: the next partition that has rows, the first one after the last.
    following = firsts.select("part").distinct().withColumn(
        "next", F.coalesce(F.lead("part").over(W.orderBy("part")), F.first("part").over(W.orderBy("part")))
    )
    open_ends = (
        walked.where("kind = 'last'")
        .select("part", "id", "text", "fingerprint")
        .join(following, "part")
        .join(firsts.withColumnRenamed("part", "next"), "next")
        .select("id", "text", "fingerprint", "next_text", "next_fingerprint")
    )
    out = walked.where("kind = 'done'").select(*_NAMES).unionByName(open_ends.mapInArrow(finish, _RESULT))
    return out.withColumnRenamed("id", id_col)


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    out = fingerprint_chain(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256",
        F.lower(F.hex("fingerprint")).alias("fingerprint"), F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
