"""Phrase collocation mining: contiguous phrases counted in HAT-tries, scored by their weakest cut.

Texts are lower-cased (A to Z), cut into pieces at ``.,;:!?`` and line ends and
into words at spaces and tabs.  They are read once: each task numbers the words
of a block of some 250,000 words of one language and stores the block as
numbers with its word list.  Phrases of 1 to 5 words are counted over the blocks:

1. Filters.  For k = 1 to 5 the 36-bit hashes of the phrases of k words are
   counted: tasks sum them up block by block, sort them and deal them by their
   first 12 bits, as differences of neighbours in byte planes, compressed to two
   or three bytes a phrase; one 4096th at a time is summed.  Beyond some 10^10
   different phrases more bits (``Bounds.hash_bits``) keep the filters sharp.
   Hashes that reach the least count go into a Bloom filter of one size
   whatever the size of the corpus.  A phrase never occurs more often than a
   part of it, so phrases of k words are looked at only where the filter has
   both their parts of k - 1 words.  Collisions and false positives cost work,
   never results, and no phrase that is frequent is left out; the more phrases
   are frequent, the less the filters spare.
2. Counts.  One pass counts the phrases that pass the filters, exactly.  A task
   keeps HAT-tries: a shallow trie over word numbers (language, first word,
   second word, ...) whose leaves are hash containers from the rest of a phrase
   to its count.  A container that outgrows its bound bursts: the words that
   begin many of its phrases get containers of their own one level deeper, the
   others stay together.
3. Beyond a number of entries whole subtrees are spilled, the largest first,
   as runs sorted by phrase; at the end the rest is.  Runs are cut by language
   and hashed first three words, compressed, and merged (summed) per prefix
   partition, one 4096th of the phrases at a time.

The counts are exact, as are the scores: decimals of 38 digits hold the
products, and their quotient fits 64 bits, since l and r are a at least.

Memory: one block, the hashes or trie entries held and the filters per task
(``Bounds``), whatever the corpus.  A frequent phrase is one entry per task, and what begins
with a frequent word is spread by the words that follow it.  The best 2000 of a
language are first taken within parts of it.

Defined results: a null text is an empty text and a null language is ``und``;
ids play no part; repeated rows count as often as they occur; ties go to the
smaller cut and to the smaller phrase in byte order; an empty table gives an
empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LARGE_ROWS, rows_per_batch, stored, table, whole_text

LONGEST = 5
LEAST = 100
TOP = 2000
# A longer candidate with INSIDE / 100 of a phrase's occurrences hides it.
INSIDE = 100
_U = np.uint64
_PRIME = _U(0x9E3779B97F4A7C15)
# The mark, in a block's 32-bit numbers, of words that are followed only: no phrase starts with them there.
_CONTEXT = 1 << 31
# Blocks of fewer different words are stored as 16-bit numbers, their highest bit being the mark.
_NARROW = 1 << 15
# Prefix partitions: phrases of one language and the same first three words share one.
_PARTS = 4096
# A byte that no UTF-8 text holds stands for the end of a piece.
_END = b"\xff"
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _END * 10)


@dataclass(frozen=True)
class Bounds:
    """What a task holds at once; results don't depend on it."""

    block: int = 1 << 18  # words of a block
    burst: int = 1 << 14  # phrases of a container
    entries: int = 250_000  # phrases of a task's tries
    hashes: int = 1 << 21  # hashes of a task
    filter_bits: int = 25  # the power of two of a Bloom filter's bits
    hash_bits: int = 36  # bits of a phrase's hash, 13 to 44


def token_lists(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words, and _END between pieces, of about ``size`` bytes at a time; all lists but the last have LONGEST tokens at least."""
    plain, at, held = text.translate(_PLAIN), 0, []
    while at < len(plain):
        found = plain.find(b" ", at + size)
        end = found if found >= 0 else len(plain)
        held += plain[at:end].replace(_END, b" \xff ").split()
        at = end
        if len(held) >= LONGEST:
            yield held
            held = []
    if held:
        yield held


class Numbers(dict):
    """Numbers of words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Block:
    """Texts of one language as numbers: 0 ends a piece, words count from 1."""

    def __init__(self) -> None:
        self.numbers = Numbers({_END: 0})
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, found: list[bytes], context: list[bytes]) -> None:
        ids = np.fromiter(map(self.numbers.__getitem__, [*found, *context, _END]), "<u4", len(found) + len(context) + 1)
        ids[len(found) : -1] |= np.uint32(_CONTEXT)
        self.parts.append(ids)
        self.size += len(ids)

    def columns(self) -> tuple[bytes, bytes]:
        ids = np.concatenate(self.parts)
        if len(self.numbers) <= _NARROW:
            ids = (ids & np.uint32(_NARROW - 1) | (ids >> np.uint32(16)) & np.uint32(_NARROW)).astype("<u2")
        return ids.tobytes(), b" ".join(list(self.numbers)[1:])


def token_blocks(docs: DataFrame, text_col: str, lang_col: str, size: int) -> DataFrame:
    """(lang, ids, words) of blocks: the numbers, and the words in the order of their numbers."""
    plain = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, Block] = {}

        def closed(lang: str) -> pa.RecordBatch:
            ids, words = blocks.pop(lang).columns()
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([ids], pa.binary()), pa.array([words], pa.binary())], ["lang", "ids", "words"])

        def added(lang: str, found: list[bytes], context: list[bytes]) -> Iterator[pa.RecordBatch]:
            blocks.setdefault(lang, Block()).add(found, context)
            if blocks[lang].size >= size or len(blocks[lang].numbers) > _NARROW - 2048:
                yield closed(lang)
            elif len(blocks) > 8 and sum(b.size for b in blocks.values()) > 4 * size:
                yield closed(max(blocks, key=lambda k: blocks[k].size))

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pending = None
                for found in token_lists(text.as_buffer().to_pybytes()):
                    if pending:
                        following = found[: LONGEST - 1]
                        yield from added(lang, pending, following[: following.index(_END)] if _END in following else following)
                    pending = found
                if pending:
                    yield from added(lang, pending, [])
        for lang in list(blocks):
            yield closed(lang)

    return plain.mapInArrow(run, "lang string, ids binary, words binary")


class Node:
    """A place in the trie: children for words that begin many phrases, one hash container for the phrases of all others."""

    __slots__ = ("burst", "children", "container", "limit")

    def __init__(self, burst: int) -> None:
        self.children: dict[int, Node] = {}
        self.container: dict[bytes, int] = {}
        self.burst = self.limit = burst

    def add(self, rows: np.ndarray, counts: np.ndarray) -> int:
        """Count different phrases, one row of word numbers each; returns the number of new entries."""
        made = 0
        if self.children:
            deeper = np.isin(rows[:, 0], np.fromiter(self.children, np.uint32, len(self.children)))
            inside, n = rows[deeper], counts[deeper]
            order = np.argsort(inside[:, 0], kind="stable")
            inside, n = inside[order], n[order]
            stops = [*(np.flatnonzero(np.diff(inside[:, 0])) + 1), len(inside)]
            at = 0
            for stop in stops:
                if stop > at:
                    made += self.children[int(inside[at, 0])].add(inside[at:stop, 1:], n[at:stop])
                at = stop
            rows, counts = rows[~deeper], counts[~deeper]
        held = self.container
        before, get = len(held), held.get
        for key, n in zip(np.ascontiguousarray(rows).view(f"V{4 * rows.shape[1]}").ravel().tolist(), counts.tolist(), strict=True):
            held[key] = get(key, 0) + n
        made += len(held) - before
        if len(held) > self.limit and rows.shape[1] > 1:
            self._burst(rows.shape[1])
        return made

    def _burst(self, width: int) -> None:
        first, n = np.unique(np.frombuffer(b"".join(self.container), "<u4").reshape(-1, width)[:, 0], return_counts=True)
        heavy = first[n >= self.limit // 32]
        if not len(heavy):  # no word begins many of the phrases: the container stays, and is looked at again when twice as large
            self.limit *= 2
            return
        for word in heavy.tolist():
            self.children.setdefault(word, Node(self.burst))
        keys = {word.to_bytes(4, "little"): self.children[word].container for word in heavy.tolist()}
        kept = {}
        for key, n in self.container.items():
            below = keys.get(key[:4])
            if below is None:
                kept[key] = n
            else:
                below[key[4:]] = n
        self.container = kept

    def subtrees(self, prefix: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], Node]]:
        """Every container with the words above it."""
        yield prefix, self
        for word, child in self.children.items():
            yield from child.subtrees((*prefix, word))


class HatTrie:
    """Counts of phrases, a trie per language and length, spilled as sorted runs."""

    def __init__(self, burst: int = Bounds.burst) -> None:
        self.burst = burst
        self.numbers = Numbers()
        self.roots: dict[tuple[str, int], Node] = {}
        self.entries = 0

    def add(self, lang: str, rows: np.ndarray, counts: np.ndarray, words: list[bytes]) -> None:
        """``rows`` numbers the words of one block, ``words[n - 1]`` is the word of the number n."""
        used, place = np.unique(rows, return_inverse=True)
        own = np.fromiter((self.numbers[words[n - 1]] for n in used.tolist()), np.uint32, len(used))
        self.entries += self.roots.setdefault((lang, rows.shape[1]), Node(self.burst)).add(own[place.reshape(rows.shape)], counts)

    def spill(self, down_to: int) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
        """Sorted runs (language, phrases, counts) of whole subtrees, the largest first, until ``down_to`` entries are left."""
        found = [(len(node.container), kind, prefix, node) for kind, root in self.roots.items() for prefix, node in root.subtrees()]
        taken: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for size, kind, prefix, node in sorted(found, key=lambda f: -f[0]):
            if self.entries <= down_to or not size:
                break
            rest = np.frombuffer(b"".join(node.container), "<u4").reshape(size, -1)
            above = np.broadcast_to(np.array(prefix, "<u4"), (size, len(prefix)))
            taken.setdefault(kind, []).append((np.hstack([above, rest]), np.fromiter(node.container.values(), np.int64, size)))
            node.container = {}
            self.entries -= size
        words = pa.array(list(self.numbers), pa.binary())
        place = np.empty(len(words), np.int64)
        place[pc.array_sort_indices(words).to_numpy()] = np.arange(len(words))
        for (lang, _), parts in taken.items():
            rows, counts = np.vstack([r for r, _ in parts]), np.concatenate([n for _, n in parts])
            order = np.lexsort(place[rows].T[::-1])
            columns = [words.take(pa.array(c)) for c in rows[order].T]
            yield lang, pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary())), counts[order]
        if not self.entries:
            self.numbers, self.roots = Numbers(), {}


def _word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    """64 bits of each word of a language; the first, of the number 0, is that of no word."""
    seed = zlib.crc32(lang.encode())
    return np.frombuffer(b"".join(xxhash.xxh64_digest(w, seed) for w in [b"", *words]), "<u8").astype(_U)


def _joined(one: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hashes of phrases that are longer by a word."""
    mixed = one * _PRIME + word
    mixed = (mixed ^ (mixed >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> _U(32))


def _places(bits: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Three bits of the filter for the first bits of a hash."""
    last, mixed = _U(64 * len(bits) - 1), keys * _PRIME
    return keys & last, (mixed >> _U(8)) & last, (mixed >> _U(30)) & last


def _may_be(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for place in _places(bits, keys):
        found &= (bits[place >> _U(6)] >> (place & _U(63))) & _U(1) == 1
    return found


Level = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def block_levels(ids: np.ndarray, words: list[bytes], lang: str, filters: list[np.ndarray], longest: int, hash_bits: int) -> Iterator[Level]:
    """Of a block, by length: the length, a place of each phrase that may be frequent by its parts, its count and its hash's first bits."""
    starts, ids = ids < _CONTEXT, (ids & np.uint32(_CONTEXT - 1)).astype(np.int64)
    at, gram, hashes = np.flatnonzero(ids), ids, _word_hashes(words, lang)
    hashed, shift = np.zeros(1, _U), _U(64 - hash_bits)
    for k in range(1, longest + 1):
        if k > 1:  # both parts are there: gram numbers the shorter phrase that starts at a place, or is negative
            at = at[at + 1 < len(ids)]
            at = at[gram[at + 1] >= 0]
        before = gram[at] << 32 if k > 1 else 0
        pairs, first, place = np.unique(before | ids[at + k - 1], return_index=True, return_inverse=True)
        hashed = _joined(hashed[pairs >> 32], hashes[pairs & 0xFFFFFFFF])
        counts = np.bincount(place[starts[at]], minlength=len(pairs))
        used = counts > 0
        yield k, at[first][used], counts[used], hashed[used] >> shift
        if k < longest:
            allowed = _may_be(filters[k - 1], hashed >> shift)[place]
            at, place = at[allowed], place[allowed]
            gram = np.full(len(ids), -1)
            gram[at] = place


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    for batch in batches:
        for lang, ids, words in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            words = words.as_buffer().to_pybytes().split()
            ids = np.frombuffer(ids.as_buffer(), "<u2" if len(words) < _NARROW else "<u4").astype(np.uint32)
            if len(words) < _NARROW:
                ids = ids & np.uint32(_NARROW - 1) | (ids & np.uint32(_NARROW)) << np.uint32(16)
            yield lang, ids, words


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts[order], heads) if len(keys) else counts


def phrase_filter(blocks: DataFrame, width: int, filters: list[np.ndarray], least: int, bounds: Bounds) -> np.ndarray:
    """The Bloom filter of the hashes that phrases of ``width`` words have ``least`` times or more."""
    shipped = blocks.sparkSession.sparkContext.broadcast(filters)
    low_bits = _U(bounds.hash_bits - 12)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held, pack = 0, zstandard.ZstdCompressor(1)

        def packed() -> pa.RecordBatch:
            keys, counts = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
            group = (keys >> low_bits).astype(np.int64)
            heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            low = keys & ((_U(1) << low_bits) - _U(1))
            steps = np.diff(low, prepend=_U(0))
            steps[heads] = low[heads]
            planes = np.vstack([c.astype("<u4").view(np.uint8).reshape(-1, 4).T for c in (steps, np.minimum(counts, least))])
            stops = [*heads[1:].tolist(), len(keys)]
            rows = [pack.compress(planes[:, a:b].tobytes()) for a, b in zip(heads.tolist(), stops, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(group[heads], pa.int32()), pa.array(rows, pa.binary())], ["part", "hashes"])

        for lang, ids, words in _blocks_of(batches):
            for k, _, counts, keys in block_levels(ids, words, lang, shipped.value, width, bounds.hash_bits):
                if k == width and len(counts):
                    parts.append((keys, counts))
                    held += len(counts)
            if held >= bounds.hashes:
                yield packed()
                parts, held = [], 0
        if held:
            yield packed()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of their parts."""
        bits, group, parts, unpack = np.zeros(1 << (bounds.filter_bits - 6), _U), None, [], zstandard.ZstdDecompressor()

        def close() -> None:
            keys, counts = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
            for place in _places(bits, keys[counts >= least] | (_U(group) << low_bits)):
                np.bitwise_or.at(bits, place >> _U(6), _U(1) << (place & _U(63)))

        for batch in batches:
            for part, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != group and parts:
                    close()
                    parts = []
                group = part
                planes = np.frombuffer(unpack.decompress(hashes), np.uint8).reshape(8, -1)
                steps, counts = (np.ascontiguousarray(p.T).view("<u4").ravel() for p in (planes[:4], planes[4:]))
                parts.append((np.cumsum(steps, dtype=_U), counts.astype(np.int64)))
        if parts:
            close()
        used = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(bits[used].view(np.int64))], ["slot", "bits"])

    hashed = blocks.mapInArrow(count, "part int, hashes binary").repartition("part").sortWithinPartitions("part")
    found = hashed.mapInArrow(add, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << (bounds.filter_bits - 6), _U)
    bits[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(_U)
    return bits


def phrase_counts(blocks: DataFrame, filters: list[np.ndarray], least: int, bounds: Bounds) -> DataFrame:
    """(lang, phrase, width, f) of the phrases that occur ``least`` times, and the number of all words of a language as the phrase ''."""
    shipped = blocks.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries, totals, most, pack = HatTrie(bounds.burst), {}, bounds.entries, zstandard.ZstdCompressor(3)

        def batch_of(runs: Iterator[tuple[str, pa.Array, np.ndarray]]) -> pa.RecordBatch:
            """Runs, cut by prefix partition: the phrases, a line each in their order below a line that names the language, and their counts."""
            parts: dict[int, tuple[list[bytes], list[int]]] = {}
            for lang, phrases, counts in runs:
                seed, head, headed = zlib.crc32(lang.encode()), _END + lang.encode().hex().encode(), set()
                for phrase, n in zip(phrases.to_pylist(), counts.tolist(), strict=True):
                    part = zlib.crc32(b" ".join(phrase.split(b" ", 3)[:3]), seed) % _PARTS
                    lines, numbers = parts.setdefault(part, ([], []))
                    if part not in headed:
                        headed.add(part)
                        lines.append(head)
                        numbers.append(0)
                    lines.append(phrase)
                    numbers.append(n)
            columns = [
                pa.array(list(parts), pa.int32()),
                pa.array([pack.compress(b"\n".join(lines)) for lines, _ in parts.values()], pa.binary()),
                pa.array([pack.compress(np.array(numbers, "<i8").tobytes()) for _, numbers in parts.values()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["part", "phrases", "counts"])

        for lang, ids, words in _blocks_of(batches):
            plain = (ids & np.uint32(_CONTEXT - 1)).astype(np.int64)
            for k, at, counts, keys in block_levels(ids, words, lang, shipped.value, len(filters), bounds.hash_bits):
                if k == 1:
                    totals[lang] = totals.get(lang, 0) + int(counts.sum())
                passed = _may_be(shipped.value[k - 1], keys)
                rows, counts = plain[at[passed][:, None] + np.arange(k)], counts[passed]
                # A part of the block at a time, so that the tries stay near their bound.
                for lo in range(0, len(rows), most // 4):
                    tries.add(lang, rows[lo : lo + most // 4], counts[lo : lo + most // 4], words)
                    if tries.entries > most:
                        yield batch_of(tries.spill(0 if len(tries.numbers) > most else most // 2))
        yield batch_of(tries.spill(0))
        yield batch_of((lang, pa.array([b""]), np.array([n])) for lang, n in totals.items())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of their parts."""
        group, sums, unpack = None, {}, zstandard.ZstdDecompressor()

        def merged() -> Iterator[pa.RecordBatch]:
            for lang, counted in sums.items():
                kept = [(p, n) for p, n in counted.items() if n >= least or not p]
                columns = [pa.repeat(lang, len(kept)), pa.array([p for p, _ in kept], pa.binary()).cast(pa.string()), pa.array([n for _, n in kept], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "f"])

        for batch in batches:
            for part, phrases, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != group:
                    yield from merged()
                    group, sums = part, {}
                for phrase, n in zip(unpack.decompress(phrases).split(b"\n"), np.frombuffer(unpack.decompress(counts), "<i8").tolist(), strict=True):
                    if phrase[:1] == _END:
                        counted = sums.setdefault(bytes.fromhex(phrase[1:].decode()).decode(), {})
                    else:
                        counted[phrase] = counted.get(phrase, 0) + n
        yield from merged()

    runs = blocks.mapInArrow(run, "part int, phrases binary, counts binary")
    merged = runs.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "lang string, phrase string, f long")
    return merged.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("width"), "f")


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, bounds: Bounds = Bounds()
) -> tuple[DataFrame, DataFrame]:
    """(lang, n), the number of words, and (lang, phrase, width, f) of phrases of up to ``longest`` words that occur ``least`` times."""
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"longest is 2 to {LONGEST}")
    blocks = stored(token_blocks(docs, text_col, lang_col, bounds.block), "phrase-blocks", **LARGE_ROWS, compression="zstd")
    filters: list[np.ndarray] = []
    with rows_per_batch(docs.sparkSession, 2):
        for width in range(1, longest + 1):
            filters.append(phrase_filter(blocks, width, filters, least, bounds))
            if not filters[-1].any():  # nor has any longer phrase
                break
        found = stored(phrase_counts(blocks, filters, least, bounds), "phrase-counts")
    return found.where("phrase = ''").select("lang", F.col("f").alias("n")), found.where("phrase <> ''")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, inside: int = INSIDE,
    bounds: Bounds = Bounds(),
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of 2 to ``longest`` words."""
    totals, found = frequent_phrases(docs, text_col, lang_col, longest, least, bounds)
    wide = found.where("width > 1").withColumnRenamed("f", "a").withColumn("words", F.split("phrase", " "))

    # Phrases that a longer one hides.
    parts = F.expr(
        "flatten(transform(sequence(2, width - 1), k -> transform(sequence(1, width - k + 1), i -> concat_ws(' ', slice(words, i, k)))))"
    )
    hiding = wide.where("width > 2").select("lang", F.col("a").alias("f"), F.explode(parts).alias("phrase"))
    hidden = hiding.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    open_ = wide.join(hidden, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("f") < inside * F.col("a"), F.lit(True))).drop("f")

    # The weakest cut of the others.
    cut = open_.withColumn("k", F.explode(F.expr("sequence(1, width - 1)"))).select(
        "lang", "phrase", "a", "k",
        F.expr("concat_ws(' ', slice(words, 1, k))").alias("left"),
        F.expr("concat_ws(' ', slice(words, k + 1, width - k))").alias("right"),
    )
    known = found.select("lang", "phrase", "f")
    scored = (
        cut.join(known.withColumnsRenamed({"phrase": "left", "f": "l"}), ["lang", "left"])
        .join(known.withColumnsRenamed({"phrase": "right", "f": "r"}), ["lang", "right"])
        .join(totals, "lang")
        .withColumn("score", F.expr("(cast(1000 as decimal(38,0)) * a * n) div (cast(l as decimal(38,0)) * r)"))
    )
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")

    # The best of each part of a language, then of the language: no task gets more than ``top`` rows of a part.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_part = F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))
    best = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("rank", of_part).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, w, i, unnest([1, 2, 3, 4, 5]) AS k FROM s),
f AS (SELECT lang, k, w[i:i + k - 1] AS ws, count(*) AS f FROM g WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE f >= 100),
x AS (SELECT lang, k, ws, f, unnest(range(1, k)) AS size FROM c WHERE k > 2),
y AS (SELECT lang, f, ws, k, size, unnest(range(1, k - size + 2)) AS i FROM x),
hidden AS (SELECT lang, ws[i:i + size - 1] AS ws, max(f) AS f FROM y GROUP BY ALL),
o AS (SELECT c.* FROM c LEFT JOIN hidden h ON c.lang = h.lang AND c.ws = h.ws WHERE c.k > 1 AND (h.f IS NULL OR 100 * h.f < 100 * c.f)),
u AS (SELECT lang, ws, k, f AS a, unnest(range(1, k)) AS j FROM o),
q AS (SELECT u.lang, u.ws, u.a, u.j, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * u.a * n.n) // (l.f::HUGEINT * r.f) AS score
      FROM u JOIN c l ON l.lang = u.lang AND l.ws = u.ws[1:u.j] JOIN c r ON r.lang = u.lang AND r.ws = u.ws[u.j + 1:] JOIN n ON n.lang = u.lang),
m AS (SELECT lang, array_to_string(ws, ' ') AS phrase, a, l, r, n, score FROM q QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM m QUALIFY rank <= 2000
"""
