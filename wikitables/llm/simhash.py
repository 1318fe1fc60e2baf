"""SimHash near-deduplication: a self-join of binary tries under a Hamming budget.

Every document gets a 64-bit fingerprint.  Equal fingerprints are one leaf.
Two fingerprints within the budget of 2 agree on at least two of four blocks
of 16 bits, so the leaves are arranged as six tries, each with another pair of
blocks leading: in one of them any wanted pair differs only below depth 32.
Down to that depth node pairs may spend nothing of the budget, so only a node
and itself go on, which is a grouping by the leading bits.  Below, node pairs
are traversed together, differing bits are added up, and a pair is left as soon
as the budget is exceeded.

A subtree with many leaves is split: its leaves move to the nodes 8 levels
further down, and visit those sibling nodes that the budget allows, until no
node is large.  Subtrees emit a spanning forest of their links, at most one
link per leaf and trie, and the components of the forests are the components
of all links.

Defined results: a null or empty text has fingerprint zero and is linked like
any other; a component's id is its smallest id that is not null (null if there
is none); rows with equal ids are rows of their own; an empty table gives an
empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table, whole_text, word_blocks
from .components import components

BUDGET = 2
WORDS = 3
SEED = 42
# Leaves of a subtree that one task may hold.
SPLIT_LEAVES = 20_000
# Levels a split goes down.
SPLIT_LEVELS = 8
BLOCKS = list(combinations(range(4), 2))


def fingerprint(text: str, width: int = WORDS) -> int:
    """Majority vote over the 64 bits of the hashes of the shingles of ``width`` words."""
    votes, total, tail = np.zeros(64, np.int64), 0, []
    for words in word_blocks(text.encode().lower()):  # bytes.lower changes A-Z only
        words = tail + words
        hashed = b"".join(map(xxhash.xxh64_digest, map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)), repeat(SEED)))
        if hashed:
            bits = np.unpackbits(np.frombuffer(hashed, np.uint8).reshape(-1, 8), axis=1)
            votes += bits.sum(axis=0, dtype=np.int64)
            total += len(bits)
        tail = words[-(width - 1) :]
    if not total:  # fewer words than a shingle has: the whole sequence, if any
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int.from_bytes(np.packbits(votes * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS) -> DataFrame:
    """(id, row, fp) of each document; row is its number in ``docs``."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), whole_text(text_col).alias("text"))
    return prints_of(plain, width)


def prints_of(plain: DataFrame, width: int = WORDS) -> DataFrame:
    """(id, row, fp) of the rows of ``plain``, which has id, row, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), width) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made.view(np.int64))], ["id", "row", "fp"])

    return plain.mapInArrow(run, "id long, row long, fp long")


def _order(trie: int) -> list[int]:
    """The blocks of a trie from the leading one; block 0 has the highest bits."""
    lead = BLOCKS[trie]
    return [*lead, *(b for b in range(4) if b not in lead)]


def trie_pairs(leaves: list[int], others: list[int] | None, depth: int, budget: int) -> Iterator[tuple[int, int]]:
    """Index pairs of sorted leaves that share the bits above ``depth`` levels from the end and differ in at most ``budget``.

    With ``others`` the pairs are between the two tries, else within the one.
    A node is a range of the sorted leaves; a node pair goes on as its child
    pairs, and those of unlike bits spend one of the budget.
    """
    own = others is None
    right = leaves if own else others
    stack = [(0, len(leaves), 0, len(right), depth - 1, 0, own)]
    while stack:
        a0, a1, b0, b1, bit, spent, same = stack.pop()
        if a0 == a1 or b0 == b1 or same and a1 - a0 < 2:
            continue
        if (a1 - a0) * (b1 - b0) <= 16 or bit < 0:  # the last leaves of both: their remaining bits at once
            for i in range(a0, a1):
                for j in range(i + 1 if same else b0, b1):
                    if (leaves[i] ^ right[j]).bit_count() <= budget:
                        yield i, j
            continue
        am = bisect_left(leaves, (leaves[a0] >> bit | 1) << bit, a0, a1)
        bm = am if same else bisect_left(right, (right[b0] >> bit | 1) << bit, b0, b1)
        bit -= 1
        stack.append((a0, am, b0, bm, bit, spent, same))
        stack.append((am, a1, bm, b1, bit, spent, same))
        if spent < budget:
            stack.append((a0, am, bm, b1, bit, spent + 1, False))
            if not same:
                stack.append((am, a1, b0, bm, bit, spent + 1, False))


def _forest(home: list[int], visit: list[int], depth: int, budget: int) -> Iterator[tuple[int, int]]:
    """Links (leaf, leaf) that connect what the pairs connect."""
    everyone = home + visit
    up = list(range(len(everyone)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(pairs: Iterator[tuple[int, int]], shift: int) -> Iterator[tuple[int, int]]:
        for i, j in pairs:
            a, b = root(i), root(j + shift)
            if a != b:
                up[b] = a
                yield everyone[i], everyone[j + shift]

    yield from join(trie_pairs(home, None, depth, budget), 0)
    if visit:
        yield from join(trie_pairs(home, visit, 64, budget), len(home))


SUBTREES = "trie int, node long, depth int, leaf long, home boolean"


def _plant(classes: DataFrame) -> DataFrame:
    """Each leaf in each trie, at its node of depth 32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            block = [fp >> np.uint64(48 - 16 * b) & np.uint64(0xFFFF) for b in range(4)]
            for trie in range(len(BLOCKS)):
                leaf = np.zeros_like(fp)
                for b in _order(trie):
                    leaf = leaf << np.uint64(16) | block[b]
                n = len(fp)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, trie, np.int32)), pa.array((leaf >> np.uint64(32)).view(np.int64)), pa.array(np.full(n, 32, np.int32)),
                     pa.array(leaf.view(np.int64)), pa.array(np.ones(n, bool))],
                    ["trie", "node", "depth", "leaf", "home"],
                )

    return classes.select("fp").mapInArrow(run, SUBTREES)


def _split(large: DataFrame) -> DataFrame:
    """Leaves of large nodes at their nodes further down, and as visitors at later siblings that the budget allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [m for m in range(1, 1 << SPLIT_LEVELS) if m.bit_count() <= BUDGET]
        for batch in batches:
            rows = []
            for trie, node, depth, leaf, home in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                child = (leaf & (1 << 64) - 1) >> (64 - depth - SPLIT_LEVELS) & (1 << SPLIT_LEVELS) - 1
                down, below = depth + SPLIT_LEVELS, node << SPLIT_LEVELS
                if home:
                    rows.append((trie, below | child, down, leaf, True))
                    rows += [(trie, below | child ^ m, down, leaf, False) for m in masks if child ^ m > child]
                else:
                    spent = ((leaf & (1 << 64) - 1) >> (64 - depth) ^ node).bit_count()
                    rows += [(trie, below | child ^ m, down, leaf, False) for m in [0, *masks] if spent + m.bit_count() <= BUDGET]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([(x + (1 << 63)) % (1 << 64) - (1 << 63) for x in c] if k == pa.int64() else c, k) for c, k in zip(columns, kinds, strict=True)],
                ["trie", "node", "depth", "leaf", "home"],
            )

    return large.mapInArrow(run, SUBTREES)


def links(classes: DataFrame, split_leaves: int = SPLIT_LEAVES) -> DataFrame:
    """Links (u, v) between distinct fingerprints, column fp, that connect all those within the budget."""
    nodes = stored(_plant(classes), "subtrees")
    ready = []
    while True:
        large = stored(
            nodes.where("depth < 56").groupBy("trie", "node", "depth").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split_leaves).drop("n"),
            "large-nodes",
        )
        if large.isEmpty():
            ready.append(nodes)
            break
        on = ["trie", "node", "depth"]
        ready.append(nodes.join(large, on, "left_anti").select(nodes.columns))
        nodes = stored(_split(nodes.join(large, on, "left_semi").select(nodes.columns)), "subtrees")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = (1 << 64) - 1
        key, home, visit = None, [], []

        def close() -> list[tuple[int, int]]:
            if len(home) + len(visit) < 2 or not home:
                return []
            order = _order(key[0])

            def plain(leaf: int) -> int:
                fp = 0
                for b in range(4):
                    fp = fp << 16 | leaf >> (48 - 16 * order.index(b)) & 0xFFFF
                return fp - (1 << 64) if fp >> 63 else fp

            return [(plain(a), plain(b)) for a, b in _forest(home, sorted(visit), 64 - key[2], BUDGET)]

        def made(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

        found: list[tuple[int, int]] = []
        for batch in batches:
            for trie, node, depth, leaf, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (trie, node, depth) != key:
                    found += close()
                    key, home, visit = (trie, node, depth), [], []
                (home if own else visit).append(leaf & full)
            if found:
                yield made(found)
                found = []
        found += close()
        yield made(found)

    # Leaves of a node come in signed order; those of a node above depth 0 share their sign.
    out = None
    for part in ready:
        sorted_nodes = part.repartition("trie", "node", "depth").sortWithinPartitions("trie", "node", "depth", "leaf")
        pairs = sorted_nodes.mapInArrow(run, "u long, v long")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split_leaves: int = SPLIT_LEAVES) -> DataFrame:
    """One row per document: id, _row, fp, component_id and kept, true for one row of each component."""
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    # Of a component the row with the least of these stays.
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    classes = stored(prints.groupBy("fp").agg(F.min(rank).alias("best")), "classes")
    roots = components(links(classes, split_leaves)).select(F.col("u").alias("fp"), "root")
    rooted = stored(classes.join(roots, "fp", "left").select("fp", "best", F.coalesce("root", "fp").alias("root")), "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("best").alias("first")), "firsts")
    named = stored(rooted.join(least, "root").select("fp", "first"), "named")
    return prints.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.col("row").alias("_row"),
        "fp",
        F.col("first.id").alias("component_id"),
        (F.col("row") == F.col("first.row")).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns of ``docs``, which must be a stored table: it is read again."""
    gone = classify(docs, id_col, text_col).where(~F.col("kept")).select("_row")
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    return numbered.join(gone, "_row", "left_anti").select(*(docs[c] for c in docs.columns))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
