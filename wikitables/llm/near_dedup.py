"""Near-deduplication by similarity: documents whose word shingles have a Jaccard similarity of 0.8 are copies.

The pipeline's stage; ``simhash`` keeps the parameters of its own contract.
Fingerprints of five-word shingles, joined by the tries of ``simhash`` under its
budget, give the first pairs: rows of one fingerprint with its first row, and
the first rows of linked fingerprints.  They count as links only if all
shingles confirm them.  At 0.8 the fingerprints of two texts differ in about
ten of 64 bits, more than a join under a Hamming budget can afford, so the
pairs out of its reach come from minima:

1. A text's shingles are WORDS neighbouring words, a shorter text's is the
   whole of it.  HASHES minima of their hashes make BANDS keys of ROWS minima
   each.  Two texts that are alike by 0.8 share a key with probability 0.9993,
   those alike by 0.85 with 0.99999.
2. Each row is paired with the first row of each of its keys.  Pairs whose
   minima agree in fewer than SURE places are left (of pairs alike by 0.8 one
   in nine thousand); of the others the shingles are compared, all of them.
   Links are those alike by 0.8.
3. Rows of a key that are not yet connected with its first row, its strays, are
   compared with the rows of the key in other components.  No pairs are made
   for it: each document is sent once to its key's cell, and a task compares
   the minima of a cell in arrays, then all shingles of those that agree in
   SURE places and are not yet connected, and returns the links it finds, a
   forest at most.  Pairs that share an earlier key are left to that one.  A
   key with more than CELL strays or other rows is cut into a grid of cells.

Of each component of the links the row with the least id stays.

Defined results: a null text is an empty text, and empty texts are copies of
each other; words are compared without the case of A to Z; rows with equal ids
are rows of their own, null ids come last; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import slices, stored, unused_name, whole_text, word_blocks
from .components import components

WORDS = 5
# Texts are copies if ALIKE[0] / ALIKE[1] of their shingles are common.
ALIKE = (4, 5)
BANDS, ROWS = 24, 6
HASHES = BANDS * ROWS
# Common minima of candidates.
SURE = HASHES * 68 // 100
# Strays and rows compared with them in one task at once, in the mean.
CELL = 1024
SEED = 42
# Hashes that are worked on at once.
_BATCH = 1 << 17
_U = np.uint64
_MIX = np.random.default_rng(SEED).integers(0, 1 << 64, (2, HASHES), _U)
_MIX[1] |= _U(1)


def shingles(text: str) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, in blocks; one hash at least."""
    tail, any_yet = [], False
    for words in word_blocks(text.encode().lower()):  # bytes.lower changes A-Z only
        words = tail + words
        hashed = b"".join(map(xxhash.xxh64_digest, map(b" ".join, zip(*(words[k:] for k in range(WORDS)), strict=False)), repeat(SEED)))
        if hashed:
            any_yet = True
            yield np.frombuffer(hashed, _U)
        tail = words[-(WORDS - 1) :]
    if not any_yet:
        yield np.frombuffer(xxhash.xxh64_digest(b" ".join(tail), SEED), _U)


def minima(texts: list[str]) -> np.ndarray:
    """The HASHES minima of each text."""
    out = np.full((HASHES, len(texts)), np.iinfo(_U).max, _U)
    owners, pieces, held = [], [], 0

    def close() -> None:
        nonlocal held
        if pieces:
            hashed = np.concatenate(pieces)
            starts = np.cumsum([0, *map(len, pieces[:-1])])
            for k in range(HASHES):
                np.minimum.at(out[k], owners, np.minimum.reduceat((hashed ^ _MIX[0, k]) * _MIX[1, k], starts))
        owners.clear()
        pieces.clear()
        held = 0

    for k, text in enumerate(texts):
        for piece in shingles(text):
            owners.append(k)
            pieces.append(piece)
            held += len(piece)
            if held >= _BATCH:
                close()
    close()
    return out.T


def are_alike(one: np.ndarray, other: np.ndarray) -> bool:
    """Of two sorted sets of shingles."""
    common = len(np.intersect1d(one, other, assume_unique=True))
    return common * ALIKE[1] >= (len(one) + len(other) - common) * ALIKE[0]


def _sketches(plain: DataFrame) -> DataFrame:
    """(id, row, sketch, keys) of each document: a byte of each minimum, and the keys of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(2)):
                least = np.ascontiguousarray(minima(batch.column(2)[lo:hi].to_pylist()))
                sketch = [r.tobytes() for r in (least >> _U(48)).astype(np.uint8)]
                keys = [[xxhash.xxh64_intdigest(r[ROWS * b : ROWS * (b + 1)].tobytes(), b) for b in range(BANDS)] for r in least]
                keys = np.array(keys, _U).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(sketch, pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))],
                    ["id", "row", "sketch", "keys"],
                )

    return plain.mapInArrow(run, "id long, row long, sketch binary, keys array<long>")


def _surely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (u, v) with enough common minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, other = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (2, 3))
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array((one == other).sum(axis=1) >= SURE))

    one = sketches.select(F.col("row").alias("u"), F.col("sketch").alias("one"))
    other = sketches.select(F.col("row").alias("v"), F.col("sketch").alias("other"))
    return pairs.join(one, "u").join(other, "v").select("u", "v", "one", "other").mapInArrow(run, "u long, v long")


def _alike(pairs: DataFrame, sketches: DataFrame, plain: DataFrame) -> DataFrame:
    """The pairs (u, v) that are links, by all their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = None, None
        for batch in batches:
            kept = []
            for i, (v, one, other) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True)):
                if v != known:
                    known, held = v, np.unique(np.concatenate(list(shingles(other.as_py()))))
                if are_alike(np.unique(np.concatenate(list(shingles(one.as_py())))), held):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(kept, pa.int64())) for c in batch.columns[:2]], ["u", "v"])

    pairs = stored(_surely(pairs, sketches), "near-candidates")
    rows = pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct()
    texts = stored(plain.select("row", "text").join(rows, "row", "left_semi"), "near-texts")
    one, other = texts.toDF("u", "one"), texts.toDF("v", "other")
    return stored(pairs.join(one, "u").join(other, "v").select("u", "v", "one", "other").mapInArrow(run, "u long, v long"), "near-links")


class Forest:
    """Components of the rows of a cell."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, row: int) -> int:
        above = self.above
        while above.setdefault(row, row) != row:
            above[row] = row = above[above[row]]
        return row


def cell_links(strays: pa.Table, others: pa.Table, band: int) -> list[tuple[int, int]]:
    """Links between strays and other rows of a cell that connect different components.

    The tables have row, root, stray, sketch, keys and text.
    """

    def arrays(table: pa.Table):
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, HASHES)
        keys = np.array(table.column("keys").to_pylist(), np.int64).reshape(-1, BANDS)
        return sketch, keys, table.column("row").to_numpy(), table.column("root").to_numpy()

    (one, one_keys, us, u_roots), (other, other_keys, vs, v_roots) = arrays(strays), arrays(others)
    v_stray = others.column("stray").to_numpy()
    texts = {"u": strays.column("text"), "v": others.column("text")}
    known: dict[tuple[str, int], np.ndarray] = {}

    def shingled(side: str, k: int) -> np.ndarray:
        if (side, k) not in known:
            if len(known) >= 2 * CELL:
                known.clear()
            known[side, k] = np.unique(np.concatenate(list(shingles(texts[side][k].as_py()))))
        return known[side, k]

    forest, links = Forest(), []
    step = max((1 << 24) // (HASHES * max(len(vs), 1)), 1)
    for lo in range(0, len(us), step):
        same = (one[lo : lo + step, None, :] == other[None]).sum(axis=2, dtype=np.uint8)
        near = (same >= SURE) & (u_roots[lo : lo + step, None] != v_roots[None]) & (~v_stray[None] | (us[lo : lo + step, None] < vs[None]))
        i, j = np.nonzero(near)
        earlier = (one_keys[lo + i, :band] == other_keys[j, :band]).any(axis=1)
        i, j = i[~earlier], j[~earlier]
        for k in np.argsort(-same[i, j].astype(int), kind="stable").tolist():
            u, v = lo + int(i[k]), int(j[k])
            a, b = forest.root(int(u_roots[u])), forest.root(int(v_roots[v]))
            if a != b and are_alike(shingled("u", u), shingled("v", v)):
                forest.above[a] = b
                links.append((int(us[u]), int(vs[v])))
    return links


def _crossed(members: DataFrame, roots: DataFrame, sketches: DataFrame, plain: DataFrame) -> DataFrame:
    """Links between rows of a key that are not connected through its first row; ``members`` has key, band, row, first."""
    rooted = members.join(roots.toDF("row", "root"), "row", "left").join(roots.toDF("first", "first_root"), "first", "left")
    rooted = rooted.where("row <> first").select("key", "band", "row", F.coalesce("root", "row").alias("root"), F.coalesce("first_root", "first").alias("first_root"))
    rooted = stored(rooted.withColumn("stray", F.col("root") != F.col("first_root")), "near-rooted")
    # Pairs are left only where the rows after the first are of several components.
    sizes = (
        rooted.groupBy("key", "band")
        .agg(F.count_if("stray").alias("strays"), F.count(F.lit(1)).alias("n"), F.min("root").alias("a"), F.max("root").alias("b"))
        .where("a <> b")
        .select("key", "band", F.expr(f"(strays - 1) div {CELL}").alias("last_i"), F.expr(f"(n - 1) div {CELL}").alias("last_j"))
    )
    placed = (
        rooted.join(sizes, ["key", "band"])
        .withColumn("own_i", F.pmod(F.xxhash64("row"), F.col("last_i") + 1))
        .withColumn("own_j", F.pmod(F.xxhash64("row"), F.col("last_j") + 1))
    )
    as_other = placed.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), "last_i"))).withColumn("j", F.col("own_j")).withColumn("side", F.lit(1))
    as_stray = placed.where("stray").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), "last_j"))).withColumn("i", F.col("own_i")).withColumn("side", F.lit(0))
    cells = stored(as_stray.unionByName(as_other).select("key", "band", "i", "j", "side", "row", "root", "stray"), "near-cells")
    bodies = sketches.select("row", "sketch", "keys").join(plain.select("row", "text"), "row").join(cells.select("row").distinct(), "row", "left_semi")
    sent = cells.join(stored(bodies, "near-bodies"), "row")

    def run(key, cell):
        side = cell.column("side").to_numpy()
        links = cell_links(cell.filter(pa.array(side == 0)), cell.filter(pa.array(side == 1)), key[1].as_py())
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})

    return stored(sent.groupBy("key", "band", "i", "j").applyInArrow(run, "u long, v long"), "near-crossed")


def print_pairs(plain: DataFrame) -> DataFrame:
    """Pairs (u, v) of rows that the fingerprints' tries connect, v the first row of its fingerprint."""
    prints = stored(simhash.prints_of(plain, WORDS), "near-prints")
    classes = stored(prints.groupBy("fp").agg(F.min("row").alias("first")), "near-classes")
    same = prints.join(classes, "fp").where("row <> first").select(F.col("row").alias("u"), F.col("first").alias("v"))
    linked = simhash.links(classes.select("fp")).toDF("a", "b")
    firsts = linked.join(classes.toDF("a", "one"), "a").join(classes.toDF("b", "other"), "b")
    return same.unionByName(firsts.select(F.greatest("one", "other").alias("u"), F.least("one", "other").alias("v")))


def near_links(plain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents' sketches, and links (u, v) between rows that connect those alike; ``plain`` has id, row, text."""
    sketches = stored(_sketches(plain), "near-sketches")
    keyed = sketches.select("row", F.posexplode("keys").alias("band", "key"))
    shared = keyed.groupBy("key", "band").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = stored(keyed.join(shared, ["key", "band"]), "near-members")
    by_minima = members.where("row <> first").select(F.col("row").alias("u"), F.col("first").alias("v"))
    found = _alike(print_pairs(plain).unionByName(by_minima).distinct(), sketches, plain)
    roots = stored(components(found), "near-roots")
    return sketches, found.unionByName(_crossed(members, roots, sketches, plain))


def drop_alike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns of ``docs``, which must be a stored table: it is read again."""
    number = unused_name(docs, "_row")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), whole_text(text_col).alias("text"))
    sketches, links = near_links(plain)
    root = components(links)
    linked = root.select(F.col("u").alias("row"), "root").unionByName(root.select(F.col("root").alias("row"), "root").distinct())
    linked = stored(sketches.select("id", "row").join(linked, "row"), "near-linked")
    least = linked.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("best"))
    gone = stored(linked.join(least, "root").where("row <> best.row").select(F.col("row").alias(number)), "near-gone")
    numbered = docs.withColumn(number, F.monotonically_increasing_id())
    return numbered.join(gone, number, "left_anti").select(*(docs[c] for c in docs.columns))
