"""Exact, near and substring deduplication against plain loops."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from wikitables.llm import exact_dedup, near_dedup, simhash, substring_dedup
from wikitables.llm.components import components

BLANK = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def exact_expected(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[BLANK.sub("", t or "")].append((-len(t or ""), i is None, i or 0, k, i))
    out = []
    for norm, members in groups.items():
        best = min(m[:3] for m in members)
        keep = next(m[4] for m in members if m[:3] == best)
        tied = [m for m in members if m[:3] == best]
        for m in members:
            out.append((m[4], keep, len(members), m is tied[0], hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def weak_hash(text):
    """Many collisions: a hash of two bits."""
    return F.pmod(F.xxhash64(text), F.lit(4))


@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, weak_hash])
def test_exact(hard_docs, hard, hashed):
    assert rows_of(exact_dedup.classify(hard_docs, hashed=hashed).drop("_row")) == exact_expected(hard)


def test_exact_drops_rows(hard_docs, hard, no_docs):
    kept = exact_dedup.drop_copies(hard_docs)
    assert kept.columns == hard_docs.columns
    assert sorted(BLANK.sub("", r["text"] or "") for r in kept.collect()) == sorted({BLANK.sub("", t or "") for _, t in hard})
    assert exact_dedup.classify(no_docs).count() == 0 and exact_dedup.drop_copies(no_docs).count() == 0


def plain_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def joined(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[root(a)] = root(b)
    return {n: root(n) for n in nodes}


def near_expected(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    nodes = sorted(set(prints))
    root = joined(((a, b) for a, b in combinations(nodes, 2) if (a ^ b).bit_count() <= 2), nodes)
    least = {}
    for (i, _), fp in zip(rows, prints):
        if i is not None:
            least[root[fp]] = min(least.get(root[fp], i), i)
    return sorted(((i, f"{fp:016x}", least.get(root[fp])) for (i, _), fp in zip(rows, prints)), key=repr)


def test_near(hard_docs, hard, no_docs):
    found = simhash.classify(hard_docs)
    digest = found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    assert rows_of(digest) == near_expected(hard)
    kept = Counter(r["component_id"] for r in found.where("kept").collect())
    assert set(kept.values()) == {1} and set(kept) == {r["component_id"] for r in found.collect()}
    dropped = simhash.drop_near_copies(hard_docs)
    assert dropped.columns == hard_docs.columns and dropped.count() == len(kept)
    assert simhash.classify(no_docs).count() == 0


@pytest.mark.parametrize("depth", [64, 32])
def test_trie_pairs(depth):
    rng = np.random.default_rng(depth)
    center = [int(x) for x in rng.integers(0, 1 << 32, 3, dtype=np.uint64)]
    if depth == 32:
        center = center[:1]
    leaves = {c ^ sum(1 << int(b) for b in rng.choice(min(depth, 64), rng.integers(0, 4), replace=False)) for c in center for _ in range(150)}
    leaves = sorted(leaves)
    wanted = {(i, j) for i, j in combinations(range(len(leaves)), 2) if (leaves[i] ^ leaves[j]).bit_count() <= 2}
    assert sorted(simhash.trie_pairs(leaves, None, depth, 2)) == sorted(wanted) and wanted
    half = leaves[::2], leaves[1::2]
    across = {(i, j) for i, a in enumerate(half[0]) for j, b in enumerate(half[1]) if (a ^ b).bit_count() <= 2}
    assert set(simhash.trie_pairs(half[0], half[1], depth, 2)) == across


@pytest.mark.parametrize("split_leaves", [20_000, 40, 3])
def test_links_of_clusters(spark, split_leaves):
    """Clusters of close fingerprints, large nodes split or not, have the components of all pairs."""
    rng = np.random.default_rng(5)
    prints = set()
    for _ in range(12):
        c = int(rng.integers(0, 1 << 63, dtype=np.uint64)) * 2 + int(rng.integers(0, 2))
        prints.add(c)
        for _ in range(40):
            c ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False))
            prints.add(c)
    nodes = sorted(prints)
    signed = {n: n - (1 << 64) if n >> 63 else n for n in nodes}
    root = joined(((a, b) for a, b in combinations(nodes, 2) if (a ^ b).bit_count() <= 2), nodes)
    classes = spark.createDataFrame([(signed[n],) for n in nodes], "fp long")
    links = [(r["u"], r["v"]) for r in simhash.links(classes, split_leaves).collect()]
    found = joined(links, list(signed.values()))
    by_root, by_found = defaultdict(set), defaultdict(set)
    for n in nodes:
        by_root[root[n]].add(signed[n])
        by_found[found[signed[n]]].add(signed[n])
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_found.values()))
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in links)


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    found = {r["u"]: r["root"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert found == {k: 0 for k in range(1, 41)} | {95: 90, 100: 90}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def substring_expected(rows, window=20):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    seen, gone = set(), defaultdict(set)
    split = [WORD.findall(t or "") for _, t in rows]
    for k in order:
        w = split[k]
        for at in range(len(w) - window + 1):
            key = tuple(w[at : at + window])
            if key in seen:
                gone[k].update(range(at, at + window))
            seen.add(key)
    return sorted(
        ((i, len(split[k]), len(gone[k]), " ".join(x for n, x in enumerate(split[k]) if n not in gone[k])) for k, (i, _) in enumerate(rows)), key=repr
    )


@pytest.mark.parametrize(("rounds", "chunk"), [(2, 1 << 19), (0, 700), (4, 64), (2, 1000)])
def test_substring(hard_docs, hard, rounds, chunk):
    if chunk < 700:
        hard = [(i, t) for i, t in hard if i not in (10, 11)]
        hard_docs = hard_docs.where("doc_id is null or doc_id not in (10, 11)")
    found = substring_dedup.remove_repeats(hard_docs, rounds=rounds, chunk=chunk).select("carried.doc_id", "n_words", "n_removed", "kept_text")
    # Rows with equal ids are alike here, so it does not matter which of them is the earlier one.
    assert rows_of(found) == substring_expected(hard)


def test_substring_in_random_texts(stored_docs):
    """Few different words: windows repeat at all offsets, inside runs and across sections."""
    rng = np.random.default_rng(9)
    pool = [" ".join(rng.choice(["a", "b", "c"], 200, p=[0.8, 0.1, 0.1])) for _ in range(6)]
    rows = []
    for k in range(40):
        cut = [p[int(rng.integers(0, 60)) * 2 : int(rng.integers(80, 200)) * 2] for p in rng.choice(pool, 3)]
        rows.append((k, "\n".join(cut)))
    found = substring_dedup.remove_repeats(stored_docs(rows), chunk=300).select("carried.doc_id", "n_words", "n_removed", "kept_text")
    assert rows_of(found) == substring_expected(rows)


def test_substring_keeps_columns(hard_docs, hard, no_docs):
    out = substring_dedup.drop_repeats(hard_docs)
    assert out.columns == hard_docs.columns and out.count() == len(hard)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[7] == hard[8][1] and texts[9] == ""
    assert substring_dedup.remove_repeats(no_docs).count() == 0 and substring_dedup.drop_repeats(no_docs).count() == 0


def test_anchors_depend_on_the_window_alone():
    """The words that decide an anchor are at the same place of equal windows, whatever stands around them."""
    rng = np.random.default_rng(3)
    inner = rng.integers(0, 5, 20).astype(np.uint64)
    for rounds in range(5):
        places = set()
        for _ in range(30):
            before, after = int(rng.integers(0, 9)), int(rng.integers(0, 9))
            names = np.concatenate((rng.integers(0, 5, before), inner, rng.integers(0, 5, after))).astype(np.uint64)
            begin, end = substring_dedup.anchors(names, np.array([before]), rounds)
            assert 0 <= begin[0] - before < end[0] - before <= 20
            places.add((int(begin[0] - before), int(end[0] - before)))
        assert len(places) == 1


def jaccard(one, other):
    a, b = ({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for w in (t.split() for t in (one, other)))
    return len(a & b) / len(a | b)


def test_near_stage_links_by_similarity(stored_docs, no_docs):
    """The pipeline's stage against all pairs: copies edited in a few words go, texts alike by less stay."""
    import corpus_pipeline

    rng = random.Random(7)
    texts = []
    for k in range(40):
        base = [f"w{rng.randrange(9000)}" for _ in range(rng.randint(30, 300))]
        texts.append(" ".join(base))
        for edits in (1, 2, len(base) // 40, len(base) // 25, len(base) // 12):
            other = list(base)
            for at in rng.sample(range(len(base)), edits):
                other[at] = f"e{rng.randrange(9000)}"
            texts.append(" ".join(other))
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if root(i) != root(j) and jaccard(texts[i], texts[j]) >= 0.8:
                up[max(root(i), root(j))] = min(root(i), root(j))
    wanted = {i for i in range(len(texts)) if root(i) == i}
    assert 40 < len(wanted) < 200
    rows = [*enumerate(texts), (1000, ""), (1001, None), (None, texts[0])]
    docs = stored_docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(docs.sparkSession, docs, "").collect()}
    assert kept == wanted | {1000}
    assert corpus_pipeline.near_dedup(docs.sparkSession, no_docs, "").count() == 0


@pytest.mark.parametrize("cell", [near_dedup.CELL, 60])
def test_near_stage_in_a_group_about_the_threshold(stored_docs, monkeypatch, cell):
    """Hundreds of copies with some 4 to 9 of 300 words changed: links cost no pairs, and of all pairs alike few are missed."""
    monkeypatch.setattr(near_dedup, "CELL", cell)
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for k in range(1, 501):
        text = list(base)
        for at in rng.sample(range(300), rng.randint(4, 9)):
            text[at] = f"new{k}x{at}"
        rows.append((k, " ".join(text)))
    docs = stored_docs(rows)
    plain = docs.select(F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("row"), "text")
    _, links = near_dedup.near_links(plain)
    ids = {r["row"]: r["id"] for r in plain.select("id", "row").collect()}
    links = [(ids[r["u"]], ids[r["v"]]) for r in links.collect()]
    sets = {i: np.unique(np.concatenate(list(near_dedup.shingles(t)))) for i, t in rows}
    assert all(near_dedup.are_alike(sets[u], sets[v]) for u, v in links) and len(links) < 24 * len(rows)
    forest = near_dedup.Forest()
    for u, v in links:
        forest.above[forest.root(u)] = forest.root(v)
    alike = [(u, v) for u in sets for v in sets if u < v and near_dedup.are_alike(sets[u], sets[v])]
    connected = sum(forest.root(u) == forest.root(v) for u, v in alike)
    print(len(alike), connected, len(links))
    assert len(alike) > 300 and connected >= 0.99 * len(alike)


def test_near_stage_takes_pairs_from_fingerprints(stored_docs, monkeypatch):
    """The tries of five-word fingerprints bring their pairs into the stage, which compares these by all shingles."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(4000)}" for _ in range(900)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1])), (3, " ".join(words[::-1])), (4, " ".join(words).upper())]
    plain = stored_docs(rows).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("row"), "text")
    prints = {i: simhash.fingerprint(t, near_dedup.WORDS) for i, t in rows}
    want = {(v, u) for u in prints for v in prints if u < v and (prints[u] ^ prints[v]).bit_count() <= simhash.BUDGET}
    pairs = {(r["u"], r["v"]) for r in near_dedup.print_pairs(plain).collect()}
    assert (4, 1) in pairs and pairs <= want
    compared = []
    whole = near_dedup._alike
    monkeypatch.setattr(near_dedup, "_alike", lambda p, *rest: whole(compared.append({tuple(r) for r in p.collect()}) or p, *rest))
    near_dedup.near_links(plain)
    assert pairs <= compared[0]


def test_parsing_holds_little_at_once():
    """A task's arrays are those of one chunk, whatever its batch holds."""
    import tracemalloc

    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 5000, 50_000))) for _ in range(14)]
    n = len(texts)
    batch = pa.record_batch({"ord": np.arange(n), "row": np.arange(n), "text": texts})
    tracemalloc.start()
    try:
        for _ in substring_dedup._parse(substring_dedup.WINDOW, substring_dedup.ROUNDS, substring_dedup.CHUNK)(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 90e6
