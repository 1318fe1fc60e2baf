"""Collocations, fill-in-middle and mixing against plain loops."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wikitables.llm import collocations, fill_in_middle, mixing

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(texts):
    """(lang, words) of phrases of 1 to 5 words, and the number of words by language."""
    counts, totals = Counter(), Counter()
    for lang, text in texts:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(ASCII_LOWER)):
            words = tuple(re.findall(r"[^ \t]+", piece))
            totals["und" if lang is None else lang] += len(words)
            for k in range(1, 6):
                counts.update(("und" if lang is None else lang, words[i : i + k]) for i in range(len(words) - k + 1))
    return counts, totals


def plain_collocations(texts, least, top):
    counts, totals = plain_counts(texts)
    candidates = {p: f for p, f in counts.items() if f >= least and len(p[1]) > 1}
    hidden = set()
    for (lang, words), f in candidates.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                if f >= candidates[lang, words[i : i + size]]:
                    hidden.add((lang, words[i : i + size]))
    best = defaultdict(list)
    for (lang, words), a in candidates.items():
        if (lang, words) not in hidden:
            cuts = [(1000 * a * totals[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            best[lang].append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    return {
        (lang, rank, p.decode(), -a, left, right, totals[lang], -score)
        for lang, rows in best.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1)
    }


def phrase_texts(hard):
    rng = random.Random(4)
    vocabulary = ["a", "b", "of", "the", "é中", "New", "york", "city", "x\x00y", "don't"]
    texts = [("en" if k % 3 else None, t) for k, (_, t) in enumerate(hard)]
    for k in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        joined = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\r\n", "\x0b"]) for w in words)
        texts.append((rng.choice(["en", "de", None, "und", ""]), joined))
    texts += [("en", "The very same line, New York city of the a")] * 40
    texts.append(("de", "word of the city " * 5000))
    return texts


@pytest.mark.parametrize("bounds", [collocations.Bounds(), collocations.Bounds(64, 8, 200, 300, 7)])
def test_collocations(spark, hard, tmp_path, bounds):
    """Also with small blocks, bursting containers, spills and a filter that lets nearly everything through."""
    texts = phrase_texts(hard)
    docs = spark.createDataFrame([(t, lang, 1, "x", "y") for lang, t in texts], "text string, lang string, f int, phrase string, words string")
    docs.repartition(3).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    for least, top in ((3, 25), (20, 2000)):
        found = {tuple(r) for r in collocations.collocations(docs, least=least, top=top, bounds=bounds).collect()}
        assert found == plain_collocations(texts, least, top) and found
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs, least=10**6).count() == 0


def test_tries_burst_and_spill_sorted_runs():
    rng = np.random.default_rng(0)
    words = [f"w{k}".encode() for k in range(300)]
    trie, wanted, runs = collocations.HatTrie(64), Counter(), []
    for _ in range(30):
        rows, counts = np.unique((rng.zipf(1.3, (800, 3)) - 1) % 300 + 1, axis=0, return_counts=True)
        trie.add("en", rows, counts, words)
        for row, n in zip(rows, counts, strict=True):
            wanted[b" ".join(words[i - 1] for i in row)] += int(n)
        assert trie.entries == sum(len(n.container) for r in trie.roots.values() for _, n in r.subtrees())
        if trie.entries > 4000:
            runs += trie.spill(2000)
            assert trie.entries <= 2000
    assert max(len(p) for p, _ in trie.roots["en", 3].subtrees()) >= 1
    runs += trie.spill(0)
    merged = Counter()
    for lang, phrases, counts in runs:
        assert lang == "en" and phrases.to_pylist() == sorted(phrases.to_pylist())
        merged.update(dict(zip(phrases.to_pylist(), counts.tolist(), strict=True)))
    assert merged == wanted and not trie.entries


def test_long_texts_are_cut_without_loss():
    rng = random.Random(1)
    text = "".join(rng.choice(["aa ", "b ", "c, ", "dd\t", "e" * 50 + " "]) for _ in range(3000))
    wanted = [w for w in next(collocations.token_lists(text.encode(), 10**9))]
    lists = list(collocations.token_lists(text.encode(), 7))
    assert sum(lists, []) == wanted and len(lists) > 300 and all(len(f) >= 5 for f in lists[:-1])
    assert list(collocations.token_lists(b"")) == []


def plain_cut(doc_id, text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return len(units), "plain", None, None, text
    if h4 % 100 < 50:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle(stored_docs, hard, no_docs):
    rng = random.Random(9)
    rows = list(hard) + [(30, "a\n\n\nb"), (31, "\n"), (32, "\n\n"), (33, "no <P> here\nor there"), (34, "<M\n>\n<<\nS>"), (35, "long\n" * 200_000 + "end")]
    rows += [(k, "".join(rng.choices(["\n", "é", "中", "x", "😀", "<P", "\r", "8"], k=rng.randrange(60)))) for k in range(100, 400)]
    docs = stored_docs(rows)
    found = fill_in_middle.fill_in_middle(docs).withColumn("again", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    wanted = Counter((i, *plain_cut(i, t or "")) for i, t in rows)
    assert Counter(tuple(r[:6]) for r in found) == wanted
    assert Counter((r["doc_id"], r["again"]) for r in found) == Counter((i, t or "") for i, t in rows)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(no_docs).count() == 0
    assert {r["form"] for r in fill_in_middle.fill_in_middle(docs, rate=0).collect()} == {"plain"}


def test_marks():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 8, 9, 63, 64, 65, 1000):
        data = rng.choice(np.frombuffer(b"\n\x0b\x8a\x09\x00\xff\x80a", np.uint8), n).tobytes()
        lines = fill_in_middle.Marks(fill_in_middle.newline_marks(fill_in_middle.as_words(data)))
        places = [i for i, c in enumerate(data) if c == 10]
        assert lines.select(np.arange(len(places))).tolist() == places
        assert lines.rank(np.arange(n + 1)).tolist() == [data[:k].count(b"\n") for k in range(n + 1)]
        inner = fill_in_middle.Marks(fill_in_middle.continuation_marks(fill_in_middle.as_words(data)))
        assert inner.rank(np.arange(n + 1)).tolist() == [sum(c >> 6 == 2 for c in data[:k]) for k in range(n + 1)]


def plain_targets(sizes):
    """Targets by source: weights 1, 2, 3, at most three times a source."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped, whole = set(), sum(sizes.values())
    while True:
        left = whole - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / share for s in order}
        over = {s for s in order if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("preference", [None, "score"])
def test_mixing(spark, hard, tmp_path, preference):
    rng = random.Random(2)
    rows = [(i, t, f"s{k % 3}" if k % 4 else None) for k, (i, t) in enumerate(hard) if not t or len(t) < 10_000]
    for k in range(100, 2100):
        source = "hot" if k % 3 == 0 else rng.choice(["tiny"] * (k % 40 == 0) + ["b", "é", "中", "z", "", None])
        rows.append((k, "w " * rng.randrange(1, 60), source))
    rows += [(5000, "", "empty"), (5001, None, "empty")]
    data = [(i, t, s, rng.choice([0.5, 1.0, 4.0]), 1, 2.0, "x") for i, t, s in rows]
    spark.createDataFrame(data, "doc_id long, text string, source string, score double, size int, target double, row string").repartition(5).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    found = mixing.mix(docs, preference=preference).collect()
    assert sorted(map(str, ((r["doc_id"], r["size"]) for r in found))) == sorted(str((i, len((t or "").encode().split()))) for i, t, _ in rows)
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in found:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
    targets = plain_targets(sizes)
    assert targets["tiny"] == 3 * sizes["tiny"] and targets["empty"] == 0
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], targets[r["source"]])
    assert all(abs(taken[s] - targets[s]) <= longest[s] / 2 + 1e-6 for s in sizes)
    again = mixing.mix(docs.repartition(2), preference=preference).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    if preference:  # documents that are liked more have more copies where the source leaves a choice
        liked = {d[0]: d[3] for d in data}
        mean = lambda score: np.mean([r["copies"] for r in found if r["source"] == "hot" and liked[r["doc_id"]] == score])
        assert mean(4.0) > mean(1.0) > mean(0.5)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix(docs.where("source = 'empty'")).collect()] == [0, 0]


def test_pareto_samples_have_their_probabilities(spark, tmp_path):
    """Unequal probabilities: documents are taken as often as their share says."""
    docs = spark.createDataFrame([(k, "w", "s", 1.0 + k % 4) for k in range(4000)], "doc_id long, text string, source string, liking double")
    docs.write.parquet(str(tmp_path / "t"))
    copies = Counter()
    for r in mixing.mix(spark.read.parquet(str(tmp_path / "t")), preference="liking").collect():
        copies[r["doc_id"] % 4] += r["copies"] / 1000
    assert all(abs(copies[k] - (1 + k) / 2.5) < 0.06 for k in range(4)), copies
