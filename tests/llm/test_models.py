"""Toxicity and quality: the grammar, what training may see, and accuracy on held-out rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wikitables.llm import quality, toxicity

SF = "/root/testdata/sf0.01"
SPEAK = {"idiot": 4.0, "lowei*": 3.0}


@pytest.fixture(scope="module")
def sums():
    grammar = toxicity.Grammar(SPEAK)
    return lambda text: round(float(np.expm1(grammar.features(text)[0])), 6)


def test_grammar(sums):
    assert sums("") == sums("the tree is green.") == 0
    assert sums("an IDIOT here") == 4 and sums("idiot%%% here") == 4 and sums("loweichen") == 3 and sums("lowe") == 0
    assert sums("you idiot") == 4 * toxicity.TARGET_FACTOR > sums("you. idiot")  # the target is in another clause
    assert sums("not an idiot") == pytest.approx(4 * toxicity.COVERED_FACTOR)
    assert sums("not at all one more idiot") == 4  # beyond the reach of the negation
    assert sums("the paper reported idiot") == pytest.approx(4 * toxicity.COVERED_FACTOR)
    assert sums('this "idiot"') == pytest.approx(4 * toxicity.COVERED_FACTOR)
    assert sums("they will kill the light") == toxicity.THREAT_WEIGHT * 1 and sums("to kill time") == 0
    assert sums("idiot, idiot") == 8


def test_fold(spark):
    assert [r[0] for r in spark.range(50).select(toxicity.fold(F.col("id"))).collect()] == [zlib.crc32(str(i).encode()) % 4 for i in range(50)]


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, extra string")


def toxic_rows(n, seed=0):
    rng = np.random.default_rng(seed)
    plain = [f"w{k}" for k in range(300)]
    rows, marks = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = list(rng.choice(plain, 40))
        if toxic:
            words[7] = words[21] = str(rng.choice(["moron", "scum", "gruntlyer", "gruntish"]))
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic), "x"))
    return rows, marks


def test_toxicity_learns(spark, stored_docs):
    rows, marks = toxic_rows(400)
    docs, labels = stored_docs(rows), labelled(spark, [*marks, (None, 1, 1, "x"), (3, 1, None, "x")])
    model = toxicity.train(docs, labels)
    found = {r["carried"]["doc_id"]: r["score"] for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    held = [m for m in marks if zlib.crc32(str(m[0]).encode()) % 4 == 2]
    assert held and all((found[i] >= 0.3) == bool(t) for i, _, t, _ in held)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in found.items() if s < 0.3}


def test_toxicity_never_sees_held_out_labels(spark, stored_docs):
    rows, marks = toxic_rows(120)
    docs = stored_docs(rows)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t, x) for i, q, t, x in marks]
    one, other = (toxicity.train(docs, labelled(spark, m)) for m in (marks, turned))
    assert one[0] == other[0] and np.array_equal(one[1], other[1])


def test_hard_rows(spark, hard_docs, hard, no_docs):
    labels = labelled(spark, [(1, 0, 1, "x"), (4, None, None, "x"), (7, 1, 0, "x"), (7, 0, 1, "x")])
    for module in (toxicity, quality):
        for marks in (labels, labels.limit(0)):
            model = module.train(hard_docs, marks)
            found = module.score(hard_docs, model, ["doc_id"]).collect()
            assert len(found) == len(hard) and all(0 <= r["score"] <= 1 for r in found)
            assert module.score(no_docs, module.train(no_docs, marks), ["doc_id", "id"]).count() == 0


@pytest.mark.parametrize(("query", "label", "least"), [(toxicity.op3_toxicity, "toxic", 0.8), (quality.op8_quality, "quality", 0.95)])
def test_held_out(spark, query, label, least):
    """The area under the curve on documents that training never saw."""
    found = query(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    good, bad = found.score[found[label] == 1].to_numpy(), found.score[found[label] == 0].to_numpy()
    assert ((good[:, None] > bad) + 0.5 * (good[:, None] == bad)).mean() > least


def test_co_training_uses_the_pool(spark):
    """Two views with few labels get better by the pool: the second view is learned from the first."""
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 3000).astype(float)
    x = [np.column_stack((y + rng.normal(0, s, 3000), rng.normal(0, 1, (3000, 3)))) for s in (0.35, 0.45)]
    few = np.arange(3000) < 30
    apart = np.arange(30) % 3 == 0
    args = [v[few] for v in x], y[few], apart
    accuracy = []
    for pool in ([v[:0] for v in x], [v[30:] for v in x]):
        rows = [(k * 7919, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(*pool, strict=True))]
        rows = spark.createDataFrame(rows, "at long, content array<float>, metadata array<float>")
        model = quality.co_train(*args, quality.Pool(rows))
        accuracy.append(((model.score([v[30:] for v in x]) >= 0.5) == (y[30:] > 0)).mean())
    assert accuracy[1] >= accuracy[0] and accuracy[1] > 0.95


def test_the_surest_of_the_whole_pool_teach(spark):
    """Bins count all documents, cuts follow from the counts, and nothing is taught to a view twice."""
    rng = np.random.default_rng(2)
    x = [rng.normal(0, 2, (4000, 1)), rng.normal(0, 2, (4000, 1))]
    views = []
    for k in (0, 1):
        views.append(quality.Logistic().fit(x[k], (x[k][:, 0] > 0).astype(float), np.ones(4000)))
    rows = spark.createDataFrame([(k, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(*x, strict=True))], "at long, content array<float>, metadata array<float>")
    pool = quality.Pool(rows.repartition(5), share=0.1, taught=100)
    odds = [views[k].odds(x[k].astype(np.float32).astype(float)) for k in (0, 1)]
    assert np.array_equal(pool.counts(views), [np.bincount(quality._bin(o), minlength=quality.BINS) for o in odds])
    seen = [set(), set()]
    for turn in range(3):
        before = [set(t.tolist()) for t in pool.taught]
        for k, taught, marks in pool.lessons(views, 0.25, turn):
            new = pool.taught[k][len(before[k]) :]
            assert not before[k] & set(new.tolist()) and len(new) == len(taught) == len(marks) and 60 < len(new) < 150
            assert np.allclose(taught, x[k][new]) and np.array_equal(marks, odds[1 - k][new] > 0) and 0.1 < marks.mean() < 0.4
            ranks = np.argsort(np.argsort(odds[1 - k]))[new]
            assert ((ranks < 4000 * 0.075 * 1.6 + 40) | (ranks >= 4000 * (1 - 0.025 * 1.6) - 40)).all()
            seen[k] |= set(new.tolist())
    empty = quality.Pool(rows.limit(0))
    assert [len(m) for _, _, m in empty.lessons(views, 0.5, 0)] == [0, 0]
