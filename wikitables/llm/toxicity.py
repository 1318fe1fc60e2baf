"""Toxicity by a weighted finite-state grammar over clauses.

Transducers are composed word by word, left to right through a clause:

- lexical: a trie over characters reads a word and writes INSULT with a weight,
  or one of the closed classes THREAT, TARGET, NEGATION, REPORT, or nothing;
- scope: a negation holds for the next words, a reporting verb or an opening
  quote for the rest of the clause; both lower what they cover;
- scoring: an insult counts by its weight, more if the clause has a target; a
  threat counts only if the clause has a target.

A document's sums over its clauses give its score by a logistic curve.

The trie's insults are learned: for each word, and each beginning of a word, of
labelled documents its log odds of being in toxic ones, less 1.96 standard
errors; what stays above MIN_WEIGHT goes into the trie.  The curve is fitted on
other labelled documents than the trie.  Both take at most TRAINING_ROWS
labelled documents, those of the least hashed ids; that bounds the trie and all
that the driver holds.  Only ids and labels choose documents for training, and
scores depend on texts alone.

Defined results: a null text is an empty text, whose score is that of a text
without matches; documents without id are never trained on; an id that is
labelled more than once is toxic if one label says so; without usable labels
the curve is fixed and scores stay below one half; rows with equal ids are
scored one by one; an empty table gives an empty table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table, whole_text

TRAINING_ROWS = 20_000
# Labelled toxic documents that must hold a word.
MIN_SUPPORT = 3
MIN_WEIGHT = 1.0
# Lengths of the beginnings of words.
PREFIXES = range(3, 8)
THRESHOLD = 0.3
# Words whose reading a worker remembers.
REMEMBERED = 200_000

# Classes of the lexical transducer's output.
INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, BREAK = "ITGNRQB"
THREAT_WEIGHT, TARGET_FACTOR, COVERED_FACTOR, NEGATION_REACH = 4.0, 1.25, 0.6, 3
# Fixed words of the closed classes in English, German, French and Spanish.
CLOSED = {
    THREAT: "kill murder destroy hurt beat shoot stab strangle töten umbringen schlagen tuer frapper matar golpear",
    TARGET: "you your yours yourself he she him her they them du dich dir ihr euch sie tu toi te vous tú ti usted ustedes",
    NEGATION: "not never no isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais non nunca jamás",
    REPORT: "said says claimed reported wrote quoted alleged sagte schrieb behauptete écrit déclaré affirmé dijo escribió afirmó",
}
_CLASS_OF = {w: c for c, words in CLOSED.items() for w in words.split()}
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.,;:!?\n\"“”«»]")
_QUOTES = frozenset("\"“”«»")
_BREAKS = frozenset(".,;:!?\n")


class Grammar:
    """The composed transducers; ``weights`` holds words and, ending in ``*``, beginnings of words."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self._known: dict[str, tuple[str, float] | None] = {}

    def read(self, word: str) -> tuple[str, float] | None:
        """The lexical transducer: the class and weight it writes for a word, None for nothing."""
        if word in _QUOTES:
            return QUOTE, 0.0
        if word in _BREAKS:
            return BREAK, 0.0
        closed = _CLASS_OF.get(word)
        if closed:
            return closed, 0.0
        nodes = [word, *(word[:n] + "*" for n in PREFIXES if n < len(word))]
        weight = max(self.weights.get(n, 0.0) for n in nodes)
        return (INSULT, weight) if weight > 0 else None

    def clause(self, symbols: list[tuple[int, str, float]]) -> float:
        """The score of a clause from its (place, class, weight) in order."""
        targeted = any(c == TARGET for _, c, _ in symbols)
        negated_to, reported, total = -1, False, 0.0
        for place, kind, weight in symbols:
            if kind == NEGATION:
                negated_to = place + NEGATION_REACH
            elif kind in (REPORT, QUOTE):
                reported = True
            else:
                if kind == THREAT:
                    weight = THREAT_WEIGHT if targeted else 0.0
                elif targeted:
                    weight *= TARGET_FACTOR
                covered = (place <= negated_to) + reported
                total += weight * COVERED_FACTOR**covered
        return total

    def features(self, text: str) -> tuple[float, float, float]:
        """Of all clauses: the sum, the most, and the sum per hundred words, as logarithms."""
        words = _TOKEN.findall(text.lower())
        known = self._known
        new = set(words).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(words)
        known.update((w, self.read(w)) for w in new)
        total = most = 0.0
        symbols: list[tuple[int, str, float]] = []
        matched = False
        for place, out in enumerate(map(known.__getitem__, words)):
            if out is None:
                continue
            kind, weight = out
            if kind == BREAK:
                if matched:
                    score = self.clause(symbols)
                    total, most = total + score, max(most, score)
                symbols, matched = [], False
            else:
                symbols.append((place, kind, weight))
                matched = matched or kind == INSULT or kind == THREAT
        if matched:
            score = self.clause(symbols)
            total, most = total + score, max(most, score)
        return float(np.log1p(total)), float(np.log1p(most)), float(np.log1p(100 * total / max(len(words), 1)))


def fold(id_column: Column) -> Column:
    """The remainder by 4 of the checksum of the id's text; 2 is held out."""
    return (F.crc32(id_column.cast("string").cast("binary")) % 4).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(fold, toxic, text) of at most ``rows`` labelled documents that are not held out."""
    marks = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("fold", fold(F.col("id")))
        .where(F.col("fold") != 2)
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    return texts.join(F.broadcast(marks), "id").select("fold", "toxic", "text")


def learn_weights(training: DataFrame) -> dict[str, float]:
    """Weights of words and beginnings of words, from the folds 0 and 1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                counts = (Counter(), Counter())
                for toxic, text in zip(batch.column(0)[lo:hi].to_pylist(), batch.column(1)[lo:hi], strict=True):
                    words = set(_TOKEN.findall(text.as_py().lower()))
                    counts[toxic].update(words | {w[:n] + "*" for w in words for n in PREFIXES if n < len(w)} | {""})
                found = list(counts[0].keys() | counts[1].keys())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.string()), *(pa.array([counts[k][f] for f in found], pa.int64()) for k in (1, 0))], ["node", "toxic", "clean"]
                )

    plain = training.where("fold < 2").select(F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"), "text")
    counted = plain.mapInArrow(count, "node string, toxic long, clean long").groupBy("node").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # The node of the empty word counts the documents; the trie is bounded by the training rows.
    rows = {r["node"]: (r["toxic"], r["clean"]) for r in counted.where(F.col("toxic") >= MIN_SUPPORT).collect()}
    all_toxic, all_clean = rows.pop("", (0, 0))
    out = {}
    for node, (toxic, clean) in rows.items():
        odds = np.log((toxic + 0.5) / (all_toxic + 1)) - np.log((clean + 0.5) / (all_clean + 1))
        weight = odds - 1.96 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
        if weight > MIN_WEIGHT:
            out[node] = float(weight)
    return out


def featured(rows: DataFrame, weights: dict[str, float], text_col: str = "text") -> DataFrame:
    """``rows`` has the column carried, whose field ``text_col`` is scored; it and the features f0, f1, f2 remain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(weights)
        for batch in batches:
            texts = batch.column("carried").field(text_col)
            made = np.array([grammar.features(t.as_py() or "") for t in texts], np.float64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("carried"), *(pa.array(made[:, k]) for k in range(3))], ["carried", "f0", "f1", "f2"])

    schema = T.StructType([rows.schema["carried"], *(T.StructField(f"f{k}", T.DoubleType()) for k in range(3))])
    return rows.select("carried").mapInArrow(run, schema)


def fit_curve(features: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic coefficients, the constant last, by Newton steps with a small penalty; a fixed curve without two kinds of labels."""
    if toxic.sum() < 5 or (1 - toxic).sum() < 5:
        return np.array([0.9, 0.9, 0.0, -3.0])
    x = np.column_stack((features, np.ones(len(features))))
    penalty = np.diag([0.1, 0.1, 0.1, 0.01])
    beta = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - toxic) + penalty @ beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, gradient)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAINING_ROWS
) -> tuple[dict[str, float], np.ndarray]:
    """The grammar's weights and the curve."""
    training = training_rows(docs, labels, id_col, text_col, label_col, rows)
    weights = learn_weights(training)
    held = training.where("fold = 3").select(F.struct("toxic", "text").alias("carried"))
    found = featured(held, weights).select(F.col("carried.toxic").alias("toxic"), "f0", "f1", "f2").toPandas()
    return weights, fit_curve(found[["f0", "f1", "f2"]].to_numpy(), (found["toxic"] > 0).to_numpy(float))


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], carry: list[str], text_col: str = "text") -> DataFrame:
    """carried, a struct of the columns ``carry``, and score of every document."""
    weights, beta = model
    rows = docs.select(F.struct(*(F.col(c) for c in dict.fromkeys([*carry, text_col]))).alias("carried"))
    power = F.lit(float(beta[3]))
    for k in range(3):
        power = power + F.col(f"f{k}") * float(beta[k])
    kept = F.struct(*(F.col("carried")[c].alias(c) for c in carry)).alias("carried")
    return featured(rows, weights, text_col).select(kept, (1 / (1 + F.exp(-power))).alias("score"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score stays below the threshold, with all their columns."""
    scored = score(docs, train(docs, labels, id_col, text_col), docs.columns, text_col)
    return scored.where(F.col("score") < threshold).select(*(F.col("carried")[c].alias(c) for c in docs.columns))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return out.select(
        "carried.doc_id",
        F.coalesce(fold(F.col("carried.doc_id")) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
