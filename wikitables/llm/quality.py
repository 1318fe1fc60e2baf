"""Document quality by co-training: a classifier of the text's content and one of the page's metadata teach each other.

The content view sees shapes of the text (word lengths, repeated words and
lines, symbols, capitals, digits, ends of lines) and hashed short words (of four
bytes at most); the metadata view sees language, source and length.  Each view
has a logistic classifier.  The pool is every document without a label that is
not held out.  In every round both classifiers score the whole pool on Spark;
counts of the log odds in bins give the odds beyond which the surest SHARE lies,
split into good and bad as the labels are.  Of these documents the other view
learns from TAUGHT at a time, chosen by hash.  At the end each view is
calibrated on labelled documents that neither saw, and a document's score is the
mean of the calibrated log odds, weighted by what each view explains there.
Without a pool no round runs.

Training takes at most TRAINING_ROWS labelled documents, those of the least
hashed ids, and about TAUGHT pseudo-labelled ones per view and round; this
bounds what the driver holds.  The views of all documents of the pool are stored
once.  Every document is scored, from its whole text.

Defined results: a null text is an empty text; null languages, sources and
lengths are values of their own; an id that is labelled more than once is good
if all labels say so; without labels of both kinds every score is the share of
good labels, or one half; rows with equal ids are scored one by one; an empty
table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table, whole_text, word_blocks
from .toxicity import fold

TRAINING_ROWS = 12_000
# Pseudo-labelled documents that a view is taught in a round.
TAUGHT = 400
ROUNDS = 5
# The share of the pool that counts as surest.
SHARE = 0.05
# Bins of the log odds, from -32 to 32, and the bins at -1 and 1: what lies between these is never sure.
BINS = 4096
_UNSURE = (31 * BINS // 64, 33 * BINS // 64)
THRESHOLD = 0.5
HASHED = 64
SHAPES = 16
CONTENT = SHAPES + HASHED
METADATA = 64
_UPPER, _DIGITS, _SYMBOLS = string.ascii_uppercase.encode(), string.digits.encode(), b"#$%&*+/<=>@[\\]^_`{|}~"


def content_features(text: str) -> np.ndarray:
    """The content view of a text."""
    data = text.encode()
    out = np.zeros(CONTENT, np.float32)
    words: Counter[bytes] = Counter()
    n_words = ended = repeats = 0
    before = b""
    for block in word_blocks(data):
        words.update(block)
        n_words += len(block)
        ended += sum(w[-1:] in b".!?" for w in block)
        repeats += sum(a == b for a, b in zip([before, *block], block, strict=False))
        before = block[-1] if block else before
    lines = [x for x in data.split(b"\n") if x.strip()]
    size, total, n_lines = max(len(data), 1), max(n_words, 1), max(len(lines), 1)
    upper, digits, symbols = (len(data) - len(data.translate(None, kind)) for kind in (_UPPER, _DIGITS, _SYMBOLS))
    most = words.most_common(1)[0][1] if words else 0
    out[:SHAPES] = (
        np.log1p(n_words),
        np.log1p(len(data)),
        len(data) / total / 10,
        len(words) / total,
        most / total,
        repeats / total,
        ended / total,
        len(set(lines)) / n_lines,
        np.log1p(len(lines)),
        n_words / n_lines / 100,
        symbols / size * 10,
        upper / size,
        digits / size * 10,
        (data.count(b"http") + data.count(b"www.") + data.count(b"@")) / total * 10,
        sum(c for w, c in words.items() if len(w) > 20) / total * 10,
        data.count(b"|") / total,
    )
    for word, count in words.items():
        if len(word) <= 4:
            out[SHAPES + zlib.crc32(word.lower()) % HASHED] += count
    out[SHAPES:] /= total
    return out


def metadata_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """The metadata view: hashed language and source, and the stated length."""
    out = np.zeros(METADATA, np.float32)
    out[zlib.crc32(f"lang={lang}".encode()) % (METADATA - 4)] += 1
    out[zlib.crc32(f"source={source}".encode()) % (METADATA - 4)] += 1
    n = np.log1p(max(n_chars or 0, 0))
    out[-4:] = (n, n * n / 10, n < np.log1p(200), n_chars is None)
    return out


class Logistic:
    """Logistic regression on scaled features, by Newton steps with a small penalty."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._scaled(x)
        penalty = np.eye(z.shape[1])
        penalty[-1, -1] = 1e-3
        beta = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            gradient = z.T @ (weight * (p - y)) + penalty @ beta
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, gradient)
            beta -= step
            if np.abs(step).max() < 1e-6:
                break
        self.beta = beta
        return self

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack((z, np.ones(len(z))))

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._scaled(x) @ self.beta, -30, 30)


class CoTrained:
    """Two views that have taught each other, their calibration and weights."""

    def __init__(self, views: list[Logistic], curves: list[tuple[float, float]], weights: list[float]) -> None:
        self.views, self.curves, self.weights = views, curves, weights

    def score(self, x: list[np.ndarray]) -> np.ndarray:
        odds = sum(w * (a * v.odds(part) + b) for v, (a, b), w, part in zip(self.views, self.curves, self.weights, x, strict=True))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


class Constant:
    """The score of all documents where there is nothing to learn."""

    def __init__(self, share: float) -> None:
        self.share = share

    def score(self, x: list[np.ndarray]) -> np.ndarray:
        return np.full(len(x[0]), self.share)


def _loss(odds: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, np.where(y > 0, -odds, odds))))


def _bin(odds: np.ndarray) -> np.ndarray:
    return ((odds + 32) * (BINS // 64)).astype(np.int64)


def _cut(counts: np.ndarray, wanted: int, taught: int) -> tuple[int, float]:
    """The last of the first bins that hold ``wanted`` documents, as far as these are sure, and the share of their documents that is taught."""
    if not wanted:
        return -1, 0.0
    running = np.cumsum(counts)
    last = min(int(np.searchsorted(running, wanted)), _UNSURE[0] - 1)
    return last, min(1.0, min(wanted, taught) / max(int(running[last]), 1))


class Pool:
    """Documents without labels: rows (at, a hash of the id; content, metadata) that stay on the executors."""

    def __init__(self, rows: DataFrame, share: float = SHARE, taught: int = TAUGHT) -> None:
        self.rows, self.share, self.size = rows, share, taught
        self.taught = [np.zeros(0, np.int64), np.zeros(0, np.int64)]  # hashes of what a view has been taught

    def _bins(self, views: list[Logistic]):
        """A function from a batch to hashes, views and, by classifier, the bins of the documents that the other view may be taught."""
        taught = self.taught

        def of(batch: pa.RecordBatch):
            at = batch.column("at").to_numpy()
            x = [batch.column(c).flatten().to_numpy().reshape(len(at), len(v.mean)) for c, v in zip(("content", "metadata"), views, strict=True)]
            return at, x, [np.where(np.isin(at, taught[1 - k]), -1, _bin(views[k].odds(x[k].astype(np.float64)))) for k in (0, 1)]

        return of

    def counts(self, views: list[Logistic]) -> np.ndarray:
        """Documents by classifier and bin."""
        bins = self._bins(views)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, BINS), np.int64)
            for batch in batches:
                for k, found in enumerate(bins(batch)[2]):
                    total[k] += np.bincount(found[found >= 0], minlength=BINS)
            view, place = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(view), pa.array(place), pa.array(total[view, place])], ["view", "bin", "n"])

        total = np.zeros((2, BINS), np.int64)
        for r in self.rows.mapInArrow(run, "view long, bin long, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).collect():
            total[r["view"], r["bin"]] = r["n"]
        return total

    def lessons(self, views: list[Logistic], good: float, turn: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """By view: what it is taught in this round, and its marks."""
        cuts = []
        for counts in self.counts(views):
            n = int(counts.sum() * self.share)
            n_good, size = round(n * good), round(self.size * good)
            low, few = _cut(counts, n - n_good, self.size - size)
            high, some = _cut(counts[::-1], n_good, size)
            cuts.append((low, few, BINS - 1 - high, some))
        bins = self._bins(views)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, _, found = bins(batch)
                drawn = at.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn)
                drawn = ((drawn ^ (drawn >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(11)) / 2.0**53
                for k, (low, few, high, some) in enumerate(cuts):
                    bad = (found[k] >= 0) & (found[k] <= low) & (drawn < few)
                    sure = np.flatnonzero(bad | (found[k] >= high) & (drawn < some))
                    column = batch.column(("metadata", "content")[k]).take(pa.array(sure))
                    columns = [pa.repeat(pa.scalar(1 - k, pa.int64()), len(sure)), pa.array(at[sure]), pa.array(~bad[sure]), column]
                    yield pa.RecordBatch.from_arrays(columns, ["view", "at", "good", "x"])

        chosen = self.rows.mapInArrow(run, "view long, at long, good boolean, x array<float>").toPandas().sort_values(["view", "at"])
        out = []
        for k in (0, 1):
            part = chosen[chosen["view"] == k]
            self.taught[k] = np.concatenate((self.taught[k], part["at"].to_numpy(np.int64)))
            out.append((k, np.array(part["x"].tolist(), np.float64).reshape(len(part), len(views[k].mean)), part["good"].to_numpy(float)))
        return out


def co_train(x: list[np.ndarray], y: np.ndarray, apart: np.ndarray, pool: Pool, rounds: int = ROUNDS) -> CoTrained | Constant:
    """Fit on labelled rows (``apart`` marks those kept for calibration) and an unlabelled pool; ``x`` by view."""
    fit = ~apart
    if min(y[fit].sum(), (1 - y[fit]).sum()) < 2:
        return Constant(float(y.mean()) if len(y) else 0.5)
    good = float(y[fit].mean())
    own_x, own_y = [part[fit] for part in x], [y[fit]] * 2
    own_w = [np.ones(int(fit.sum()))] * 2

    def learned(k: int) -> Logistic:
        return Logistic().fit(own_x[k], own_y[k], own_w[k])

    views = [learned(0), learned(1)]
    for turn in range(rounds):
        lessons = pool.lessons(views, good, turn)
        if not any(len(marks) for _, _, marks in lessons):
            break
        for k, rows, marks in lessons:
            own_x[k] = np.concatenate((own_x[k], rows))
            own_y[k] = np.concatenate((own_y[k], marks))
            own_w[k] = np.concatenate((own_w[k], np.full(len(marks), 0.5)))
        views = [learned(0), learned(1)]

    # Calibration: a line through each view's odds, then weights by what they explain beyond the share of good labels.
    held = apart if min(y[apart].sum(), (1 - y[apart]).sum()) >= 2 else fit
    curves, gains = [], []
    base = _loss(np.full(int(held.sum()), np.log(y[held].mean() / (1 - y[held].mean()))), y[held])
    for k in (0, 1):
        odds = views[k].odds(x[k][held])
        line = Logistic().fit(odds[:, None], y[held], np.ones(len(odds)))
        a = float(line.beta[0] / line.scale[0])
        curves.append((a, float(line.beta[1] - a * line.mean[0])))
        gains.append(max(base - _loss(a * odds + curves[k][1], y[held]), 1e-6))
    return CoTrained(views, curves, [g / sum(gains) for g in gains])


def _views(rows: DataFrame) -> DataFrame:
    """Columns carried, lang, source, n_chars, text to carried and the two views."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [content_features(t.as_py()).tolist() for t in batch.column("text")]
            meta = [metadata_features(*v).tolist() for v in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)]
            kind = pa.list_(pa.float32())
            yield pa.RecordBatch.from_arrays([batch.column("carried"), pa.array(text, kind), pa.array(meta, kind)], ["carried", "content", "metadata"])

    carried = rows.schema["carried"].dataType.simpleString()
    return rows.select("carried", "lang", "source", "n_chars", "text").mapInArrow(run, f"carried {carried}, content array<float>, metadata array<float>")


def _plain(docs: DataFrame, carried: list, text_col: str) -> DataFrame:
    return docs.select(
        F.struct(*carried).alias("carried"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.col("n_chars").cast("long").alias("n_chars"),
        whole_text(text_col).alias("text"),
    )


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    training_rows: int = TRAINING_ROWS,
) -> CoTrained | Constant:
    """Co-train on documents whose fold is not 2; fold 3 calibrates."""
    marks = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("good"))
        .groupBy("id")
        .agg(F.min("good").alias("good"))
    )
    order = [F.xxhash64("id"), F.col("id")]
    labelled = marks.where(fold(F.col("id")) != 2).orderBy(*order).limit(training_rows)
    used = docs.where(F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 2))
    viewed = _views(_plain(used, [F.col(id_col).alias("id")], text_col)).select(F.col("carried.id").alias("id"), "content", "metadata")
    # Labels meet the views, not the texts.
    viewed = stored(viewed.join(marks, "id", "left"), "quality-views", compression="zstd")
    chosen = F.broadcast(labelled.select("id"))
    found = viewed.where("good IS NOT NULL").join(chosen, "id", "left_semi").select("good", fold(F.col("id")).alias("fold"), "content", "metadata").toPandas()
    x = [np.array(found[c].tolist(), np.float64).reshape(len(found), width) for c, width in (("content", CONTENT), ("metadata", METADATA))]
    pool = Pool(viewed.where("good IS NULL").select(F.xxhash64("id").alias("at"), "content", "metadata"))
    return co_train(x, found["good"].to_numpy(float), found["fold"].to_numpy() == 3, pool)


def score(docs: DataFrame, model: CoTrained | Constant, carry: list[str], text_col: str = "text") -> DataFrame:
    """carried, a struct of the columns ``carry``, and score, the chance of good quality, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [content_features(t.as_py()) for t in batch.column("text")]
            meta = [metadata_features(*v) for v in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)]
            x = [np.array(v, np.float64).reshape(batch.num_rows, w) for v, w in ((text, CONTENT), (meta, METADATA))]
            yield pa.RecordBatch.from_arrays([batch.column("carried"), pa.array(model.score(x), pa.float64())], ["carried", "score"])

    rows = _plain(docs, [F.col(c) for c in carry], text_col)
    carried = rows.schema["carried"].dataType.simpleString()
    return rows.mapInArrow(run, f"carried {carried}, score double")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out (never trained on), score, predicted (1: good)."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return out.select(
        "carried.doc_id",
        F.coalesce(fold(F.col("carried.doc_id")) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
