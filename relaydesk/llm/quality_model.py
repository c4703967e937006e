"""Quality of a text by positive-unlabelled learning.

Trusted positives and unlabelled web text stand for the two sides; negatives are never shown. The class
prior among the unlabelled is estimated first (a net tells positives from unlabelled; the share of unlabelled
rows above a score, over that of positives, bounds the prior at every score, and the best bin gives it).
Then a net minimises the non-negative unbiased risk: the positive risk, plus the unlabelled risk with the
positives' part taken off, which is stopped from going below zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Workspace, text_pieces
from .hashing import shingles, unique_per_row, words
from .learning import Net, Scaler, held_out, logistic, minibatches, seeded_few, sigmoid

SAMPLE_ROWS = 20_000  # positives, and as many unlabelled rows, that the net is fitted on
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "pipes", "shouts", "periods", "commas", "other_marks",
    "beyond_ascii", "lines_per_word", "new_windows", "new_words", "upper_words",
)
_CLASSES = np.zeros(256, np.uint8)
for _number, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b"|", b"!?", b".", b",", b"\"'()[]{}:;/\\@^~_=+-`", bytes(range(128, 256)), b"\n"), 1):
    _CLASSES[list(_bytes)] = _number


def _features(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of :data:`FEATURES` per text; a text without words has zeros but for what its bytes show."""
    n = len(at) - 1
    sizes = np.diff(at)
    row = np.repeat(np.arange(n), sizes)
    counts = np.bincount(row * 16 + _CLASSES[buf], minlength=16 * n).reshape(n, 16)
    begin, end, own = words(buf, at)
    n_words = np.bincount(own, minlength=n)
    some = np.maximum(n_words, 1)
    size = np.maximum(sizes, 1)
    windows, w_row = shingles(buf, at, 3)
    singles, s_row = shingles(buf, at, 1)
    new = lambda h, r: np.bincount(unique_per_row(h, r)[1], minlength=n) / np.maximum(np.bincount(r, minlength=n), 1)
    shouted = np.bincount(own, weights=(_CLASSES[buf[begin]] == 1) & (_CLASSES[buf[np.minimum(begin + 1, end - 1)]] == 1) if len(begin) else None, minlength=n)
    word_bytes = np.bincount(own, weights=end - begin, minlength=n) / some
    return np.column_stack([
        np.log1p(sizes), np.log1p(n_words), word_bytes, *[counts[:, k] / size for k in (1, 2)], *[counts[:, k] / some for k in (3, 4, 5, 6, 7, 8)],
        counts[:, 9] / size, counts[:, 10] / some, new(windows, w_row), new(singles, s_row), shouted / some,
    ]).astype(np.float32)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, x``: the features of every whole text; null is empty."""

    def kernel(batches):
        for batch in batches:
            for first, last, buf, at in text_pieces(batch.column(1)):
                x = _features(buf, at)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists], ["doc_id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(kernel, f"doc_id {kind}, x array<float>")


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.05, doubt: float = 1.0) -> float:
    """Share of positives among unlabelled scores, by the best bin: the smallest ratio of the shares of
    unlabelled and positive scores above a threshold, each widened by its sampling error."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    cuts = np.quantile(positive, np.linspace(0, 1 - least, 200))
    above = lambda s: 1 - np.searchsorted(np.sort(s), cuts, side="left") / len(s)
    p, u = above(positive), above(unlabelled)
    error = doubt * (np.sqrt(u * (1 - u) / len(unlabelled)) + u / p * np.sqrt(p * (1 - p) / len(positive)))
    return float(np.clip((u / p)[np.argmin((u + error) / p)], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, hidden: int = 16, epochs: int = 40, seed: int = 42, batch: int = 512):
    """``(scaler, net, prior)`` by non-negative unbiased risk with the logistic loss."""
    both = np.concatenate([positive, unlabelled])
    scaler = Scaler(both)
    p, u = scaler(positive), scaler(unlabelled)
    rng = np.random.default_rng(seed)
    # the prior is read off rows that its net has not seen
    half = lambda x: rng.permutation(len(x)) < len(x) / 2
    a, b = half(p), half(u)
    split = logistic(np.concatenate([p[a], u[b]]), np.concatenate([np.ones(a.sum()), np.zeros(b.sum())]), seed=seed, epochs=20)
    prior = class_prior(split(p[~a]), split(u[~b]))
    net = Net(p.shape[1], hidden, seed)

    def gradient(m, rows):
        xp, xu = p[rng.integers(0, len(p), len(rows))], u[rows]
        x = np.concatenate([xp, xu])
        s = sigmoid(m(x))
        sp, su = s[: len(xp)], s[len(xp) :]
        loss_as_negative = lambda z: -np.log(np.clip(1 - z, 1e-12, 1))
        negative = loss_as_negative(su).mean() - prior * loss_as_negative(sp).mean()
        if negative >= 0:  # d/dz of -log s(z) is s - 1, of -log(1 - s(z)) is s
            g = np.concatenate([prior * (sp - 1) / len(xp) - prior * sp / len(xp), su / len(xu)])
        else:  # below zero the negative part is undone instead
            g = np.concatenate([prior * sp / len(xp), -su / len(xu)])
        return x, g

    net.fit(minibatches(len(u), batch, epochs, rng), gradient, rate=0.005)
    return scaler, net, prior


def score(docs: DataFrame, labels: DataFrame, work: Workspace, folds: int = 4, fold: int = 2, sample_rows: int = SAMPLE_ROWS, seed: int = 42,
          threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted``: probability that a text is of quality 1.

    Positives are rows whose label outside the held-out fold is 1; unlabelled are rows without any label
    outside it. At most ``sample_rows`` of each fit the model, all texts are scored. Null or empty texts have
    a score like any other. An id with several labels is positive if one is. Without positives or unlabelled
    rows the score is 0.5. Repeated rows are scored each; other columns are not read.
    """
    told = work.stage("features", features(docs.select("doc_id", "text")).withColumn("held_out", held_out("doc_id", folds, fold)))
    known = labels.where(~held_out("doc_id", folds, fold) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = told.where(F.col("doc_id").isNotNull()).join(known, "doc_id", "left")
    take = lambda part: np.array([r[0] for r in seeded_few(part.select("doc_id", "x"), sample_rows, "doc_id", seed).select("x").collect()], np.float64).reshape(-1, len(FEATURES))
    positive, unlabelled = take(rows.where("quality = 1")), take(rows.where("quality IS NULL"))
    model = fit(positive, unlabelled, seed=seed)[:2] if len(positive) and len(unlabelled) else None

    def kernel(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES)).astype(np.float64)
            s = sigmoid(model[1](model[0](x))) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s)], ["doc_id", "held_out", "score"])

    kind = told.schema["doc_id"].dataType.simpleString()
    scored = told.select("doc_id", "x", "held_out").mapInArrow(kernel, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
