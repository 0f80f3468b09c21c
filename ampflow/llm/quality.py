"""Quality of documents by a linear-chain conditional random field over lines.

Each line is labelled good or bad from its own features and those of the lines
before and after it; label transitions are learned too.  A document's score is
the mean over its lines of the marginal of "good", weighted by their lengths.

A null text counts as empty.  An empty text is one empty line; its features
say so, and it is scored like any other.  Without labelled rows every score is
0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampflow.llm import crf
from ampflow.llm.common import bounded_batches, fold, picked, texts_of

#: Documents of either label to learn from, at most, taken by the hash of their id.
TRAIN_DOCS = 700
#: Characters of text to learn from, at most.
TRAIN_CHARS = 30_000_000
#: From this score on a document is good.
THRESHOLD = 0.3
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>"
_LOUD = b"!?"
_STOPS = b".,;:"
_OTHER = b"()[]{}\"'`~^_=+/\\@-"
_RATIOS = (_UPPER, _DIGITS, _SYMBOLS, _LOUD, _STOPS, _OTHER, b" \t")


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, features) and the length of each line in code points."""
    rows, sizes, seen = [], [], set()
    for line in (text or "").split("\n"):
        b = line.encode("utf-8", "replace")
        n = len(b)
        words = b.split()
        k = len(words)
        row = [np.log1p(n)]
        row += [(n - len(b.translate(None, cls))) / n if n else 0.0 for cls in _RATIOS]
        if k:
            unique = len(set(words))
            row += [1 - unique / k, sum(map(bytes.__eq__, words, words[1:])) / k, min(n / k, 40.0) / 10, b.count(b"|") / k]
            row += [float(k < 4), float(words[-1][-1:] in (b".", b"!", b"?", b":", b'"')), float(line.strip()[:1].isupper())]
        else:
            row += [0.0] * 7
        row += [float(k == 0), float(k > 0 and line in seen)]
        seen.add(line)
        rows.append(row)
        sizes.append(len(line))
    x = np.array(rows)
    return np.concatenate([x, np.sqrt(x[:, 1:12]), x[:, 1:12] > 0.1], 1), np.array(sizes)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the line before and after, then first and last."""
    zero = np.zeros((1, x.shape[1]))
    ends = np.zeros((len(x), 2))
    ends[0, 0] = ends[-1, 1] = 1
    return np.concatenate([x, np.concatenate([zero, x[:-1]]), np.concatenate([x[1:], zero]), ends], 1)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of label 1 against label 0; the last is the bias
    trans: np.ndarray


def _design(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts, sizes, starts, total = [], [], [], 0
    for text in texts:
        x, size = line_features(text)
        parts.append(with_neighbours(x))
        sizes.append(size)
        starts.append(total)
        total += len(x)
    return np.concatenate(parts), np.concatenate(sizes), np.array(starts)


def fit(texts: list[str | None], labels: list[int], rounds: int = 250) -> QualityModel | None:
    """Learn from whole texts; every line takes its document's label."""
    if not texts or len(set(labels)) < 2:
        return None
    x, _, starts = _design(texts)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = np.clip((x - mean) / scale, -6, 6)
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    count = np.diff(np.append(starts, len(x)))
    gold = np.repeat(np.array(labels), count)
    per_line = np.repeat(1 / np.sqrt(count), count)  # long documents would else outweigh the rest
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    pairs = crf.observed_pairs(gold, starts, 2)
    adam = crf.Adam(w, trans, rate=0.05)
    for _ in range(rounds):
        scores = np.stack([np.zeros(len(x)), x @ w], 1)
        marginals, expected = crf.forward_backward(scores, starts, trans, pairs=True)
        adam.up(x.T @ (per_line * (gold - marginals[:, 1])) / len(texts) - 1e-3 * w, (pairs - expected) / max(1, len(x)) - 1e-2 * trans)
    return QualityModel(mean, scale, w, trans)


def score(model: QualityModel | None, texts: list[str | None]) -> np.ndarray:
    """Length-weighted marginal of "good" of each text."""
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    x, sizes, starts = _design(texts)
    x = np.clip((x - model.mean) / model.scale, -6, 6)
    s = np.stack([np.zeros(len(x)), x @ model.weights[:-1] + model.weights[-1]], 1)
    good = crf.forward_backward(s, starts, model.trans)[:, 1]
    weight = sizes + 1.0
    return np.clip(np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts), 0, 1)


def train(docs: DataFrame, labels: DataFrame, trainable: Column, per_label: int = TRAIN_DOCS, most_chars: int = TRAIN_CHARS) -> QualityModel | None:
    """Fit on the driver, on at most ``per_label`` documents of either label and ``most_chars`` of text in all.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality (0 or 1; others are left out).
    """
    rows = picked(labels.where(trainable & F.col("quality").isin(0, 1)).select("doc_id", "quality"), "quality", per_label)
    rows.sort(key=lambda r: (r["_h"], r.doc_id, r.quality))
    texts = texts_of(docs.select("doc_id", "text"), [r.doc_id for r in rows], most_chars)
    rows = sorted((r for r in rows if r.doc_id in texts), key=lambda r: (r.doc_id, r.quality))
    return fit([texts[r.doc_id] for r in rows], [r.quality for r in rows])


def scorer(spark, model: QualityModel | None):
    """A column function from text to score."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score(shared.value, texts.tolist()), dtype="float64")

    return run


def classify(docs: DataFrame, labels: DataFrame, train_on: Column) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, score, predicted; learns from labels where ``train_on``."""
    run = scorer(docs.sparkSession, train(docs, labels, train_on))
    out = docs.select("doc_id", run("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = classify(docs, labels, fold("doc_id", 5) != 0)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
