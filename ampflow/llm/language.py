"""Language ID by a linear-chain conditional random field over words.

A word's features are its character n-grams between boundary marks (those that
touch a mark are its affixes) and, if training saw it often, itself (lexicon).
Transitions between the languages of neighbouring words are learned with them.
Forward-backward gives each word's language in mixed text; a document gets the
language with the most letters.

Null and letterless texts are ``und`` with score 0.  Without labelled rows
every document is ``und``.  Ties go to the language first in order.
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

#: Documents a language to learn from, at most, taken by the hash of their id.
TRAIN_DOCS = 150
#: Characters of text to learn from, at most.
TRAIN_CHARS = 30_000_000
#: Buckets of n-gram features.
BUCKETS = 1 << 16
NGRAMS = (1, 2, 3, 4)
#: A word is in the lexicon from this many uses in training.
LEXICON_USES = 3
#: Distinct words whose scores a Python worker keeps.
CACHE = 250_000
_OPEN, _SHUT = "\x02", "\x03"


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS, languages)
    lexicon: np.ndarray  # sorted hashes of words
    words: np.ndarray  # (lexicon + 1, languages); the last row is zero
    trans: np.ndarray


def _letters(word: str) -> str:
    """The word in lower case without what is at its ends and no letter; empty if it has no letter."""
    if word.isalpha():
        return word.lower()
    a, b = 0, len(word)
    while a < b and not word[a].isalpha():
        a += 1
    while b > a and not word[b - 1].isalpha():
        b -= 1
    return word[a:b].lower()


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, its word's index, hash of each word)."""
    text = _OPEN + (_SHUT + _OPEN).join(words) + _SHUT
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    opened = code == ord(_OPEN)
    word = np.cumsum(opened) - 1
    buckets, owner = [], []
    grams = np.zeros(len(code), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        grams = grams[:m] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :] + np.uint64(1)
        if n in NGRAMS:
            keep = word[:m] == word[n - 1 :]
            if n == 1:
                keep &= ~opened & (code != ord(_SHUT))
            mixed = grams[keep]
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            buckets.append((mixed >> np.uint64(40)) % np.uint64(BUCKETS))
            owner.append(word[:m][keep])
    first = np.nonzero(opened)[0]
    place = (np.arange(len(code)) - first[word]).astype(np.uint64)
    spread = (code + np.uint64(7)) * (place * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB))
    spread ^= spread >> np.uint64(29)
    hashes = np.add.reduceat(spread * np.uint64(0x9E3779B97F4A7C15), first)
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owner), hashes


def _scores(model: LanguageModel, words: list[str]) -> np.ndarray:
    buckets, owner, hashes = _features(words)
    k = len(model.languages)
    out = np.empty((len(words), k))
    for j in range(k):
        out[:, j] = np.bincount(owner, model.weights[buckets, j], len(words))
    at = np.searchsorted(model.lexicon, hashes)
    known = np.append(model.lexicon, np.uint64(0))[at] == hashes
    return out + model.words[np.where(known & (at < len(model.lexicon)), at, len(model.lexicon))]


class _Words(dict):
    """Word to its index among the distinct words met; letterless words get -1."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.size = 0

    def __missing__(self, raw: str) -> int:
        word = _letters(raw)
        at = -1
        if word:
            at, self.size = self.size, self.size + 1
            self.new.append(word)
        self[raw] = at
        return at


def fit(texts: list[str], langs: list[str], rounds: int = 30, chain_rounds: int = 6) -> LanguageModel | None:
    """Learn from whole texts; every word takes its document's language.

    First the words alone (softmax over distinct words), then the chain with
    its transitions.
    """
    names = sorted(set(langs))
    if not names:
        return None
    k, seen, ids, starts, gold, total = len(names), _Words(), [], [], [], 0
    for text, lang in zip(texts, langs):
        row = np.fromiter(map(seen.__getitem__, (text or "").split()), np.int64)
        row = row[row >= 0]
        if len(row):
            starts.append(total)
            total += len(row)
            ids.append(row)
            gold.append(np.full(len(row), names.index(lang)))
    zero = np.zeros(0, np.uint64)
    if not ids:
        return LanguageModel(names, np.zeros((BUCKETS, k)), zero, np.zeros((1, k)), np.zeros((k, k)))
    ids, gold, starts = np.concatenate(ids), np.concatenate(gold), np.array(starts)
    types = seen.size
    buckets, owner, hashes = _features(seen.new)
    counts = np.zeros((types, k))
    np.add.at(counts, (ids, gold), 1)
    uses = counts.sum(1)
    lexicon, back = np.unique(hashes, return_inverse=True)
    per_word = np.bincount(back, uses, len(lexicon))
    kept = per_word >= LEXICON_USES
    index = np.where(kept, np.cumsum(kept) - 1, int(kept.sum()))[back]
    weights, words, trans = np.zeros((BUCKETS, k)), np.zeros((int(kept.sum()) + 1, k)), np.zeros((k, k))
    model = LanguageModel(names, weights, lexicon[kept], words, trans)

    def emit() -> np.ndarray:
        out = np.empty((types, k))
        for j in range(k):
            out[:, j] = np.bincount(owner, weights[buckets, j], types)
        return out + words[index]

    def push(wrong: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g, w = np.empty_like(weights), np.empty_like(words)
        for j in range(k):
            g[:, j] = np.bincount(buckets, wrong[owner, j], BUCKETS)
            w[:, j] = np.bincount(index, wrong[:, j], len(words))
        w[-1] = 0
        return g - 1e-3 * weights, w - 1e-3 * words

    damped = np.sqrt(counts.sum(1, keepdims=True))  # frequent words would else outweigh the rest
    share = counts / counts.sum(1, keepdims=True)
    alone = crf.Adam(weights, words, rate=0.05)
    for _ in range(rounds):
        s = emit()
        s = np.exp(s - s.max(1, keepdims=True))
        alone.up(*push(damped * (share - s / s.sum(1, keepdims=True))))
    pairs = crf.observed_pairs(gold, starts, k)
    trans += np.log((pairs + 1) / (pairs + 1).sum(1, keepdims=True))
    np.clip(trans, -8, 0, out=trans)
    chain = crf.Adam(weights, words, trans, rate=0.02)
    for _ in range(chain_rounds):
        marginals, expected = crf.forward_backward(emit()[ids], starts, trans, pairs=True)
        wrong = np.zeros((types, k))
        np.add.at(wrong, (ids, gold), 1)
        for j in range(k):
            wrong[:, j] -= np.bincount(ids, marginals[:, j], types)
        chain.up(*push(wrong), pairs - expected - 1e-2 * trans)
        np.clip(trans, -8, 8, out=trans)
    model.weights = weights.astype(np.float32)
    return model


def label(model: LanguageModel | None, texts: list[str | None], state: dict | None = None) -> tuple[list[str], list[float], list[float]]:
    """Of each text its language, the share of letters in it, and the fit; ``state`` keeps words between calls.

    The fit is how sure its words are of a language each, whichever it is: mixed text has a low share and a high fit.
    """
    names, confidence, fits = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    if model is None:
        return names, confidence, fits
    state = {} if state is None else state
    if "words" not in state or len(state["words"]) > CACHE:
        state["words"], state["scores"] = _Words(), np.zeros((0, len(model.languages)))
    seen: _Words = state["words"]
    ids, starts, sizes, docs, total = [], [], [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        parts = text.split()
        row = np.fromiter(map(seen.__getitem__, parts), np.int32, len(parts))
        keep = row >= 0
        if keep.all():
            size = np.fromiter(map(len, parts), np.int32, len(parts))
        else:
            size = np.fromiter(map(len, parts), np.int32, len(parts))[keep]
            row = row[keep]
        if len(row):
            docs.append(i)
            starts.append(total)
            total += len(row)
            ids.append(row)
            sizes.append(size)
    if not docs:
        return names, confidence, fits
    if seen.new:
        state["scores"] = np.concatenate([state["scores"], _scores(model, seen.new)])
        seen.new = []
    marginals = crf.forward_backward(state["scores"][np.concatenate(ids)], np.array(starts), model.trans)
    sizes = np.concatenate(sizes)
    mass = np.add.reduceat(marginals * sizes[:, None], starts)
    whole = mass.sum(1, keepdims=True)
    sure = np.add.reduceat(marginals.max(1) * sizes, starts) / whole[:, 0]
    mass /= whole
    for i, best, row, fit_ in zip(docs, mass.argmax(1), mass, sure):
        names[i], confidence[i], fits[i] = model.languages[best], float(min(1.0, row[best])), float(min(1.0, fit_))
    return names, confidence, fits


def train(docs: DataFrame, trainable: Column, per_language: int = TRAIN_DOCS, most_chars: int = TRAIN_CHARS) -> LanguageModel | None:
    """Fit on the driver, on at most ``per_language`` documents of each language and ``most_chars`` of text in all.

    ``docs`` has doc_id, text and lang; rows with a null text or lang are left out.
    Of an id in two languages the text counts for both.
    """
    ok = docs.where(trainable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    rows = picked(ok.select("doc_id", "lang"), "lang", per_language)
    rows.sort(key=lambda r: (r["_h"], r.doc_id, r.lang))
    texts = texts_of(ok, [r.doc_id for r in rows], most_chars)
    rows = sorted((r for r in rows if r.doc_id in texts), key=lambda r: (r.doc_id, r.lang))
    return fit([texts[r.doc_id] for r in rows], [r.lang for r in rows])


def predictor(spark, model: LanguageModel | None):
    """A column function from text to struct(lang, score, fit)."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, fit double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        for texts in batches:
            names, confidence, fits = label(shared.value, texts.tolist(), state)
            yield pd.DataFrame({"lang": names, "score": confidence, "fit": fits})

    return predict


def identify(docs: DataFrame, train_on: Column, per_language: int = TRAIN_DOCS) -> DataFrame:
    """``docs`` (doc_id, text, lang) to doc_id, lang_pred, score; learns from rows where ``train_on``."""
    predict = predictor(docs.sparkSession, train(docs, train_on, per_language))
    return docs.select("doc_id", predict("text").alias("p")).select("doc_id", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs, fold("doc_id", 3) != 1)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
