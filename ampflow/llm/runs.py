"""Periodic runs of words, by an enhanced suffix array.

The words of a block of documents are one sequence of numbers in which no two
documents share a number, so one suffix array serves them all and no repeat
crosses from one text into another.  Prefix doubling gives the array, its
inverse and, from the ranks kept at each doubling, the longest common prefixes.

An LCP interval of depth d holds the suffixes that share d words.  Of its
children all but the largest are gone through: suffix i begins (or ends) a square
of period d that does not rotate right if ISA[i + d] (or ISA[i - d]) is in the
interval but in another child.  Rotated left as far as it goes, the square is a
run; squares of the same stretch merge to the smallest period.  Intervals are pairs
of positions in arrays; no tree is built.

A run repeats its period ``least_exponent`` times at least, so intervals with fewer
suffixes than that hold none and are passed over.

Words are what bytes other than space and \\t..\\r make up.  A null text has no
words, and neither runs nor kept words; an empty one is the same.  Texts of every length are
whole: a text longer than a block is a block of its own, in memory in
proportion to its words (about 150 bytes a word, more if it repeats
itself at great length).  Rows count, not ids: repeated rows give repeated
results, null ids are left as they are.  Other columns than those named are not
read.  Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampflow.llm.common import bounded_batches

#: Words of documents that share a suffix array.
BLOCK = 1 << 18
#: Suffixes that are checked at once.
CHECKED = 1 << 20
LEAST_LENGTH = 6
LEAST_EXPONENT = 4


@dataclass
class Suffixes:
    order: np.ndarray  # the suffix array
    place: np.ndarray  # its inverse
    levels: list[np.ndarray]  # levels[h][i]: class of the 2**h symbols from i
    lcp: np.ndarray  # lcp[p]: symbols that order[p - 1] and order[p] share; 0 at both ends


def _first(new: np.ndarray) -> np.ndarray:
    """Position at which each item's group begins, given where groups begin."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def suffixes(symbols: np.ndarray) -> Suffixes:
    """Prefix doubling; after each step only suffixes that share their rank are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    now = symbols[order]
    new = np.ones(n, bool)
    new[1:] = now[1:] != now[:-1]
    rank = np.empty(n, np.int32)
    rank[order] = _first(new)
    levels, apart = [rank], np.where(new, 0, -1)  # apart[p]: the step that told order[p] from order[p - 1]
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
    width = 1
    while len(open_):
        at = order[open_]
        ahead = at + width
        key = rank[at].astype(np.int64) * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[open_], key = at[by], key[by]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        rank = rank.copy()
        rank[order[open_]] = open_[_first(new)]
        fresh = open_[new]
        apart[fresh[apart[fresh] < 0]] = len(levels)
        levels.append(rank)
        open_ = open_[~(new & np.append(new[1:], True))]
        width *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return Suffixes(order, place, levels, _common(order, levels, apart))


def _common(order: np.ndarray, levels: list[np.ndarray], apart: np.ndarray) -> np.ndarray:
    """Longest common prefixes of neighbours: told apart at step s, they share 2**(s - 1) symbols and more by the lower levels."""
    n = len(order)
    lcp = np.zeros(n + 1, np.int64)
    near = np.flatnonzero(apart[1:] > 0) + 1
    lcp[near] = 1 << (apart[near] - 1)
    for h in range(len(levels) - 3, -1, -1):
        p = near[apart[near] >= h + 2]
        a, b = order[p - 1] + lcp[p], order[p] + lcp[p]
        within = np.maximum(a, b) < n
        same = within & (levels[h][np.minimum(a, n - 1)] == levels[h][np.minimum(b, n - 1)])
        lcp[p[same]] += 1 << h
    return lcp


def _smaller_left(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each position of ``at`` the nearest one to its left with a smaller value; there must be one.

    Climbs a tree of minima until a left neighbour holds a smaller value, then descends to the last of them.
    """
    tree = [values]
    while len(tree[-1]) > 1:
        v = tree[-1]
        if len(v) % 2:
            v = np.append(v, np.iinfo(np.int64).max)
        tree.append(np.minimum(v[::2], v[1::2]))
    node, level, active = at.copy(), np.zeros(len(at), np.int64), np.arange(len(at))
    want = values[at]
    for h in range(len(tree)):
        here = node[active]
        hit = (here % 2 == 1) & (tree[h][here - 1] < want[active])
        found = active[hit]
        node[found] -= 1
        level[found] = h
        active = active[~hit]
        node[active] >>= 1
        if not len(active):
            break
    for h in range(int(level.max(initial=0)), 0, -1):
        deep = np.flatnonzero(level >= h)
        right = node[deep] * 2 + 1
        inside = right < len(tree[h - 1])
        smaller = inside & (tree[h - 1][np.minimum(right, len(tree[h - 1]) - 1)] < want[deep])
        node[deep] = np.where(smaller, right, right - 1)
    return node


@dataclass
class Children:
    """Child ranges of LCP intervals, the largest of each left out: order[begin:end] within order[left:right]."""

    depth: np.ndarray
    left: np.ndarray
    right: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def small_children(lcp: np.ndarray, least: int = 2) -> Children:
    """The children but the largest of all LCP intervals of ``least`` suffixes or more."""
    at = np.flatnonzero(lcp > 0)
    left = _smaller_left(lcp, at)
    right = len(lcp) - 1 - _smaller_left(np.ascontiguousarray(lcp[::-1]), len(lcp) - 1 - at)
    large = right - left >= least
    at, left, right = at[large], left[large], right[large]
    by = np.lexsort((at, right, left))
    at, left, right = at[by], left[by], right[by]
    opens = np.ones(len(at), bool)
    opens[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    last = np.append(opens[1:], True)[: len(at)]
    own = np.cumsum(opens) - 1
    before = np.where(opens, left, np.roll(at, 1))
    own = np.append(own, own[last])
    out = Children(*(np.append(x, x[last]) for x in (lcp[at], left, right)), np.append(before, at[last]), np.append(at, right[last]))
    size = out.end - out.begin
    most = np.zeros(int(own.max(initial=-1)) + 1, np.int64)
    np.maximum.at(most, own, size)
    largest = np.zeros(len(most), np.int64)
    full = np.flatnonzero(size == most[own])
    largest[own[full]] = full
    keep = np.ones(len(size), bool)
    keep[largest] = False
    return Children(*(x[keep] for x in (out.depth, out.left, out.right, out.begin, out.end)))


def squares(s: Suffixes, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all squares that do not rotate right, of intervals of ``least`` suffixes or more."""
    c = small_children(s.lcp, least)
    n, ends = len(s.order), np.cumsum(c.end - c.begin)
    found, a = [np.zeros(0, np.int64)], 0
    while a < len(ends):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + CHECKED, "right")))
        size = c.end[a:b] - c.begin[a:b]
        of = np.repeat(np.arange(a, b), size)
        i = s.order[np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + c.begin[of]]
        for sign in (1, -1):
            j = i + sign * c.depth[of]
            inside = (j >= 0) & (j < n)
            r = s.place[np.clip(j, 0, n - 1)]
            square = inside & (r >= c.left[of]) & (r < c.right[of]) & ((r < c.begin[of]) | (r >= c.end[of]))
            found.append(np.minimum(i, j)[square] * (n + 1) + c.depth[of][square])
        a = b
    key = np.unique(np.concatenate(found))
    return key // (n + 1), key % (n + 1)


def runs(symbols: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of all runs of ``least_length`` symbols and ``least_exponent`` (2 at least) periods, by start, then period."""
    if not len(symbols):
        return (np.zeros(0, np.int64),) * 3
    s = suffixes(symbols)
    start, period = squares(s, least_exponent)
    end, turned = start + 2 * period, np.zeros(len(start), np.int64)
    for h in range(len(s.levels) - 1, -1, -1):  # rotate left: 2**h words at once, where they equal those a period on
        before = start - turned - (1 << h)
        inside, before, level = before >= 0, np.maximum(before, 0), s.levels[h]
        turned[inside & (level[before] == level[np.minimum(before + period, len(level) - 1)])] += 1 << h
    start = start - turned
    long = end - start >= np.maximum(least_length, least_exponent * period)
    start, end, period = start[long], end[long], period[long]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


def kept(n: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``n`` words no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) == 0


def blocks_of(texts: list[list[bytes]], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` words each."""
    a, held = 0, 0
    for b, words in enumerate(texts):
        if held and held + len(words) > size:
            yield a, b
            a, held = b, 0
        held += len(words)
    if a < len(texts):
        yield a, len(texts)


def runs_of_texts(texts: list[list[bytes]], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of each list of words, in word numbers of its own; see ``runs``."""
    for a, b in blocks_of(texts):
        sizes = np.array([len(w) for w in texts[a:b]])
        offsets = np.append(0, np.cumsum(sizes))
        flat = np.empty(offsets[-1], object)
        flat[:] = [w for words in texts[a:b] for w in words]
        codes = pd.factorize(flat)[0].astype(np.int64)
        symbols = np.repeat(np.arange(b - a), sizes) * (len(codes) + 1) + codes
        start, end, period = runs(symbols, least_length, least_exponent)
        cut = np.searchsorted(start, offsets)
        for k in range(b - a):
            own = slice(cut[k], cut[k + 1])
            yield start[own] - offsets[k], end[own] - offsets[k], period[own]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """A batch of (id, text as bytes, ...) in slices of about a block of words."""
    held, a, size = [], 0, 0
    for k, text in enumerate(batch.column(1)):
        words = (text.as_py() or b"").split()  # of bytes: space and \t..\r only
        if held and size + len(words) > BLOCK:
            yield batch.slice(a, k - a), held
            held, a, size = [], k, 0
        held.append(words)
        size += len(words)
    if held:
        yield batch.slice(a), held


def collapsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT, prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``id_col``, ``n_words``, ``runs`` (start, length, period, by start, then period) and ``text`` of each document.

    ``text`` is what is left without the repeats of every run: its words joined by a space.
    ``prepare`` may change the words of a text, given its id.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in _texts(batch):
                ids = rows.column(0)
                if prepare:
                    texts = [prepare(i, w) for i, w in zip(ids.to_pylist(), texts)]
                n_words, found, left = [], [], []
                for words, (start, end, period) in zip(texts, runs_of_texts(texts, least_length, least_exponent)):
                    n_words.append(len(words))
                    found.append([{"start": a, "length": b - a, "period": q} for a, b, q in zip(start.tolist(), end.tolist(), period.tolist())])
                    left.append(b" ".join(words if not len(start) else [words[i] for i in np.flatnonzero(kept(len(words), start, end, period)).tolist()]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(found, run), pa.array(left, pa.binary())], ["id", "n_words", "runs", "text"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = rows.mapInArrow(find, f"id {kind}, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, text binary")
    return out.select(F.col("id").alias(id_col), "n_words", "runs", F.col("text").cast("string").alias("text"))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Where a tenth of ids by crc32 say so, the words from one on repeat the first of them."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = collapsed(docs, prepare=planted)
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"), F.expr("1000 * b.length div -b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

