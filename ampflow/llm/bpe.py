"""Byte-level BPE by replaying merges over the distinct words of a block.

Words are what the splitting pattern matches.  For the words of a block not met
before, an inverted index leads from each pair of neighbouring tokens (by the
rank of what it merges to) to the positions where it stands.  Ranks are taken
in order; each merges its pair wherever it stands, all words at once, and only
the pairs of the touched neighbours enter the index anew.

Texts are split at spaces that follow a non-space first: no match runs over
such a place, so these pieces, which recur, can be encoded once.

A null text is empty: no tokens.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampflow.llm.common import bounded_batches

#: Distinct pieces that a Python worker keeps encoded, about.
CACHE = 250_000
#: Characters of text whose new words are merged together: the more, the more words a merge step serves.
BLOCK = 16_000_000
_NONE = np.int32(1 << 30)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank, a line each."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merges:
    """Which pair of tokens merges to which, for arrays of pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ids must be below 65536")
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 16 | right] = rank
        self.keys = np.array(sorted(pairs), np.uint32)
        self.made = np.array([pairs[k] for k in self.keys.tolist()] + [0], np.int32)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        #: Tokens with which a pair of a lower rank than their own can be made.
        self.early = {x for k, made in pairs.items() for x in (k >> 16, k & 0xFFFF) if made < x}

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge; ``_NONE`` where it has none."""
        key = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.made[at], _NONE)


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Merge all words at once: (ids of all words in a row, where each word's begin and the last ends).

    A step merges a pair in all its places; of places that overlap, every
    other one from the left.  Where a merge makes a pair of a lower rank, that
    one goes first: the word's places further right wait in the index.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    words_at = np.cumsum(size) - size
    n = int(size.sum())
    token = np.append(merges.byte[np.frombuffer(b"".join(words), np.uint8)], np.int32(0xFFFF))  # the last: no token
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    full = size > 0
    after[(words_at + size)[full] - 1] = n
    before[words_at[full]] = n
    owner = np.repeat(np.arange(len(words)), size)
    alive = np.ones(n + 1, bool)
    rank = np.append(merges.look(token[:n], token[after[:n]]), _NONE)
    placed = np.nonzero(rank < _NONE)[0]
    placed = placed[np.argsort(rank[placed], kind="stable")]
    cuts = np.nonzero(np.diff(rank[placed], prepend=-1))[0].tolist()
    heap = rank[placed[cuts]].tolist()  # ascending, so a heap
    spread = placed.tolist()
    index = {r: spread[a:b] for r, a, b in zip(heap, cuts, [*cuts[1:], len(spread)])}

    def enter(ranks: np.ndarray, places: np.ndarray) -> None:
        rank[places] = ranks
        for r, p in zip(ranks.tolist(), places.tolist()):
            if r in index:
                index[r].append(p)
            elif r != _NONE:
                index[r] = [p]
                heappush(heap, r)

    def _in_turn(r: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places to merge now, up to each word's first that makes a lower pair; the words that have more."""
        following = after[after[at]]
        touching = np.append(False, following[:-1] == at[1:])
        left = np.where(touching, r, token[before[at]])
        own = np.full(len(at), r)
        lower = np.minimum(merges.look(own, token[following]), merges.look(left, own)) < r
        word = owner[at]
        begin = np.nonzero(np.append(True, word[1:] != word[:-1]))[0]
        before_this = np.cumsum(lower) - lower
        waits = before_this > np.repeat(before_this[begin], np.diff(np.append(begin, len(at))))
        return at[~waits], np.unique(word[waits])

    while heap:
        r = heappop(heap)
        at = np.array(index.pop(r))
        at = at[rank[at] == r]
        if len(at) > 1:
            at = np.unique(at)
            run = np.append(True, after[at[:-1]] != at[1:])
            begin = np.nonzero(run)[0]
            every = at
            at = at[(np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % 2 == 0]
            if r in merges.early and (owner[at[1:]] == owner[at[:-1]]).any():
                at, waiting = _in_turn(r, at)
                if len(waiting):
                    index[r] = every[np.isin(owner[every], waiting)].tolist()
                    heappush(heap, r)
        if not len(at):
            continue
        gone = after[at]
        following = after[gone]
        token[at], alive[gone], rank[gone] = r, False, _NONE
        after[at], before[following] = following, at
        enter(merges.look(token[at], token[following]), at)
        ahead = before[at]
        ahead = ahead[ahead < n]
        enter(merges.look(token[ahead], np.full(len(ahead), r)), ahead)
    count = np.append(0, np.cumsum(alive[:n]))
    return token[:n][alive[:n]], np.append(count[words_at], count[n])


_DOUBLE = regex.compile(r"\s ")
_CUT = regex.compile(r"(?<=\S)(?= )", regex.V1)


def _pieces(text: str) -> tuple[list[str], list[str]]:
    """The text cut before each space that follows a non-space: (pieces as they stand, pieces that follow a space)."""
    if _DOUBLE.search(text):
        return [p for p in _CUT.split(text) if p], []
    head, *rest = text.split(" ")
    return [head] if head else [], rest


class Encoder:
    """Encodes texts block by block and keeps what it has encoded.

    A piece is kept as (ids, the ids as text, the bytes they decode to).
    """

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.merges = Merges(self.ranks)
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.words: dict[str, tuple[bytes, str, bytes]] = {}
        self.heads: dict[str, tuple[bytes, str, bytes]] = {}
        self.tails: dict[str, tuple[bytes, str, bytes]] = {}

    def _merge(self, fresh: list[str]) -> None:
        merge, ids = [], []
        for word in fresh:
            token = word.encode("utf-8", "replace")
            if (whole := self.ranks.get(token)) is not None:  # a word that is a token stays whole
                self.words[word] = (whole.to_bytes(4, "little"), str(whole), self.bytes_of[whole])
            else:
                merge.append(word)
                ids.append(token)
        row, ends = replay(ids, self.merges)
        data, plain = row.astype("<u4").tobytes(), row.tolist()
        said, decoded, ends = list(map(str, plain)), list(map(self.bytes_of.__getitem__, plain)), ends.tolist()
        for word, a, b in zip(merge, ends, ends[1:]):
            self.words[word] = (data[4 * a : 4 * b], ",".join(said[a:b]), b"".join(decoded[a:b]))

    def learn(self, texts: list[str]) -> None:
        """Encode what is new in the texts: its words go through the replay together."""
        if len(self.heads) + len(self.tails) > CACHE or len(self.words) > CACHE:
            self.words, self.heads, self.tails = {}, {}, {}
        heads: set[str] = set()
        tails: set[str] = set()
        for text in texts:
            a, b = _pieces(text)
            heads.update(a)
            tails.update(b)
        find = self.pattern.findall
        cut = [(self.heads, p, find(p)) for p in heads if p not in self.heads]
        cut += [(self.tails, p, find(" " + p)) for p in tails if p not in self.tails]
        fresh = {w for _, _, ws in cut for w in ws}.difference(self.words)
        if fresh:
            self._merge(list(fresh))
        words = self.words
        for known, piece, ws in cut:
            if len(ws) == 1:
                known[piece] = words[ws[0]]
            else:
                own = [words[w] for w in ws]
                known[piece] = (b"".join([x[0] for x in own]), ",".join([x[1] for x in own]), b"".join([x[2] for x in own]))

    def rows(self, texts: list[str]) -> Iterator[list[tuple[bytes, str, bytes]]]:
        """The encoded pieces of each text, once they are learned."""
        head, tail = self.heads.__getitem__, self.tails.__getitem__
        for text in texts:
            a, b = _pieces(text)
            yield [*map(head, a), *map(tail, b)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        texts = [t or "" for t in texts]
        self.learn(texts)
        return [b"".join([x[0] for x in row]) for row in self.rows(texts)]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(4)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(path, pattern)


def blocks(batches: Iterator[pd.Series], size: int = BLOCK) -> Iterator[list[list[str]]]:
    """Batches of texts, gathered until they hold ``size`` characters; nulls become empty."""
    held, total = [], 0
    for batch in batches:
        texts = ["" if t is None else t for t in batch]
        held.append(texts)
        total += sum(map(len, texts))
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id and digests of its ids and of the bytes decoded from them."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(path, pattern)
        for block in blocks(batches):
            own.learn([t for texts in block for t in texts])
            for texts in block:
                rows = []
                for row in own.rows(texts):
                    said = ",".join([x[1] for x in row])
                    rows.append((said.count(",") + 1 if said else 0, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(b"".join([x[2] for x in row])).hexdigest()))
                yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", run("text").alias("d")).select("doc_id", "d.*")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, ids (array of ints)."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path, pattern)
        for block in blocks(batches):
            own.learn([t for texts in block for t in texts])
            for texts in block:
                yield pd.Series([np.frombuffer(b"".join([x[0] for x in row]), "<i4") for row in own.rows(texts)], dtype=object)

    return docs.select("doc_id", run("text").alias("ids"))


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """``rows`` (doc_id, ids) to doc_id, text; a null list of ids is an empty text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path, pattern)
        for lists in batches:
            yield pd.Series(["" if x is None else own.decode(np.asarray(x, "<u4").tobytes()).decode("utf-8", "replace") for x in lists])

    return rows.select("doc_id", run("ids").alias("text"))


def op9(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
