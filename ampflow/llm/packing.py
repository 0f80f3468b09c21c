"""Packing of token sequences by the sum-of-squares rule, online.

A document's whole windows of ``window`` tokens stand alone; the rest is placed
into a partly filled window.  A level array counts the open windows at each
fill level; a rest goes to the level at which the sum of the squared counts
comes out smallest (ties: to the fullest window), or opens a window.  Where the
rest does not fit it may be cut, at a price of ``CUT``: its first part fills the
window, what is left is placed anew.  The price is worth it once levels hold a
few windows each, so the open ones stay few whatever the lengths are.

Each partition of the input packs its own documents, so nothing is shuffled.
At its end what is still open is closed by cutting: pieces of the emptiest fill
the gaps of the fullest, so a partition pads one window at most.

Added tokens of the vocabulary (``added_tokens``) are found in a text before all
else, the leftmost and longest first; what lies between them is encoded by itself.

Null and empty texts have the end token only.  Repeated rows and null ids are
packed like others; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ampflow.llm.bpe import _pieces, read_ranks
from ampflow.llm.common import bounded_batches

WINDOW = 1024
#: What a cut costs, in the units of the sum of squares; no whole number, so that a cut never ties with a fit.
CUT = 1.5
END = 0
#: Distinct pieces that a Python worker keeps encoded.
CACHE = 250_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Levels:
    """Open windows by fill level; a window is a list of pieces (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window, np.int64)
        self.stacks: list[list[list]] = [[] for _ in range(window)]
        self.open = 0

    def best(self, size: int) -> int:
        """The level whose use makes the sum of squared counts smallest; 0 opens a window."""
        twice = 2.0 * self.count
        cost = np.roll(twice, -size) + 1  # of the level that comes out, past the end that of what is left
        cost[self.window - size] = 0  # a full window counts no more
        cost[self.window - size + 1 :] += CUT
        cost[1:] += 1 - twice[1:]
        cost[1:][self.count[1:] == 0] = np.inf
        return self.window - 1 - int(cost[::-1].argmin())

    def place(self, piece: tuple) -> Iterator[list]:
        """Put a piece into a window; gives the windows that this fills."""
        doc, start, ids, total = piece
        while ids:
            size = len(ids) // 4
            level = self.best(size)
            if level:
                pieces = self.stacks[level].pop()
                self.count[level] -= 1
                self.open -= 1
            else:
                pieces = []
            fits = min(size, self.window - level)
            pieces.append((doc, start, ids[: 4 * fits], total))
            start, ids = start + fits, ids[4 * fits :]
            if level + fits == self.window:
                yield pieces
            else:
                self.stacks[level + fits].append(pieces)
                self.count[level + fits] += 1
                self.open += 1

    def squeeze(self) -> list[list]:
        """Fill the fullest windows with cuts of the emptiest; one at most stays open."""
        rows = [[level, pieces] for level in range(self.window - 1, 0, -1) for pieces in self.stacks[level]]
        full, i, j = [], 0, len(rows) - 1
        while i < j:
            gap = self.window - rows[i][0]
            while gap and i < j:
                doc, start, ids, total = rows[j][1].pop()
                n = len(ids) // 4
                if n > gap:
                    rows[j][1].append((doc, start, ids[: 4 * (n - gap)], total))
                    start, ids, n = start + n - gap, ids[4 * (n - gap) :], gap
                rows[i][1].append((doc, start, ids, total))
                rows[i][0] += n
                rows[j][0] -= n
                gap -= n
                if not rows[j][1]:
                    j -= 1
            if not gap:
                full.append(rows[i][1])
                i += 1
        self.__init__(self.window)
        if i == j:
            level, pieces = rows[i]
            self.stacks[level].append(pieces)
            self.count[level], self.open = 1, 1
        return full

    def rest(self) -> list[list]:
        return [pieces for stack in self.stacks for pieces in stack]


def pack(docs: Iterator[tuple], window: int = WINDOW) -> Iterator[list | None]:
    """(doc_id, ids as 32-bit bytes) to windows: lists of (doc_id, start, ids, doc_tokens).

    Gives None after each document, so that the caller may write what it has.
    """
    levels = Levels(window)
    for doc, ids in docs:
        total = len(ids) // 4
        whole = total - total % window
        for a in range(0, whole, window):
            yield [(doc, a, ids[4 * a : 4 * (a + window)], total)]
        if total > whole:
            yield from levels.place((doc, whole, ids[4 * whole :], total))
        yield None
    yield from levels.squeeze()
    yield from levels.rest()


def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """The added tokens of a ``tokenizers`` file with their ids."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError("added tokens must match as they stand")
    return tuple((t["content"], t["id"]) for t in tokens)


class _Tokens:
    """Pieces of text to their ids as little-endian 32-bit numbers; each is encoded once while it is kept."""

    def __init__(self, path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
        import tiktoken

        self.encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={}).encode_ordinary
        self.tails = _Tails(self.encode)
        self.added = {token: _bytes([i]) for token, i in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.find = re.compile(f"({'|'.join(map(re.escape, longest))})").split if longest else lambda text: [text]

    def ids(self, text: str | None, end: int = END) -> bytes:
        if len(self.tails) > CACHE:
            self.tails.clear()
        out = []
        for i, part in enumerate(self.find(text or "")):
            if i % 2:
                out.append(self.added[part])
                continue
            heads, tails = _pieces(part)
            out += [_bytes(self.encode(p)) for p in heads]
            out += map(self.tails.__getitem__, tails)
        out.append(int(end).to_bytes(4, "little"))
        return b"".join(out)


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()  # 4 bytes an id on all platforms that Spark runs on


class _Tails(dict):
    """Pieces that follow a space, encoded when first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = _bytes(self.encode(" " + piece))
        return ids


@lru_cache(2)
def tokens(path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> _Tokens:
    """One table of encoded pieces a worker process."""
    return _Tokens(path, pattern, added)


def packer(path: str, pattern: str, window: int = WINDOW, end: int = END, added: tuple[tuple[str, int], ...] = ()):
    """The function that packs one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens(path, pattern, added)
        sequence = TaskContext.get().partitionId() << 40

        def docs():
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield doc, known.ids(text.as_py(), end)

        rows: list[tuple] = []
        for pieces in pack(docs(), window):
            if pieces is not None:
                offset = 0
                for doc, start, ids, total in pieces:
                    n = len(ids) // 4
                    rows.append((doc, start, n, zlib.crc32(ids), total, sequence, offset))
                    offset += n
                sequence += 1
            if len(rows) >= 5000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def pack_documents(docs: DataFrame, path: str, pattern: str, window: int = WINDOW, end: int = END, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """``docs`` (doc_id, text) to one row a piece, see ``SCHEMA``.

    ``path`` is the rank file of the vocabulary; its ids are those of the same vocabulary's other files,
    if ``added`` holds the added tokens of those.
    """
    bounded_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(packer(path, pattern, window, end, added), SCHEMA)


def op4(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added_tokens(public_tokenizers.path("byte_bpe_50k.json")))
