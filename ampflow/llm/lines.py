"""Quality rules: counts within a document, and how often its lines recur across a host's documents.

Lines are normalised (lower case, single spaces) and hashed.  For each host
(``source``) and line the documents that hold it are counted; a line in more
than ``MIN_DOCS`` documents and in more than ``SHARE`` of the host's, or in more
than ``MANY`` whatever the host's size, is boilerplate and is removed.  A document that loses more than half of its words
that way is depleted and rejected, as is one that fails the base rules.

A null source is a host of its own.  A null text has no words, and so fails.
Repeated rows count as documents of their own; ids may be null or repeat.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampflow.llm.common import bounded_batches, saved

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
MIN_DOCS = 10
SHARE = 0.01
#: A limit of its own for large hosts, where the share alone would be tens of thousands.
MANY = 1000
_SYMBOLS = b"#*$%&|<>"
_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, hashes array<long>, line_words array<int>"


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur more than once."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    again = np.zeros(len(windows), bool)
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            again[i] = again[j] = True
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.nonzero(again)[0]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def line_key(own: list[bytes]) -> int:
    """Hash of a line's words: the line in lower case, with single spaces."""
    key = xxhash.xxh3_64_intdigest(b" ".join(own).decode("utf-8", "replace").lower())
    return key - ((key >> 63) << 64)


def without(text: str | None, keys: list[int] | None) -> str:
    """The text without lines of these keys; lines without words stay."""
    out, gone = [], set(() if keys is None else keys)
    for line in (text or "").split("\n"):
        own = line.encode("utf-8", "replace").split()
        if not own or line_key(own) not in gone:
            out.append(line)
    return "\n".join(out)


def measure(text: str | None) -> tuple:
    """The base counts, and of each distinct normalised line its hash and words."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    words = data.split()  # of bytes: splits at ASCII white space only
    lines: dict[int, int] = {}
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        own = line.split()
        if not own:
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        key = line_key(own)
        lines[key] = lines.get(key, 0) + len(own)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    return len(words), chars, symbols, dup, repeated_words(words), list(lines), list(lines.values())


def profile(docs: DataFrame, *more: str) -> DataFrame:
    """``docs`` (doc_id, source, text) to its measures and columns ``more``, a row each, with a row_id; stored."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(_STATS)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=[c.split()[0] for c in _STATS.split(", ")])

    host = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    return saved(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", host.alias("host"), *more, run("text").alias("s")).select("row_id", "doc_id", "host", *more, "s.*"), "line-profile")


def boilerplate(lines: DataFrame, rows: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, many: int = MANY) -> DataFrame:
    """(host, hash) of lines above the limits; ``lines`` has each document's distinct lines, ``rows`` its host."""
    counts = lines.groupBy("host", "hash").agg(F.count("*").alias("docs")).where(F.col("docs") > min(min_docs, many))
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_docs"))
    return counts.join(hosts, "host").where((F.col("docs") > many) | (F.col("docs") > min_docs) & (F.col("docs") > share * F.col("host_docs"))).select("host", "hash")


def _judged(rows: DataFrame, min_docs: int, share: float, many: int, *gathered) -> DataFrame:
    """``rows`` of a profile with removed_words, base_failed, kept, and what is ``gathered`` of each row's removed lines."""
    lines = rows.select("row_id", "host", F.explode(F.arrays_zip("hashes", "line_words")).alias("l")).select("row_id", "host", F.col("l.hashes").alias("hash"), F.col("l.line_words").alias("words"))
    common = boilerplate(lines, rows, min_docs, share, many)
    removed = lines.join(common, ["host", "hash"], "left_semi").groupBy("row_id").agg(F.sum("words").alias("removed_words"), *gathered)
    out = rows.drop("hashes", "line_words").join(removed, "row_id", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    depleted = 2 * F.col("removed_words") > F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted).drop("row_id", "host")


def rules(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, many: int = MANY) -> DataFrame:
    """``docs`` (doc_id, source, text) to the base counts, removed_words, base_failed, kept."""
    return _judged(profile(docs), min_docs, share, many)


def without_boilerplate(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, many: int = MANY) -> DataFrame:
    """``docs`` (doc_id, source, text) to doc_id, text without the lines above the limits; documents that ``rules`` does not keep go."""
    judged = _judged(profile(docs, "text"), min_docs, share, many, F.collect_set("hash").alias("gone"))  # no more than a document's own lines

    @F.pandas_udf("string")
    def strip(texts: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([without(t, g) for t, g in zip(texts, gone)], dtype=object)

    return judged.where("kept").select("doc_id", strip("text", "gone").alias("text"))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rules(docs).select(*columns)
