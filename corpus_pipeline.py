"""A training-corpus pipeline: five stages over ``documents``, each written before the next.

Rows count, not ids: null and repeated ids, null, empty and very long texts and
repeated rows go through every stage like others, unless its docstring says so.
Empty tables give empty results.  Other columns than those of ``documents`` are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampflow.llm import language, packing, quality, secrets, simhash
from ampflow.llm.common import saved, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The words of a text must be this sure of a language each, whichever it is.
FIT = 0.5


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose words are of known languages, mixed ones too; null and letterless texts go."""
    predict = language.predictor(spark, language.train(docs, F.lit(True)))
    out = docs.select(*COLUMNS).withColumn("_p", predict("text"))
    return out.where((F.col("_p.lang") != "und") & (F.col("_p.fit") >= FIT)).drop("_p")


def qualities(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose lines score as good; an empty text is scored like any other."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    out = docs.select(*COLUMNS).withColumn("_s", quality.scorer(spark, model)("text"))
    return out.where(F.col("_s") >= quality.THRESHOLD).drop("_s")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates (five words, 0.8), that of the smallest id."""
    return simhash.deduplicate(docs.select(*COLUMNS)).select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets, nested encodings included, by a mark; no document goes, a null text stays null."""
    out = secrets.redact(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of what is left into training sequences; a null text has the end token only."""
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added)


STAGES = [
    ("language_id", languages),
    ("quality_classifier", qualities),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models and greedy packing are beyond SQL; tests use brute force.
ORACLE_SQL = None
