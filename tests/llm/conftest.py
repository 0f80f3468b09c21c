import random

import pytest

WORDS = {
    "en": "the and with from this that there where house river under water small light after again".split(),
    "de": "der und mit von nicht auch über schön straße haus fluss wasser klein licht nach wieder".split(),
    "fr": "le et avec de pas aussi été où maison rivière eau petite lumière après encore très".split(),
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars) with nulls, empty and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    rows = []
    for i in range(120):
        lang = ("en", "de", "fr")[i % 3]
        text = "\n".join(sentence(rng, lang, rng.randint(4, 14)) for _ in range(rng.randint(2, 8)))
        if i % 5 == 0:
            text = " | ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text, lang, f"src{i % 3}", len(text)))
    rows += [(200, None, "en", None, None), (201, "", None, "src0", 0), (202, " \n\t ", "de", "src1", 4), (203, "123 456 !!", "fr", "src1", 10)]
    rows += [(204, "the river " * 30000, "en", "src0", 300000), (None, "no id here at all but words", "en", "src2", 27)]
    rows += [rows[3], rows[3], (205, rows[4][1], "de", "src2", 9), (206, "x" * 50000, "en", "src0", 50000)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus, with columns whose names the operators use inside."""
    df = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    for name in ("score", "p", "s", "fp", "component", "host", "hash", "row_id", "ids", "m", "d", "u", "v", "_n", "words"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("doc_id < -1")


@pytest.fixture(scope="session")
def nulls(spark):
    """Nothing but nulls."""
    return spark.createDataFrame([(None,) * 5] * 2, "doc_id long, text string, lang string, source string, n_chars long")
