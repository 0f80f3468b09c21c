"""Added tokens inside texts, against the default encoding of the ``tokenizers`` file."""

import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ampflow.llm import packing

RANKS, OWN = P.path("byte_bpe_50k.tiktoken"), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
ADDED = packing.added_tokens(P.path("byte_bpe_50k.json"))
TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "end  <|endoftext|>  \n two", "<|endoftext|", "<<|endoftext|>|>", "", "none"]


def expected(text):
    return np.array(OWN.encode(text, add_special_tokens=False).ids + [0], "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endo", "|>", "a", " ", "  ", "\n", "b's", "é", " the"]), max_size=12).map("".join))
def test_ids_are_those_of_the_default_encoding(text):
    assert packing.tokens(RANKS, P.PATTERN, ADDED).ids(text) == expected(text)


def test_op4_over_a_table(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = packing.op4(spark, str(tmp_path)).collect()
    got = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in rows if r.length == r.doc_tokens}
    want = {i: (len(expected(t)) // 4, zlib.crc32(expected(t))) for i, t in enumerate(TEXTS)}
    assert got == want
