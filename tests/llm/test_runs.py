"""Periodic runs: against a plain search, whole query included."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from ampflow.llm import runs


def plain(w, least_length, least_exponent):
    """All runs by comparing words a period apart."""
    n, best = len(w), {}
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least_length, least_exponent * q):
                best.setdefault((s, i + q), q)
            i += i == s
    return sorted(((s, e, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("limits", [(6, 4), (2, 2), (6, 2), (1, 3)])
def test_runs_equal_a_plain_search(limits):
    rng = random.Random(sum(limits))
    for _ in range(600):
        n, k = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.4 and n:
            a, p = rng.randrange(n), rng.randint(1, 9)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        got = zip(*(x.tolist() for x in runs.runs(np.array(w, np.int64), *limits)))
        assert list(got) == plain(w, *limits)


def test_suffix_array_and_common_prefixes():
    rng = random.Random(3)
    for _ in range(300):
        w = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 50))]
        s = runs.suffixes(np.array(w, np.int64))
        assert s.order.tolist() == sorted(range(len(w)), key=lambda i: w[i:])
        for p in range(1, len(w)):
            a, b = w[s.order[p - 1] :], w[s.order[p] :]
            shared = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert s.lcp[p] == shared


def test_no_run_crosses_documents_and_blocks_do_not_matter(monkeypatch):
    rng = random.Random(4)
    texts = [[rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 40))] for _ in range(60)] + [[], [b"a"] * 300, [b"a"] * 20, [b"a"] * 20]
    want = [[(s, e, q) for s, e, q in plain(t, 6, 4)] for t in texts]
    for size in (1, 50, 1 << 18):
        blocks = list(runs.blocks_of(texts, size))
        assert [k for a, b in blocks for k in range(a, b)] == list(range(len(texts)))
        monkeypatch.setattr(runs, "BLOCK", size)
        monkeypatch.setattr(runs, "CHECKED", size)
        assert [list(zip(*(x.tolist() for x in r))) for r in runs.runs_of_texts(texts)] == want


def test_long_texts_are_whole():
    w = np.random.default_rng(0).integers(0, 50_000, 100_000)
    w = np.concatenate([w, np.tile(w[:30_000], 5), np.zeros(200_000, np.int64)])
    s, e, q = runs.runs(w)
    assert (100_000, 250_000, 30_000) in list(zip(s.tolist(), e.tolist(), q.tolist()))
    assert e.max() == len(w) and q[e.argmax()] == 1


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain(words, 6, 4)
    left = [x for i, x in enumerate(words) if not any(s + q <= i < e for s, e, q in found)]
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    return (doc_id, len(found), *four, sha256(lines.encode()).hexdigest(), sha256(b" ".join(left)).hexdigest())


def test_the_query_equals_brute_force(spark, docs, corpus, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns."""
    more = docs.sparkSession.createDataFrame([(300 + i, "a b a b a b a b c " * (1 + i % 7) + "x y \x1f z", "en", "s", 1) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(more, allowMissingColumns=True).where("doc_id is null or doc_id <> 204").write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in runs.op12(spark, str(tmp_path)).collect()]
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(got, key=key) == sorted((expected(r.doc_id, r.text) for r in rows), key=key)
    assert sum(r[1] > 0 for r in got) > 20


def test_texts_without_their_repeats(spark, nothing):
    df = spark.createDataFrame([("x", "so  so so so so so so\nit goes", 9), (None, None, 9)], "id string, body string, runs int")
    rows = runs.collapsed(df, "id", "body").collect()
    assert [(r.id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in rows] == [("x", 9, [(0, 7, 1)], "so it goes"), (None, 0, [], "")]
    assert runs.collapsed(nothing).count() == 0
