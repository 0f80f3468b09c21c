"""Recall of the inverted file where queries lie apart from most rows."""

import numpy as np

from ampflow.llm import ann


def test_queries_unlike_the_rows_find_their_neighbours(spark):
    rng, n = np.random.default_rng(5), 4000
    x = rng.normal(size=(200, 32))[rng.integers(0, 200, n)]  # groups of copies, whose neighbours share a list
    x[::100] = rng.normal(size=(n // 100, 32))
    own = ann.valid(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    got = {}
    for r in ann.search(own, own.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = 0
    for q in range(0, n, 100):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        far[q] = np.inf
        true = np.lexsort((np.arange(n), far))[:10]
        hits += len(set(true.tolist()) & set(got[q]))
        assert len(got[q]) == 10 and all(abs(far[v] - s) < 1e-9 for v, s in got[q].items())
    assert hits >= 0.95 * n // 100 * 10


def test_a_block_loses_nothing_to_its_codes():
    """Codes that say little, many more rows than are measured first."""
    rng = np.random.default_rng(6)
    v, q = rng.normal(size=(900, 8)), rng.normal(size=(20, 8))
    index = ann.learn(rng.normal(size=(2, 8)), 1)
    at = np.zeros(900, np.int64)
    found = ann._measure(index, 0, np.arange(900), v, index.codes(v, at), np.arange(-20, 0), q, 10)
    for i in range(20):
        far = np.sqrt(((v - q[i]) ** 2).sum(1))
        rows = found[found["query_id"] == i - 20]
        assert rows["vec_id"].tolist() == np.argsort(far)[:10].tolist() and np.allclose(rows["score"], np.sort(far)[:10])
