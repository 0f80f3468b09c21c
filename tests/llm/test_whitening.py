"""Whitening: the eigenproblem against numpy, the query against brute force."""

import math

import numpy as np
import pytest

from ampflow.llm import whitening


def gaps(kind, n, rng):
    values = {"plain": np.sort(rng.random(n)), "equal": np.repeat(rng.random(), n), "pairs": np.repeat(np.sort(rng.random(-(-n // 2))), 2)[:n], "steep": 10.0 ** -np.arange(n), "low rank": np.append(np.zeros(n - 1), 1.0)}[kind]
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    return q * values @ q.T


@pytest.mark.parametrize("kind", ["plain", "equal", "pairs", "steep", "low rank"])
@pytest.mark.parametrize("n", [1, 2, 3, 8, 40, 130])
def test_components_equal_numpy(kind, n):
    a = gaps(kind, n, np.random.default_rng(n))
    a = (a + a.T) / 2
    values, vectors = whitening.components(a, 4)
    want = np.linalg.eigvalsh(a)[::-1][: min(4, n)]
    norm = np.abs(a).max() * n
    assert np.allclose(values, want, atol=1e-14 * norm)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * norm


def test_a_tridiagonal_matrix_has_the_same_eigenvalues():
    a = gaps("plain", 12, np.random.default_rng(5))
    d, e, _ = whitening.tridiagonal(a)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    assert np.allclose(np.linalg.eigvalsh(t), np.linalg.eigvalsh(a))
    for x in (0.1, 0.5, 0.9):
        assert whitening.below(d, e, np.array([x]))[0] == (np.linalg.eigvalsh(a) < x).sum()


def brute(rows, k=4):
    """(id, component, n, deviation, whitened up to sign, explained) of rows of one length."""
    x = {i: [math.floor(256 * float(c)) for c in v] for i, v in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    d = np.array(fit, float) - np.array(s) / n
    v = d.T @ d / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    return {i: (n, sum((n * a - b) ** 2 for a, b in zip(c, s)), (np.array(c) - np.array(s) / n) @ w / np.sqrt(e), e / np.trace(v)) for i, c in x.items()}


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=6) * np.arange(6, 0, -1) / 4]) for i in range(200)]
    good += [(500 + i, good[0][1]) for i in range(150)] + [(900, [0.0] * 6), (901, [-0.0] * 6)]
    bad = [(1000, None), (1001, [None] + [1.0] * 5), (1002, [math.nan] * 6), (1003, [math.inf] * 6)]
    path = str(tmp_path_factory.mktemp("vectors"))
    frame = spark.createDataFrame(good + bad + [(1004, []), (None, good[1][1]), good[2]], "vec_id long, embedding array<float>")
    frame.selectExpr("*", "'clash' id", "'clash' x", "'clash' n", "1 component").repartition(7).write.parquet(f"{path}/embeddings.parquet")
    return path, good


def test_the_query_equals_brute_force(spark, vectors):
    path, good = vectors
    want, signs = brute(good), {}
    rows = whitening.op11(spark, path).collect()
    assert len(rows) == 4 * (len(good) + 2)  # the null id and the repeated row besides
    assert sorted({r.vec_id for r in rows if r.vec_id is not None}) == sorted(i for i, _ in good)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-12
    for r in rows:
        n, deviation, w, explained = want[r.vec_id if r.vec_id is not None else 1]
        k = r.component - 1
        assert (r.n, r.deviation) == (n, deviation) and math.isclose(r.explained, explained[k], rel_tol=1e-12)
        if abs(w[k]) > 1e-3:
            assert signs.setdefault(k, np.sign(r.whitened / w[k])) == np.sign(r.whitened / w[k])
        assert math.isclose(abs(r.whitened), abs(w[k]), rel_tol=1e-9, abs_tol=1e-9)


def test_without_vectors_or_variance(spark, tmp_path):
    kind = "vec_id long, embedding array<double>"

    def result(rows, name):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        return whitening.op11(spark, f"{tmp_path}/{name}").orderBy("vec_id", "component").collect()

    assert result([], "none") == [] == result([(1, None), (2, []), (3, [math.nan])], "bad")
    one = result([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "one")
    assert [tuple(r) for r in one] == [(i, c, 1, 0, None, 0.0, None) for i in (1, 2) for c in (1, 2)]
    line = result([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0])], "line")
    assert [r.whitened is None for r in line] == [False, True] * 3 and line[0].explained == pytest.approx(1) and line[0].identity_error < 1e-12
    mixed = result([(1, [0.0]), (2, [1.0]), (3, [0.0, 5.0]), (4, [3.0, 1.0])], "mixed")
    assert [(r.vec_id, r.component, r.n) for r in mixed] == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (3, 2, 2), (4, 1, 2), (4, 2, 2)]


def test_far_and_huge_entries(spark):
    rows = spark.createDataFrame([(i, [1e15 + i * 2.0, float(i % 3)]) for i in range(50)] + [(99, [1e300, 0.0])], "vec_id long, embedding array<double>")
    x = whitening.whole(rows)
    assert x.where("id = 99").first().x[0] == (1 << 63) - 1
    near = x.where("id < 99")
    model = whitening.fit_whitening(near)
    got = whitening.whitened(near, model).collect()
    assert abs(model[2].identity_error) < 1e-9 and len(got) == 50
    s = sum(r.x[0] for r in near.collect())
    assert got[0].deviation == sum((50 * a - b) ** 2 for a, b in zip(near.where(f"id = {got[0].id}").first().x, (s, sum(r.x[1] for r in near.collect()))))
    assert whitening.whitened(x, whitening.fit_whitening(x)).where("id = 99").first().deviation is None
