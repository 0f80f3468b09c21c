"""Approximate nearest neighbours: inverted file of coarse centroids with product-quantised residuals.

Coarse centroids and residual codebooks are learned on a bounded sample; every
vector is then filed under its nearest centroid with the codes of its residual.
A query reads the lists of its nearest centroids: distance tables from the
query's residual to all codewords give approximate distances, the best of each
list block are measured exactly on the original vectors, then those whose
quantisation error leaves them a chance, so that a block read loses nothing; the
best of all are returned.  How many lists to read is calibrated on queries
themselves, a bounded number of them, against brute force over all rows.

Lists and the queries that read them are cut into blocks of bounded size by
their counts, so a vector that a third of the rows share is no hot task.

Vectors that are null, empty, zero, or hold null or non-finite components take
no part.  Only vectors of one length have a distance, so each length is searched
apart, with an index of its own.  A vec_id counts once in a
result; null ids take no part.  Ties go to the smaller vec_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ampflow.llm.common import saved

#: Vectors to learn from, at most, taken by the hash of their id.
SAMPLE = 10_000
#: Lists at most; below that, about the root of the number of vectors.
MAX_LISTS = 1024
SUBSPACES = 16
CODES = 256
#: Share of true neighbours that the calibrated number of lists must hold.
RECALL = 0.98
#: Queries to calibrate on, at most, taken by the hash of their id.
ASKED = 256
#: Vectors, and queries, in a block at most (about).
BLOCK = 8192
#: Candidates of a block that are measured exactly before any is ruled out.
SHORTLIST = 100
#: Pairs measured at once.
PAIRS = 65_536
FOUND = "query_id long, vec_id long, score double"


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Index of the nearest center of each row."""
    out = np.empty(len(x), np.int64)
    norm = (centers**2).sum(1)
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = (norm - 2 * x[a : a + 4096] @ centers.T).argmin(1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from distinct points; empty clusters restart at random points."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centers = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds if len(distinct) > k else 0):
        own = _nearest(x, centers)
        count = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], x[rng.integers(0, len(x), len(centers))])
    return centers


@dataclass
class Index:
    centers: np.ndarray  # (lists, dimensions)
    books: np.ndarray  # (subspaces, codes, dimensions of a subspace)

    def residual(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Residuals to centroids, padded to whole subspaces: (rows, subspaces, dimensions of one)."""
        r = x - self.centers[own]
        m, _, d = self.books.shape
        return np.pad(r, ((0, 0), (0, m * d - r.shape[1]))).reshape(len(x), m, d)

    def codes(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        r = self.residual(x, own)
        return np.stack([_nearest(r[:, j], self.books[j]) for j in range(len(self.books))], 1).astype(np.uint8)


def learn(x: np.ndarray, lists: int, seed: int = 7) -> Index:
    """Centroids and codebooks from sample vectors."""
    lists = max(1, min(lists, len(x) // 8 or 1))
    centers = kmeans(x, lists, 12, seed)
    own = _nearest(x, centers)
    m = min(SUBSPACES, x.shape[1])
    d = -(-x.shape[1] // m)
    index = Index(centers, np.zeros((m, 1, d)))
    r = index.residual(x, own)
    books = [kmeans(r[:, j], CODES, 8, seed + j) for j in range(m)]
    codes = max(map(len, books))
    index.books = np.stack([np.concatenate([b, np.repeat(b[-1:], codes - len(b), 0)]) for b in books])
    return index


def calibrated(index: Index, filed: DataFrame, asking: DataFrame, k: int, target: float = RECALL) -> int:
    """Lists to read, so that ``target`` of the true ``k`` neighbours of up to ``ASKED`` queries are in them: brute force over all of ``filed``, one pass."""
    some = asking.orderBy(F.xxhash64("vec_id"), "vec_id").limit(ASKED).toPandas()
    if not len(some):
        return 1
    centre = index.centers.mean(0)
    own, q = some["vec_id"].to_numpy(), _matrix(some["v"]) - centre

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame({"i": [], "list": [], "vec_id": [], "score": []})
        for rows in batches:
            if not len(rows):
                continue
            x, ids = _matrix(rows["v"]) - centre, rows["vec_id"].to_numpy()
            far = (q**2).sum(1)[:, None] + (x**2).sum(1) - 2 * q @ x.T
            far[own[:, None] == ids] = np.inf
            i = np.repeat(np.arange(len(q)), min(k, len(ids)))
            at = np.argsort(far, 1, kind="stable")[:, :k].ravel()
            best = pd.concat([best, pd.DataFrame({"i": i, "list": rows["list"].to_numpy()[at], "vec_id": ids[at], "score": far[i, at]})])
            best = best[best["score"] < np.inf].sort_values(["i", "score", "vec_id"]).groupby("i").head(k)
        yield best

    found = filed.select("list", "vec_id", "v").mapInPandas(nearest, "i int, list int, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("i").orderBy("score", "vec_id"))
    true = found.withColumn("n", rank).where(F.col("n") <= k).select("i", "list").toPandas()  # k rows a query
    place = np.argsort(np.argsort((index.centers**2).sum(1) - 2 * (q + centre) @ index.centers.T, 1), 1)
    needed = np.sort(place[true["i"], true["list"]]) + 1
    return int(needed[min(len(needed) - 1, math.ceil(target * len(needed)))]) if len(needed) else 1


def valid(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v: array of floats) of the vectors that take part."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v")).where("vec_id is not null and size(v) > 0")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    return rows.where(F.coalesce(fine, F.lit(False)))


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _measure(own: Index, at: int, ids: np.ndarray, v: np.ndarray, codes: np.ndarray, asking: np.ndarray, q: np.ndarray, keep: int) -> pd.DataFrame:
    """The ``keep`` nearest of a block of list ``at`` for each query; ``ids`` ascend, so ties go to the smaller, and one that repeats counts once.

    A vector lies no nearer than the distance to its codewords less its own
    distance from them, so those measured rule the others out.
    """
    residual = own.residual(q, np.full(len(q), at))
    off = np.sqrt(((own.residual(v, np.full(len(v), at)) - own.books[np.arange(codes.shape[1]), codes]) ** 2).sum((1, 2)))
    repeated = (ids[1:] == ids[:-1]).any()
    out = []
    step = max(1, 2_000_000 // len(ids))
    for a in range(0, len(q), step):
        some, asks = q[a : a + step], asking[a : a + step]
        tables = ((residual[a : a + step, :, None, :] - own.books) ** 2).sum(-1)
        far = np.zeros((len(tables), len(ids)))
        for j in range(codes.shape[1]):
            far += tables[:, j, codes[:, j]]
        self_ = asks[:, None] == ids
        far[self_] = np.inf
        score = np.full(far.shape, np.inf)

        def measure(i: np.ndarray, j: np.ndarray) -> None:
            for b in range(0, len(i), PAIRS):
                score[i[b : b + PAIRS], j[b : b + PAIRS]] = np.sqrt(((v[j[b : b + PAIRS]] - some[i[b : b + PAIRS]]) ** 2).sum(-1))

        short = np.argsort(far, 1, kind="stable")[:, :SHORTLIST]
        measure(np.repeat(np.arange(len(some)), short.shape[1]), short.ravel())
        score[self_] = np.inf
        sure = keep <= len(ids) and not repeated
        bound = np.partition(score, keep - 1, 1)[:, keep - 1] if sure else np.full(len(some), np.inf)
        near = np.sqrt(far)
        open_ = near - off - 1e-12 * (near + off) <= bound[:, None]
        np.put_along_axis(open_, short, False, 1)
        measure(*np.nonzero(open_ & ~self_))
        i, j = np.nonzero(score <= bound[:, None])
        order = np.lexsort((j, score[i, j], i))
        i, j = i[order], j[order]
        rows = pd.DataFrame({"query_id": asks[i], "vec_id": ids[j], "score": score[i, j]})[~self_[i, j]]
        rows = rows[np.isfinite(rows["score"])].drop_duplicates(["query_id", "vec_id"])
        out.append(rows.groupby("query_id").head(keep))
    return pd.concat(out)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank, vec_id, score.

    ``vectors`` and ``queries`` are (vec_id, v) as ``valid`` gives them.  An id
    that repeats counts once as a candidate, by its nearest vector; of a query's
    vectors the first in order asks.
    """
    spark = vectors.sparkSession
    asking = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    lengths = vectors.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()  # a row a length of vectors: a few
    found = [_found(vectors.where(F.size("v") == r.n), asking.where(F.size("v") == r.n), r["count"], k) for r in lengths]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    once = reduce(DataFrame.union, found).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(vectors: DataFrame, asking: DataFrame, total: int, k: int) -> DataFrame:
    """Of ``total`` vectors of one length: the nearest that each block read finds, a query's among them."""
    spark = vectors.sparkSession
    sample = _matrix(vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["v"])
    learned = learn(sample, min(MAX_LISTS, round(math.sqrt(total))))
    index = spark.sparkContext.broadcast(learned)

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                x = _matrix(rows["v"])
                own = _nearest(x, index.value.centers)
                yield pd.DataFrame({"list": own, "vec_id": rows["vec_id"], "codes": [c.tobytes() for c in index.value.codes(x, own)], "v": rows["v"]})

    kind = vectors.schema["v"].dataType.simpleString()
    filed = saved(vectors.mapInPandas(file, f"list int, vec_id long, codes binary, v {kind}"), "filed")
    sizes = filed.groupBy("list").agg(F.count("*").alias("n")).collect()  # a row a list: MAX_LISTS at most
    count = np.zeros(len(index.value.centers), np.int64)
    for r in sizes:
        count[r["list"]] = r["n"]

    probes = calibrated(learned, filed, asking, k)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = index.value
        for rows in batches:
            if not len(rows):
                continue
            x = _matrix(rows["v"])
            order = np.argsort((own.centers**2).sum(1) - 2 * x @ own.centers.T, 1)
            held = np.cumsum(count[order], 1)
            take = np.maximum(probes, (held < 2 * k + 1).sum(1) + 1)  # enough rows for k neighbours, the query aside
            pairs = [(int(c), i) for i in range(len(x)) for c in order[i, : take[i]] if count[c]]
            yield pd.DataFrame({"list": [c for c, _ in pairs], "query_id": rows["vec_id"].to_numpy()[[i for _, i in pairs]], "q": [rows["v"].iloc[i] for _, i in pairs]})

    asked = asking.mapInPandas(probe, f"list int, query_id long, q {kind}")
    asks = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}
    blocks = spark.createDataFrame([(int(c), -(-int(n) // BLOCK), -(-asks.get(c, 0) // BLOCK)) for c, n in enumerate(count) if n], "list int, vb int, qb int")
    blocks = F.broadcast(blocks)  # MAX_LISTS rows at most
    left = filed.join(blocks, "list").where("qb > 0").withColumn("vb", F.expr("int(pmod(xxhash64(vec_id), vb))")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
    right = asked.join(blocks, "list").withColumn("qb", F.expr("int(pmod(xxhash64(query_id), qb))")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("vb") - 1)))

    def look(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        rows = rows.sort_values("vec_id", kind="stable")
        codes = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1)
        own, at = index.value, int(rows["list"].iloc[0])
        return _measure(own, at, rows["vec_id"].to_numpy(), _matrix(rows["v"]), codes, asked["query_id"].to_numpy(), _matrix(asked["q"]), k)

    return left.groupBy("list", "vb", "qb").cogroup(right.groupBy("list", "vb", "qb")).applyInPandas(look, FOUND)


def op5(spark, sf_dir: str) -> DataFrame:
    rows = valid(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(rows, rows.where(F.expr("pmod(vec_id, 100) = 0")))
