"""Near-duplicates by SimHash, joined on a grid of segment bit counts.

A fingerprint of 64 bits is cut into 32 segments of 2 bits; its embedding is
the vector of their bit counts (0, 1 or 2).  The Manhattan distance of two
embeddings never exceeds the Hamming distance of the fingerprints.  Counts are
written in unary (00, 01, 11), so that this lower bound is itself the number of
differing bits of the unary codes.

Grid range-join: if two embeddings differ by 4 at most, then in one half (16
segments) they differ by 2 at most, and some grid point of that half lies
within 1 of both.  So every fingerprint is filed under all grid points within 1
of either half, about 50 cells; each pair within the limit shares a cell.
Members of a cell are compared by the lower bound, then exactly.

Work is on distinct fingerprints, so copies cost nothing here.  A cell gives
back the links of a spanning forest only.  A cell with many members is linked
through midpoints instead: fingerprints at 4 bits or less have a common point
within 2 bits of both, and all that share such a point are linked, so that work
stays in proportion to the members.  The members of a cell too large for that
in one task are passed on, and their midpoints are dealt out over the cluster;
no point has more than 2081 members.  Nothing is capped.

Null and wordless texts have fingerprint zero, linked like any other.  Rows
with a null id take part in linking; a component of such rows alone has a null
component_id.  Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampflow.llm.common import bounded_batches, saved, with_hot
from ampflow.llm.components import connected

SHINGLE = 4
SEED = 42
LIMIT = 4
#: Cells with more members are linked through midpoints.
DENSE = 2048
#: Cells with more members are passed on, and their midpoints dealt out.
HUGE = 1 << 15
#: Rows of cells gathered before they are compared together.
BLOCK = 200_000
_EVEN = np.uint64(0x5555555555555555)


def shingle_hashes(text: str | None, width: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each run of ``width`` words; of all words if they are fewer."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        return [digest(joined, seed)]
    ends = list(accumulate(len(w) + 1 for w in words))
    return [digest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[width - 1 :])]


def fingerprints(texts: list[str | None], width: int = SHINGLE) -> np.ndarray:
    """Signed 64-bit fingerprints: a bit is set if it is in over half of the hashes."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        hashes = np.array(shingle_hashes(text, width), np.uint64)
        if len(hashes):
            ones = np.zeros(64, np.int64)
            for a in range(0, len(hashes), 16384):  # bounds the unpacked bits of a very long text
                bits = np.unpackbits(hashes[a : a + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += bits.sum(0, dtype=np.int32)
            out[i] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out.view(np.int64)


def unary(fp: np.ndarray) -> np.ndarray:
    """The embedding: each segment's bit count in unary."""
    odd = fp >> np.uint64(1)
    return ((fp | odd) & _EVEN) | ((fp & odd & _EVEN) << np.uint64(1))


def cells_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index of the fingerprint) for all grid points within 1 of either half."""
    code, cells, who = unary(fp), [], []
    everyone = np.arange(len(fp))
    for half in range(2):
        v = (code >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        tag = np.uint64(half) << np.uint64(32)
        cells.append(v | tag)
        who.append(everyone)
        for s in range(16):
            low, high = np.uint64(1) << np.uint64(2 * s), np.uint64(2) << np.uint64(2 * s)
            has_low, has_high = (v & low) != 0, (v & high) != 0
            for mask, flip in ((~has_high, np.where(has_low, high, low)), (has_low, np.where(has_high, high, low))):  # one up, one down
                cells.append((v[mask] ^ flip[mask]) | tag)
                who.append(everyone[mask])
    return np.concatenate(cells), np.concatenate(who)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links a–b: (member, smallest member)."""
    names, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ids[: len(a)], ids[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


#: What leads from a fingerprint to all points within half the limit.
_HALFWAY = np.array([0] + [1 << i for i in range(64)] + [(1 << i) | (1 << j) for i, j in combinations(range(64), 2)], np.uint64)


def _midpoints(fp: np.ndarray, room: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """All links of a dense cell, through points within half the limit."""
    parts = -(-len(fp) * len(_HALFWAY) // room)
    out_a, out_b = [fp[:0]], [fp[:0]]
    for part in range(parts):
        keys, who = [], []
        for m in _HALFWAY:
            k = fp ^ m
            if parts > 1:
                mine = ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(parts) == part
                keys.append(k[mine])
                who.append(fp[mine])
            else:
                keys.append(k)
                who.append(fp)
        keys, who = np.concatenate(keys), np.concatenate(who)
        order = np.argsort(keys, kind="stable")
        keys, who = keys[order], who[order]
        same = keys[1:] == keys[:-1]
        a, b = forest(who[1:][same], who[:-1][same])
        out_a.append(a)
        out_b.append(b)
    return forest(np.concatenate(out_a), np.concatenate(out_b))


def link_cells(cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest among the members of each cell; ``cell`` is sorted."""
    edge = np.nonzero(np.append(True, cell[1:] != cell[:-1]))[0]
    size = np.diff(np.append(edge, len(cell)))
    out_a, out_b = [fp[:0]], [fp[:0]]
    for at, n in zip(edge[size > DENSE], size[size > DENSE]):
        a, b = _midpoints(np.unique(fp[at : at + n]))
        out_a.append(a)
        out_b.append(b)
    left = np.repeat(size, size) - (np.arange(len(cell)) - np.repeat(edge, size))  # members from here on
    left[np.repeat(size > DENSE, size)] = 0
    live = np.nonzero(left > 1)[0]
    code, held = unary(fp), 0
    step = 1
    while len(live):
        i, j = live, live + step
        near = np.bitwise_count(code[i] ^ code[j]) <= LIMIT
        i, j = i[near], j[near]
        near = np.bitwise_count(fp[i] ^ fp[j]) <= LIMIT
        out_a.append(fp[i[near]])
        out_b.append(fp[j[near]])
        held += int(near.sum())
        if held > 500_000:  # many links in few cells: keep their forest only
            a, b = forest(np.concatenate(out_a), np.concatenate(out_b))
            out_a, out_b, held = [a], [b], len(a)
        step += 1
        live = live[left[live] > step]
    return forest(np.concatenate(out_a), np.concatenate(out_b))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        cell, who = cells_of(fp)
        yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(fp[who].view(np.int64))], ["cell", "fp"])


def _links(a: np.ndarray, b: np.ndarray | None = None) -> pa.RecordBatch:
    """Links a–b; without b, members passed on: their v is null."""
    v = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), v], ["u", "v"])


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (key, fp) sorted by key, in blocks of whole keys; parts of a key of over ``most`` rows come with no keys."""
    keys, fps, held, passing = [], [], 0, None
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if passing is not None:
            cut = int(np.searchsorted(key, passing, "right"))
            yield key[:0], fp[:cut]
            key, fp = key[cut:], fp[cut:]
            if not len(key):
                continue
            passing = None
        keys.append(key)
        fps.append(fp)
        held += len(key)
        last = key[-1]
        if held >= BLOCK and last != keys[0][0] or held > most and last == keys[0][0]:
            key, fp = np.concatenate(keys), np.concatenate(fps)
            cut = int(np.searchsorted(key, last, "left"))
            if cut:
                yield key[:cut], fp[:cut]
            key, fp = key[cut:], fp[cut:]
            if len(key) > most:
                yield key[:0], fp
                key, fp, passing = key[:0], fp[:0], last
            keys, fps, held = ([key], [fp], len(key)) if len(key) else ([], [], 0)
    if held:
        yield np.concatenate(keys), np.concatenate(fps)


def _compare(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by cell: whole cells are compared, block by block; cells of over ``most`` members are passed on."""
    for cell, fp in _blocks(batches, most):
        if not len(cell):
            yield _links(fp)
            continue
        edge = np.nonzero(np.append(True, cell[1:] != cell[:-1]))[0]
        size = np.diff(np.append(edge, len(cell)))
        huge = np.repeat(size > most, size)
        if huge.any():
            yield _links(fp[huge])
            cell, fp = cell[~huge], fp[~huge]
        if len(cell):
            yield _links(*link_cells(cell, fp))


def _halfway(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fp), 64):
            some = fp[at : at + 64]
            keys = (some[:, None] ^ _HALFWAY).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(some, len(_HALFWAY)).view(np.int64))], ["point", "fp"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by point: all that share a point are linked."""
    for point, fp in _blocks(batches, len(_HALFWAY)):
        same = point[1:] == point[:-1]
        if same.any():
            yield _links(*forest(fp[1:][same], fp[:-1][same]))


def fingerprinter(spark, width: int = SHINGLE):
    """A column function from text to its fingerprint."""
    bounded_batches(spark)

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints(texts.tolist(), width))

    return run


def link(classes: DataFrame, huge: int | None = None) -> DataFrame:
    """``classes`` (fp: distinct fingerprints) to the links (u, v) of a spanning forest of each cell."""
    most = HUGE if huge is None else huge
    filed = classes.select("fp").mapInArrow(_spread, "cell long, fp long")
    compared = filed.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda rows: _compare(rows, most), "u long, v long")
    compared = saved(compared, "links")
    links, left = compared.where("v is not null"), compared.where("v is null")
    if left.isEmpty():
        return links
    points = left.select("u").distinct().mapInArrow(_halfway, "point long, fp long")
    return links.union(points.repartition("point").sortWithinPartitions("point").mapInArrow(_meet, "u long, v long"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, fp (long), component_id."""
    spark = docs.sparkSession
    prints = saved(docs.select("doc_id", fingerprinter(spark, width)("text").alias("fp")), "fingerprints")
    classes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "classes")
    reached = connected(link(classes))
    linked = saved(classes.join(reached.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", "n", F.coalesce("component", "fp").alias("component")), "linked")
    smallest = saved(linked.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("m")), "smallest")
    named = saved(with_hot(linked.select("fp", "component", "n"), smallest, "component", "m").select("fp", "component_id", "n"), "named")
    return with_hot(prints, named, "fp").select("doc_id", "fp", "component_id")


# By similarity ----------------------------------------------------------------

#: Words of a shingle, and shared part of two texts' shingles, from which texts are near-duplicates.
NEAR_WIDTH, NEAR_SHARE = 5, 0.8
#: Samples of a text's shingles, and shingles in one: texts that share 0.8 have one in common with a probability of 0.997.
SAMPLES, SAMPLE_SIZE = 32, 8
#: Verified pairs of a text that go to one task, about.
PAIRS = 64
_SKETCH = "set_key long, fp long, samples array<long>"


def _mixed(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def sketch(text: str | None, width: int = NEAR_WIDTH) -> tuple[int, int, list[int]]:
    """(key of the set of shingles, fingerprint, key of each sample of ``SAMPLE_SIZE`` shingles)."""
    hashes = np.unique(np.array(shingle_hashes(text, width), np.uint64))
    if not len(hashes):
        return 0, 0, []
    low = np.full(SAMPLES * SAMPLE_SIZE, np.iinfo(np.uint64).max, np.uint64)
    turn, step = _mixed(len(low), 11), _mixed(len(low), 12)
    for a in range(0, len(hashes), 1024):
        low = np.minimum(low, (hashes[a : a + 1024, None] * turn + step).min(0))  # the hashes are random: a product orders them anew
    keys = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(low.reshape(SAMPLES, -1))]
    signed = [k - ((k >> 63) << 64) for k in (xxhash.xxh64_intdigest(hashes.tobytes()), *keys)]
    return signed[0], int(fingerprints([text], width)[0]), signed[1:]


def share(a: str | None, b: str | None, width: int = NEAR_WIDTH) -> float:
    """Shared part of two texts' sets of shingles; 1 for two empty ones."""
    x, y = set(shingle_hashes(a, width)), set(shingle_hashes(b, width))
    return len(x & y) / len(x | y) if x or y else 1.0


def _shared(cells: DataFrame) -> DataFrame:
    """The rows (cell, a) of cells with two texts or more, with their number n."""
    counts = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    return saved(cells.select("cell", "a").join(counts, "cell"), "cells")


def _pairs(cells: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame | None:
    """Verified links (a, b) among texts of a cell, each compared with leaders of its cell; none if no cell is shared.

    ``cells`` come from ``_shared``; every round moves ``texts``, so these are those of ``cells`` only.

    In a round every cell has leaders, twice as many as the round before
    (at first one): the texts that share cells with the most others, as the common
    source of edits does, so that few of its edits are left after the first round; texts that are linked to one, and the leaders, leave the cell.
    It ends when no cell has two texts left.
    """

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([share(x, y, width) >= least for x, y in zip(a, b)])

    links, turn = None, 0
    while not cells.isEmpty():
        part = F.pmod(F.xxhash64("a", F.lit(turn)), F.lit(2**turn))
        degree = cells.groupBy("a").agg(F.sum("n").alias("degree"))
        leaders = saved(cells.join(degree, "a").groupBy("cell", part.alias("part")).agg(F.max_by("a", F.struct("degree", "a")).alias("b")).select("cell", "b"), "leaders")
        tried = cells.join(leaders, "cell").where("a <> b")
        edges = saved(tried.select("a", "b").distinct(), "tried")
        heavy = edges.groupBy("b").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts"))
        right = texts.withColumnsRenamed({"a": "b", "text": "other"}).join(heavy, "b").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        left = edges.join(heavy, "b").withColumn("part", F.expr("int(pmod(xxhash64(a), parts))")).drop("parts").join(texts, "a")
        good = saved(left.join(right, ["b", "part"]).where(near("text", "other")).select("a", "b"), "verified")
        links = good if links is None else links.unionByName(good)
        done = tried.join(good, ["a", "b"], "left_semi").select("cell", "a").union(leaders.select("cell", "b"))
        cells = _shared(cells.join(done.distinct(), ["cell", "a"], "left_anti"))
        turn += 1
    return links


def deduplicate(docs: DataFrame, width: int = NEAR_WIDTH, least: float = NEAR_SHARE) -> DataFrame:
    """``docs`` (doc_id, text and others) with one row of each group of near-duplicates.

    Linked are texts whose fingerprints of ``width``-word shingles are linked by
    the grid join, and texts whose sets of shingles share ``least`` or more.  The
    latter is beyond what fingerprints of 64 bits tell (such texts differ in ten
    bits of them, and a grid for ten bits sets nothing apart), so candidates come
    from samples of shingles, and each is verified by the sets themselves.

    The row of the smallest doc_id stays (a null one comes last), among equal ids
    that of the smallest hash of its text.  Rows count, not ids: of rows that repeat an id those
    whose texts are in no common group all stay, and of equal rows one.  Wordless texts are one group.

    ``docs`` are read three times, so store what is costly or random.  A row is known by two hashes of
    its content: texts are dealt out twice however many rounds there are, once to find those that may
    have a near-duplicate and once for the rows that stay, and only the former are stored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    @F.pandas_udf(_SKETCH)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sketch(t, width) for t in texts], columns=["set_key", "fp", "samples"])

    content = [x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))]  # a hash passes over nulls, so they are told
    known = docs.withColumns({"_row": F.xxhash64(*content), "_text": F.xxhash64("text")})
    key = ["_row", "_text"]
    whole = known.dropDuplicates(key)
    rows = saved(known.select("doc_id", *key, run("text").alias("_s")), "sketched")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_text", "_row")
    classes = saved(rows.groupBy(F.col("_s.set_key").alias("a")).agg(F.min(order).alias("best"), F.first("_s.fp").alias("fp"), F.first("_s.samples").alias("samples")), "classes")
    of_print = classes.groupBy("fp").agg(F.min("a").alias("u"))
    same = classes.join(of_print, "fp").where("a <> u").select(F.col("a").alias("u"), F.col("u").alias("v"))
    grid = link(of_print.select("fp"))
    named = of_print.select(F.col("fp").alias("_f"), F.col("u").alias("_u"))
    grid = grid.join(named, F.col("u") == F.col("_f")).select("_u", "v").withColumnRenamed("_u", "u").join(named, F.col("v") == F.col("_f")).select("u", F.col("_u").alias("v"))
    cells = _shared(classes.select("a", F.explode("samples").alias("cell")))
    # These lists grow with the corpus, so their joins are shuffles at every size, never broadcasts.
    listed = cells.select("a").distinct().join(classes, "a").select("a", "best._row", "best._text")
    texts = saved(whole.select(*key, "text").join(listed.hint("merge"), key).select("a", "text"), "texts")
    verified = _pairs(cells, texts, width, least)
    links = same.union(grid)
    if verified is not None:
        links = links.union(verified)
    reached = connected(links).withColumnRenamed("node", "a")
    kept = classes.join(reached, "a", "left").groupBy(F.coalesce("component", "a").alias("component")).agg(F.min("best").alias("best")).select("best._row", "best._text")
    return whole.join(kept.hint("merge"), key, "left_semi").drop(*key)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
