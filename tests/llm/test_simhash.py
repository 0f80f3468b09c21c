"""Fingerprints and links against brute force."""

import numpy as np
import pytest
import xxhash

from ampflow.llm import simhash
from ampflow.llm.components import connected


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, ids):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            r = find(i)
            low[r] = min(low.get(r, d), d)
    return [low.get(find(i)) for i in range(len(prints))]


def test_whole_query_against_brute_force(docs, corpus):
    rows = simhash.near_duplicates(docs).collect()
    prints = [slow_fingerprint(r[1]) for r in corpus]
    expected = sorted(zip([r[0] for r in corpus], prints, slow_components(prints, [r[0] for r in corpus])), key=str)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in rows), key=str) == expected


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    fp = [int(x) for x in rng.integers(0, 2**63, 20)]
    while len(fp) < n:
        x = fp[rng.integers(len(fp))]
        for k in rng.integers(0, 64, rng.integers(1, 6)):
            x ^= 1 << int(k)
        fp.append(x)
    return np.unique(np.array(fp, np.uint64))


def as_dict(pair):
    return dict(zip(pair[0].tolist(), pair[1].tolist()))


def test_cells_and_midpoints_lose_no_link():
    fp = clustered(700)
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None]) <= 4, 1))
    expected = as_dict(simhash.forest(fp[i], fp[j]))
    cell, who = simhash.cells_of(fp)
    order = np.argsort(cell, kind="stable")
    assert as_dict(simhash.forest(*simhash.link_cells(cell[order], fp[who][order]))) == expected
    assert as_dict(simhash._midpoints(fp, 200_000)) == expected


def test_dense_cells_take_the_midpoint_way(monkeypatch):
    fp = clustered(300, 3)
    cell, who = simhash.cells_of(fp)
    order = np.argsort(cell, kind="stable")
    plain = as_dict(simhash.forest(*simhash.link_cells(cell[order], fp[who][order])))
    monkeypatch.setattr(simhash, "DENSE", 3)
    assert as_dict(simhash.forest(*simhash.link_cells(cell[order], fp[who][order]))) == plain


@pytest.mark.parametrize(("huge", "batch"), [(1, 50), (3, 7), (40, 10_000), (10**6, 33)])
def test_huge_cells_are_passed_on_and_lose_no_link(spark, monkeypatch, huge, batch):
    fp = clustered(400, 5)
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None]) <= 4, 1))
    expected = as_dict(simhash.forest(fp[i].view(np.int64), fp[j].view(np.int64)))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(batch))
    rows = simhash.link(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long"), huge).collect()
    spark.conf.set(key, before)
    got = simhash.forest(np.array([r.u for r in rows]), np.array([r.v for r in rows]))
    assert as_dict(got) == expected


def test_blocks_hold_whole_keys():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    for most, step in ((5, 3), (40, 7), (1000, 64)):
        keys = np.sort(np.repeat(np.arange(60), rng.integers(1, 30, 60)))
        rows = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + step]), pa.array(np.arange(len(keys))[a : a + step])], ["k", "fp"]) for a in range(0, len(keys), step)]
        met, seen = set(), []
        for key, fp in simhash._blocks(iter(rows), most):
            seen += fp.tolist()
            assert not met & set(key.tolist())
            met |= set(key.tolist())
        assert sorted(seen) == list(range(len(keys)))


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_empty_and_null_tables(nothing, nulls):
    assert simhash.near_duplicates(nothing).count() == 0
    assert [(r.fp, r.component_id) for r in simhash.near_duplicates(nulls).collect()] == [(0, None)] * 2


def test_one_document_of_each_group_stays(docs, corpus, nothing, nulls):
    kept = simhash.deduplicate(docs)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    named = [i for i in ids if i is not None]
    assert len(named) == len(set(named)) and 205 not in named and 4 in named and None in ids
    assert kept.columns == docs.columns
    assert simhash.deduplicate(nothing).count() == 0 and simhash.deduplicate(nulls).count() == 1


def test_rows_go_by_their_text_not_by_their_id(spark):
    a, b = "one two three four five six seven", "a text that nothing else is at all like"
    rows = spark.createDataFrame([(1, a), (5, a), (5, b), (None, b), (None, "x y z"), (7, "x y z"), (9, ""), (8, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.deduplicate(rows).collect()) == [(1, a), (5, b), (7, "x y z"), (8, None)]


def test_texts_that_share_four_fifths_are_linked(spark):
    """Against all pairs: groups with edits of many sizes; what is not within reach stays."""
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(30, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            own = base[:]
            for _ in range(rng.randint(1, max(1, len(base) // 25))):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    n = len(texts)
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if simhash.share(texts[i], texts[j]) >= 0.8:
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    expected = {min(i for i in range(n) if root[i] == r) for r in set(root)}
    got = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == expected and len(expected) < 0.6 * n


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    from ampflow.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.createDataFrame([(i % 7 if i < 40 else 0, i) for i in range(100)], "k long, x long")
    named = rows.groupBy("k").count().withColumnRenamed("count", "n").withColumn("name", rows["k"] * 10)
    got = sorted((r.k, r.x, r.name) for r in common.with_hot(rows, named, "k").collect())
    assert got == sorted((r.k, r.x, r.k * 10) for r in rows.collect())


def test_texts_move_twice_and_candidates_only_in_rounds(spark, monkeypatch):
    """A group of many edits takes several rounds; none of them may read the other texts."""
    import random

    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    alone = [" ".join(rng.choices(words, k=60)) for _ in range(150)]
    base = rng.choices(words, k=80)
    edits = [" ".join(base[:i] + ["x"] + base[i + 1 :]) for i in range(0, 80, 8)]
    columns, moved = {}, []
    save, pairs = simhash.saved, simhash._pairs
    monkeypatch.setattr(simhash, "saved", lambda df, name: columns.setdefault(name, df.columns) and save(df, name))
    monkeypatch.setattr(simhash, "_pairs", lambda cells, texts, *more: moved.extend(texts.collect()) or pairs(cells, texts, *more))
    got = sorted(r.doc_id for r in simhash.deduplicate(spark.createDataFrame(list(enumerate(alone + edits)), "doc_id long, text string")).collect())
    assert got == list(range(151))
    assert sorted(r.text for r in moved) == sorted(edits)
    assert [name for name, of in columns.items() if "text" in of] == ["texts"]


def test_rows_alike_but_for_a_null_are_different_rows(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, a, None, "s"), (1, a, "s", None), (1, a, None, "s"), (1, b, "s", None), (None, b, None, "s"), (2, None, "x", "y"), (None, None, "x", "y"), (None, "x", None, "y"), (None, "x", "y", None)]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id) == [(1, b), (1, a), (2, None)]
    assert [r.text for r in kept if r.doc_id is None] == ["x"] and all(tuple(r) in rows for r in kept)
