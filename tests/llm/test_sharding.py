"""Shards: the capacity is the smallest, groups stay whole, slots are gapless."""

import random
import zlib

import numpy as np
import pytest

from ampflow.llm import sharding


def best_capacity(sizes, shards):
    """By dynamic programming over all cuts."""
    ends = np.append(0, np.cumsum(sizes))
    now = ends.copy()
    for _ in range(shards - 1):
        now = np.array([min(max(now[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(len(ends))])
    return int(now[-1])


@pytest.mark.parametrize("case", range(12))
def test_the_capacity_is_the_smallest(spark, case, monkeypatch):
    rng = random.Random(case)
    monkeypatch.setattr(sharding, "FIRST_BITS", rng.choice([1, 4, 16]))
    monkeypatch.setattr(sharding, "MORE_BITS", rng.choice([3, 8]))
    n, shards = rng.choice([1, 5, 60, 150]), rng.choice([1, 2, 7])
    rows = sorted({rng.randrange(-(1 << 63), 1 << 63) >> rng.choice([0, 0, 40]): 8 + int(rng.paretovariate(1.2) * 50) for _ in range(n)}.items())
    groups = spark.createDataFrame(rows, "key long, size long")
    made = sharding.plan(groups, shards)
    got = {}
    for r in groups.select("size", made.shard(groups.key).alias("s")).collect():
        got.setdefault(r.s, []).append(r["size"])
    assert set(got) <= set(range(shards))
    lonely = set(made.alone)
    rest = [size for key, size in rows if key not in lonely]
    left = shards - len(lonely)
    assert max(map(sum, got.values())) == max([best_capacity(rest, left), *(s for k, s in rows if k in lonely)])
    order = [s for (key, _), s in zip(rows, [r.s for r in groups.orderBy("key").select(made.shard(groups.key).alias("s")).collect()]) if key not in lonely]
    assert order == sorted(order)  # contiguous


def test_even_cuts_keep_to_the_capacity():
    rng = np.random.default_rng(2)
    for _ in range(200):
        sizes, shards = rng.integers(1, 50, rng.integers(1, 40)), int(rng.integers(1, 9))
        ends, capacity = np.append(0, np.cumsum(sizes)), best_capacity(sizes, shards)
        cuts = [0, *sharding.even_cuts(ends, capacity, shards)]
        assert cuts[-1] == len(sizes) and cuts == sorted(cuts)
        assert max(np.diff(ends[cuts])) <= capacity


def shards_of(spark, df, path):
    df.write.parquet(f"{path}/documents.parquet")
    return sharding.op13(spark, str(path)).collect()


def test_the_query(spark, docs, corpus, tmp_path):
    """Every row once, equal texts together, slots without gaps; nulls, repeats and clashing columns."""
    rows = shards_of(spark, docs.where("doc_id is null or doc_id not in (204, 206)"), tmp_path)
    texts = [(r[0], r[1] or "") for r in corpus if r[0] not in (204, 206)]
    want = sorted(((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=str) == want
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    slots, by_text, held = {}, {}, [0] * 24
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        by_text.setdefault((r["size"], r.text_crc32), set()).add(r.shard)
        held[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in by_text.values())
    groups = {}
    for _, size, crc in want:
        groups[size, crc] = groups.get((size, crc), 0) + size
    assert max(held) <= sum(held) / 24 + max(groups.values())


def test_a_group_larger_than_a_share_stands_alone(spark, tmp_path):
    df = spark.range(3000).selectExpr("id doc_id", "if(id < 1000, repeat('hot ', 50), concat('text ', id, repeat(' x', int(id % 97)))) text")
    rows = shards_of(spark, df, tmp_path)
    held = {}
    for r in rows:
        held[r.shard] = held.get(r.shard, 0) + r["size"]
    assert sum(r.shard == 0 for r in rows) == 1000 and held.pop(0) == 208_000
    assert len(held) == 23 and max(held.values()) < 1.06 * min(held.values())


def test_empty_tables_and_few_groups(spark, nothing, nulls, tmp_path):
    assert shards_of(spark, nothing, tmp_path / "a") == []
    rows = shards_of(spark, nulls, tmp_path / "b")
    assert [(r["size"], r.text_crc32, r.shard) for r in rows] == [(8, 0, 0)] * 2 and sorted(r.slot for r in rows) == [0, 1]


def test_written_shards_hold_whole_rows(spark, docs, tmp_path):
    made = sharding.planned(docs, 5)
    sharding.write(docs, made, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.columns) == sorted([*docs.columns, "shard"])
    assert back.select(docs.columns).exceptAll(docs).isEmpty() and back.count() == docs.count()
