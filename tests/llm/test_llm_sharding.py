"""Differencing against its own sums, and shards against their contract."""

import random
import zlib
from collections import Counter, defaultdict

from cases import ROWS, documents, empty, read, table

from corpusloom.llm import sharding as sh
from corpusloom.llm.queries import QUERIES


def test_differencing_keeps_sums():
    rng = random.Random(1)
    for shards in (2, 3, 16):
        items = [[rng.randrange(1, 1000), *[0] * (shards - 1)] for _ in range(200)]
        total, bins = sh.difference(items, shards)
        sums = [0] * shards
        for x, b in zip(items, bins):
            assert sorted(b) == list(range(shards))
            for v, at in zip(x, b):
                sums[at] += v
        assert sums == total and sum(total) == sum(map(sum, items))
        assert max(sums) - min(sums) <= 100
    assert sh.difference([], 3) == ([0, 0, 0], [])


def test_differencing_of_known_numbers():
    total, _ = sh.difference([[x, 0] for x in (8, 7, 6, 5, 4)], 2)
    assert sorted(total) == [14, 16]  # 8-7, 6-5, then 4-1-1: a difference of 2


def check(rows, got, shards=16, balance=None):
    assert len(got) == len(rows)
    text = {}
    for i, t, *_ in rows:
        text.setdefault(i, set()).add(t or "")
    slots, sums, homes = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        assert any(r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode()) for t in text[r["doc_id"]])
        slots[r["shard"]].append(r["slot"])
        sums[r["shard"]] += r["size"]
        homes[r["digest"]].add(r["shard"])
    assert all(0 <= s < shards for s in slots) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    group = Counter()
    for r in got:
        group[r["digest"]] += r["size"]
    assert all(len(h) == 1 for h in homes.values()) and all(r["shard_bytes"] == sums[r["shard"]] for r in got)
    # no shard is larger than it must be: an ideal one, or the largest group
    ideal = max(max(group.values(), default=0), sum(sums.values()) / shards)
    if balance:
        assert max(sums.values()) <= (1 + balance) * ideal
        if ideal == sum(sums.values()) / shards:
            assert min(sums[s] for s in range(shards)) >= (1 - balance) * ideal


def test_contract(spark):
    docs = documents(spark)
    check([(r["doc_id"], r["text"]) for r in docs.collect()], read(sh.assign_shards(docs)), balance=0.2)
    one = read(QUERIES["op5_kk_sharding"](spark, "/root/testdata/sf0.001"))
    assert {r["law"] for r in one} == {"bytes"} and {r["grown_shard"] for r in one} == {None}


def test_trees_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(sh, "CHUNK", 20)
    monkeypatch.setattr(sh, "FAN_IN", 3)
    rng = random.Random(2)
    rows = [(k, "x" * rng.randrange(1, 400) + str(k), "en", "a", 1) for k in range(600)]
    check(rows, read(sh.assign_shards(table(spark, rows), 4)), 4, balance=0.01)


def test_a_hot_text_stays_whole(spark):
    rows = [(k, "y" * 100, "en", "a", 1) for k in range(3000)] + [(7, "y" * 100, "en", "a", 1)] * 500 + [(10_000 + k, "z" * k, "en", "a", 1) for k in range(300)]
    got = read(sh.assign_shards(table(spark, rows), 8))
    check(rows, got, 8, balance=0.01)
    rest = sorted({r["shard"]: r["shard_bytes"] for r in got}.values())
    assert rest[-1] == 3500 * 101 and rest[-2] - rest[0] <= 0.02 * rest[-2]  # the others share what is left


def test_no_assignment_is_better_by_much():
    """Against the best of all assignments of few items."""
    import itertools

    rng = random.Random(4)
    for _ in range(40):
        sizes = [rng.randrange(1, 60) for _ in range(8)]
        best = min(max(sum(x for x, b in zip(sizes, bins) if b == k) for k in range(3)) for bins in itertools.product(range(3), repeat=8))
        total, _ = sh.difference([[x, 0, 0] for x in sizes], 3)
        assert max(total) <= best * 7 / 6 + 1


def test_the_layout_of_the_files_does_not_matter(spark):
    docs = documents(spark)
    one = sorted(map(repr, read(sh.assign_shards(docs))))
    assert sorted(map(repr, read(sh.assign_shards(docs.repartition(7).sortWithinPartitions("text"))))) == one


def test_edges(spark):
    check(ROWS, read(sh.assign_shards(table(spark))))
    assert read(sh.assign_shards(empty(spark))) == []
