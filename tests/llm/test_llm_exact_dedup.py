"""The cuckoo index against a dictionary, and exact duplicates against brute force and SQL."""

import hashlib
import random
import re

from cases import ROWS, SF, empty, read, table, untouched
from oracle import connect, same

from corpusloom.llm import exact_dedup as ed
from corpusloom.llm.queries import QUERIES, SQL


def digest(k):
    return hashlib.sha256(str(k).encode()).hexdigest()


def test_index_is_a_dictionary():
    rng, index, plain = random.Random(3), ed.CuckooIndex(4), {}
    for step in range(20_000):
        d = digest(rng.randrange(3000))
        if rng.random() < 0.6:
            index.put(d, step)
            plain[d] = step
        else:
            assert index.delete(d) == (d in plain)
            plain.pop(d, None)
        if step % 500 == 0:
            assert dict(index.items()) == plain and len(index) == len(plain)
            assert sum(map(len, index.table)) == len(plain)
    assert index.resizes > 0
    assert all(index.get(d) == v for d, v in plain.items())
    assert index.get(digest("never")) is None and not index.delete(digest("never"))


def test_a_filter_hit_is_verified():
    index = ed.CuckooIndex(2)
    index.put("ab" * 32, 1)
    twin = "ab" * 12 + "cd" * 20  # the same fingerprint, buckets and content bucket
    assert index.maybe(twin) and index.get(twin) is None and not index.delete(twin)


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        t = t or ""
        groups.setdefault(re.sub("[ \t-\r]", "", t), []).append((-len(t), i is None, i or 0))
    out = []
    for i, t, *_ in rows:
        t = t or ""
        key = re.sub("[ \t-\r]", "", t)
        best = min(groups[key])
        out.append((i, None if best[1] else best[2], len(groups[key]), hashlib.sha256(key.encode()).hexdigest()))
    return out


def plain(rows):
    return sorted(map(repr, rows))


def test_report(spark):
    got = read(ed.duplicate_report(table(spark)))
    assert plain((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == plain(brute(ROWS))
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)
    assert read(ed.duplicate_report(empty(spark))) == []


def test_deduplicate(spark):
    docs = table(spark)
    got = ed.deduplicate(docs)
    assert got.columns == docs.columns and untouched(got)
    want = {r[3]: r[1] for r in brute(ROWS)}
    assert plain(r["doc_id"] for r in read(got)) == plain(want.values())
    assert ed.deduplicate(empty(spark)).count() == 0


def test_small_partitions_change_nothing(spark, monkeypatch):
    want = plain((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in read(ed.duplicate_report(table(spark))))
    monkeypatch.setattr(ed, "PARTITION_ROWS", 2)
    assert plain((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in read(ed.duplicate_report(table(spark)))) == want
    batches = ed.pa.RecordBatch.from_pylist([{"digest": digest(k % 3), "keep_id": k, "keep_chars": 1, "keep_row": k, "group_size": 1, "ties": 1} for k in range(9)])
    folded = [r for b in ed._fold(iter([batches, batches]), 2) for r in b.to_pylist()]
    assert len(folded) == 6 and all(r["group_size"] == 3 and r["keep_id"] < 3 and r["ties"] == 1 for r in folded)


def test_index_inserts_and_deletes(spark):
    half, rest = table(spark, ROWS[:8]), table(spark, ROWS[8:])
    both = ed.insert_into_index(ed.build_index(half), rest)
    want = {(r["digest"], r["keep_id"], r["group_size"]) for r in read(ed.build_index(table(spark)))}
    assert {(r["digest"], r["keep_id"], r["group_size"]) for r in read(both)} == want
    gone = ed.digests(half).select("digest")
    left = {r["digest"] for r in read(ed.delete_from_index(both, gone))}
    assert left == {x[0] for x in want} - {r["digest"] for r in read(gone)}


def test_sql(spark):
    same(spark, connect(SF), QUERIES["op2_exact_dedup"], SQL["op2_exact_dedup"], SF)
