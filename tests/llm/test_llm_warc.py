"""WARC round trips against brute force, and the loser tree against sorting."""

import hashlib
import heapq
import random

from cases import read
from pyspark.sql import functions as F

from corpusloom.llm import warc

BIG, OTHER = "<p>" + "x" * 1500, "ü" * 600
PAGES = [
    (1, "https://A.example.com/b?q#f", BIG), (2, "https://a.example.com/a", BIG), (3, "https://a.example.com/a", BIG), (3, "https://a.example.com/a", BIG),
    (4, None, None), (5, "", ""), (6, "not a url", "short"), (7, "http://u:p@h.org:80/x\r\nInjected: 1", "short"), (None, "https://h.org/", BIG), (None, "https://h.org/", None),
    (9, "https://h.org/y", OTHER), (8, "https://h.org/x", OTHER), (10, "https://h.org/z", "WARC/1.1\r\n\r\n\r\nContent-Length: 5\r\n\r\n" * 40), (-5, "https://h.org/n", "n" * 999), (11, "https://h.org/n", "n" * 999),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumns({c: F.lit("clash") for c in ("value", "sha", "head", "bytes", "payload", "key", "run", "offset", "part", "at")})


def brute(rows):
    best = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if i is not None and len(h) >= 1000:
            best[h] = max(best.get(h, i), i)
    out = []
    for i, _, h in rows:
        h = (h or "").encode()
        again = h in best and i != best[h]
        out.append((i, len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", best[h] if again else None))
    return sorted(map(repr, out))


def check(rows, got):
    assert sorted(repr((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got) == brute(rows)
    assert sorted(r["capture_rank"] for r in got) == list(range(len(got)))
    order = sorted(got, key=lambda r: r["capture_rank"])
    keys = [(r["url_key"], r["captured"]) for r in order]
    assert keys == sorted(keys)


def test_edges(spark):
    check(PAGES, read(warc.round_trip(pages(spark))))
    assert read(warc.round_trip(pages(spark).filter("page_id = 777"))) == []


def test_real_pages(spark):
    from oracle import connect, same

    from corpusloom.llm.queries import QUERIES, SQL

    sf = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{sf}/pages.parquet")
    check([tuple(r) for r in df.select("page_id", "url", "html").collect()], read(warc.round_trip(df)))
    same(spark, connect(sf), QUERIES["op10_warc"], SQL["op10_warc"], sf)


def test_records_are_members_of_their_own(spark, tmp_path):
    import glob
    import gzip

    path = str(tmp_path / "a")
    warc.write_archives(pages(spark), path, volume_bytes=500)
    files, seen = glob.glob(f"{path}/**/part-*", recursive=True), []
    assert len(files) > 3  # a file ends with the record that fills it
    for f in files:
        data = open(f, "rb").read()
        whole = gzip.decompress(data)  # one gzip stream to any reader
        found = list(warc.members(data))
        assert b"".join(r for r, _ in found) == whole
        for record, offset in found:
            headers, block = warc.record_at(data, offset)
            assert len(block) == int(headers["Content-Length"]) and "Injected" not in headers and warc.parse(record)[0] == headers
            seen.append((f.rsplit("/", 2)[1:], offset, headers.get("X-Page-Id"), headers["WARC-Type"]))
    assert len(seen) == len(PAGES)
    got = read(warc.read_archives(spark, path))
    assert sorted(("/".join(f), o, i, k) for f, o, i, k in seen if i) == sorted((r["run"], r["offset"], str(r["page_id"]), r["record_type"]) for r in got if r["page_id"] is not None)


def test_broken_archives_are_refused():
    import pytest

    whole = warc.member(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    assert warc.record_at(b"xx" + whole, 2)[1] == b"abc"
    for data in (b"junk", whole[:-1], whole + b"\0"):
        with pytest.raises(ValueError):
            list(warc.members(data))
    for record in (b"junk", b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcX"):
        with pytest.raises(ValueError):
            warc.parse(record)


def test_runs_are_ascending_spans():
    import pyarrow as pa

    rng = random.Random(3)
    rows = [(f"k{rng.randrange(5)}", "t", False, rng.randrange(3), f"a{rng.randrange(3)}", n) for n in range(300)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + 70])], names=list(warc.ORDER)) for a in range(0, 300, 70)]
    _, runs = warc.slices(iter(batches))
    parts = [[rows[k] for a, b in spans for k in range(a, b)] for spans in runs]
    assert all(p == sorted(p) and len({r[4] for r in p}) == 1 for p in parts) and sorted(sum(parts, [])) == sorted(rows)
    assert list(warc.LoserTree(parts)) == sorted(rows)


def test_loser_tree():
    rng = random.Random(1)
    for _ in range(200):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(9))]
        assert list(warc.LoserTree(runs)) == list(heapq.merge(*runs))
