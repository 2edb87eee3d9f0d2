"""Closed syncmers against a plain restatement with the same hash."""

import hashlib
import re

import xxhash
from cases import ROWS, documents, empty, read, table
from pyspark.sql import functions as F

from corpusloom.llm import fingerprints as fp

TOKEN = re.compile("[぀-ヿ㐀-鿿가-힯]|[^ \\t-\\r぀-ヿ㐀-鿿가-힯]{1,16}")
LOW = (1 << 24) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else (v & (2**64 - 1)).to_bytes(8, "little"), seed=seed)
    return signed(seed)


def anchors(text):
    h = [0, 0, 0, 0] + [hashed(t.encode()) for t in TOKEN.findall(text)]
    if len(h) == 4:
        h = h[:4]
    s = [hashed(*h[i : i + 3]) for i in range(len(h) - 2)]
    found = {}
    for i in range(len(s) - 2):
        if min(s[i], s[i + 2]) <= s[i + 1]:
            x = signed((hashed(s[i], s[i + 2]) & (2**64 - 1)) & ~LOW)
            found[x] = min(found.get(x, LOW), i)
    return [(x, found[x]) for x in sorted(found)[:64]]


def shown(a):
    return "".join(f"{(x | i) & (2**64 - 1):016X}" for x, i in a)


def likeness(a, b):
    x, y = {v for v, _ in a}, {v for v, _ in b}
    u = sorted(x | y)[:64]
    return 1.0 if not u else len(x & y & set(u)) / len(u)


def check(rows, got):
    """rows: (doc_id, text) with distinct ids."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(order)
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, e, n = anchors(text), anchors(edited), anchors(after)
        r = by[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == shown(a) and r["edited_fingerprint"] == shown(e)
        assert abs(r["near_edited"] - likeness(a, e)) < 1e-12 and abs(r["near_next"] - likeness(a, n)) < 1e-12


def test_restatement(spark):
    docs = documents(spark)
    check([(r["doc_id"], r["text"]) for r in docs.collect()], read(fp.fingerprint_report(docs)))


def test_many_buckets_and_one_give_the_same(spark, monkeypatch):
    docs = documents(spark)
    one = sorted(read(fp.fingerprint_report(docs)), key=lambda r: r["doc_id"])
    monkeypatch.setattr(fp, "BUCKET_ROWS", 7)
    assert sorted(read(fp.fingerprint_report(docs)), key=lambda r: r["doc_id"]) == one


def test_repeated_and_null_ids(spark, monkeypatch):
    """A third of the ids is null, a third is one id, many rows are repeats; all in small buckets."""
    import random

    rng = random.Random(12)
    text = lambda: " ".join(rng.choices("lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam".split(), k=rng.randrange(2, 14)))
    rows = [(None, text()) for _ in range(60)] + [(50, text()) for _ in range(40)] + [(50, "the same text in many rows of one id")] * 25 + [(None, None)] * 9 + [(k, text()) for k in range(100)]
    rng.shuffle(rows)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), -hashed(r[1].encode())))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(anchors(t)), shown(anchors(edited)), round(likeness(anchors(t), anchors(after)), 9)))
    df = table(spark, [(i, t, "en", "a", 1) for i, t in rows])
    for size in (6, 500):
        monkeypatch.setattr(fp, "BUCKET_ROWS", size)
        assert sorted(map(repr, want)) == sorted(map(repr, [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_next"], 9)) for r in read(fp.fingerprint_report(df))]))


def test_edges(spark):
    unique = list({r[0]: r for r in ROWS if r[0] is not None}.values())
    check([r[:2] for r in unique], read(fp.fingerprint_report(table(spark, unique))))
    got = read(fp.fingerprint_report(table(spark)))
    assert len(got) == len(ROWS) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert read(fp.fingerprint_report(empty(spark))) == []


def test_an_edit_disturbs_only_its_surroundings(spark):
    words = [f"w{k}" for k in range(60)]
    changed = words[:30] + ["changed"] + words[31:]
    df = spark.createDataFrame([(" ".join(words), " ".join(changed))], "a string, b string")
    df = fp.with_anchors(fp.with_anchors(df, "a", "x"), "b", "y")
    pairs = fp.match_positions(df, "x", "y", "p").select(F.col("p")).first()[0]
    lost = {p for _, p in anchors(" ".join(words))} - {r["left"] for r in pairs}
    assert pairs and all(r["left"] == r["right"] for r in pairs) and all(30 <= p <= 34 for p in lost)
