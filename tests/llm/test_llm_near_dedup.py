"""BagMinHash signatures are unbiased; classes equal those of all pairs by brute force."""

import random
from collections import Counter

import numpy as np
from cases import ROWS, documents, empty, read, table, untouched

from corpusloom.llm import bagminhash as bag
from corpusloom.llm import near_dedup as nd


def shingles(text):
    w = (text or "").encode().split()
    return Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()


def overlap(a, b):
    if not a and not b:
        return 1.0
    return sum(min(n, b[s]) for s, n in a.items()) / sum(max(a[s], b[s]) for s in a.keys() | b.keys())


def classes(rows):
    """Sets of rows by comparing all pairs."""
    find = linked(rows)
    return {find(k) for k in range(len(rows))}


def linked(rows):
    bags = [shingles(t) for _, t, *_ in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if overlap(bags[i], bags[j]) >= 0.8:
                top[find(i)] = find(j)
    return find


def brute(rows):
    """Class (smallest id that isn't null) of every row."""
    find, ids, size = linked(rows), {}, Counter()
    for k, r in enumerate(rows):
        c = find(k)
        size[c] += 1
        if r[0] is not None:
            ids[c] = min(ids.get(c, r[0]), r[0])
    return sorted(repr((r[0], ids.get(find(k)), size[find(k)])) for k, r in enumerate(rows))


def check(rows, df):
    got = read(df)
    assert sorted(repr((r["doc_id"], r["class_id"], r["class_size"])) for r in got) == brute(rows)
    kept = [r for r in got if r["kept"]]
    assert all(r["doc_id"] == r["class_id"] for r in kept) and len(kept) == len(classes(rows))  # one row a class


def test_all_pairs(spark):
    docs = documents(spark)
    check([(r["doc_id"], r["text"]) for r in docs.collect()], nd.near_duplicates(docs))


def test_edges(spark):
    check(ROWS, nd.near_duplicates(table(spark)))
    assert read(nd.near_duplicates(empty(spark))) == []
    assert nd.deduplicate(empty(spark)).count() == 0
    docs = table(spark)
    got = nd.deduplicate(docs)
    assert got.columns == docs.columns and untouched(got)
    ids = [r["class_id"] for r in read(nd.near_duplicates(docs)) if r["kept"]]
    assert sorted(map(repr, ids)) == sorted(repr(r["doc_id"]) for r in read(got))


def chain(n, seed=1, words=120):
    """Texts of which each is near the one before, but the ends are far apart."""
    rng = random.Random(seed)
    fresh = lambda: f"w{rng.randrange(10**9)}"
    text = [fresh() for _ in range(words)]
    out = []
    for _ in range(n):
        out.append(" ".join(text))
        text = text[4:] + [fresh() for _ in range(4)]
    return out


def test_chains_and_crowds(spark):
    rng = random.Random(2)
    texts = chain(12) + [t for s in range(3, 9) for t in chain(2, s)]
    base = chain(1, 50, 150)[0].split()
    for k in range(60):  # a crowd around one text, members of which are far from each other
        w = list(base)
        at = rng.randrange(0, 130)
        w[at : at + 6] = [f"x{k}a{j}" for j in range(6)]
        texts.append(" ".join(w))
    texts += ["again again again again again again " * k for k in (1, 2, 4, 5, 20, 21, 24)]  # multiplicities count
    rows = [(k, t, "en", "a", 1) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    check(rows, nd.near_duplicates(table(spark, rows)))


def test_blocks_leave_no_link_out(spark, monkeypatch):
    monkeypatch.setattr(nd, "CHUNK", 5)
    monkeypatch.setattr(nd, "SIGNS", 16)
    rng, base = random.Random(4), chain(1, 60, 100)[0].split()
    rows = []
    for k in range(80):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(100)] = f"y{rng.randrange(30)}"
        rows.append((k, " ".join(w), "en", "a", 1))
    check(rows, nd.near_duplicates(table(spark, rows)))


def test_repeated_rows_without_ids(spark):
    rows = [(None, "all ids are null here today", "en", "a", 1)] * 5 + [(2, "these two are one row twice", "en", "a", 1)] * 2 + [(3, "another text of its own kind", "en", "a", 1)]
    got = read(nd.near_duplicates(table(spark, rows)))
    assert [r["kept"] for r in got].count(True) == 3 and len(got) == 8
    assert nd.deduplicate(table(spark, rows)).count() == 3


def test_texts_do_not_move_where_signatures_tell(spark):
    """A crowd in one bucket whose members aren't near: no text is compared; and small blocks lose no link."""
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    n = 3000
    sig = rng.integers(0, 2**32, (n, nd.M), dtype=np.uint64).astype("<u4")
    sig[:, :4] = 7  # the band that they share
    sig[1], sig[n - 1] = sig[0], sig[0]
    nodes = spark.createDataFrame([(k, bytearray(sig[k].tobytes())) for k in range(n)], "node long, sig binary")
    members = nodes.select(F.lit(1).cast("long").alias("bucket"), "node", F.col("node").alias("label"))
    twin = members.withColumn("bucket", F.lit(2).cast("long"))
    assert nd._open_buckets(members.unionByName(twin)).count() == 1
    assert nd._open_buckets(members.unionByName(twin.filter("node > 0"))).count() == 2
    left = nd._apart(members.unionByName(twin), nodes)
    assert {r["node"] for r in left.collect()} == {0, 1, n - 1}


def jobs(spark, name, act):
    """What ``act`` returns, and how many jobs it takes."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        return act(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_components_of_few_links_take_few_jobs(spark, monkeypatch):
    """Rounds over a few links write more small files, and more of the event log, than a small table may take."""
    rng = random.Random(9)
    links = [(k, k + 1) for k in range(100, 140)] + [(300, 7), (7, 300), (8, 8)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(130)]
    rng.shuffle(links)
    table_ = nd.materialize(spark.createDataFrame(links, "a long, b long").repartition(5))
    few, n = jobs(spark, "few links", lambda: sorted(map(tuple, nd.components(table_).collect())))
    assert n <= 6
    monkeypatch.setattr(nd, "FEW", 0)
    assert few == sorted(map(tuple, nd.components(table_).collect()))
    assert {r[1] for r in few if r[0] < 1000} == {7, 8, 100}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 300, dtype=np.uint64)
    a = rng.integers(0, 9, 300)
    for change in (0.05, 0.3, 1.0):
        b = np.where(rng.random(300) < change, rng.integers(0, 9, 300), a)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        doc = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        sig = bag.signatures(doc, np.concatenate([h[a > 0], h[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 8192)
        assert abs((sig[0] == sig[1]).mean() - true) < 5 * (true * (1 - true) / 8192) ** 0.5 + 1e-9


def test_counts_and_overlap():
    memo = nd._Words()
    for x, y in ((PAIR := "a b c d e f a b c d e g")[:-2], PAIR), ("a", "a"), ("a b", "b a"), ("", ""), ("x " * 30, "x " * 20):
        d, h, w = bag.shingle_counts([nd.hashed_words(x, memo), nd.hashed_words(y, memo)], 5)
        got = bag.jaccard((h[d == 0], w[d == 0]), (h[d == 1], w[d == 1]))
        assert abs(got - overlap(shingles(x), shingles(y))) < 1e-12
