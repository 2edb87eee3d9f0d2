"""Mixtures against their definition, recomputed in plain Python from what came out."""

import math
from collections import Counter, defaultdict

from cases import ROWS, documents, empty, read, table, untouched
from pyspark.sql import functions as F

from corpusloom.llm import mixing as mx


def tokens(text):
    return len((text or "").encode().split()) + 1


def check(rows, schedule, limit=2.0, block_tokens=1 << 20):
    by = defaultdict(int)
    for _, t, _, s, *_ in rows:
        by[s] += tokens(t)
    top, total = max(by.values()), sum(by.values())
    # the smallest exponent at which no source repeats more often than allowed
    worst = top / min(by.values())
    exponent = 0.0 if worst <= limit else 1 - math.log(limit) / math.log(worst)
    want = {s: (top / n) ** (1 - exponent) for s, n in by.items()}
    norm = sum((n / total) ** exponent for n in by.values())
    passes, spent = Counter(), defaultdict(int)
    blocks = defaultdict(list)
    for r in schedule:
        assert abs(r["repeats"] - want[r["source"]]) < 1e-6 and abs(r["weight"] - (by[r["source"]] / total) ** exponent / norm) < 1e-9
        passes[(r["doc_id"], r["source"], r["tokens"], r["epoch"])] += 1
        spent[r["source"]] += r["tokens"]
        blocks[r["block"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in blocks.values())
    copies = Counter((i, s, tokens(t)) for i, t, _, s, *_ in rows)
    for (i, s, n), c in copies.items():  # whole passes take every document
        for e in range(math.floor(want[s] + 1e-9)):
            assert passes[(i, s, n, e)] == c
    longest = {s: max(tokens(t) for _, t, _, x, *_ in rows if x == s) for s in by}
    for s, n in spent.items():  # a budget is met to within one document
        assert n <= want[s] * by[s] + 1e-6 and n > want[s] * by[s] - longest[s] - 1e-6


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_definition(spark):
    docs = documents(spark)
    for limit in (1.0, 1.5, 2.0, 4.0):
        check(rows_of(docs), read(mx.schedule(docs, max_repeats=limit)), limit)


def test_blocks_hold_the_target_weights(spark):
    rows = [(k, "w " * 9, "en", "abbcccc"[k % 7], 1) for k in range(7000)]
    got = read(mx.schedule(table(spark, rows), max_repeats=2.0, block_tokens=2000))
    check(rows, got)
    by = defaultdict(Counter)
    weight = {}
    for r in got:
        by[r["block"]][r["source"]] += r["tokens"]
        weight[r["source"]] = r["weight"]
    full = [c for b, c in by.items() if b < max(by)]
    for c in full:
        for s, w in weight.items():
            assert abs(c[s] - 2000 * w) <= 20


def test_slices_do_not_change_the_permutation(spark, monkeypatch):
    docs = documents(spark)
    one = sorted(read(mx.schedule(docs)), key=repr)
    monkeypatch.setattr(mx, "SLICE", 3)
    assert sorted(read(mx.schedule(docs)), key=repr) == one


def test_apply_is_the_schedule(spark):
    docs = documents(spark)
    out = mx.apply(docs, max_repeats=2.0)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in read(out)) == Counter(r["doc_id"] for r in read(mx.schedule(docs, max_repeats=2.0)))
    assert out.distinct().count() == docs.distinct().count()


def test_entropy(spark):
    src = spark.createDataFrame([("a", 0.7), ("b", 0.2), ("c", 0.1)], "source string, share double")
    for a in (0.0, 0.3, 0.8, 1.0):
        w = [x**a for x in (0.7, 0.2, 0.1)]
        h = -sum(x / sum(w) * math.log(x / sum(w)) for x in w)
        assert abs(mx.bisect_entropy(src, h) - a) < 1e-4
    assert mx.bisect_entropy(src, 9.0) == 0.0 and mx.bisect_entropy(src, 0.0) == 1.0
    docs = documents(spark)
    got = {r["source"]: r["weight"] for r in read(mx.schedule(docs, max_repeats=None, target_entropy=1.0))}
    natural = Counter()
    for r in read(docs):
        natural[r["source"]] += tokens(r["text"])
    n = sum(natural.values())
    entropy = lambda ws: -sum(w * math.log(w) for w in ws if w)
    assert abs(entropy(got.values()) - max(1.0, entropy(x / n for x in natural.values()))) < 1e-3


def test_edges(spark):
    check(ROWS, read(mx.schedule(table(spark))))
    assert read(mx.schedule(empty(spark))) == [] and mx.apply(empty(spark)).count() == 0
    docs = table(spark)
    out = mx.apply(docs)
    assert out.columns == docs.columns and untouched(out) and out.count() == mx.schedule(docs).count()
    assert {r["doc_id"] for r in read(out)} == {r[0] for r in ROWS}
    only = docs.filter(F.col("source").isNull())
    assert {r["source"] for r in read(mx.schedule(only))} == {None}
