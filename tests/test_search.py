"""Search against a small model in plain Python, and properties of the operators."""

import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.functions.constants import STOP
from corpusloom.operators import index, rag, ranking, serving, store
from corpusloom.plans.kit import one_query
from corpusloom.sources.tables import corpus

SF = "/root/testdata/sf0.001"
DOCS = [
    (1, "apple pie", "apple banana apple", "https://a.com/1"), (2, "", "banana cherry banana.", "https://a.com/2"), (3, "cherry", "", "https://apple.com/3"),
    (4, "x", "apple cherry date", "https://a.com/4"), (5, "", "", ""), (6, "fig", "apple banana cherry date fig", "https://a.com/6"),
]


def table(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, title string, text string, url string")
    return df.withColumn("domain", F.lit("a.com")).withColumn("source_type", F.lit("webpage"))


_BUILT = {}


def built(spark):
    """The index of the small table, made once."""
    if spark not in _BUILT:
        _BUILT[spark] = store.build(table(spark))
    return _BUILT[spark]


def words(s):
    return [w.strip(".") for w in s.lower().split() if len(w.strip(".")) > 2 and w.strip(".") not in STOP["en"]]


def test_bm25(spark):
    q = ["apple", "cherry", "apple"]
    body, head = {d[0]: Counter(words(d[2])) for d in DOCS}, {d[0]: Counter(words(d[1])) for d in DOCS}
    n, avg = len(DOCS), sum(sum(c.values()) for c in body.values()) / len(DOCS)
    want = {}
    for i in body:
        s = 0.0
        for t in q:
            df = sum(t in body[k] or t in head[k] for k in body)
            f = body[i][t] + 2.0 * head[i][t]
            s += math.log((n - df + 0.5) / (df + 0.5) + 1) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sum(body[i].values()) / avg)) if f else 0
        if s:
            want[i] = round(s, 9)
    terms = ranking.query_terms(one_query(spark, " ".join(q)))
    assert {r["doc_id"]: round(r["lex"], 9) for r in ranking.bm25(built(spark), terms).collect()} == want


def test_gvsm_without_correlations_is_cosine(spark):
    post = index.postings(table(spark))
    terms = ranking.query_terms(one_query(spark, "apple date"))
    w = {(r["doc_id"], r["term"]): r["w"] for r in ranking.document_weights(post).collect()}
    q = {r["term"]: r["w"] for r in ranking.query_weights(post, terms).collect()}
    got = {r["doc_id"]: r["sem"] for r in ranking.gvsm(built(spark), terms, least=99).collect()}
    for d in {k[0] for k in w}:
        mine = {t: v for (i, t), v in w.items() if i == d}
        dot = sum(q.get(t, 0) * v for t, v in mine.items())
        if dot:
            cos = dot / math.sqrt(sum(v * v for v in q.values())) / math.sqrt(sum(v * v for v in mine.values()))
            assert abs(got[d] - cos) < 1e-9


def test_pruned_pairs_are_all_pairs(spark):
    post = index.postings(corpus(spark, SF))
    kept = {(r[0], r[1]): r[2] for r in ranking.pair_counts(post, 30).collect()}
    docs = {}
    for r in post.collect():
        docs.setdefault(r["doc_id"], []).append(r["term"])
    often = Counter(t for ts in docs.values() for t in ts)
    every = Counter((a, b) for ts in docs.values() for a in ts for b in ts if a < b and often[a] >= 20 and often[b] >= 20)
    assert kept == {k: n for k, n in every.items() if n >= 30}


def test_correlations_are_bounded(spark):
    post = index.postings(corpus(spark, SF))
    for method in ("cosine", "jaccard", "dice"):
        low, high = ranking.term_correlations(post, method, 20).agg(F.min("r"), F.max("r")).first()
        assert 0 < low <= high <= 1 + 1e-9


def test_hashing(spark):
    idx, sign = ranking.bucket_of(F.col("t"))
    for r in spark.createDataFrame([("apple",), ("ñu",), ("thon",)], "t string").select("t", idx.alias("i"), sign.alias("s")).collect():
        h = hashlib.sha1(r["t"].encode()).digest()
        assert (r["i"], r["s"]) == (int.from_bytes(h[:4], "little") % 384, 1 if h[4] & 1 else -1)


def test_search(spark):
    none = ranking.search(built(spark), one_query(spark, "zzzz"), 5).collect()
    assert none == []  # one unknown token keeps no vector hit
    got = ranking.search(built(spark), one_query(spark, "apple cherry"), 10).collect()
    assert [r["doc_id"] for r in got][:1] and 5 not in {r["doc_id"] for r in got}
    assert all(-1e-9 <= r["score"] <= 1 + 1e-9 for r in got)
    lexical = ranking.search(built(spark), one_query(spark, "apple cherry"), 10, vectors=False).collect()
    assert {r["doc_id"] for r in lexical} == {4, 6} and all(r["score"] <= 0.25 + 1e-9 for r in lexical)
    single = ranking.search(built(spark), one_query(spark, "apple"), 10).collect()
    assert {r["doc_id"] for r in single} == {1, 3, 4, 6}


def test_batch_is_one_by_one(spark):
    both = spark.createDataFrame([(1, "apple cherry"), (2, "banana fig")], "query_id int, query string")
    rows = lambda df: [(r["doc_id"], round(r["score"], 9)) for r in df.orderBy("rank").collect()]
    batch = ranking.search(built(spark), both, 10)
    for k, text in ((1, "apple cherry"), (2, "banana fig")):
        assert rows(batch.filter(F.col("query_id") == k)) == rows(ranking.search(built(spark), one_query(spark, text), 10))


def test_gate(spark):
    gate = lambda n, s, **o: serving.fallback_gate(spark.createDataFrame([(i, s) for i in range(n)], "doc_id int, score double"), **o).first()["triggered"]
    assert [gate(4, 0.29), gate(5, 0.29), gate(4, 0.30), gate(0, 0.0), gate(4, 0.29, only_fallback=False)] == [True, False, False, True, False]


def test_answer(spark):
    docs = spark.createDataFrame([(1, 1, 0.9, "Apples are red. Nothing here.\nMore apples."), (2, 2, 0.5, "Apples are red. Pears.")], "doc_id long, rank int, score double, text string")
    got = rag.answer(docs, "apples").first()
    assert got["answer"] == "More apples. Apples are red." or got["answer"] == "Apples are red. More apples."
    assert rag.answer(docs, "kiwi").first()["answer"].startswith("Apples are red. Nothing")
    assert rag.answer(docs, "apples", chars=5).first()["n_sentences"] == 0
    assert rag.answer(docs.limit(0), "apples").first()["answer"] == ""
    assert "kiwi" in rag.prompts(docs.withColumn("title", F.lit("t")).withColumn("url", F.lit("u")), "kiwi").first()["prompt"]


def test_merge(spark):
    kind = "doc_id long, title string, text string, url string, source_type string, score double, source_rank long"
    a = spark.createDataFrame([(1, "l", "", "", "webpage", 0.2, 3), (2, "l2", "", "", "webpage", 0.9, 0)], kind)
    b = spark.createDataFrame([(1, "w", "", "", "web_search", 0.8, 5)], kind)
    got = {r["doc_id"]: (r["title"], r["score"], r["source_rank"]) for r in serving.merge_results(a, b).collect()}
    assert got == {1: ("w", 0.8, 3), 2: ("l2", 0.9, 0)}


def test_stream_reads_only_what_is_new(spark, tmp_path):
    from corpusloom.streaming.sync import compact, read_postings, sync_postings

    schema = "doc_id long, text string"
    add = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: sync_postings(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "state"))
    add([(1, "apple apple pear")])
    run()
    add([(2, "pear")])
    run()
    got = lambda path="out": sorted((r["doc_id"], r["term"], r["tf"]) for r in read_postings(spark, str(tmp_path / path)).collect())
    assert got() == [(1, "apple", 2), (1, "pear", 1), (2, "pear", 1)]
    add([(1, "pear plum"), (2, "")])  # what comes again replaces its postings
    run()
    assert got() == [(1, "pear", 1), (1, "plum", 1)]
    compact(spark, str(tmp_path / "out"), str(tmp_path / "one"))
    assert got("one") == got()
