"""The index as tables: what it holds, when it is built anew, and that queries read no text."""

import random
from collections import Counter

from pyspark.sql import functions as F
from test_search import DOCS, built, table

from corpusloom.functions import text
from corpusloom.operators import index, ranking, store
from corpusloom.plans.kit import indexed, one_query
from corpusloom.sources.tables import corpus

SF = "/root/testdata/sf0.001"


def test_counts_inside_a_row_are_counts(spark):
    rng = random.Random(1)
    rows = [(k, rng.choices("abcde", k=rng.randrange(12))) for k in range(50)] + [(99, None)]
    got = index.counted(spark.createDataFrame(rows, "i int, t array<string>"), "t", "terms", "n").collect()
    for r in got:
        assert dict(zip(r["terms"] or [], r["n"] or [])) == dict(Counter(r["t"] or []))


def test_tables(spark):
    s = indexed(spark, SF)
    body = {(r["doc_id"], r["term"]): r["tf"] for r in index.postings(corpus(spark, SF)).collect()}
    assert {(r["doc_id"], r["term"]): r["tf_body"] for r in s.postings.filter("tf_body > 0").collect()} == body
    both = {(r["doc_id"], r["term"]): (r["tf_body"], r["tf_title"]) for r in index.both_fields(corpus(spark, SF)).collect()}
    assert {(r["doc_id"], r["term"]): (r["tf_body"], r["tf_title"]) for r in s.postings.collect()} == both
    vec = {(r["doc_id"], r["idx"]): round(r["v"], 9) for r in ranking.hashed(ranking.record_terms(corpus(spark, SF)), "doc_id").collect()}
    assert {(r["doc_id"], r["idx"]): round(r["v"], 9) for r in s.vectors.collect()} == vec
    assert s.count() == corpus(spark, SF).count()


def test_an_index_is_taken_while_it_fits(spark, tmp_path):
    path = str(tmp_path / "index")
    s = store.open_or_build(table(spark), path)
    first = spark.read.parquet(f"{path}/stats").inputFiles()
    assert store.open_or_build(table(spark), path).print == s.print and spark.read.parquet(f"{path}/stats").inputFiles() == first
    other = table(spark).withColumn("text", F.when(F.col("doc_id") == 2, "grape").otherwise(F.col("text")))
    changed = store.open_or_build(other, path)
    assert changed.print != s.print and changed.postings.filter("term = 'grape'").count() == 1
    store.open_or_build(other, path, rebuild=True)
    assert spark.read.parquet(f"{path}/stats").inputFiles() != first


def test_saved_pairs_change_no_score(spark, tmp_path):
    s = indexed(spark, SF)
    terms = ranking.query_terms(one_query(spark))
    score = lambda: {r["doc_id"]: round(r["sem"], 9) for r in ranking.gvsm(s, terms, least=20).collect()}
    plain = score()
    s.with_pairs(str(tmp_path / "pairs"), 20)
    assert s.pairs.count() > 0 and score() == plain
    one = spark.read.parquet(str(tmp_path / "pairs/head")).inputFiles()
    s.with_pairs(str(tmp_path / "pairs"), 20)
    assert spark.read.parquet(str(tmp_path / "pairs/head")).inputFiles() == one
    s.with_pairs(str(tmp_path / "pairs"), 30)
    assert s.pairs.agg(F.min("n")).first()[0] >= 30
    s.pairs = None


def test_a_search_reads_no_text(spark):
    s = built(spark)
    plan = ranking.search(s, one_query(spark, "apple cherry"), 10)._jdf.queryExecution().toString()
    assert "text" not in plan.replace("TextFileFormat", "") and "regexp_extract_all" not in plan


def test_lists_of_equal_length_are_ordered_without_gathering(spark):
    rng = random.Random(7)
    lists = {f"t{k}": sorted(rng.sample(range(9), rng.choice((2, 3, 3, 3)))) for k in range(14)}
    lists["same"] = lists["t3"]
    post = spark.createDataFrame([(d, t) for t, ds in lists.items() for d in ds], "doc_id long, term string")
    queries = spark.createDataFrame([(q, t) for q in (1, 2) for t in lists if q == 1 or rng.random() < 0.7], "query_id int, term string")
    got = {(r["query_id"], r["term"]): r["place"] for r in index.ranked_postings(post, queries).collect()}
    for q in (1, 2):
        mine = [r["term"] for r in queries.collect() if r["query_id"] == q]
        want = sorted(mine, key=lambda t: (len(lists[t]), lists[t], t))
        assert [got[q, t] for t in want] == list(range(1, len(want) + 1))


def test_nearest_fills_with_the_smallest_ids(spark):
    s = built(spark)
    q = ranking.hashed(one_query(spark, "fig date").select("query_id", text.tokenize("query").alias("terms")), "query_id")
    got = [r["doc_id"] for r in ranking.nearest(s, q, 4).orderBy("pos").collect()]
    every = [r["doc_id"] for r in ranking.nearest(s, q, 100).orderBy("pos").collect()]
    assert got == every[:4] and sorted(every) == [d[0] for d in DOCS if d[1] or d[2] or d[3]]


def test_blocks_of_postings(spark):
    post = spark.createDataFrame([(d, "a") for d in range(10)] + [(5, "b")], "doc_id long, term string")
    got = {(r["term"], r["block"]): r["doc_ids"] for r in index.block_postings(post, 4).collect()}
    assert got == {("a", 0): [0, 1, 2, 3], ("a", 1): [4, 5, 6, 7], ("a", 2): [8, 9], ("b", 1): [5]}


def test_rows_of_the_index_are_made_where_they_are(spark, tmp_path):
    """Vectors and norms were made by shuffles and windows of every posting, counts by lambdas."""
    s = store.build(table(spark), str(tmp_path / "index"))
    assert set(store.TABLES) == {"forward", "postings", "terms", "stats"} and not (tmp_path / "index/vectors").exists()
    rows = {r["doc_id"]: r for r in s.forward.collect()}
    assert dict(zip(rows[1]["terms"], zip(rows[1]["tf"], rows[1]["title_tf"]))) == {"apple": (2, 1), "banana": (1, 0)}
    assert dict(zip(rows[1]["more_terms"], rows[1]["more_tf"])) == {"pie": 1} and rows[3]["more_terms"] == ["cherry"]
    assert [(rows[k]["recorded"], rows[k]["filled"], rows[k]["dl"], rows[k]["top"]) for k in (1, 3, 5)] == [(True, True, 3, 2), (True, True, 0, 1), (False, False, 0, 1)]
    spaces = spark.createDataFrame([(1, " ", "\t\u2003", ""), (2, "", "  ", "http://x.org/apple"), (3, None, None, None), (4, "", "12", "")], "doc_id long, title string, text string, url string")
    got = {r["doc_id"]: r for r in store.build(spaces, str(tmp_path / "odd")).forward.collect()}
    assert [got[k]["filled"] for k in (1, 2, 3, 4)] == [False, True, False, True]
    want = {(r["doc_id"], r["idx"]): round(r["v"], 9) for r in ranking.hashed(ranking.record_terms(spaces), "doc_id").collect()}
    assert {(k, i): round(v, 9) for k, r in got.items() for i, v in zip(r["places"], r["values"])} == want and any(k == 2 for k, _ in want)
