"""The engine as an object, the command line, and files that it reads and writes."""

import json

from pyspark.sql import functions as F

from corpusloom.__main__ import main
from corpusloom.api import Engine
from corpusloom.operators import crawl, index, ranking
from corpusloom.plans.kit import indexed, one_query
from corpusloom.sources import tables

SF = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_defaults_are_the_operators(spark):
    c = tables.corpus(spark, SF)
    q = "tion ther thon"
    key = lambda df: [(r["doc_id"], round(r["score"], 9)) for r in rows(df.orderBy("rank"))]
    assert key(Engine(c).search(q)) == key(ranking.search(indexed(spark, SF), one_query(spark, q), 20))
    assert len(rows(Engine(c).search([q, "the house"], top_k=3).groupBy("query_id").count())) <= 2
    assert key(Engine(c, use_cosine=False, alpha=0.2).search(q)) != key(Engine(c).search(q))
    assert Engine(c).serve(q, 5).count() == 5


def test_answers(spark):
    e = Engine(tables.corpus(spark, SF))
    plain = rows(e.answer("tion ther thon"))[0]
    assert plain["answer"] and plain["sources"] and plain["sufficient"]
    said = rows(e.answer("tion ther thon", generator=lambda p: '{"sufficient": false}\nNothing known.'))[0]
    assert said["answer"] == "Nothing known." and said["sufficient"] is False

    def broken(prompt):
        raise OSError("down")

    assert rows(e.answer("tion ther thon", generator=broken))[0]["answer"] == plain["answer"]
    assert [str(c["doc_id"]) for c in plain["contexts"]] and {str(u["doc_id"]) for u in plain["used"]} == set(plain["sources"].split(",")) and plain["total_sources"] == len(plain["used"])
    assert {c["doc_id"] for c in plain["contexts"]} >= {u["doc_id"] for u in plain["used"]} and len(plain["contexts"]) == 5


def test_an_insufficient_answer_asks_the_outside_once(spark):
    c = tables.corpus(spark, SF)
    asked, top = [], c.agg(F.max("doc_id")).first()[0]

    def outside(query):
        asked.append(query)
        return spark.createDataFrame([("https://x.org/1", "Zyzzyva beetle", "The zyzzyva is a beetle.", 1)], "url string, title string, text string, web_rank int")

    say = lambda p: "Zyzzyva beetle it is." if "zyzzyva is a beetle" in p.lower() else '{"sufficient": false}\nNo.'
    got = rows(Engine(c).answer("zyzzyva beetle", generator=say, web=outside))[0]
    assert asked == ["zyzzyva beetle"] and got["web_search_used"] and got["answer"] == "Zyzzyva beetle it is."
    assert str(top + 1) in got["sources"].split(",") and top + 1 in {x["doc_id"] for x in got["contexts"]}
    assert not rows(Engine(c).answer("zyzzyva beetle", generator=lambda p: "Enough.", web=outside))[0]["web_search_used"] and len(asked) == 1


def test_service(spark):
    import threading
    from urllib.request import urlopen

    from corpusloom.serve import Service, page, server

    def outside(query):
        return spark.createDataFrame([("https://x.org/1", "Zyzzyva", "zyzzyva beetle", 1)], "url string, title string, text string, web_rank int")

    service = Service(Engine(tables.corpus(spark, SF)), outside)
    s = server(service, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_address[1]}"
    ask = lambda path: json.loads(urlopen(base + path).read())
    try:
        got = ask("/search?query=tion+ther+thon&top_k=x")
        assert got["total"] == len(got["results"]) == 40 and not got["web_search_used"] and got["local_results"] == 40
        assert set(got["results"][0]) == {"doc_id", "title", "snippet", "url", "file_type", "crawl_date", "domain", "score", "source_type"}
        assert ask("/search?query=") == {"query": "", "total": 0, "results": [], "web_search_used": False, "local_results": 0, "avg_local_score": 0.0}
        found = ask("/search?query=zyzzyva")  # nothing of one's own: the outside source is asked, and known from then on
        assert found["web_search_used"] and found["results"][0]["source_type"] == "web_search" and found["local_results"] == 0
        assert service.engine.records.filter("title = 'Zyzzyva'").count() == 1
        told = ask("/rag?query=tion+ther+thon")
        assert told["answer"] and told["total_sources"] == len(told["sources"]) and len(told["contexts"]) == 5
        with urlopen(base + "/") as r:
            assert r.headers["Access-Control-Allow-Origin"] == "*" and r.read().decode() == page() and "__" not in page()
    finally:
        s.shutdown()


def test_ingest_at_run_time(spark, tmp_path):
    from corpusloom.streaming.sync import ingest_stream

    c = tables.corpus(spark, SF)
    held = [Engine(c)]
    kind = "doc_id long, title string, text string, url string"
    spark.createDataFrame([(10**6, "Zyzzyva", "zyzzyva beetle", "https://x.org/z")], kind).write.parquet(str(tmp_path / "in"))

    def take(batch, number):
        held[0] = held[0].ingest(spark.createDataFrame(batch.collect(), batch.schema))

    ingest_stream(spark, str(tmp_path / "in"), kind, take, str(tmp_path / "state"))
    assert rows(held[0].search("zyzzyva"))[0]["doc_id"] == 10**6


def test_ingest(spark):
    c = tables.corpus(spark, SF)
    top = c.agg(F.max("doc_id")).first()[0]
    web = spark.createDataFrame([("https://x.org/1", "Zyzzyva", "zyzzyva beetle", 1), ("https://x.org/2", "Zyzzyva two", "another zyzzyva beetle", 2), ("https://x.org/3", "", "no title", 3)], "url string, title string, text string, page int")
    e = Engine(c).search_and_index(web, "page")
    got = rows(e.search("zyzzyva beetle", top_k=2))
    assert {r["doc_id"] for r in got} == {top + 1, top + 2}
    assert e.records.count() == c.count() + 2
    again = e.ingest(e.records.filter(F.col("doc_id") == top + 1).withColumn("text", F.lit("changed")))
    assert again.records.count() == c.count() + 2 and again.records.filter("text = 'changed'").count() == 1


def test_saved_index(spark, tmp_path):
    post = index.postings(tables.corpus(spark, SF))
    inverted = index.inverted_index(post)
    tables.write_index(inverted, str(tmp_path / "index"), 3)
    key = lambda df: sorted((r["term"], tuple(r["doc_ids"]), r["df"]) for r in df.collect())
    assert key(tables.read_index(spark, str(tmp_path / "index"))) == key(inverted)
    nodes = [
        {"is_end": False, "docs": [], "children": {"car": 1, "dog": 3}}, {"is_end": True, "docs": [2, 1, 2], "children": {"t": 2}},
        {"is_end": True, "docs": [3], "children": {}}, {"is_end": True, "docs": [5], "children": {}}]
    (tmp_path / "trie.json").write_text(json.dumps({"nodes": nodes, "root": 0, "count": 3, "doc_count": 5}))
    assert key(tables.read_index(spark, str(tmp_path / "trie.json"))) == [("car", (1, 2), 2), ("cart", (3,), 1), ("dog", (5,), 1)]
    pairs = ranking.pair_counts(post, 30)
    tables.write_pair_counts(pairs, str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == pairs.count()


def test_command_line(spark, tmp_path, capsys):
    out, report = str(tmp_path / "records"), str(tmp_path / "report")
    main(["crawl", "--pages", f"{SF}/pages.parquet", "--output", out, "--report", report, "--raw-dir", str(tmp_path / "raw")])
    want = crawl.crawl_records(spark.read.parquet(f"{SF}/pages.parquet"))
    got = tables.read_jsonl(spark, out)
    assert sorted(r["url"] for r in rows(got)) == sorted(r["url"] for r in rows(want))
    assert sorted(r["doc_id"] for r in rows(got)) == list(range(1, want.count() + 1))
    assert any(r["value"].startswith("written: ") for r in rows(spark.read.text(report)))
    assert spark.read.parquet(str(tmp_path / "raw")).count() == spark.read.parquet(f"{SF}/pages.parquet").count()
    main(["crawl", "--pages", f"{SF}/pages.parquet", "--output", out, "--only-new"])
    assert tables.read_jsonl(spark, out).count() == want.count()
    capsys.readouterr()
    main(["search", "--records", out, "--query", "data", "--top-k", "3"])
    main(["answer", "--records", "/nowhere", "--records", out, "--query", "data"])
    lines = capsys.readouterr().out.strip().splitlines()
    assert lines and "answer" in json.loads(lines[-1])
