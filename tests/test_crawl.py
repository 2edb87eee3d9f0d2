"""The crawl against a page-by-page model, page extraction over whole tables, and fetching from a local server."""

import hashlib
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import web
from corpusloom.functions.constants import BINARY_SUFFIXES, TOPIC_KEYWORDS
from corpusloom.operators import crawl
from corpusloom.plans.crawling import _rules, first_pages, linked_pages
from corpusloom.sources import fetch, tables
from corpusloom.sources.settings import read_env

SF = "/root/testdata/sf0.001"


def canonical(spark, urls):
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", web.canonical_url("u").alias("c"))
    return {r["u"]: r["c"] for r in df.collect()}


def model(pages, seeds, canon, depth_limit=2, max_pages=10**9, chars=300, cap=120, rules=None, existing=(), hashes=()):
    """One page after the other, level by level, in plain Python."""
    html = {}
    for p in sorted(pages, key=lambda p: p["page_id"], reverse=True):
        html[canon[p["url"]]] = p["html"]
    frontier = {canon[u]: (-5.0, None) for u in seeds}
    done, counts, texts, written = {}, {}, set(hashes), 0
    for depth in range(depth_limit + 1):
        following = {}
        for url, (priority, parent) in sorted(frontier.items(), key=lambda x: (x[1][0], x[0])):
            if written >= max_pages:
                return done
            host = url.split("/")[2].lower()
            rel, n = None, None
            if url in existing:
                out = "already_in_output"
            elif counts.get(host, 0) >= cap:
                out = "domain_limit"
            elif rules is not None and not rules.get(host, False):
                out = "blocked_by_robots"
            else:
                counts[host] = counts.get(host, 0) + 1
                page = web.parse_page(html[url]) if url in html else None
                key = hashlib.sha256(page["text"].encode()).hexdigest() if page else None
                if page is None:
                    out = "fetch_errors"
                elif len(page["text"]) < chars:
                    out = "too_short"
                elif key in texts:
                    out = "duplicate_text"
                else:
                    texts.add(key)
                    blob = (page["title"] + " " + page["text"][:5000] + " " + url).lower()
                    rel = float(sum(k in blob for k in TOPIC_KEYWORDS))
                    out = "written" if rel > 0 else "low_relevance"
                    if out == "written":
                        written += 1
                        links = [canon.get(urljoin(url, x)) for x in page["links"]]
                        links = [x for x in links if x and not x.lower().endswith(tuple("." + b for b in BINARY_SUFFIXES))]
                        n = len(links)
                        for x in links:
                            if depth < depth_limit and x not in frontier and x not in done and x not in following:
                                following[x] = (-max(0.1, rel / 2), url)
            done[url] = (depth, priority, parent, out, rel if out == "written" else None, n)
        frontier = following
    return done


@pytest.mark.parametrize("limits", [{}, {"cap": 2}, {"max_pages": 3}, {"rules": True, "cap": 3}])
def test_crawl_is_the_page_by_page_model(spark, limits):
    pages = linked_pages(spark, SF)
    rows = [r.asDict() for r in pages.collect()]
    seeds = [r["url"] for r in first_pages(pages).collect()]
    links = {urljoin(c, x) for r in rows for c in [r["url"].strip()] for x in web.parse_page(r["html"])["links"]}
    canon = canonical(spark, {r["url"] for r in rows})
    canon |= canonical(spark, links | {urljoin(c, x) for r in rows for c in [canon[r["url"]]] if c for x in web.parse_page(r["html"])["links"]})
    rules = {r["domain"]: r["allowed"] for r in _rules(pages).collect()} if limits.get("rules") else None
    want = model(rows, seeds, canon, cap=limits.get("cap", 120), max_pages=limits.get("max_pages", 10**9), rules=rules)
    got = crawl.crawl(crawl.snapshot(pages), first_pages(pages), max_pages=limits.get("max_pages", 10**9), per_domain=limits.get("cap", 120), rules=_rules(pages) if rules else None)
    mine = {r["url"]: (r["depth"], r["priority"], r["parent_url"], r["outcome"], r["relevance_score"] if r["outcome"] == "written" else None, len(r["out_links"]) if r["out_links"] is not None else (0 if r["outcome"] == "written" else None)) for r in got.collect()}
    assert mine == want
    assert limits or any(v[3] == "written" and v[0] > 0 for v in want.values())


def test_cascade_with_an_earlier_output(spark):
    rows = [(1, "https://a.com/1", "x"), (2, "https://a.com/1#again", "x"), (3, "https://a.com/2", "x"), (4, "ftp://a.com/3", "x"), (5, "https://b.com/1", "y"), (6, "https://c.com/1", "z"), (7, "https://c.com/1?q", "z"), (8, "https://a.com/4", "short")]
    body = {"x": "python data " * 40, "y": "software code " * 40, "z": "nothing of note " * 40, "short": "python"}
    pages = spark.createDataFrame([(i, u, f"<title>t</title><p>{body[k]}</p>") for i, u, k in rows], "page_id long, url string, html string")
    run = lambda **o: {r["page_id"]: r["outcome"] for r in crawl.outcomes(pages, **o).collect()}
    assert run() == {1: "written", 2: "already_visited", 3: "duplicate_text", 4: "bad_url", 5: "written", 6: "low_relevance", 7: "already_visited", 8: "too_short"}
    old = spark.createDataFrame([("https://a.com/1",)], "url string")
    assert run(existing=old) == {1: "already_in_output", 2: "already_in_output", 3: "written", 4: "bad_url", 5: "written", 6: "low_relevance", 7: "already_visited", 8: "too_short"}
    known = pages.filter("page_id = 5").select(F.sha2(web.html_text("html"), 256).alias("text_hash"))
    assert run(hashes=known)[5] == "duplicate_text" and run(per_domain=1)[3] == "domain_limit"
    rules = spark.createDataFrame([("a.com", True), ("b.com", False)], "domain string, allowed boolean")
    got = run(rules=rules)
    assert got[1] == "written" and got[5] == got[6] == got[7] == "blocked_by_robots"
    read = pages.withColumn("fetched", F.when(F.col("page_id") == 1, "fetch_errors").when(F.col("page_id") == 5, "non_html"))
    got = {r["page_id"]: r["outcome"] for r in crawl.outcomes(read).collect()}
    assert got[1] == "fetch_errors" and got[3] == "written" and got[5] == "non_html"
    assert crawl.outcomes(pages.limit(0)).count() == 0


class Site(BaseHTTPRequestHandler):
    text = "python data software " * 30
    pages = {"/": f"<a href='/two'>2</a><a href='/x.zip'>z</a><p>{text} one</p>", "/two": f"<a href='/json'>j</a><p>{text} two</p>"}

    def do_GET(self):
        self.server.agents.append(self.headers["User-Agent"])
        if self.path == "/json":
            body, kind = b"{}", "application/json"
        elif self.path in self.pages:
            body, kind = self.pages[self.path].encode("latin-1") + b"caf\xe9", "text/html; charset=latin-1"
        else:
            return self.send_error(404)
        self.send_response(200)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Language", "en")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def site():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    s.agents = []
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def test_pages_from_a_server(spark, site, tmp_path):
    base = f"http://127.0.0.1:{site.server_address[1]}"
    spark.dataSource.register(fetch.Pages)
    urls = [f"{base}/", f"{base}/json", f"{base}/none", "http://127.0.0.1:9/x", "no url"]
    got = {r["url"]: r for r in spark.read.format("loom_pages").option("urls", json.dumps(urls)).option("delay", "0.01").option("user_agent", "me").load().collect()}
    assert [got[u]["fetched"] for u in urls] == [None, "non_html", "fetch_errors", "fetch_errors", "fetch_errors"]
    assert got[urls[0]]["html"].endswith("café") and got[urls[0]]["header_language"] == "en" and set(site.agents) == {"me"}
    seeds = spark.createDataFrame([(base,)], "url string")
    raw = []
    out = {r["url"]: r["outcome"] for r in crawl.crawl(fetch.fetcher(5, 0.01), seeds, raw=lambda df: raw.extend(df.collect())).collect()}
    assert out == {f"{base}/": "written", f"{base}/two": "written", f"{base}/json": "non_html"} and len(raw) == 2
    (tmp_path / "seeds").write_text(f"# mine\n{base}/\n")
    from corpusloom.__main__ import main

    main(["crawl", "--seeds-file", str(tmp_path / "seeds"), "--output", str(tmp_path / "out"), "--max-pages", "1", "--delay", "0", "--save-raw", "--log-level", "warning"])
    rows = tables.read_jsonl(spark, str(tmp_path / "out")).collect()
    assert [r["url"] for r in rows] == [f"{base}/"] and rows[0]["out_links"] == [f"{base}/two"] and rows[0]["depth"] == 0
    assert spark.read.parquet(str(tmp_path / "out.raw")).count() == 1


def test_a_domain_is_asked_after_a_pause(monkeypatch):
    now, slept = [0.0], []
    monkeypatch.setattr(fetch.time, "monotonic", lambda: now[0])
    monkeypatch.setattr(fetch.time, "sleep", lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    pause = fetch.Pause(2.0)
    for u in ("http://a/1", "http://b/1", "http://a/2", "http://A/3"):
        pause.before(u)
    assert slept == [2.0, 2.0]


def test_settings_and_paths(spark, tmp_path):
    (tmp_path / "env").write_text("# c\n\nA=1\nB = x=y \nbad\n")
    there = {"A": "old"}
    assert read_env(str(tmp_path / "env"), there) == {"A": "1", "B": "x=y"} and there == {"A": "old", "B": "x=y"}
    assert read_env(str(tmp_path / "none")) == {}
    assert tables.first_existing(spark, [str(tmp_path / "none"), str(tmp_path / "env")]) == str(tmp_path / "env")
    with pytest.raises(FileNotFoundError):
        tables.first_existing(spark, [str(tmp_path / "none")])
    lines = ['{"doc_id": 1, "url": "https://a.com/x#y", "text": "t"}', "{oops", "", '{"doc_id": 2, "url": "ftp://z", "text": ""}']
    (tmp_path / "out").write_text("\n".join(lines))
    urls, hashes, malformed = tables.scan_output(spark, str(tmp_path / "out"))
    assert [r[0] for r in urls.collect()] == ["https://a.com/x"] and [r[0] for r in hashes.collect()] == [hashlib.sha256(b"t").hexdigest()] and malformed == 1


def test_cooc_files(spark, tmp_path):
    new = {"terms": ["b", "a"], "cooc_rows": [0], "cooc_cols": [1], "cooc_data": [4], "cooc_shape": [2, 2], "df": {"a": 5, "b": 4}, "total_docs": 9, "min_cooc": 3}
    (tmp_path / "new").write_text(json.dumps(new))
    pairs, df, head = tables.read_cooc(spark, str(tmp_path / "new"))
    assert [tuple(r) for r in pairs.collect()] == [("a", "b", 4)] and {tuple(r) for r in df.collect()} == {("a", 5), ("b", 4)} and head == {"total_docs": 9, "min_cooc": 3}
    tables.write_cooc(pairs, df, 9, 3, str(tmp_path / "saved"))
    p, d, h = tables.open_cooc(spark, str(tmp_path / "saved"))
    assert (p.collect(), sorted(d.collect()), h) == (pairs.collect(), sorted(df.collect()), head)
    (tmp_path / "far").write_text(json.dumps({**new, "cooc_cols": [7]}))
    with pytest.raises(ValueError):
        tables.read_cooc(spark, str(tmp_path / "far"))
    (tmp_path / "odd").write_text(json.dumps({**new, "cooc_data": [4, 5], "cooc": {"a": {"b": 2}}}))
    assert [tuple(r) for r in tables.read_cooc(spark, str(tmp_path / "odd"))[0].collect()] == [("a", "b", 2)]
