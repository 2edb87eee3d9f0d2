"""The crawl over the snapshot of pages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.web import canonical_url, relevance, url_domain
from corpusloom.operators import crawl
from corpusloom.operators.common import first_per
from corpusloom.plans import sqlkit as k
from corpusloom.plans.kit import registry
from corpusloom.plans.sqlkit import sql
from corpusloom.sources.tables import corpus, table

QUERIES, SQL, query = registry()


def _pages(spark, d):
    return table(spark, d, "pages")


@query(sql("SELECT page_id, outcome FROM outcome", "outcome"))
def crawl_outcome_cascade(spark, d):
    return crawl.outcomes(_pages(spark, d)).select("page_id", "outcome")


@query(sql("SELECT page_id, canonical AS url, title, domain, language, CAST(length(text) AS INTEGER) AS n_chars, text_hash, relevance_score FROM outcome WHERE outcome = 'written'", "outcome"))
def crawl_records(spark, d):
    return crawl.crawl_records(_pages(spark, d)).drop("text")


@query(sql("SELECT outcome, count(*) AS n FROM outcome GROUP BY 1", "outcome"))
def crawl_report_stats(spark, d):
    return crawl.report_stats(_pages(spark, d))


@query(sql("SELECT domain, count(*) AS n FROM outcome WHERE outcome NOT IN ('bad_url','already_visited','domain_limit') GROUP BY 1", "outcome"))
def crawl_report_domains(spark, d):
    return crawl.report_domains(_pages(spark, d))


@query(f"SELECT page_id, {k.domain('url')} AS domain FROM pages QUALIFY row_number() OVER (PARTITION BY {k.domain('url')} ORDER BY page_id) <= 3")
def per_domain_limit(spark, d):
    rows = _pages(spark, d).select("page_id", url_domain("url").alias("domain"))
    return first_per(rows, ["domain"], [F.col("page_id")], 3)


@query(sql(f"SELECT doc_id, -greatest(0.1, {k.relevance('title', 'text', 'url')} / 2) AS priority FROM corpus", "corpus"))
def frontier_priority(spark, d):
    return corpus(spark, d).select("doc_id", crawl.frontier_priority(relevance("title", "text", "url")).alias("priority"))


_RULES = f"SELECT DISTINCT {k.domain('url')} AS domain, NOT starts_with({k.domain('url')}, 'blog') AS allowed FROM pages WHERE starts_with(url, 'https')"


def _rules(pages):
    """Rules as from robots files: sites that answer by https have some, and blogs don't allow."""
    return pages.filter("startswith(url, 'https')").select(url_domain("url").alias("domain")).distinct().withColumn("allowed", ~F.startswith("domain", F.lit("blog")))


@query(f"SELECT page_id, {k.domain('url')} AS domain FROM pages WHERE {k.domain('url')} IN (SELECT domain FROM ({_RULES}) WHERE allowed)")
def robots_filter(spark, d):
    """Pages of the domains whose rules allow; domains without rules aren't allowed."""
    pages = _pages(spark, d).select("page_id", "url")
    return crawl.robots_filter(pages, _rules(pages)).select("page_id", "domain")


_FETCHED = "CASE WHEN contains(e.url, 'page=') THEN 'fetch_errors' WHEN contains(e.url, '.html') THEN 'non_html' END"


@query(sql(f"SELECT page_id, outcome FROM ({k.cascade('ext2', old='u.canonical IN (SELECT canonical FROM ext2 WHERE html_language = ' + k.lit('es') + ')', may=f'u.site IN (SELECT domain FROM ({_RULES}) WHERE allowed)', fetched=_FETCHED, cap=9)})", "ext2"))
def crawl_cascade_full(spark, d):
    """Every reason: an earlier output of the Spanish pages, rules, a small cap, pages that weren't read or aren't HTML."""
    pages = _pages(spark, d)
    earlier = crawl.extracted(pages).filter("html_language = 'es'").select(F.col("canonical").alias("url"))
    status = F.when(F.contains("url", F.lit("page=")), "fetch_errors").when(F.contains("url", F.lit(".html")), "non_html")
    return crawl.outcomes(pages.withColumn("fetched", status), per_domain=9, existing=earlier, rules=_rules(pages)).select("page_id", "outcome")


@query(sql(f"SELECT DISTINCT link AS url FROM links WHERE link IS NOT NULL AND NOT regexp_matches({k.url_path('link')}, '{k.BINARY}') AND link NOT IN (SELECT {k.canonical('url')} FROM pages WHERE {k.canonical('url')} IS NOT NULL)", "links"))
def new_urls_antijoin(spark, d):
    """Links of all pages to URLs that no page has."""
    pages = _pages(spark, d)
    known = pages.select(canonical_url("url").alias("url")).filter("url IS NOT NULL")
    return crawl.clean_links(pages).select(F.col("link").alias("url")).distinct().join(known, "url", "left_anti")


_H = "sha256(coalesce(text,''))"


@query(f"SELECT doc_id, {_H} AS text_hash FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND {_H} NOT IN (SELECT {_H} FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))")
def new_text_antijoin(spark, d):
    """Documents that have no label and no text of one that has."""
    rows = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
    known = table(spark, d, "labels").select("doc_id").distinct()
    seen = rows.join(known, "doc_id", "left_semi").select("text_hash")
    return rows.join(known, "doc_id", "left_anti").join(seen, "text_hash", "left_anti").select("doc_id", "text_hash")


@query(sql("SELECT DISTINCT canonical AS url, text_hash FROM ext2 WHERE canonical IS NOT NULL", "ext2"))
def existing_output_keys(spark, d):
    return crawl.extracted(_pages(spark, d)).filter("canonical IS NOT NULL").select(F.col("canonical").alias("url"), "text_hash").distinct()


_NEXT = f"SELECT page_id, url, html, lead(url) OVER (PARTITION BY {k.domain('url')} ORDER BY page_id) AS next FROM pages"
_EDGES = f"""p AS ({_NEXT}),
e AS (SELECT DISTINCT {k.canonical('p.url')} AS src, link AS dst FROM links JOIN p USING (page_id) WHERE link IS NOT NULL AND NOT regexp_matches({k.url_path('link')}, '{k.BINARY}')
  UNION SELECT {k.canonical('url')}, {k.canonical('next')} FROM p WHERE next IS NOT NULL AND NOT regexp_matches({k.url_path('next')}, '{k.BINARY}')),
n AS (SELECT DISTINCT {k.canonical('url')} AS url FROM pages)"""


def linked_pages(spark, d):
    """The pages, each with one more link, to the next page of its site: the test pages themselves hardly link to each other."""
    after = F.lead("url").over(Window.partitionBy(url_domain("url")).orderBy("page_id"))
    return _pages(spark, d).withColumn("next", after).select("page_id", "url", F.when(F.col("next").isNull(), F.col("html")).otherwise(F.concat(F.lit('<a href="'), "next", F.lit('">next</a>'), "html")).alias("html"))


def first_pages(pages):
    """The first page of each site."""
    return pages.groupBy(url_domain("url").alias("domain")).agg(F.min_by("url", "page_id").alias("url")).select("url")


@query(sql(f"SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1", "links").replace("WITH links", "WITH RECURSIVE links").replace("\nSELECT url, CAST", f""",
{_EDGES},
s AS (SELECT {k.canonical("arg_min(url, page_id)")} AS url FROM pages GROUP BY {k.domain("url")}),
r(url, depth) AS (SELECT DISTINCT url, 0 FROM s UNION SELECT dst, depth + 1 FROM r JOIN e ON src = r.url JOIN n ON n.url = dst WHERE depth < 2)
SELECT url, CAST""", 1))
def crawl_bfs(spark, d):
    """Two levels from the first page of each site."""
    pages = linked_pages(spark, d)
    return crawl.bfs(pages, first_pages(pages)).select("url", "depth")


@query()
def crawl_run(spark, d):
    """A whole crawl from the first page of each site, with every filter, in the order of priorities."""
    pages = linked_pages(spark, d)
    out = crawl.crawl(crawl.snapshot(pages), first_pages(pages), max_pages=1 << 30, per_domain=4, rules=_rules(pages))
    return out.select("url", "depth", "priority", "parent_url", "outcome", "relevance_score", F.size("out_links").alias("n_links"))
