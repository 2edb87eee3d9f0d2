"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text, web
from corpusloom.operators import crawl
from corpusloom.plans import sqlkit as k
from corpusloom.plans.kit import registry
from corpusloom.plans.sqlkit import sql
from corpusloom.sources.tables import corpus, table

QUERIES, SQL, query = registry()


@query(f"SELECT page_id, {k.canonical('url')} AS canonical FROM pages")
def canonicalize_url(spark, d):
    return table(spark, d, "pages").select("page_id", web.canonical_url("url").alias("canonical"))


@query(f"SELECT page_id, {k.domain('url')} AS domain FROM pages")
def url_domain(spark, d):
    return table(spark, d, "pages").select("page_id", web.url_domain("url").alias("domain"))


@query(f"SELECT doc_id, {k.lang_code('upper(lang) || CASE WHEN doc_id % 2 = 0 THEN chr(95) || chr(85) || chr(83) ELSE chr(32) END')} AS code FROM documents")
def normalize_language(spark, d):
    raw = F.concat(F.upper("lang"), F.when(F.col("doc_id") % 2 == 0, F.lit("_US")).otherwise(F.lit(" ")))
    return table(spark, d, "documents").select("doc_id", web.normalize_language(raw).alias("code"))


@query(f"SELECT page_id, {k.lang_url('url')} AS language FROM pages")
def language_from_url(spark, d):
    return table(spark, d, "pages").select("page_id", web.language_from_url("url").alias("language"))


@query(f"SELECT doc_id, {k.lang_text('text')} AS language FROM documents")
def language_from_text(spark, d):
    return table(spark, d, "documents").select("doc_id", web.language_from_text("text").alias("language"))


@query(sql("SELECT page_id, language FROM ext2", "ext2"))
def detect_language(spark, d):
    return crawl.extracted(table(spark, d, "pages")).select("page_id", "language")


@query(sql(f"SELECT doc_id, {k.relevance('title', 'text', 'url')} AS score FROM corpus", "corpus"))
def relevance_score(spark, d):
    return corpus(spark, d).select("doc_id", web.relevance("title", "text", "url").alias("score"))


@query(sql(f"SELECT doc_id, {k.relevance('title', 'text', 'url')} AS score FROM corpus WHERE {k.relevance('title', 'text', 'url')} > 0", "corpus"))
def relevance_filter(spark, d):
    return corpus(spark, d).select("doc_id", web.relevance("title", "text", "url").alias("score")).filter("score > 0")


_TYPED = "url || CASE doc_id % 6 WHEN 0 THEN '.PDF' WHEN 1 THEN '/a.jpeg' WHEN 2 THEN '/v.mp4?x=1' WHEN 3 THEN '/d.pdf?p=2' ELSE '' END"


@query(sql(f"SELECT doc_id, {k.file_type(_TYPED, 'source_type')} AS file_type FROM corpus", "corpus"))
def guess_file_type(spark, d):
    url = F.expr(f"concat(url, {_TYPED.removeprefix('url || ')})")
    return corpus(spark, d).select("doc_id", web.file_type(url, F.col("source_type")).alias("file_type"))


@query("SELECT doc_id, sha256(coalesce(text,'')) AS text_hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))


@query("SELECT page_id, 'web_' || substr(sha256(url),1,16) AS hash_id FROM pages")
def hash_doc_id(spark, d):
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("web_"), F.substring(F.sha2("url", 256), 1, 16)).alias("hash_id"))


@query("SELECT page_id, substr(sha256(url),1,16) AS key FROM pages")
def raw_page_key(spark, d):
    return table(spark, d, "pages").select("page_id", F.substring(F.sha2("url", 256), 1, 16).alias("key"))


@query("SELECT doc_id, CAST(length(coalesce(text,'')) AS BIGINT) AS n FROM documents WHERE length(coalesce(text,'')) >= 300")
def min_chars_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n")).filter("n >= 300")


@query(f"SELECT doc_id, {k.strip('substr(replace(coalesce(text,chr(32)),chr(10),chr(32)),1,320)')} AS snippet FROM documents")
def api_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", text.api_snippet("text").alias("snippet"))


_COMPACT = k.compact("coalesce(text,chr(32))")


@query(f"SELECT doc_id, {k.strip(f'substr({_COMPACT},1,320)')} AS snippet FROM documents")
def rag_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", text.rag_snippet("text").alias("snippet"))


_BARE = k.compact("regexp_replace(html, '<[^>]+>', ' ', 'g')")


@query(f"SELECT page_id, {_BARE} AS text FROM pages")
def strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", text.strip_tags("html").alias("text"))


_C = "substr(text,1,400)"
_A = "substr(text,1,1200)"


@query(sql(f"SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE {k.strip(f'CASE WHEN {k.last_at(_C, chr(32))} > 280 THEN substr({_C},1,{k.last_at(_C, chr(32))}) ELSE {_C} END')} END AS cut FROM corpus", "corpus"))
def truncate_budget(spark, d):
    return corpus(spark, d).select("doc_id", text.truncate_budget("text", 400).alias("cut"))


def _cut(mark):
    at = k.last_at(_A, mark)
    return f"WHEN {at} > 960 THEN {k.strip(f'substr({_A},1,{at}+1)')} "


@query(sql(f"SELECT doc_id, CASE WHEN length(text) <= 1200 THEN text {_cut('. ')}{_cut('! ')}{_cut('? ')}WHEN {k.last_at(_A, ' ')} > 960 THEN {k.strip(f'substr({_A},1,{k.last_at(_A, chr(32))})')} || '...' ELSE {k.strip(_A)} || '...' END AS cut FROM corpus", "corpus"))
def truncate_answer(spark, d):
    return corpus(spark, d).select("doc_id", text.truncate_answer("text", 1200).alias("cut"))


_LINE = "CASE doc_id % 4 WHEN 0 THEN '{\"sufficient\": false}' || chr(10) || chr(10) || title WHEN 1 THEN '{\"sufficient\": true}' || chr(10) || title WHEN 2 THEN '{not json}' || chr(10) || title ELSE title END"


@query(sql("SELECT doc_id, doc_id % 4 <> 0 AS sufficient, CASE doc_id % 4 WHEN 0 THEN " + f"regexp_replace(title, '^{text.SPACE}+', '')" + " WHEN 1 THEN " + f"regexp_replace(title, '^{text.SPACE}+', '')" + " WHEN 2 THEN '{not json}' || chr(10) || title ELSE title END AS answer FROM corpus", "corpus"))
def parse_sufficient(spark, d):
    rows = corpus(spark, d).select("doc_id", F.expr(_LINE).alias("raw"))
    return rows.select("doc_id", text.sufficient("raw").alias("sufficient"), text.without_marker("raw").alias("answer"))


@query(sql(f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n, array_to_string(s, '|') AS sentences FROM (SELECT doc_id, {k.sentences('text')} AS s FROM corpus)", "corpus"))
def split_sentences(spark, d):
    return corpus(spark, d).select("doc_id", text.split_sentences("text").alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.array_join("s", "|").alias("sentences"))


@query(f"SELECT page_id, {k.strip(f'''regexp_extract(html, {k.lit('(?is)<title[^>]*>(.*?)</title>')}, 1)''')} AS title FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", web.html_title("html").alias("title"))


@query(sql("SELECT page_id, html_language FROM ext", "ext"))
def html_lang(spark, d):
    return table(spark, d, "pages").select("page_id", web.html_language("html").alias("html_language"))


@query("SELECT page_id, CAST(len(l) AS BIGINT) AS n, array_to_string(l, ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*href=[\"'']([^\"'']*)[\"'']', 1) AS l FROM pages)")
def html_links(spark, d):
    return table(spark, d, "pages").select("page_id", web.html_links("html").alias("l")).select("page_id", F.size("l").cast("long").alias("n"), F.array_join("l", " ").alias("links"))


# the end of a page that was cut: a started tag goes, and so does the text behind the last tag if an entity is cut in it
_WHOLE = "regexp_replace(regexp_replace(html, '<[^>]*$', ''), '>[^<>]*&[^\\s;<>]{0,33}$', '>')"
_BARE = _WHOLE
for _t in ("script", "style", "noscript", "svg"):
    _BARE = f"regexp_replace({_BARE}, '(?is)<{_t}[^>]*>.*?(</{_t}>|$)', ' ', 'g')"


def _opened(x: str) -> str:
    """Entities of the test pages."""
    for name, c in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, {k.lit(name)}, {k.lit(c)})"
    return x


_TITLE = f"regexp_extract({_WHOLE}, '(?is)<title[^>]*>(.*?)(</title>|$)', 1)"


@query(f"""SELECT page_id, {k.strip(_opened(_TITLE))} AS title, {k.strip(_opened(k.compact(_opened(f"regexp_replace({_BARE}, '<[^>]+>', ' ', 'g')")))) } AS text,
array_to_string(list_filter(list_transform(regexp_extract_all({_WHOLE}, {k.lit(k.HREF)}, 1), lambda x: {k.strip('x')}), lambda x: x <> ''), ' ') AS links,
nullif(regexp_extract(lower(regexp_extract(html, '(?is)<html[^>]*\\slang=["'']([^"'']*)["'']', 1)), '^[a-z]{{2,3}}'), '') AS html_language FROM pages""")
def html_extract(spark, d):
    return crawl.parsed(table(spark, d, "pages")).withColumn("links", F.array_join("links", " "))


@query(sql(f"SELECT page_id, CAST(pos AS INTEGER) AS pos, link FROM links WHERE link IS NOT NULL AND NOT regexp_matches({k.url_path('link')}, '{k.BINARY}')", "links"))
def clean_links(spark, d):
    return crawl.clean_links(table(spark, d, "pages"))


_BIN = "url || CASE page_id % 3 WHEN 0 THEN '/f.ZIP' WHEN 1 THEN '/f.docx' ELSE '/f' END"


@query(f"SELECT page_id FROM (SELECT page_id, {_BIN} AS u FROM pages WHERE NOT contains(url, '?') AND NOT contains(url, '#')) WHERE NOT regexp_matches({k.url_path('u')}, '{k.BINARY}')")
def binary_link_filter(spark, d):
    plain = table(spark, d, "pages").filter("NOT contains(url, '?') AND NOT contains(url, '#')")
    return plain.filter(~web.is_binary(F.expr(f"concat(url, {_BIN.removeprefix('url || ')})"))).select("page_id")


@query(f"SELECT page_id, array_to_string(list_distinct_ordered, ' ') AS urls FROM (SELECT page_id, list(u ORDER BY pos) AS list_distinct_ordered FROM (SELECT page_id, u, min(pos) AS pos FROM (SELECT page_id, {k.canonical('x')} AS u, pos FROM (SELECT page_id, regexp_replace(unnest(l), '[.,;:)]+$', '') AS x, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, 'https?://[^\\s<>\"{{}}|\\\\^`\\[\\]]*') AS l FROM pages)) WHERE length(x) > 10) WHERE u IS NOT NULL AND NOT contains(u, 'duckduckgo.com') AND NOT ends_with(u, 'xhtml1-transitional.dtd') AND NOT ends_with(u, '/1999/xhtml') GROUP BY 1, 2) GROUP BY 1)")
def serp_url_extract(spark, d):
    return crawl.serp_urls(table(spark, d, "pages")).filter(F.size("urls") > 0).select("page_id", F.array_join("urls", " ").alias("urls"))


@query(f"SELECT page_id, {k.canonical('url')} AS urls FROM pages WHERE {k.canonical('url')} IS NOT NULL")
def serp_marked_urls(spark, d):
    """Result pages with anchors, wrapped addresses and shown ones, all of the page's own URL, and noise."""
    wrapped = F.concat(F.lit('<a class="x result__a" href="//duckduckgo.com/l/?uddg='), F.url_encode("url"), F.lit('&rut=1">r</a><a rel="n" href=\''), "url", F.lit("' class='result__a'>r</a>"))
    shown = F.concat(F.lit('<span class="result__url" id="u"> '), "url", F.lit(' </span><a class="result__a" href="https://duckduckgo.com/y.js">ad</a>'))
    return crawl.serp_urls(table(spark, d, "pages").withColumn("html", F.concat(wrapped, shown, "html"))).select("page_id", F.array_join("urls", " ").alias("urls")).filter("urls <> ''")


@query("SELECT page_id, CAST(len(list_filter(range(1, 1 + least(length(a), length(b))), lambda i: substr(a, 1, i) = substr(b, 1, i))) AS INTEGER) AS n FROM (SELECT page_id, url AS a, min(url) OVER () AS b FROM pages)")
def common_prefix(spark, d):
    """Of each URL and the smallest one."""
    pages = table(spark, d, "pages")
    return pages.join(F.broadcast(pages.agg(F.min("url").alias("b")))).select("page_id", web.common_prefix("url", "b").alias("n"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'en' ELSE 'es' END AS ui, 'https://html.duckduckgo.com/html/?q=' || replace(url_encode(source || ' ' || lang), '%20', '+') || '&kl=us-en' AS q, CAST(substr('2024-01-02T03:04:05Z', 1, 10) AS VARCHAR) AS day FROM documents")
def ui_values(spark, d):
    rows = table(spark, d, "documents")
    return rows.select("doc_id", web.ui_language("lang").alias("ui"), web.query_url(F.concat("source", F.lit(" "), "lang")).alias("q"), web.date_part(F.lit("2024-01-02T03:04:05Z")).alias("day"))
