"""Scans, tokens, the inverted index and its lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import tokenize
from corpusloom.operators import index, ranking
from corpusloom.operators.common import first_per, with_rank
from corpusloom.operators.serving import nonempty
from corpusloom.plans.kit import one_query, registry
from corpusloom.plans.sqlkit import Q3, sql, strip, tok
from corpusloom.sources.tables import corpus, parse_doc_id, parse_records, table
from corpusloom.streaming.sync import new_documents

QUERIES, SQL, query = registry()

_RAW_ID = "CASE WHEN doc_id % 7 = 0 THEN 'web_' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) WHEN doc_id % 5 = 0 THEN ' ' || doc_id WHEN doc_id % 11 = 0 THEN doc_id || '.7' ELSE CAST(doc_id AS VARCHAR) END"


def raw_id():
    d = F.col("doc_id").cast("string")
    return F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("web_"), F.substring(F.sha2(d, 256), 1, 16))).when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" "), d)).when(F.col("doc_id") % 11 == 0, F.concat(d, F.lit(".7"))).otherwise(d)


@query(f"SELECT doc_id AS src, TRY_CAST(CASE WHEN regexp_full_match(r, '\\s*[+-]?[0-9]+\\s*') THEN trim(r) END AS BIGINT) AS parsed FROM (SELECT doc_id, {_RAW_ID} AS r FROM documents)")
def parse_doc_id_query(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("src"), parse_doc_id(raw_id()).alias("parsed"))


QUERIES["parse_doc_id"], SQL["parse_doc_id"] = QUERIES.pop("parse_doc_id_query"), SQL.pop("parse_doc_id_query")


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'updated ' || CAST(doc_id AS VARCHAR) ELSE title END AS title, CAST(length(text) AS BIGINT) AS n_chars, language
FROM (SELECT doc_id, split_part(coalesce(text,''), chr(10), 1) AS title, coalesce(text,'') AS text, lang AS language FROM documents) WHERE doc_id % 7 <> 0""")
def scan_records(spark, d):
    """JSON lines with malformed, blank and repeated ones mixed in, parsed back."""
    docs = corpus(spark, d)
    rid = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("web_"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    line = lambda title: F.to_json(F.struct(rid.alias("doc_id"), title.alias("title"), "text", "url", "language"))
    first = docs.select(F.col("doc_id").alias("k"), F.lit(0).alias("v"), line(F.col("title")).alias("value"))
    later = docs.filter("doc_id % 10 = 0").select(F.col("doc_id").alias("k"), F.lit(1).alias("v"), line(F.concat(F.lit("updated "), F.col("doc_id").cast("string"))).alias("value"))
    broken = docs.filter("doc_id % 9 = 0").select(F.col("doc_id").alias("k"), F.lit(2).alias("v"), F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.lit(', "title": ')).alias("value"))
    empty = docs.filter("doc_id % 13 = 0").select(F.col("doc_id").alias("k"), F.lit(3).alias("v"), F.lit("  ").alias("value"))
    lines = first.unionByName(later).unionByName(broken).unionByName(empty).withColumn("at", F.struct("v", "k"))
    return parse_records(lines, order="at").select("doc_id", "title", F.length("text").cast("long").alias("n_chars"), "language")


@query(sql(f"SELECT doc_id, title, url FROM corpus WHERE length({strip('title')}) > 0 OR length({strip('text')}) > 0 OR length({strip('url')}) > 0", "corpus"))
def nonempty_records(spark, d):
    return nonempty(corpus(spark, d)).select("doc_id", "title", "url")


@query(sql("SELECT doc_id, CAST(len(body) AS BIGINT) AS n_tokens, CAST(len(list_distinct(body)) AS BIGINT) AS n_terms FROM toks", "toks"))
def tokenized_documents(spark, d):
    return index.tokens(corpus(spark, d)).select("doc_id", F.size("body").cast("long").alias("n_tokens"), F.size(F.array_distinct("body")).cast("long").alias("n_terms"))


@query(f"SELECT doc_id, array_to_string({tok('text')}, ' ') AS en, array_to_string({tok('text', 'es')}, ' ') AS es FROM documents", "tokenize")
def tokenize_query(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(tokenize("text"), " ").alias("en"), F.array_join(tokenize("text", "es"), " ").alias("es"))


@query(sql("SELECT doc_id, term, tf FROM post", "post"))
def term_frequency(spark, d):
    return index.postings(corpus(spark, d))


@query(sql("SELECT count(*) AS n_terms, max(doc_id) AS max_doc_id FROM (SELECT DISTINCT term FROM post), (SELECT max(doc_id) AS doc_id FROM documents)", "post"))
def index_totals(spark, d):
    post = index.postings(corpus(spark, d))
    return post.agg(F.countDistinct("term").alias("n_terms")).join(F.broadcast(table(spark, d, "documents").agg(F.max("doc_id").alias("max_doc_id"))))


@query(sql("SELECT term, array_to_string(list(doc_id ORDER BY doc_id), ',') AS doc_ids, count(*) AS df FROM post GROUP BY term", "post"))
def inverted_index(spark, d):
    return index.inverted_index(index.postings(corpus(spark, d))).select("term", F.array_join("doc_ids", ",").alias("doc_ids"), "df")


@query(sql("SELECT doc_id FROM post WHERE term = 'tion'", "post"))
def term_search(spark, d):
    return index.all_terms(index.postings(corpus(spark, d)), ["tion"])


@query(sql("SELECT doc_id FROM post WHERE term IN ('tion','ther','thon') GROUP BY doc_id HAVING count(*) = 3", "post"))
def and_search(spark, d):
    return index.all_terms(index.postings(corpus(spark, d)), Q3.split())


@query(sql("SELECT doc_id, n, pos FROM trie", "trie"))
def partial_and(spark, d):
    terms = ranking.query_terms(one_query(spark)).select("query_id", "term")
    found = index.matches(index.postings(corpus(spark, d)), terms)
    least = spark.createDataFrame([(1, index.default_least(3))], "query_id int, m int")
    return index.candidates(found, least).select("doc_id", "n", F.col("pos").cast("long").alias("pos"))


@query("SELECT doc_id, CAST(n AS BIGINT) AS n_chars FROM (SELECT doc_id, length(coalesce(text,'')) AS n, (SELECT CAST(max(doc_id) * 0.9 AS BIGINT) FROM documents) AS mark FROM documents) WHERE doc_id > mark")
def incremental_new_docs(spark, d):
    docs = table(spark, d, "documents")
    mark = docs.agg(F.round(F.max("doc_id") * F.lit(0.9)).cast("long").alias("m")).first()["m"]
    return new_documents(docs, mark or 0).select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


@query("SELECT coalesce(max(doc_id), 0) + 1 AS next_doc_id FROM documents")
def next_doc_id(spark, d):
    return table(spark, d, "documents").agg((F.coalesce(F.max("doc_id"), F.lit(0)) + 1).alias("next_doc_id"))


@query("SELECT page_id, url, (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY page_id) AS doc_id FROM pages")
def assign_doc_ids(spark, d):
    top = table(spark, d, "documents").agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("top"))
    return with_rank(table(spark, d, "pages"), "page_id", "place").join(F.broadcast(top)).select("page_id", "url", (F.col("top") + F.col("place")).cast("long").alias("doc_id"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def last_write_wins(spark, d):
    return first_per(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT doc_id, sha256(coalesce(text,'')) AS text_hash FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(coalesce(text,'')) ORDER BY doc_id) = 1")
def exact_text_dedup(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
    return rows.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text_hash")
