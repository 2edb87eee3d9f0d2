"""Statistics, scores and the search service."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import blank, tokenize
from corpusloom.functions.web import canonical_url, html_text, html_title
from corpusloom.operators import index, ranking, serving
from corpusloom.operators.counting import flat_counts, flat_vectors
from corpusloom.plans import sqlkit as k
from corpusloom.plans.kit import indexed, one_query, registry
from corpusloom.plans.sqlkit import Q3, sql
from corpusloom.sources.tables import corpus, table

QUERIES, SQL, query = registry()
R = 6


def _post(spark, d):
    return index.postings(corpus(spark, d))


def _terms(spark):
    return ranking.query_terms(one_query(spark))


@query(sql("SELECT term, df FROM df2", "df2"))
def bm25_df(spark, d):
    return index.document_frequency(index.both_fields(corpus(spark, d)))


@query(sql("SELECT term, round(ln((n_docs-df+0.5)/(df+0.5)+1), 6) AS idf FROM df2 CROSS JOIN stats", "df2", "stats"))
def bm25_idf(spark, d):
    c = corpus(spark, d)
    return index.document_frequency(index.both_fields(c)).join(F.broadcast(ranking.length_stats(c))).select("term", F.round(ranking.bm25_idf(F.col("df"), F.col("n_docs")), R).alias("idf"))


@query(sql("SELECT CAST(n_docs AS BIGINT) AS n_docs, round(avgdl, 6) AS avgdl FROM stats", "stats"))
def doc_length_stats(spark, d):
    return ranking.length_stats(corpus(spark, d)).select(F.col("n_docs").cast("long").alias("n_docs"), F.round("avgdl", R).alias("avgdl"))


@query(sql("SELECT doc_id, round(lex, 6) AS score FROM lex", "lex"))
def bm25_scores(spark, d):
    return ranking.bm25(indexed(spark, d), _terms(spark)).select("doc_id", F.round("lex", R).alias("score"))


@query(sql("SELECT term, df FROM df", "df"))
def gvsm_df(spark, d):
    return index.document_frequency(_post(spark, d))


@query(sql("SELECT term, round(ln((n+1)/(df+1))+1, 6) AS idf FROM df CROSS JOIN nn", "df", "nn"))
def gvsm_idf(spark, d):
    post = _post(spark, d)
    n = post.agg(F.countDistinct("doc_id").alias("n"))
    return index.document_frequency(post).join(F.broadcast(n)).select("term", F.round(F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1, R).alias("idf"))


@query(sql("SELECT doc_id, term, round(w, 6) AS w FROM w", "w"))
def tfidf_vectors(spark, d):
    return ranking.document_weights(flat_counts(corpus(spark, d), "doc_id", "text")).select("doc_id", "term", F.round("w", R).alias("w"))


@query(sql("SELECT term, round(w, 6) AS w FROM qw", "qw"))
def query_vectors(spark, d):
    return ranking.query_weights(_post(spark, d), _terms(spark)).select("term", F.round("w", R).alias("w"))


_PAIRS = "SELECT a.term AS term_a, b.term AS term_b, count(*) AS n FROM post a JOIN post b ON a.doc_id = b.doc_id AND a.term < b.term JOIN df x ON x.term = a.term AND x.df >= 3 JOIN df y ON y.term = b.term AND y.df >= 3 GROUP BY 1, 2 HAVING count(*) >= 3"


@query(sql(_PAIRS, "post", "df"))
def cooccurrence_counts(spark, d):
    return ranking.pair_counts(_post(spark, d))


@query(sql("SELECT 'ther' AS term_a, 'tion' AS term_b, (SELECT count(*) FROM post a JOIN post b USING (doc_id) WHERE a.term = 'tion' AND b.term = 'ther') AS n", "post"))
def pair_count_lookup(spark, d):
    both = index.all_terms(_post(spark, d), ["tion", "ther"])
    return both.agg(F.count(F.lit(1)).alias("n")).select(F.lit("ther").alias("term_a"), F.lit("tion").alias("term_b"), "n")


def _correlation(method, formula):
    twin = sql(f"SELECT term_a, term_b, round({formula}, 6) AS r FROM ({_PAIRS}) p JOIN (SELECT term AS term_a, CAST(df AS DOUBLE) AS da FROM df) USING (term_a) JOIN (SELECT term AS term_b, CAST(df AS DOUBLE) AS db FROM df) USING (term_b)", "post", "df")

    @query(twin, f"term_correlation_{method}")
    def run(spark, d):
        return ranking.term_correlations(_post(spark, d), method).withColumn("r", F.round("r", R))


for _m, _f in (("cosine", "n/sqrt(da*db)"), ("jaccard", "n/(da+db-n)"), ("dice", "2*n/(da+db)")):
    _correlation(_m, _f)


@query(sql("SELECT doc_id, round(sem, 6) AS score FROM sem", "sem"))
def gvsm_scores(spark, d):
    return ranking.gvsm(indexed(spark, d), _terms(spark)).select("doc_id", F.round("sem", R).alias("score"))


@query(sql("SELECT doc_id, CAST(idx AS INTEGER) AS idx, round(v, 6) AS v FROM emb", "emb"))
def hashed_embeddings(spark, d):
    return flat_vectors(ranking.record_text(corpus(spark, d)), "doc_id", "text").select("doc_id", "idx", F.round("v", R).alias("v"))


def _near(spark, d, k=3000):
    q = ranking.hashed(one_query(spark).select("query_id", tokenize("query").alias("terms")), "query_id")
    return ranking.nearest(indexed(spark, d), q, k)


@query(sql("SELECT doc_id, pos, round(vec, 6) AS score FROM vec", "vec"))
def vector_knn(spark, d):
    return _near(spark, d).select("doc_id", F.col("pos").cast("long").alias("pos"), F.round("vec", R).alias("score"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT vec_id AS qid, v AS u FROM e WHERE vec_id % 50 = 0)
SELECT qid, vec_id, round(list_cosine_similarity(u, v), 6) AS sim FROM q, e WHERE qid <> vec_id QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(u, v), 9) DESC, vec_id) <= 10""")
def embedding_knn(spark, d):
    """The ten nearest of all vectors for every vector whose id is divisible by 50."""
    return ranking.dense_nearest(table(spark, d, "embeddings"), table(spark, d, "embeddings").filter("vec_id % 50 = 0"), 10).select("qid", "vec_id", F.round("s", R).alias("sim"))


@query(sql("""SELECT CAST(doc_id AS VARCHAR) AS id, substr(title || chr(10) || text, 1, 40000) AS document, title, url, source_type, doc_id FROM corpus WHERE doc_id % 3 <> 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), substr('new ' || title || chr(10) || text, 1, 40000), 'new ' || title, url, source_type, doc_id FROM corpus WHERE doc_id % 3 = 0""", "corpus"))
def vector_upsert(spark, d):
    c = corpus(spark, d)
    newer = c.filter("doc_id % 3 = 0").withColumn("title", F.concat(F.lit("new "), "title"))
    return ranking.upsert(ranking.vector_items(c), ranking.vector_items(newer))


@query(sql("SELECT doc_id, pos FROM cand", "cand"))
def candidate_union(spark, d):
    store, terms = indexed(spark, d), _terms(spark)
    found = index.matches(store.of_terms(ranking.asked(terms)).filter("tf_body > 0"), terms.select("query_id", "term"))
    trie = index.candidates(found, spark.createDataFrame([(1, 2)], "query_id int, m int"))
    return ranking.candidate_union(trie, _near(spark, d)).select("doc_id", F.col("pos").cast("long").alias("pos"))


@query(sql("SELECT doc_id, round(lex / max(lex) OVER (), 6) AS scaled FROM lex", "lex"))
def max_normalize(spark, d):
    lex = ranking.bm25(indexed(spark, d), _terms(spark))
    return lex.join(F.broadcast(lex.agg(F.max("lex").alias("m")))).select("doc_id", F.round(F.col("lex") / F.col("m"), R).alias("scaled"))


@query(sql("SELECT doc_id, round(score, 6) AS score FROM fused", "fused"))
def fusion_scores(spark, d):
    return ranking.search(indexed(spark, d), one_query(spark), 1 << 30).select("doc_id", F.round("score", R).alias("score"))


@query(sql("SELECT doc_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 20", "ranked"))
def hybrid_search(spark, d):
    return ranking.search(indexed(spark, d), one_query(spark), 20).select("doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", R).alias("score"))


@query(sql("SELECT doc_id FROM toks WHERE list_has_any(body, ['tion','ther','thon']) OR list_has_any(head, ['tion','ther','thon']) OR contains(lower(url),'tion') OR contains(lower(url),'ther') OR contains(lower(url),'thon')", "toks"))
def lexical_match(spark, d):
    return ranking.lexical_match(corpus(spark, d), Q3.split()).select("doc_id")


_BOOST = "SELECT doc_id, 0.15 AS score, CAST(10000 AS BIGINT) AS source_rank FROM corpus WHERE (contains(lower(title), 'thon') OR contains(lower(text), 'thon')) AND doc_id NOT IN (SELECT doc_id FROM ranked WHERE rank <= 20)"


@query(sql(_BOOST.replace("0.15 AS", "CAST(0.15 AS DOUBLE) AS"), "corpus", "ranked"))
def substring_boost(spark, d):
    c = corpus(spark, d)
    return serving.substring_boost(c, "Thon", ranking.search(indexed(spark, d), one_query(spark), 20))


@query(sql("SELECT count(*) AS local_results, round(avg(score), 6) AS avg_score, count(*) < 5 AND avg(score) < 0.3 AS triggered FROM ranked WHERE rank <= 20", "ranked"))
def fallback_gate(spark, d):
    return serving.fallback_gate(ranking.search(indexed(spark, d), one_query(spark), 20)).withColumn("avg_score", F.round("avg_score", R))


@query("SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS web_rank, round(1 - (row_number() OVER (ORDER BY page_id) - 1) / CAST(count(*) OVER () AS DOUBLE), 4) AS score_hint FROM pages")
def rank_score_hint(spark, d):
    return serving.score_hints(table(spark, d, "pages").select("page_id"), "page_id")


def _web(spark, d):
    pages = serving.score_hints(table(spark, d, "pages"), "page_id")
    return pages.select(F.col("page_id").alias("doc_id"), html_title("html").alias("title"), html_text("html").alias("text"), canonical_url("url").alias("url"), F.lit("web_search").alias("source_type"), F.col("score_hint").alias("score"), F.col("web_rank").alias("source_rank"))


_WEB = "SELECT page_id AS doc_id, title, text, canonical AS url, 'web_search' AS source_type, round(1 - (row_number() OVER (ORDER BY page_id) - 1) / CAST(count(*) OVER () AS DOUBLE), 4) AS score, row_number() OVER (ORDER BY page_id) - 1 AS source_rank FROM ext"


@query(sql(f"SELECT doc_id, CASE WHEN w.doc_id IS NOT NULL THEN w.title ELSE l.title END AS title, CASE WHEN w.doc_id IS NOT NULL THEN w.source_type ELSE l.source_type END AS source_type, round(greatest(l.score, w.score), 6) AS score, least(l.source_rank, w.source_rank) AS source_rank FROM (SELECT doc_id, title, source_type, score, rank - 1 AS source_rank FROM ranked JOIN corpus USING (doc_id) WHERE rank <= 40) l FULL JOIN ({_WEB}) w USING (doc_id)", "ranked", "corpus", "ext"))
def merge_web_results(spark, d):
    c = corpus(spark, d)
    found = ranking.search(indexed(spark, d), one_query(spark), 40).select("doc_id", "score", (F.col("rank") - 1).cast("long").alias("source_rank"))
    merged = serving.merge_results(c.join(found, "doc_id"), _web(spark, d))
    return merged.select("doc_id", "title", "source_type", F.round("score", R).alias("score"), "source_rank")


_SHOWN = f"CASE WHEN title = '' THEN '(sin título)' ELSE title END AS title, {k.strip('substr(replace(text,chr(10),chr(32)),1,320)')} AS snippet, url, {k.file_type('url', 'source_type')} AS file_type, domain, source_type"


@query(sql(f"SELECT doc_id, {_SHOWN} FROM corpus", "corpus"))
def search_api_projection(spark, d):
    return serving.projection(corpus(spark, d))


_ENDPOINT = f"SELECT doc_id, {_SHOWN}, round(score, 6) AS score, source_rank FROM (SELECT doc_id, score, rank - 1 AS source_rank FROM ranked WHERE rank <= 40 UNION ALL SELECT doc_id, 0.15, 10000 FROM corpus WHERE (contains(lower(title), '{Q3}') OR contains(lower(text), '{Q3}')) AND doc_id NOT IN (SELECT doc_id FROM ranked WHERE rank <= 40)) JOIN corpus USING (doc_id) ORDER BY round(score, 9) DESC, source_rank, lower(corpus.title), doc_id LIMIT 40"


@query(sql(_ENDPOINT, "ranked", "corpus"))
def search_endpoint(spark, d):
    web = _web(spark, d).filter("source_rank < 10")  # an external search returns ten results
    c = corpus(spark, d)
    out = serving.endpoint(c, one_query(spark), Q3, 40, web, index=indexed(spark, d))
    return out.select("doc_id", "title", "snippet", "url", "file_type", F.coalesce("domain", F.lit("")).alias("domain"), "source_type", F.round("score", R).alias("score"), "source_rank")


@query(sql("SELECT doc_id, rank, round(score, 6) AS score FROM ranked ORDER BY rank LIMIT 6 OFFSET 6", "ranked"))
def result_page(spark, d):
    found = ranking.search(indexed(spark, d), one_query(spark), 80).select("doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", R).alias("score"))
    return serving.page(found, ["rank"], 2)


@query(sql(f"SELECT item_id, term, qtf FROM (SELECT item_id, unnest({k.tok('text')}) AS term FROM benchmark) JOIN df USING (term) GROUP BY ALL".replace("SELECT item_id, term, qtf FROM", "SELECT item_id, term, count(*) AS qtf FROM"), "df"))
def batch_query_terms(spark, d):
    """A batch of queries: the known terms of every benchmark item."""
    terms = ranking.query_terms(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), blank("text").alias("query")))
    return terms.join(index.document_frequency(_post(spark, d)).select("term"), "term").select(F.col("query_id").alias("item_id"), "term", "qtf")


@query(sql("SELECT count(*) AS n FROM rec", "rec"))
def vector_count(spark, d):
    return spark.createDataFrame([(indexed(spark, d).count(),)], "n long")


@query(sql("SELECT CAST(term AS VARCHAR) AS term, CAST(doc_id // 4096 AS BIGINT) AS block, array_to_string(list(doc_id ORDER BY doc_id), ',') AS doc_ids FROM post GROUP BY ALL", "post"))
def block_index(spark, d):
    """The inverted index with lists cut by ranges of ids."""
    return index.block_postings(_post(spark, d)).select("term", "block", F.array_join("doc_ids", ",").alias("doc_ids"))
