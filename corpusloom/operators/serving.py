"""What surrounds the ranking: substring boost, the external fallback, merging, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.constants import API_TOP_K, BOOST_RANK, BOOST_SCORE, FALLBACK_MIN_RESULTS, FALLBACK_MIN_SCORE, PAGE_SIZE
from corpusloom.functions.text import api_snippet, blank, strip
from corpusloom.functions.web import file_type, url_domain
from corpusloom.operators.common import settled, with_rank
from corpusloom.operators.ranking import search
from corpusloom.operators.store import Store

NO_TITLE = "(sin título)"


def nonempty(records: DataFrame) -> DataFrame:
    return records.filter((F.length(strip(blank("title"))) > 0) | (F.length(strip(blank("text"))) > 0) | (F.length(strip(blank("url"))) > 0))


def substring_boost(corpus: DataFrame, query: str, ranked: DataFrame) -> DataFrame:
    """Records that hold the query as it stands and aren't ranked, with a fixed low score."""
    q = query.lower()
    hit = F.contains(F.lower(blank("title")), F.lit(q)) | F.contains(F.lower(blank("text")), F.lit(q))
    return nonempty(corpus).filter(hit).join(ranked.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(BOOST_SCORE).alias("score"), F.lit(BOOST_RANK).cast("long").alias("source_rank"))


def triggered(results: int, score: float, enabled: bool = True, only_fallback: bool = True, least_results: int = FALLBACK_MIN_RESULTS, least_score: float = FALLBACK_MIN_SCORE) -> bool:
    """The gate of :func:`fallback_gate` for figures that are known."""
    return enabled and only_fallback and results < least_results and score < least_score


def fallback_gate(ranked: DataFrame, enabled: bool = True, only_fallback: bool = True, results: int = FALLBACK_MIN_RESULTS, score: float = FALLBACK_MIN_SCORE) -> DataFrame:
    """One row: count and mean score of the local results, and whether to ask another source."""
    stats = ranked.agg(F.count(F.lit(1)).alias("local_results"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"))
    return stats.withColumn("triggered", F.lit(enabled and only_fallback) & (F.col("local_results") < results) & (F.col("avg_score") < score))


def score_hints(rows: DataFrame, by: str) -> DataFrame:
    """External results with their rank (from 0) and a score that falls with it."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return with_rank(rows, by, "place").join(F.broadcast(total)).withColumn("web_rank", (F.col("place") - 1).cast("long")).withColumn("score_hint", F.round(1 - F.col("web_rank") / F.col("total"), 4)).drop("place", "total")


def merge_results(local: DataFrame, web: DataFrame) -> DataFrame:
    """By id: the larger score, the smaller rank, record and type of the external source where it has one.

    ``local`` and ``web`` have ``doc_id, title, text, url, source_type, score, source_rank``.
    """
    own = local.select("doc_id", F.struct("title", "text", "url", "source_type", "score", "source_rank").alias("l"))
    other = web.select("doc_id", F.struct("title", "text", "url", "source_type", "score", "source_rank").alias("w"))
    both = own.join(other, "doc_id", "full_outer")
    pick = lambda c: F.when(F.col("w").isNotNull(), F.col(f"w.{c}")).otherwise(F.col(f"l.{c}")).alias(c)
    return both.select("doc_id", *map(pick, ("title", "text", "url", "source_type")), F.greatest("l.score", "w.score").alias("score"), F.least("l.source_rank", "w.source_rank").alias("source_rank"))


def projection(records: DataFrame) -> DataFrame:
    """The columns that the search service returns."""
    return records.select(
        "doc_id", F.when(blank("title") == "", NO_TITLE).otherwise(F.col("title")).alias("title"), api_snippet("text").alias("snippet"),
        blank("url").alias("url"), file_type("url", "source_type").alias("file_type"), "domain", "source_type")


def index_external(records: DataFrame, web: DataFrame, by: str, crawl_date: str | None = None) -> DataFrame:
    """``web(url, title, text, ...)`` as records: ids after the largest known one, rank, score hint, date.

    Rows without a title or text aren't records.
    """
    usable = web.filter((F.length(strip(blank("title"))) > 0) & (F.length(strip(blank("text"))) > 0))
    top = records.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("top"))
    date = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'") if crawl_date is None else F.lit(crawl_date)
    out = score_hints(usable, by).join(F.broadcast(top)).withColumn("doc_id", (F.col("top") + F.col("web_rank") + 1).cast("long")).drop("top")
    return out.withColumn("source_type", F.lit("web_search")).withColumn("domain", url_domain("url")).withColumn("crawl_date", date)


def ingest(records: DataFrame, new: DataFrame) -> DataFrame:
    """``records`` with ``new`` ones in place of those with the same id; every index made from it is fresh."""
    return records.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new, allowMissingColumns=True)


def endpoint(corpus: DataFrame, queries: DataFrame, query: str, top_k: int = API_TOP_K, web: DataFrame | None = None, index: Store | None = None, **options) -> DataFrame:
    """The answer of the search service for one query, best first."""
    ranked = settled(search(index or corpus, queries, top_k, **options).select("doc_id", "score", (F.col("rank") - 1).cast("long").alias("source_rank")))
    # of the boosted, all of one score, at most top_k can show; these few rows are then looked up by id
    boost = settled(substring_boost(corpus, query, ranked).join(corpus.select("doc_id", F.lower("title").alias("t")), "doc_id").orderBy("t", "doc_id").limit(top_k).select("doc_id", "score", "source_rank"))
    found = ranked.unionByName(boost)
    records = corpus.join(F.broadcast(found), "doc_id")
    if web is not None:
        asked = web.join(F.broadcast(fallback_gate(ranked).filter("triggered").select(F.lit(1).alias("go")))).drop("go")
        cols = ["doc_id", "title", "text", "url", "source_type", "score", "source_rank"]
        records = merge_results(records.select(cols), asked.select(cols)).withColumn("domain", F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)))
    extra = ["crawl_date"] if "crawl_date" in records.columns else []
    shown = records.select(
        "doc_id", F.when(blank("title") == "", NO_TITLE).otherwise(F.col("title")).alias("title"), api_snippet("text").alias("snippet"), blank("url").alias("url"),
        file_type("url", "source_type").alias("file_type"), "domain", "source_type", "score", "source_rank", *extra, F.lower(blank("title")).alias("__t"))
    return shown.orderBy(F.desc(F.round("score", 9)), "source_rank", "__t", "doc_id").limit(top_k).drop("__t")


def envelope(results: DataFrame, query: str, ranked: DataFrame, web_used: bool) -> dict:
    """What the service answers: the rows of a top-k result, and what the fallback gate saw."""
    gate = fallback_gate(ranked).first()
    rows = [{**r.asDict(), "crawl_date": r["crawl_date"] if "crawl_date" in results.columns else None} for r in results.drop("source_rank").collect()]
    return {"query": query, "total": len(rows), "results": rows, "web_search_used": web_used, "local_results": gate["local_results"], "avg_local_score": gate["avg_score"]}


def page(results: DataFrame, order: list, number: int, size: int = PAGE_SIZE) -> DataFrame:
    return results.orderBy(*order).offset((number - 1) * size).limit(size)
