"""Postings, corpus statistics, the inverted index and its lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.constants import DIMENSION, MAX_CANDIDATES, MIN_COOC
from corpusloom.functions.text import tokenize
from corpusloom.operators.common import kept, top_k
from corpusloom.operators.counting import flat_counts, pair_table


def tokens(corpus: DataFrame, language: str = "en") -> DataFrame:
    return corpus.withColumn("body", tokenize("text", language)).withColumn("head", tokenize("title", language))


def counted(df: DataFrame, tokens_col: str, terms: str, counts: str) -> DataFrame:
    """``df`` with the distinct tokens of an array, and how often each occurs; nothing is shuffled.

    In the sorted array every token begins where it differs from the one before.
    Each array is a column that is read twice, so that it isn't made anew for each element.
    """
    s, at = f"__{terms}_s", f"__{terms}_at"
    df = df.withColumn(s, F.array_sort(tokens_col))
    df = df.withColumn(at, F.expr(f"filter(transform(`{s}`, (x, i) -> if(i = 0 or x <> get(`{s}`, i - 1), i, null)), i -> i is not null)"))
    df = df.withColumn(terms, F.expr(f"transform(`{at}`, i -> get(`{s}`, i))"))
    return df.withColumn(counts, F.expr(f"transform(`{at}`, (i, k) -> coalesce(get(`{at}`, k + 1), size(`{s}`)) - i)")).drop(s, at)


def postings(corpus: DataFrame, field: str = "text", language: str = "en") -> DataFrame:
    """``doc_id, term, tf`` of one field of ``corpus``, whose ids are distinct."""
    return flat_counts(corpus, "doc_id", field, language).select("doc_id", "term", "tf")


def both_fields(corpus: DataFrame, language: str = "en") -> DataFrame:
    """``doc_id, term, tf_body, tf_title`` in one pass over the corpus."""
    field = lambda name, body: F.transform(tokenize(name, language), lambda t: F.struct(t.alias("term"), F.lit(body).alias("body")))
    rows = corpus.select("doc_id", F.inline(F.concat(field("text", 1), field("title", 0))))
    return rows.groupBy("doc_id", "term").agg(F.sum("body").alias("tf_body"), F.sum(1 - F.col("body")).alias("tf_title"))


def inverted_index(post: DataFrame) -> DataFrame:
    """``term, doc_ids, df``: sorted lists without repeats."""
    return post.groupBy("term").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"), F.count(F.lit(1)).alias("df"))


BLOCK = 4096


def block_postings(post: DataFrame, block: int = BLOCK) -> DataFrame:
    """``term, block, doc_ids``: the index with lists cut by ranges of ids, so that no list is longer than ``block``."""
    of = F.floor(F.col("doc_id") / block).cast("long")
    return post.groupBy("term", of.alias("block")).agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))


def document_frequency(post: DataFrame) -> DataFrame:
    """How many documents hold a term; ``post`` has one row for each."""
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def ranked_postings(post: DataFrame, queries: DataFrame) -> DataFrame:
    """Query terms with their place among the query's posting lists, by (df, list, term).

    ``queries(query_id, term)`` has distinct terms.  Lists are compared only among
    terms of a query with equal frequency, and without gathering them: of two such
    lists the one with the smallest id that the other lacks comes first.
    """
    df = document_frequency(post.join(F.broadcast(queries.select("term").distinct()), "term", "left_semi"))
    found = kept(queries.join(F.broadcast(df), "term").select("query_id", "term", "df"))  # one row for each term that was asked for
    a, b = (found.select("query_id", "df", F.col("term").alias(x)) for x in ("t", "u"))
    ties = a.join(b, ["query_id", "df"]).filter("t < u").select("t", "u").distinct()
    lead = None
    if not ties.isEmpty():
        side = lambda own, sign: post.join(F.broadcast(ties), post["term"] == ties[own]).select("t", "u", "doc_id", F.lit(sign).alias("s"))
        apart = side("t", 1).unionByName(side("u", -1)).groupBy("t", "u", "doc_id").agg(F.sum("s").alias("s")).filter("s <> 0")
        lead = apart.groupBy("t", "u").agg(F.min_by("s", "doc_id").alias("s"))
    # how many lists of the query come before each
    less = (F.col("o.df") < F.col("f.df")) | ((F.col("o.df") == F.col("f.df")) & (F.col("o.term") < F.col("f.term")))
    pairs = found.alias("f").join(found.alias("o"), (F.col("f.query_id") == F.col("o.query_id")) & (F.col("f.term") != F.col("o.term")), "left")
    if lead is not None:
        low, high = F.least("f.term", "o.term"), F.greatest("f.term", "o.term")
        pairs = pairs.join(F.broadcast(lead), (F.col("t") == low) & (F.col("u") == high) & (F.col("f.df") == F.col("o.df")), "left")
        less = F.when(F.col("s").isNull(), less).otherwise((F.col("s") > 0) == (F.col("o.term") == F.col("t")))
    return pairs.groupBy(F.col("f.query_id").alias("query_id"), F.col("f.term").alias("term"), F.col("f.df").alias("df")).agg((F.sum(F.coalesce(less.cast("int"), F.lit(0))) + 1).alias("place"))


def matches(post: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, doc_id, n, place``: distinct query terms in a document, and its first list."""
    placed = ranked_postings(post, queries)
    return post.join(F.broadcast(placed), "term").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))


def candidates(found: DataFrame, least: DataFrame, limit: int = MAX_CANDIDATES) -> DataFrame:
    """The first ``limit`` documents with enough terms, ``least(query_id, m)``; ``pos`` counts from 1."""
    enough = found.join(F.broadcast(least), "query_id").filter("n >= m")
    return top_k(enough, ["query_id"], [F.desc("n"), F.col("place"), F.col("doc_id")], limit, "doc_id", "pos").select("query_id", "doc_id", "n", "pos")


def all_terms(post: DataFrame, terms: list[str]) -> DataFrame:
    """Documents that hold every term."""
    want = sorted(set(terms))
    return post.filter(F.col("term").isin(want)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(want)).select("doc_id")


def default_least(terms: int, asked: int | None = None) -> int:
    """How many terms a document must hold: one or two, or what was asked within reach."""
    return (1 if terms <= 1 else 2) if asked is None else max(1, min(asked, max(1, terms)))


def bucket_of(term, dimension: int = DIMENSION):
    """Place and sign of a term in the hashed space, from its SHA-1."""
    h = F.sha1(term.cast("binary"))
    low = F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1)))
    return (F.conv(low, 16, 10).cast("long") % dimension).cast("int"), F.when(F.conv(F.substring(h, 10, 1), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)


def pair_counts(post: DataFrame, least: int = MIN_COOC) -> DataFrame:
    """``term_a, term_b, n`` with ``term_a < term_b``: documents that hold both, at least ``least``."""
    return pair_table(post, least).select("term_a", "term_b", "n")
