"""BM25 over two fields, the correlation-aware vector space, hashed vectors, and their fusion.

Every operator takes ``queries(query_id, term, qtf)`` and works for a batch of
queries in one plan.  Query tables are small and broadcast; corpus tables are
never collected.  What a query reads is the index (:mod:`.store`): the postings and
places of its terms, and term counts; no text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.constants import ALPHA, BM25_B, BM25_K1, DIMENSION, MAX_CANDIDATES, MIN_COOC, TITLE_WEIGHT, VECTOR_WEIGHT
from corpusloom.functions.text import blank, tokenize
from corpusloom.operators.common import kept, settled, top_k
from corpusloom.operators.counting import matrix, nearest_of, pair_table
from corpusloom.operators.index import bucket_of, candidates, document_frequency, matches, pair_counts
from corpusloom.operators.store import Store, build, idf
from corpusloom.sources.deploy import ship


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, qtf`` of ``queries(query_id, query)``."""
    return queries.select("query_id", F.explode(tokenize("query")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def _store(index: Store | DataFrame) -> Store:
    return index if isinstance(index, Store) else build(index)


def asked(terms: DataFrame) -> list[str]:
    """The distinct terms of the stated queries."""
    return [r["term"] for r in terms.select("term").distinct().collect()]


# -- BM25 ---------------------------------------------------------------------
def bm25_idf(df, n):
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def length_stats(corpus: DataFrame) -> DataFrame:
    """One row: how many documents, and their mean number of body tokens."""
    return corpus.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size(tokenize("text")).cast("long")).alias("total")).select(
        F.greatest("n_docs", F.lit(1)).alias("n_docs"), (F.col("total") / F.greatest("n_docs", F.lit(1))).alias("avgdl"))


def bm25(index: Store | DataFrame, terms: DataFrame, k1: float = BM25_K1, b: float = BM25_B, title_weight: float = TITLE_WEIGHT, words: list[str] | None = None) -> DataFrame:
    """``query_id, doc_id, lex``.  A repeated query term counts repeatedly."""
    store = _store(index)
    post = store.of_terms(asked(terms) if words is None else words)
    f = F.col("tf_body") + title_weight * F.col("tf_title")
    norm = f + k1 * (1 - b + b * F.col("dl") / max(store.avgdl, 1e-9))
    weight = bm25_idf(F.col("df"), F.lit(store.n_docs)) * f * (k1 + 1) / norm
    want = terms.join(F.broadcast(document_frequency(post)), "term")
    return post.join(F.broadcast(want), "term").groupBy("query_id", "doc_id").agg(F.sum(weight * F.col("qtf")).alias("lex"))


# -- correlation-aware vector space --------------------------------------------
def document_weights(post: DataFrame) -> DataFrame:
    """``doc_id, term, w``: normalised frequency times inverse document frequency.

    Documents without tokens don't count; the count of the others rides along by a broadcast row.
    """
    if {"top", "first"} <= set(post.columns):  # told by the row that the term is from
        seen = kept(post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("first").alias("first")))
        n, df, rows = seen.agg(F.sum("first").alias("n")), seen, post
    else:
        n, df = post.agg(F.countDistinct("doc_id").alias("n")), document_frequency(post)
        rows = post.join(post.groupBy("doc_id").agg(F.max("tf").alias("top")), "doc_id")
    idf = df.join(F.broadcast(n)).select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    return rows.join(idf, "term").select("doc_id", "term", (F.col("tf") / F.col("top") * F.col("idf")).alias("w"))


def query_weights(post: DataFrame, terms: DataFrame) -> DataFrame:
    """``query_id, term, w`` of the query terms that the corpus knows."""
    n = post.agg(F.countDistinct("doc_id").alias("n"))
    df = document_frequency(post.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi"))
    known = terms.join(F.broadcast(df), "term").join(F.broadcast(n))
    top = terms.groupBy("query_id").agg(F.max("qtf").alias("top"))
    return known.join(top, "query_id").select("query_id", "term", (F.col("qtf") / F.col("top") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)).alias("w"))


def correlation(n, a, b, method: str = "cosine"):
    """Of two terms in ``n`` common documents and ``a`` and ``b`` documents each."""
    if method == "cosine":
        return n / F.sqrt(a * b)
    if method == "jaccard":
        return n / (a + b - n)
    if method == "dice":
        return 2 * n / (a + b)
    raise ValueError(f"unknown correlation {method!r}")


def term_correlations(post: DataFrame, method: str = "cosine", least: int = MIN_COOC) -> DataFrame:
    return pair_table(post, least).select("term_a", "term_b", correlation(F.col("n"), F.col("df_a"), F.col("df_b"), method).alias("r"))


def spread(store: Store, weights: DataFrame, words: list[str], method: str = "cosine", least: int = MIN_COOC) -> DataFrame:
    """``query_id, term, x``: the query vector times the correlation matrix.

    Only pairs with one end in the query are counted; the matrix as a whole is
    never made.  Saved pair counts are read instead where the store has them.
    """
    if store.pairs is not None and store.least == least:
        n = store.pairs.filter(F.col("term").isin(words)).select(F.col("term").alias("q"), F.col("other").alias("term"), "n")
    else:
        want = F.array(*map(F.lit, words)).cast("array<string>")
        held = store.forward.select("terms", F.array_intersect("terms", want).alias("have")).filter(F.size("have") > 0)
        pairs = held.select(F.explode("have").alias("q"), "terms").select("q", F.explode("terms").alias("term")).filter("q <> term")
        n = pairs.groupBy("q", "term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    dq = store.terms.filter(F.col("term").isin(words)).select(F.col("term").alias("q"), F.col("df_body").alias("df_q"))
    r = n.join(F.broadcast(dq), "q").join(store.terms.select("term", F.col("df_body").alias("df")), "term").select("q", "term", correlation(F.col("n"), F.col("df_q"), F.col("df"), method).alias("r"))
    r = r.unionByName(weights.select(F.col("term").alias("q"), "term", F.lit(1.0).alias("r")).distinct())
    return r.join(F.broadcast(weights.withColumnRenamed("term", "q")), "q").groupBy("query_id", "term").agg(F.sum(F.col("w") * F.col("r")).alias("x"))


def gvsm(index: Store | DataFrame, terms: DataFrame, method: str = "cosine", least: int = MIN_COOC, of: DataFrame | None = None, words: list[str] | None = None) -> DataFrame:
    """``query_id, doc_id, sem``: correlation-aware similarity, not bounded by 1.

    Of all documents, or of the ids in ``of`` alone.  Weights of documents, and so their
    norms, are made from their counts where they meet the terms' frequencies.
    """
    store = _store(index)
    words = asked(terms) if words is None else words
    top = terms.groupBy("query_id").agg(F.max("qtf").alias("top"))
    known = store.terms.filter(F.col("term").isin(words) & (F.col("df_body") > 0))
    q = settled(terms.join(F.broadcast(known), "term").join(top, "query_id").select("query_id", "term", (F.col("qtf") / F.col("top") * idf(store.n_filled)).alias("w")))  # the terms of the stated queries
    norm = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nq"))
    # one row of x for each term, with what a document's weight of it needs: its terms meet it once, whatever the number of queries
    x = spread(store, q, words, method, least).groupBy("term").agg(F.collect_list(F.struct("query_id", "x")).alias("xs"))
    x = kept(store.terms.filter("df_body > 0").select("term", idf(store.n_filled).alias("idf")).join(x, "term", "left"))
    rows = store.forward.select("doc_id", "terms", "tf", "top")
    if of is not None:
        rows = rows.join(of.select("doc_id").distinct(), "doc_id", "left_semi")
    met = rows.select("doc_id", "top", F.inline(F.arrays_zip(F.col("terms").alias("term"), "tf"))).join(x, "term")
    met = met.select("doc_id", (F.col("tf") / F.col("top") * F.col("idf")).alias("w"), "xs")
    # a row a query that the term counts for, and one for the document's norm
    met = met.select("doc_id", "w", F.explode(F.concat(F.array(F.struct(F.lit(None).cast(q.schema["query_id"].dataType).alias("query_id"), F.lit(None).cast("double").alias("x"))), F.coalesce("xs", F.array()))).alias("q"))
    dot = met.groupBy("doc_id", "q.query_id").agg(F.sum(F.col("w") * F.col("q.x")).alias("dot"), F.sum(F.col("w") * F.col("w")).alias("w2"))
    mine = F.when(F.col("query_id").isNotNull(), F.struct("query_id", "dot"))
    dot = dot.groupBy("doc_id").agg(F.sqrt(F.max(F.when(F.col("query_id").isNull(), F.col("w2")))).alias("nd"), F.collect_list(mine).alias("d")).select("doc_id", "nd", F.inline("d"))
    return dot.join(F.broadcast(norm), "query_id").filter("nq > 0").select("query_id", "doc_id", (F.col("dot") / (F.col("nd") * F.col("nq"))).alias("sem"))


# -- hashed vectors -----------------------------------------------------------
def hashed(rows: DataFrame, key: str, dimension: int = DIMENSION) -> DataFrame:
    """``key, idx, v``: sparse unit vectors of ``rows(key, terms)``."""
    idx, sign = bucket_of(F.col("term"), dimension)
    raw = rows.select(key, F.explode("terms").alias("term")).select(key, idx.alias("idx"), sign.alias("s")).groupBy(key, "idx").agg(F.sum("s").alias("v")).filter("v <> 0")
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v")).cast("double")).alias("norm"))
    return raw.join(norm, key).select(key, "idx", (F.col("v") / F.col("norm")).alias("v"))


def record_text(corpus: DataFrame) -> DataFrame:
    """What a record's vector is made of: title and text, else its URL; empty records have none."""
    title, text, url = blank("title"), blank("text"), blank("url")
    any_text = (F.trim(title) != "") | (F.trim(text) != "")
    return corpus.filter(any_text | (url != "")).select("doc_id", F.when(any_text, F.concat(title, F.lit("\n"), text)).otherwise(url).alias("text"))


def record_terms(corpus: DataFrame) -> DataFrame:
    return record_text(corpus).select("doc_id", tokenize("text").alias("terms"))


def nearest(index: Store | DataFrame, queries: DataFrame, k: int = MAX_CANDIDATES) -> DataFrame:
    """``query_id, doc_id, vec, pos``: the ``k`` nearest of all records, ties by id.

    ``queries(query_id, idx, v)``: a query has few places, so the product is a join on
    places.  Documents without a common place, or with a negative product, score 0
    and still rank, by id: the ``k`` smallest ids hold all of them that can.
    """
    store = _store(index)
    q = queries.select("query_id", "idx", F.col("v").alias("u"))
    places = [r["idx"] for r in q.select("idx").distinct().collect()]  # of the stated queries, at most the dimension
    dot = store.vectors.filter(F.col("idx").isin(places)).join(F.broadcast(q), "idx").groupBy("query_id", "doc_id").agg(F.sum(F.col("v") * F.col("u")).alias("d")).filter("d > 0")
    order = [F.desc(F.round("vec", 9)), F.col("doc_id")]
    near = kept(top_k(dot.select("query_id", "doc_id", F.least(F.lit(1.0), "d").alias("vec")), ["query_id"], order, k, "doc_id", "pos"))
    short = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    short = queries.select("query_id").distinct().join(short, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < k).select("query_id")
    first = store.forward.filter("recorded").select("doc_id").orderBy("doc_id").limit(k)
    rest = first.join(F.broadcast(short)).join(near, ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", F.lit(0.0).alias("vec"))
    both = near.select("query_id", "doc_id", "vec").unionByName(rest)
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("pos") <= k)


KNN_BLOCK = 4096  # queries that meet all vectors in one pass


def dense_nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``qid, vec_id, s``: by cosine the ``k`` nearest others of ``vectors(vec_id, embedding)`` for each of ``queries``, ties by id.

    The stated queries meet all vectors in blocks of ``KNN_BLOCK``, each of which is
    small enough to be sent to every task; a task of vectors keeps what can be among the
    nearest of its own, by products of matrices.  The work is the number of queries times that
    of vectors.
    """
    spark = vectors.sparkSession
    ship(spark)
    numbered = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("v IS NOT NULL")
    e, q = numbered(vectors), numbered(queries)
    blocks = max(1, -(-q.count() // KNN_BLOCK))
    out = None
    for b in range(blocks):
        part = (q if blocks == 1 else q.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)).toArrow().combine_chunks()  # some KNN_BLOCK rows
        if not part.num_rows:
            continue
        block = spark.sparkContext.broadcast((part.column("vec_id").to_numpy(), matrix(part.to_batches()[0], 1)))
        sims = e.mapInArrow(lambda batches, block=block: nearest_of(batches, *block.value, k), "qid long, vec_id long, s double")
        out = sims if out is None else out.unionByName(sims)
    if out is None:
        out = spark.createDataFrame([], "qid long, vec_id long, s double")
    return top_k(out, ["qid"], [F.desc(F.round("s", 9)), F.col("vec_id")], k, "vec_id", "place")


def upsert(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those with the same key."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def vector_items(corpus: DataFrame, limit: int = 40000) -> DataFrame:
    """What the vector collection stores of each record."""
    return corpus.filter((F.trim(blank("title")) != "") | (F.trim(blank("text")) != "") | (blank("url") != "")).select(
        F.col("doc_id").cast("string").alias("id"), F.substring(F.concat("title", F.lit("\n"), "text"), 1, limit).alias("document"), "title", "url",
        F.coalesce(F.nullif("source_type", F.lit("")), F.lit("webpage")).alias("source_type"), "doc_id")


# -- fusion -------------------------------------------------------------------
def fuse(cands: DataFrame, sem: DataFrame, lex: DataFrame, vec: DataFrame, alpha: float = ALPHA, share: float = VECTOR_WEIGHT) -> DataFrame:
    """``query_id, doc_id, pos, score`` of candidates; parts are scaled by their maxima.

    Maxima of the first two are over the candidates, that of the vectors is over all hits.
    """
    top = vec.groupBy("query_id").agg(F.max("vec").alias("mv"))
    key = ["query_id", "doc_id"]
    rows = cands.join(sem, key, "left").join(lex, key, "left").join(vec.select(*key, "vec"), key, "left").join(F.broadcast(top), "query_id", "left")
    rows = rows.fillna(0.0, ["sem", "lex", "vec"])
    best = rows.groupBy("query_id").agg(F.max("sem").alias("ms"), F.max("lex").alias("ml"))
    rows = rows.join(F.broadcast(best), "query_id")
    scaled = lambda x, m: F.when(F.coalesce(F.col(m), F.lit(0.0)) > 0, F.col(x) / F.col(m)).otherwise(0.0)
    return rows.select(*key, "pos", ((1 - share) * (alpha * scaled("sem", "ms") + (1 - alpha) * scaled("lex", "ml")) + share * scaled("vec", "mv")).alias("score"))


def lexical_match(corpus: DataFrame, terms: list[str]) -> DataFrame:
    """Records with a term among their tokens, or inside their URL."""
    want = F.array(*map(F.lit, sorted(set(terms))))
    tok = F.array_union(tokenize("title"), tokenize("text"))
    return corpus.filter(F.arrays_overlap(tok, want) | F.exists(want, lambda t: F.contains(F.lower(blank("url")), t)))


def candidate_union(trie: DataFrame, vec: DataFrame) -> DataFrame:
    """Index candidates first, then vector hits, each id at its first place."""
    both = trie.select("query_id", "doc_id", F.lit(0).alias("part"), "pos").unionByName(vec.select("query_id", "doc_id", F.lit(1).alias("part"), "pos"))
    firsts = both.groupBy("query_id", "doc_id").agg(F.min(F.struct("part", "pos")).alias("m"))
    order = Window.partitionBy("query_id").orderBy("m.part", "m.pos")
    return firsts.select("query_id", "doc_id", F.row_number().over(order).alias("pos"))


def search(index: Store | DataFrame, queries: DataFrame, top_k: int = 20, least: int | None = None, max_candidates: int = MAX_CANDIDATES, vectors: bool = True, semantic: dict | None = None, lexical: dict | None = None, **weights) -> DataFrame:
    """``query_id, doc_id, rank, score`` of ``queries(query_id, query)``.

    Candidates hold enough query terms (one for a single term, else two) or are
    among the nearest vectors; where there is neither, one term is enough.
    ``semantic`` and ``lexical`` are options of :func:`gvsm` and :func:`bm25`,
    ``weights`` those of :func:`fuse`.  Records without an index are indexed first.
    """
    store = _store(index)
    terms = settled(query_terms(queries))  # of the stated queries
    words = asked(terms)
    sizes = settled(queries.select("query_id", F.size(F.array_distinct(tokenize("query"))).alias("k"), F.size(tokenize("query")).alias("k_all"), F.get(tokenize("query"), F.lit(0)).alias("t")))
    needed = F.when(F.col("k") <= 1, 1).otherwise(2) if least is None else F.greatest(F.lit(1), F.least(F.lit(least), F.greatest("k", F.lit(1))))
    limit = sizes.select("query_id", needed.alias("m"))
    post = store.of_terms(words)
    found = kept(matches(post.filter("tf_body > 0"), terms.select("query_id", "term")))
    trie = candidates(found, limit, max_candidates)
    if vectors:
        near = nearest(store, hashed(queries.select("query_id", tokenize("query").alias("terms")), "query_id"), max_candidates)
        single = F.broadcast(sizes.filter("k_all = 1").select("query_id", "t"))
        # a single query token keeps only hits that hold it, in a field or in the URL
        held = post.select("doc_id", F.col("term").alias("t"), F.lit(True).alias("held"))
        tested = near.join(single, "query_id").join(held, ["doc_id", "t"], "left").join(store.forward.select("doc_id", "url"), "doc_id")
        guard = tested.filter(F.coalesce("held", F.lit(False)) | F.contains("url", F.col("t"))).select(*near.columns)
        hits = near.join(single, "query_id", "left_anti").unionByName(guard)
    else:
        hits = trie.select("query_id", "doc_id", F.lit(0.0).alias("vec"), "pos").limit(0)
    hits = kept(hits)
    cands = kept(candidate_union(trie, hits))
    relaxed = candidates(found, limit.join(cands.select("query_id").distinct(), "query_id", "left_anti").withColumn("m", F.lit(1)), max_candidates)
    cands = cands.unionByName(relaxed.select("query_id", "doc_id", "pos"))
    cands = kept(cands.join(store.forward.filter("filled").select("doc_id"), "doc_id", "left_semi"))
    scored = fuse(cands, gvsm(store, terms, of=cands, words=words, **(semantic or {})), bm25(store, terms, words=words, **(lexical or {})), hits, **weights)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "pos")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).select("query_id", "doc_id", "rank", "score")
