"""The engine as one object: search, service, answers and ingest over a DataFrame of records."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.constants import ALPHA, API_TOP_K, BM25_B, BM25_K1, FALLBACK_RESULTS, MAX_CANDIDATES, MIN_COOC, RAG_CHARS, RAG_SENTENCES, RAG_TOP_K, SEARCH_TOP_K, TITLE_WEIGHT, VECTOR_WEIGHT
from corpusloom.functions.text import rag_snippet, sufficient, truncate_answer, without_marker
from corpusloom.operators import rag, ranking, serving, store
from corpusloom.operators.common import settled, shared_folder
from corpusloom.sources.tables import read_jsonl

#: A source of outside results: a query in, ``url, title, text`` and a rank out.
Web = Callable[[str], DataFrame]


class Engine:
    """``records`` has ``doc_id, title, text, url, domain, source_type``.

    The index is built when a query first needs it: at ``index_path``, where one of
    the same records is taken as it is, or in the shared folder.  With ``cooc_path``
    the pair counts that reach ``min_cooc`` are saved too, and read by queries.
    """

    def __init__(
        self, records: DataFrame, index_path: str | None = None, cooc_path: str | None = None, min_cooc: int = MIN_COOC, use_cosine: bool = True, force_rebuild: bool = False,
        alpha: float = ALPHA, title_weight: float = TITLE_WEIGHT, bm25_k1: float = BM25_K1, bm25_b: float = BM25_B, vector_weight: float = VECTOR_WEIGHT, vectors: bool = True,
    ):
        self.records, self.index_path, self.cooc_path, self.force_rebuild = records, index_path, cooc_path, force_rebuild
        self.options = {
            "semantic": {"method": "cosine" if use_cosine else "jaccard", "least": min_cooc},
            "lexical": {"k1": bm25_k1, "b": bm25_b, "title_weight": title_weight}, "alpha": alpha, "share": vector_weight, "vectors": vectors,
        }
        self._store: store.Store | None = None

    @classmethod
    def open(cls, spark: SparkSession, dataset_path: str, index_path: str | None = None, **options) -> "Engine":
        """An engine over JSON lines, whose index lies beside them unless told otherwise."""
        return cls(with_defaults(read_jsonl(spark, dataset_path)), index_path or dataset_path.rstrip("/") + ".index", **options)

    @property
    def index(self) -> store.Store:
        if self._store is None:
            path = self.index_path or shared_folder(self.records.sparkSession, "engine-" + hashlib.sha256(store.fingerprint(self.records).encode()).hexdigest()[:16])
            self._store = store.open_or_build(self.records, path, self.force_rebuild)
            if self.cooc_path:
                self._store.with_pairs(self.cooc_path, self.options["semantic"]["least"], self.force_rebuild)
        return self._store

    def count(self) -> int:
        """How many records have a vector."""
        return self.index.count()

    def _queries(self, queries) -> DataFrame:
        if isinstance(queries, DataFrame):
            return queries
        texts = [queries] if isinstance(queries, str) else list(queries)
        return self.records.sparkSession.createDataFrame(list(enumerate(texts)), "query_id int, query string")

    def search(self, queries, top_k: int = SEARCH_TOP_K, min_match: int | None = None, max_candidates: int = MAX_CANDIDATES) -> DataFrame:
        """``query_id, doc_id, rank, score`` of a text, a list of texts, or ``queries(query_id, query)``."""
        return ranking.search(self.index, self._queries(queries), top_k, min_match, max_candidates, **self.options)

    def serve(self, query: str, top_k: int = API_TOP_K, web: DataFrame | None = None) -> DataFrame:
        """What the search service returns; ``web`` are results of an outside source, used where the gate opens."""
        return serving.endpoint(self.records, self._queries(query), query, top_k, web, self.index, **self.options)

    def respond(self, query: str, top_k: int = API_TOP_K, web: Web | None = None) -> tuple[dict, "Engine"]:
        """The service's answer with its envelope, and the engine that knows the outside results, if any were asked for.

        The outside source is asked only where the gate opens on the local results.
        """
        if not query.strip():
            return {"query": query, "total": 0, "results": [], "web_search_used": False, "local_results": 0, "avg_local_score": 0.0}, self
        local = settled(self.serve(query, top_k))
        engine, used, shown = self, False, local
        if web is not None and serving.fallback_gate(local).first()["triggered"]:
            new = self._indexed(web(query))
            if used := not new.isEmpty():
                outside = new.select("doc_id", "title", "text", "url", "source_type", F.col("score_hint").alias("score"), F.col("web_rank").alias("source_rank"))
                shown, engine = settled(self.serve(query, top_k, outside)), self.ingest(new)
        return serving.envelope(shown, query, local, used), engine

    def retrieve(self, query: str, top_k: int = RAG_TOP_K) -> DataFrame:
        """The ``top_k`` best records with their rank and score."""
        return self.records.join(F.broadcast(settled(self.search(query, top_k).select("doc_id", "rank", "score"))), "doc_id")

    def answer(self, query: str, top_k: int = RAG_TOP_K, max_sentences: int = RAG_SENTENCES, max_chars: int = RAG_CHARS, generator: Callable[[str], str] | None = None, web: Web | None = None) -> DataFrame:
        """One row: ``answer, sources, contexts, total_sources, sufficient, web_search_used``; extractive, or by ``generator`` where that gives text.

        A generator also tells whether the records were sufficient.  Where they
        weren't, the outside source ``web`` is asked, its results are ingested, and
        retrieval and generator run once more.  Sources are the retrieved records
        that the answer uses, contexts all of them, both in the order of ranks.
        """
        first = self._answer(query, top_k, max_sentences, max_chars, generator)
        if web is not None and not first.first()["sufficient"]:
            new = self._indexed(web(query))
            if not new.isEmpty():
                return self.ingest(new)._answer(query, top_k, max_sentences, max_chars, generator).withColumn("web_search_used", F.lit(True))
        return first

    def _answer(self, query, top_k, max_sentences, max_chars, generator) -> DataFrame:
        docs = settled(self.retrieve(query, top_k).select("doc_id", "title", "text", "url", "rank", "score"))  # top_k rows
        out = rag.answer(docs, query, max_sentences, max_chars).select("answer", "sources", F.lit(True).alias("sufficient"))
        if generator is not None:
            # one row, kept: the generator is asked once
            said = settled(rag.generate(rag.prompts(docs, query), generator).select(truncate_answer(without_marker("answer"), max_chars).alias("said"), sufficient("answer").alias("enough")))
            named = rag.attributed(docs.join(F.broadcast(said)), F.col("said")).agg(F.array_join(F.array_sort(F.collect_set("doc_id")), ",").alias("named"))
            some = F.length("said") > 0
            out = out.join(F.broadcast(said)).join(F.broadcast(named)).select(F.when(some, F.col("said")).otherwise(F.col("answer")).alias("answer"), F.when(some, F.col("named")).otherwise(F.col("sources")).alias("sources"), F.col("enough").alias("sufficient"))
        in_order = lambda c, fields: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("rank", F.struct(*fields).alias("d"))))), lambda s: s["d"])
        used = F.array_contains(F.split("sources", ","), F.col("doc_id").cast("string"))
        rows = docs.join(F.broadcast(out)).agg(
            in_order(used, ["doc_id", "title", "url", "score"]).alias("used"), in_order(F.lit(True), ["doc_id", "title", rag_snippet("text").alias("snippet"), "url"]).alias("contexts"))
        return settled(out.join(F.broadcast(rows)).select("answer", "sources", "used", "contexts", F.size("used").alias("total_sources"), "sufficient", F.lit(False).alias("web_search_used")))

    def _indexed(self, web: DataFrame) -> DataFrame:
        """Outside results, at most ``FALLBACK_RESULTS``, as records."""
        by = "web_rank" if "web_rank" in web.columns else "rank"
        return settled(serving.index_external(self.records, web.orderBy(by).limit(FALLBACK_RESULTS), by))

    def ingest(self, new: DataFrame) -> "Engine":
        """The engine over the records with ``new`` ones added or replaced; its index is of all of them."""
        out = Engine.__new__(Engine)
        out.__dict__.update(self.__dict__)
        out.records, out.index_path, out.cooc_path, out._store = serving.ingest(self.records, new.select(*[c for c in self.records.columns if c in new.columns])), None, None, None
        return out

    def search_and_index(self, web: DataFrame, by: str = "web_rank") -> "Engine":
        """The engine over the records and an outside source's results, ranked by ``by``."""
        return self.ingest(serving.index_external(self.records, web, by))

    def should_search_web(self, local_results: int, avg_score: float, enabled: bool = True, only_fallback: bool = True) -> bool:
        """Whether local results are too few and too weak."""
        return serving.triggered(local_results, avg_score, enabled, only_fallback)


def with_defaults(records: DataFrame) -> DataFrame:
    """Records with the columns that the service reads, where a file lacks them."""
    have = set(records.columns)
    add = {c: F.lit(v).cast("string") for c, v in (("title", ""), ("text", ""), ("url", ""), ("domain", None), ("source_type", "webpage"), ("crawl_date", None)) if c not in have}
    return records.withColumns(add) if add else records
