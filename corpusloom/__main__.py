"""Command line: ``crawl``, ``index``, ``search`` and ``answer`` over JSON-lines records, ``serve``."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.constants import API_TOP_K, MAX_DEPTH, MAX_PAGES, MIN_CHARS, PER_DOMAIN, RAG_CHARS, RAG_SENTENCES, RAG_TOP_K
from corpusloom.sources.fetch import AGENT, DELAY, TIMEOUT

log = logging.getLogger("corpusloom")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusloom")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("crawl", help="records of the pages that pass every filter")
    c.add_argument("--pages", help="a snapshot: Parquet with page_id, url, html; without one pages are fetched")
    c.add_argument("--output", required=True)
    c.add_argument("--report")
    c.add_argument("--raw-dir")
    c.add_argument("--save-raw", action="store_true", help="keep the HTML in --raw-dir, or in a folder beside the output")
    c.add_argument("--seeds-file", help="start from these URLs; without them every page of the snapshot is visited")
    c.add_argument("--max-pages", type=int, default=MAX_PAGES)
    c.add_argument("--max-depth", type=int, default=MAX_DEPTH)
    c.add_argument("--min-chars", type=int, default=MIN_CHARS)
    c.add_argument("--per-domain-limit", type=int, default=PER_DOMAIN)
    c.add_argument("--timeout", type=float, default=TIMEOUT)
    c.add_argument("--delay", type=float, default=DELAY)
    c.add_argument("--user-agent", default=AGENT)
    c.add_argument("--log-level", default="INFO")
    c.add_argument("--doc-id-mode", choices=("int", "hash"), default="int")
    c.add_argument("--only-new", action="store_true", help="without URLs and texts that the output has")
    for name in ("index", "search", "answer", "serve"):
        s = sub.add_parser(name)
        s.add_argument("--records", required=True, action="append", help="JSON lines; of several places the first that exists")
        s.add_argument("--index", help="where the index lies; beside the records unless told")
        s.add_argument("--cooc", help="save pair counts there, and read them")
        s.add_argument("--force-rebuild", action="store_true")
        if name == "serve":
            s.add_argument("--host", default="127.0.0.1")
            s.add_argument("--port", type=int, default=5000)
        elif name != "index":
            s.add_argument("--query", required=True)
            s.add_argument("--top-k", type=int, default=API_TOP_K if name == "search" else RAG_TOP_K)
        if name == "answer":
            s.add_argument("--max-sentences", type=int, default=RAG_SENTENCES)
            s.add_argument("--max-chars", type=int, default=RAG_CHARS)
    return top


def crawl(spark: SparkSession, a: argparse.Namespace) -> None:
    from corpusloom.operators import crawl as ops
    from corpusloom.operators.common import kept, with_rank
    from corpusloom.sources import tables
    from corpusloom.sources.fetch import fetcher

    if not a.pages and not a.seeds_file:
        raise SystemExit("crawl needs --pages or --seeds-file")
    if a.save_raw and not a.raw_dir:
        a.raw_dir = a.output.rstrip("/") + ".raw"
    old, hashes, first = None, None, 0
    if a.only_new:
        old, hashes, malformed = tables.scan_output(spark, a.output)
        first = tables.read_jsonl(spark, a.output).agg(F.max("doc_id")).first()[0] or 0
        log.info("the output has %d URLs and %d malformed lines", old.count(), malformed)
    pages = spark.read.parquet(a.pages) if a.pages else None
    shown = ["url", "title", "domain", "text", "language", "relevance_score", "text_hash"]
    if a.seeds_file:
        fetch = ops.snapshot(pages) if a.pages else fetcher(a.timeout, a.delay, a.user_agent)
        raw = (lambda got: tables.write_raw_pages(got, a.raw_dir)) if a.raw_dir else None
        out = kept(ops.crawl(fetch, tables.read_seeds(spark, a.seeds_file), a.max_depth, a.max_pages, a.min_chars, a.per_domain_limit, old, hashes, raw=raw))
        written = out.filter("outcome = 'written'").withColumn("page_id", F.row_number().over(ops.Window.orderBy("depth", "priority", "url")))  # at most --max-pages rows
        shown += ["out_links", "depth", "parent_url"]
    else:
        out = kept(ops.outcomes(pages, a.min_chars, a.per_domain_limit, old, hashes))
        chosen = out.filter("outcome = 'written'").select("page_id", "relevance_score", "text_hash")
        written = ops.extracted(pages).drop("relevance_score", "text_hash").join(chosen, "page_id").withColumn("url", F.col("canonical"))
    rows = with_rank(written.select("page_id", *shown), "page_id", "place")
    doc_id = F.concat(F.lit("web_"), F.substring(F.sha2("url", 256), 1, 16)) if a.doc_id_mode == "hash" else F.lit(first) + F.col("place")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    tables.write_jsonl(rows.select(doc_id.alias("doc_id"), *(c for c in shown if c != "text_hash"), now.alias("crawl_date"), F.lit("webpage").alias("source_type")), a.output)
    if a.raw_dir and not a.seeds_file:
        tables.write_raw_pages(pages, a.raw_dir)
    if a.report:
        tables.write_report(out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")), a.report, "outcome")


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("corpusloom").getOrCreate()
    if a.command == "crawl":
        logging.basicConfig(level=a.log_level.upper())
        return crawl(spark, a)
    from corpusloom.api import Engine
    from corpusloom.sources.tables import first_existing

    engine = Engine.open(spark, first_existing(spark, a.records), a.index, cooc_path=a.cooc, force_rebuild=a.force_rebuild)
    if a.command == "index":
        return print(engine.index.path, engine.index.n_docs, engine.count())
    if a.command == "serve":
        from corpusloom.serve import Service, server

        engine.index  # built before the first request
        return server(Service(engine), a.host, a.port).serve_forever()
    got = engine.serve(a.query, a.top_k) if a.command == "search" else engine.answer(a.query, a.top_k, a.max_sentences, a.max_chars).drop("contexts", "used")
    for row in got.toJSON().collect():  # top-k rows
        print(row)


if __name__ == "__main__":
    main()
