"""Pages from the web: a function over a table of URLs, and a Spark data source around it.

URLs are dealt by domain, so that one task asks a domain, one page after the other,
with a pause in between.  What comes back is ``html``, the language of the header,
and in ``fetched`` a reason where there is no page: ``fetch_errors`` or ``non_html``.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusloom.functions.web import url_domain
from corpusloom.sources.deploy import ship

AGENT, TIMEOUT, DELAY = "corpusloom", 12.0, 1.0
FIELDS = ("url", "html", "fetched", "header_language")
PAGE = T.StructType([T.StructField(n, T.StringType()) for n in FIELDS])


def get(url: str, timeout: float = TIMEOUT, agent: str = AGENT) -> tuple:
    """``url, html, fetched, header_language`` of one page; bytes that don't fit the charset are replaced."""
    try:
        with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
            language = r.headers.get("Content-Language")
            if "text/html" not in (r.headers.get("Content-Type") or "").lower():
                return url, None, "non_html", language
            charset = r.headers.get_content_charset() or "utf-8"
            data = r.read()
    except (OSError, ValueError):  # refused, timed out, no such host, an error status, or no URL
        return url, None, "fetch_errors", None
    try:
        return url, data.decode(charset, "replace"), None, language
    except LookupError:
        return url, data.decode("utf-8", "replace"), None, language


class Pause:
    """Waits so that a domain is asked once in ``delay`` seconds."""

    def __init__(self, delay: float):
        self.delay, self.last = delay, {}

    def before(self, url: str) -> None:
        host = urlsplit(url).netloc.lower()
        wait = self.last.get(host, -1e9) + self.delay - time.monotonic()
        if wait > 0:
            time.sleep(wait)
        self.last[host] = time.monotonic()


def fetch_pages(urls: DataFrame, timeout: float = TIMEOUT, delay: float = DELAY, agent: str = AGENT) -> DataFrame:
    """Fetch ``urls(url)`` where they are dealt to."""
    ship(urls.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pause = Pause(delay)
        for b in batches:
            for u in b["url"]:  # a page at a time: pages are large, and each takes its time
                pause.before(u)
                yield pd.DataFrame([get(u, timeout, agent)], columns=list(FIELDS), dtype=object)

    return urls.select("url").repartition(url_domain("url")).mapInPandas(run, PAGE)


def fetcher(timeout: float = TIMEOUT, delay: float = DELAY, agent: str = AGENT) -> Callable[[DataFrame], DataFrame]:
    """A source for :func:`corpusloom.operators.crawl.crawl`."""
    from corpusloom.operators.common import kept

    # kept: a page is asked for once, whatever reads it
    return lambda urls: kept(fetch_pages(urls, timeout, delay, agent))


class Pages(DataSource):
    """``spark.read.format("loom_pages").option("urls", json list)``; register it with ``spark.dataSource.register(Pages)``.

    Options: ``urls``, ``timeout``, ``delay``, ``user_agent``.
    """

    @classmethod
    def name(cls) -> str:
        return "loom_pages"

    def schema(self) -> T.StructType:
        return PAGE

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = json.loads(options.get("urls", "[]"))
        self.how = float(options.get("timeout", TIMEOUT)), options.get("user_agent", AGENT)
        self.delay = float(options.get("delay", DELAY))

    def partitions(self) -> list[InputPartition]:
        """One for each domain."""
        by: dict[str, list[str]] = {}
        for u in self.urls:
            by.setdefault(urlsplit(u).netloc.lower(), []).append(u)
        return [InputPartition(x) for x in by.values()] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        pause = Pause(self.delay)
        for u in partition.value:
            pause.before(u)
            yield get(u, *self.how)
