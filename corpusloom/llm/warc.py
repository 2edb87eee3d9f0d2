"""WARC archives, and their capture index by external merge.

``write_archives`` writes one record per page, each a gzip member of its own, with
Spark's text writer, so executors write straight to shared storage.  The line
separator is an empty gzip member: it adds nothing to the inflated stream, and
every byte of a file belongs to a member.  A file ends with the record that takes
it past ``volume_bytes``; records are never cut.  Offsets in the index count bytes
of the file, so a record is read by itself from its offset (:func:`record_at`).
``read_archives`` reads member by member, parses by Content-Length and checks
every payload against its digest.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the
largest page_id is a response and the others are revisits without a payload.

The global capture index is an external merge.  The captures of each archive are
sorted by URL key and time in the task that read it (the JVM's sort, which spills)
and written as a run.  Runs are cut into ranges of keys of about ``RANGE_ROWS``
captures; the task of a range receives the slices of all runs as they were written
and merges them with a loser tree.  Nothing is sorted after the runs are written: a
slice that came in pieces is several ascending runs to the tree.  The range includes
time, id and place, so one URL with a third of all captures is spread over several
tasks.

``pages`` has no capture time, so a record's date is its page_id in seconds.

Edge cases: null html is an empty payload; a null URL has an empty key and no
target header; line breaks in URLs are percent-encoded; null ids are written
without an id header and read back as null (of equal payloads that all have
null ids each is a response); rows repeated as a whole are written as often as
they occur; an empty table gives an empty result; extra columns are ignored.  A
single payload may have up to 1 GB, as it is one value of a row.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import discard, materialize, shared_folder, ship

VOLUME_BYTES = 64 << 20  # a file ends with the record that reaches this
RANGE_ROWS = 200_000  # captures that one task merges
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def url_key(url):
    """Host labels reversed, then path and query: captures of a site sort together."""
    lower = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(lower, r"\.")), ","), F.lit(")"), rest), F.lit(""))


def records(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``value``: one WARC record a page."""
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    base = base.withColumn("bytes", F.octet_length("payload")).withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    heads = materialize(base.filter(F.col("bytes") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND head IS NOT NULL").select("sha", "head"))
    both = base.join(heads, "sha", "left")
    revisit = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    date = F.date_format(F.timestamp_seconds(F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = lambda name, value: F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), F.when(revisit, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Target-URI", uri), line("WARC-Date", date), line("X-Page-Id", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha"))),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("head").cast("string"), F.lit(">")))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "))
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("payload")))
    size = F.when(revisit, F.lit(len(HTTP))).otherwise(F.lit(len(HTTP)) + F.col("bytes"))
    return both.select(F.concat(head, size.cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n")).alias("value"))


def member(data: bytes) -> bytes:
    """A gzip member."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


#: An empty member, as text of single bytes.
SEPARATOR = member(b"").decode("latin-1")


def _volumes(volume_bytes: int):
    """Members of the records, and the number of the file that each goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        volume, fill = 0, 0
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                members, volumes = [], []
                for x in batch.column(0).slice(a, 256):
                    members.append(member(x.as_buffer().to_pybytes()))
                    volumes.append(volume)
                    fill += len(members[-1]) + len(SEPARATOR)
                    if fill >= volume_bytes:
                        volume, fill = volume + 1, 0
                yield pa.RecordBatch.from_arrays([pa.array(volumes, pa.int32()), pa.array(members, pa.binary())], names=["volume", "value"])

    return run


def write_archives(pages: DataFrame, path: str, min_bytes: int = 1000, volume_bytes: int = VOLUME_BYTES) -> None:
    """Archives below ``path``: a file for each task and volume."""
    ship(pages.sparkSession)
    packed = records(pages, min_bytes).select(F.col("value").cast("binary")).mapInArrow(_volumes(volume_bytes), "volume int, value binary")
    packed.select("volume", F.col("value").cast("string").alias("value")).write.partitionBy("volume").option("lineSep", SEPARATOR).option("encoding", "ISO-8859-1").text(path)


RECORD = "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, url string, captured string, run string, offset long"


def members(data) -> Iterator[tuple[bytes, int]]:
    """(inflated bytes, offset) of each member of a file that isn't empty."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts, end = zlib.decompressobj(wbits=31), [], at
        while not z.eof:
            if end >= len(view):
                raise ValueError(f"the member at byte {at} has no end")
            try:
                parts.append(z.decompress(view[end : end + 65536]))
            except zlib.error as e:
                raise ValueError(f"no gzip member at byte {at}") from e
            end += min(65536, len(view) - end)
        if record := b"".join(parts):
            yield record, at
        at = end - len(z.unused_data)


def parse(record: bytes) -> tuple[dict, memoryview]:
    """Headers and block of an inflated record."""
    if not record.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    end = record.index(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in record[:end].decode("utf-8").split("\r\n")[1:])
    size = int(headers["Content-Length"])
    if record[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError("a record has no end")
    return headers, memoryview(record)[end + 4 : end + 4 + size]


def record_at(data: bytes, offset: int) -> tuple[dict, memoryview]:
    """The record that starts at ``offset`` of a file, without reading what is before or after it."""
    return parse(next(members(memoryview(data)[offset:]))[0])


def _number(urn: str | None):
    return int(urn.rsplit(":", 1)[1][:-1]) if urn else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.strip().split(" ")[0] for x in RECORD.split(",")]
    kinds = [pa.int64() if x.strip().endswith("long") else pa.string() for x in RECORD.split(",")]

    def out(rows):
        cols = list(zip(*rows)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            rows, run = [], "/".join(path.as_py().rsplit("/", 2)[1:])
            for record, offset in members(content.as_buffer()):
                h, block = parse(record)
                kind, sha = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
                payload = block[bytes(block[:2048]).index(b"\r\n\r\n") + 4 :]
                if kind == "response" and hashlib.sha1(payload).hexdigest() != sha:
                    raise ValueError(f"the payload of {h['WARC-Record-ID']} doesn't match its digest")
                rows.append((int(h["X-Page-Id"]) if "X-Page-Id" in h else None, kind, sha, len(payload) if kind == "response" else None, _number(h.get("WARC-Refers-To")), h.get("WARC-Target-URI"), h["WARC-Date"], run, offset))
                if len(rows) == 8192:
                    yield out(rows)
                    rows = []
            yield out(rows)


#: The order of captures; the last two make it total.
ORDER = ("key", "captured", "none", "page_id", "run", "offset")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a record, the records of an archive as a run in the order of captures.

    A revisit has no payload and no size of its own (:func:`with_sizes`).
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")
    got = files.mapInArrow(_read, RECORD).withColumn("key", url_key(F.col("url"))).withColumn("none", F.col("page_id").isNull())
    return materialize(got.sortWithinPartitions("run", *(c for c in ORDER if c != "run")))


def with_sizes(captures: DataFrame) -> DataFrame:
    """Revisits with the size of the payload of the response that they refer to."""
    own, again = captures.filter("record_type = 'response'"), captures.filter("record_type = 'revisit'").drop("payload_bytes")
    sizes = own.filter("page_id IS NOT NULL").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest")).agg(F.max("payload_bytes").alias("payload_bytes"))
    return own.unionByName(again.join(materialize(sizes), ["refers_to", "payload_digest"], "left"))


class LoserTree:
    """k-way merge: the leaves are sorted runs, each inner node keeps the loser of its match."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.tree = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, winner: int) -> None:
        at = (winner + self.k) // 2
        while at > 0:
            if self.tree[at] == -1:  # the first to come waits for its match
                self.tree[at] = winner
                return
            if self._beats(self.tree[at], winner):
                winner, self.tree[at] = self.tree[at], winner
            at //= 2
        self.tree[0] = winner

    def __iter__(self):
        while (w := self.tree[0]) != -1 and self.heads[w] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self._play(w)


def slices(batches: Iterator[pa.RecordBatch]) -> tuple[list[pa.RecordBatch], list[list[tuple[int, int]]]]:
    """The batches, and the ascending runs among their rows: each a list of spans of row numbers."""
    parts, runs, row = [], [], 0
    last, ends = {}, {}  # by archive: its last capture, and the run that it is the end of
    for b in batches:
        parts.append(b)
        for at, key in enumerate(zip(*(b.column(n).to_pylist() for n in ORDER)), row):
            key = tuple(x if x is not None else 0 for x in key)
            archive = key[4]
            if archive not in last or key < last[archive]:
                ends[archive] = []
                runs.append(ends[archive])
            spans = ends[archive]
            if spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + 1)
            else:
                spans.append((at, at + 1))
            last[archive] = key
        row += b.num_rows
    return parts, runs


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the slices of all runs that fall into this range of keys."""
    parts, runs = slices(batches)
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    columns = [table.column(n).combine_chunks() for n in ORDER]

    def stream(spans):
        for a, b in spans:
            for at in range(a, b, 1024):
                n = min(1024, b - at)
                yield from zip(*([x if x is not None else 0 for x in c.slice(at, n).to_pylist()] for c in columns), range(at, at + n))

    order = [x[-1] for x in LoserTree([stream(r) for r in runs])]
    table = table.take(pa.array(order, pa.int64()))
    table = table.append_column("part", pa.array([TaskContext.get().partitionId()] * len(order), pa.int64()))
    table = table.append_column("at", pa.array(range(len(order)), pa.int64()))
    yield from table.to_batches(max_chunksize=16384)


def merge_index(captures: DataFrame) -> DataFrame:
    """The captures of sorted runs with ``capture_rank``, their place in the global order of key and time."""
    ship(captures.sparkSession)
    kinds = ", ".join(f"{n} {t}" for n, t in captures.dtypes)
    ranges = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(captures.count() / RANGE_ROWS))
    merged = materialize(captures.repartitionByRange(ranges, *ORDER).mapInArrow(_merge, f"{kinds}, part long, at long"))
    # one row for each range
    before = merged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    return merged.join(before.select("part", "before"), "part").withColumn("capture_rank", F.coalesce("before", F.lit(0)) + F.col("at")).drop("part", "at", "before", "none")


def round_trip(pages: DataFrame, min_bytes: int = 1000, path: str | None = None) -> DataFrame:
    """Write the archives, read them back, merge their index.

    Without a ``path`` they lie in the shared folder until they have been read.
    """
    spark = pages.sparkSession
    place = path or shared_folder(spark, "warc")
    write_archives(pages, place, min_bytes)
    captures = read_archives(spark, place)
    if path is None:
        discard(spark, place)
    return with_sizes(materialize(merge_index(captures))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("key").alias("url_key"), "captured", "capture_rank", F.col("run").alias("archive"), F.col("offset").alias("archive_offset"))
