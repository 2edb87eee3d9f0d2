"""Exact de-duplication with a cuckoo-filter index of live digests.

Texts are equal when they are identical after every character of
``[\\x20\\x09-\\x0D]`` is deleted.  Of equal texts the row with the most code
points stays, then the smallest ``doc_id`` (nulls last).

Shape of the plan:

1. The JVM reduces every row to ``(doc_id, n_chars, digest)``.
2. Each scan partition folds its rows into a local :class:`CuckooIndex`, so a
   digest that a third of all rows share leaves a partition as one entry.
3. The entries go to the index partition that owns the digest (digests are
   uniform, so partitions are even, and there is one for every ``PARTITION_ROWS``
   rows at least) and are folded into that partition's index.
4. Rows meet their survivor in one join on the digest, which adaptive
   execution splits where one digest is hot.

Edge cases: a null text counts as empty; empty texts form one group; a null
``doc_id`` is kept as null and loses ties; of rows repeated as a whole one
stays; an empty table gives an empty result; extra columns are ignored by the
report and returned untouched by :func:`deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import WS, fresh, materialize, quoted, ship, text_of

SLOTS = 4
MAX_KICKS = 200
PARTITION_ROWS = 250_000  # entries that one index holds at most, but for chance


class CuckooIndex:
    """A cuckoo filter over digests, backed by bucketed entries.

    ``digest`` is a hexadecimal string of at least 24 digits.  The filter
    holds 16-bit fingerprints, four to a bucket; its answer "no" is final, and
    a "maybe" is verified against the stored entries of the digest's content
    bucket.  When an insertion finds no place after ``MAX_KICKS`` moves, the
    filter doubles and is refilled from the stored keys.
    """

    CONTENT_BITS = 12

    def __init__(self, buckets: int = 1024):
        self.size = 1 << max(1, (buckets - 1).bit_length())
        self.table: list[list[int]] = [[] for _ in range(self.size)]
        self.content: list[dict] = [{} for _ in range(1 << self.CONTENT_BITS)]
        self.live = 0
        self.resizes = 0

    # -- addresses -----------------------------------------------------
    @staticmethod
    def _print(digest: str) -> int:
        return int(digest[:4], 16) or 1

    def _home(self, digest: str) -> int:
        return int(digest[4:20], 16) & (self.size - 1)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.size - 1)

    def _bucket(self, digest: str) -> dict:
        return self.content[int(digest[20:24], 16) & ((1 << self.CONTENT_BITS) - 1)]

    # -- filter --------------------------------------------------------
    def maybe(self, digest: str) -> bool:
        mark, a = self._print(digest), self._home(digest)
        return mark in self.table[a] or mark in self.table[self._other(a, mark)]

    def _place(self, digest: str) -> bool:
        mark, a = self._print(digest), self._home(digest)
        b = self._other(a, mark)
        for x in (a, b):
            if len(self.table[x]) < SLOTS:
                self.table[x].append(mark)
                return True
        at = b if (mark ^ a) & 1 else a
        for step in range(MAX_KICKS):
            row, k = self.table[at], step % SLOTS
            row[k], mark = mark, row[k]
            at = self._other(at, mark)
            if len(self.table[at]) < SLOTS:
                self.table[at].append(mark)
                return True
        return False

    def _grow(self) -> None:
        """Double until every stored key has a place."""
        while True:
            self.size *= 2
            self.resizes += 1
            self.table = [[] for _ in range(self.size)]
            if all(self._place(d) for part in self.content for d in part):
                return

    # -- entries -------------------------------------------------------
    def get(self, digest: str):
        return self._bucket(digest).get(digest) if self.maybe(digest) else None

    def put(self, digest: str, value) -> None:
        """Insert, or replace the entry of a live digest."""
        known = self.get(digest) is not None
        self._bucket(digest)[digest] = value
        if known:
            return
        self.live += 1
        if not self._place(digest):
            self._grow()

    def delete(self, digest: str) -> bool:
        """Remove a live digest; False if it isn't live."""
        if self.get(digest) is None:
            return False
        del self._bucket(digest)[digest]
        mark, a = self._print(digest), self._home(digest)
        at = a if mark in self.table[a] else self._other(a, mark)
        self.table[at].remove(mark)
        self.live -= 1
        return True

    def items(self) -> Iterator[tuple]:
        for part in self.content:
            yield from part.items()

    def __len__(self) -> int:
        return self.live


ENTRY = "digest string, keep_id long, keep_chars long, keep_row long, group_size long, ties long"


def _order(entry) -> tuple:
    """The smallest stays: most code points, smallest id (null last), first row."""
    keep_id, chars, row = entry[0], entry[1], entry[2]
    return (-chars, keep_id is None, keep_id if keep_id is not None else 0, row)


def _better(old, new) -> tuple:
    """The entry of two folded: who stays, the rows of both, and how many of them can't be told from who stays."""
    best, other = (old, new) if _order(old) <= _order(new) else (new, old)
    same = best[:2] == other[:2]
    return (*best[:3], old[3] + new[3], best[4] + (other[4] if same else 0))


def _fold(batches: Iterator[pa.RecordBatch], limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Fold entries into one cuckoo index and hand out what is live at the end, or whenever ``limit`` are."""
    kinds = [("digest", pa.string()), *((n, pa.int64()) for n in ("keep_id", "keep_chars", "keep_row", "group_size", "ties"))]
    schema = pa.schema(kinds)

    def live(index):
        rows = []
        for digest, value in index.items():
            rows.append((digest, *value))
            if len(rows) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], schema=schema)

    index = CuckooIndex()
    for batch in batches:
        for digest, *new in zip(*(c.to_pylist() for c in batch.columns)):
            old = index.get(digest)
            index.put(digest, tuple(new) if old is None else _better(old, tuple(new)))
        if limit is not None and len(index) >= limit:
            yield from live(index)
            index = CuckooIndex()
    yield from live(index)


def _fold_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _fold(batches, PARTITION_ROWS)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_code_points, digest, row)`` for every row, cut from its lineage."""
    text = text_of(text_col)
    return materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.length(text).cast("long").alias("chars"),
            F.sha2(F.translate(text, WS, ""), 256).alias("digest"),
        ).withColumn("row", F.monotonically_increasing_id())
    )


def entries(keys: DataFrame) -> DataFrame:
    """Index entries of single rows, folded where they are."""
    one = F.lit(1).cast("long")
    return keys.select("digest", F.col("doc_id").alias("keep_id"), F.col("chars").alias("keep_chars"), F.col("row").alias("keep_row"), one.alias("group_size"), one.alias("ties")).mapInArrow(_fold_some, ENTRY)


def _owned(found: DataFrame, rows: int) -> DataFrame:
    """Entries dealt to the index partitions that own their digests."""
    parts = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PARTITION_ROWS))
    return found.repartition(parts, "digest")


def survivors(keys: DataFrame) -> DataFrame:
    """One row for each distinct digest: who stays, how many rows share it, and how many rows are repeats of who stays."""
    ship(keys.sparkSession)
    # checkpointed, so that the joins below see a plain exchange on either side and skew can be split
    return materialize(_owned(entries(keys), keys.count()).mapInArrow(_fold, ENTRY))


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    keys = digests(docs, id_col, text_col)
    best = survivors(keys)
    return keys.join(best, "digest").select(
        "doc_id", "keep_id", "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    A row stays if digest, length and id are those of its group's survivor; of
    rows that are alike in all three, one stays.
    """
    best = survivors(digests(docs, id_col, text_col))
    d, n, i = fresh(docs, "digest", "chars", "id")
    text = text_of(text_col)
    out = docs.withColumns({d: F.sha2(F.translate(text, WS, ""), 256), n: F.length(text).cast("long"), i: F.col(id_col).cast("long")})

    def among(found: DataFrame) -> DataFrame:
        stay = found.select(F.col("digest").alias("s0"), F.col("keep_chars").alias("s1"), F.col("keep_id").alias("s2"))
        return out.join(stay, (out[d] == stay["s0"]) & (out[n] == stay["s1"]) & out[i].eqNullSafe(stay["s2"]), "left_semi")

    alike = best.filter("ties > 1")
    if alike.isEmpty():
        return among(best).select(*quoted(docs))
    return among(best.filter("ties = 1")).select(*quoted(docs)).unionByName(among(alike).dropDuplicates([d]).select(*quoted(docs)))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The live entries as a table (write it bucketed by ``digest``)."""
    return survivors(digests(docs, id_col, text_col))


def delete_from_index(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without the digests of ``gone(digest)``.

    Both sides meet in the index partition that owns the digest; each rebuilds
    its filter from the stored keys and deletes.
    """
    ship(index.sparkSession)

    def drop(parts):
        live, dead = CuckooIndex(), []
        names = [x.strip().split(" ")[0] for x in ENTRY.split(",")]
        schema = None
        for b in parts:
            schema = b.schema
            for row in b.to_pylist():
                (dead.append(row["digest"]) if row["dead"] else live.put(row["digest"], tuple(row[n] for n in names[1:])))
        for d in dead:
            live.delete(d)
        if schema is not None:
            rows = [(k, *v) for k, v in live.items()]
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, cols)], names=names)

    both = index.withColumn("dead", F.lit(False)).unionByName(gone.select("digest").distinct().withColumn("dead", F.lit(True)), allowMissingColumns=True)
    return _owned(both, index.count()).mapInArrow(drop, ENTRY)


def insert_into_index(index: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index with the rows of ``docs`` folded in."""
    ship(index.sparkSession)
    keys = digests(docs, id_col, text_col)
    return _owned(index.unionByName(entries(keys)), index.count() + keys.count()).mapInArrow(_fold, ENTRY)
