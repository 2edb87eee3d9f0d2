"""Near-duplicate classes: BagMinHash signatures, bands, verified multiset overlap.

Two texts are linked when the weighted Jaccard coefficient of their multisets
of five-word shingles is at least 0.8; a class is a connected component of
links.  Words are runs of characters other than ASCII white space.

Shape of the plan, none of whose steps gathers a group in one task:

1. Texts become digests and signatures; equal texts fold into one node (with
   map-side partial aggregates, so a hot text leaves a partition once).
2. Every node puts ``BANDS`` hashes of ``ROWS`` registers each; nodes that share
   one are a bucket.  In a bucket all members are compared with the one that
   meets most others (a star, not all pairs).  Pairs whose signatures agree in
   less than ``SCREEN`` of the registers are dropped (five standard errors below
   0.8), the others are verified on their whole texts.
3. The components of these links tell which members of a bucket are still
   apart.  First their signatures alone meet, in blocks of ``SIGNS`` nodes; only
   nodes that agree there with one of another component in ``SCREEN`` of the
   registers go on, and only with the blocks where they do.  Then texts are compared
   in blocks of ``CHUNK`` of those that are left, where sums of products give all
   multiset overlaps at once, and only links leave a block.  Buckets with the same
   members, compared member by member, are read once.
4. Components come from minimum labels over links with pointer jumping,
   checkpointed each round; at most ``FEW`` links are joined up by one task, as
   the rounds would write many more small files than rows.

With ``m = 80`` a pair at exactly 0.8 shares no band with probability 2.6e-5.

Edge cases: null and empty texts have no shingles and form one class; texts of
1 to 4 words have one shingle, all their words; rows repeated as a whole are
members of a class like any other, and one row of each class is kept; a null id is null in
the report, and its class carries the smallest id that isn't null (null if
there is none); an empty table gives an empty result; extra columns are
ignored by the report and returned untouched by :func:`deduplicate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bagminhash import jaccard, mix, shingle_counts, signatures
from corpusloom.llm.common import fresh, materialize, quoted, ship, text_of, tidy

BANDS, ROWS = 20, 4
M = BANDS * ROWS
SCREEN = 0.55
CHUNK = 384  # texts of a side that a block holds
SIGNS = 256  # signatures of a side that a block holds
FEW = 1 << 13  # links whose components one task finds


class _Words(dict):
    """64-bit hashes of words, kept while few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 60_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def hashed_words(text: str, memo: _Words) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


NODE = "digest string, doc_id long, sig binary, bands array<long>"


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                doc, h, w = shingle_counts([hashed_words(t, memo) for t in texts], k)
                sig = signatures(doc, h, w, len(texts), M)
                band = np.repeat(salt[None], len(texts), 0)
                for r in range(ROWS):
                    band = mix(band ^ sig[:, r::ROWS][:, :BANDS])
                small = (sig >> np.uint64(32)).astype("<u4")
                yield pa.RecordBatch.from_arrays([
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts], pa.string()),
                    part.column(0), pa.array([x.tobytes() for x in small], pa.binary()),
                    pa.array(list(band.view(np.int64)), pa.list_(pa.int64())),
                ], names=["digest", "doc_id", "sig", "bands"])

    return run


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The share of registers in which two signatures agree."""
    for b in batches:
        n = b.num_rows
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u4").reshape(n, M) if n else np.zeros((0, M)) for c in ("sx", "sy"))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array((x == y).mean(1) if n else [], pa.float64())], names=["a", "b", "near"])


def _verify(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        last: tuple = (None, None)
        for b in batches:
            out = []
            for x, tx, ty in zip(b.column("b").to_pylist(), b.column("tx"), b.column("ty")):
                if last[0] != x:  # one centre after the other
                    _, h, w = shingle_counts([hashed_words(ty.as_py(), memo)], k)
                    last = (x, (h, w))
                _, h, w = shingle_counts([hashed_words(tx.as_py(), memo)], k)
                out.append(jaccard((h, w), last[1]))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out, pa.float64())], names=["a", "b", "j"])

    return run


def _linked(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """Those of distinct ``pairs(a, b)`` that reach the threshold."""
    sig = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sx"))
    other = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sy"))
    near = pairs.join(sig, "a").join(other, "b").select("a", "b", "sx", "sy").mapInArrow(_agree, "a long, b long, near double")
    check = materialize(near.filter(F.col("near") >= SCREEN).select("a", "b"))
    tx = texts.select(F.col("node").alias("a"), F.col("text").alias("tx"))
    ty = texts.select(F.col("node").alias("b"), F.col("text").alias("ty"))
    both = check.join(tx, "a").join(ty, "b").select("a", "b", "tx", "ty")
    return materialize(both.mapInArrow(_verify(k), "a long, b long, j double").filter(F.col("j") >= threshold).select("a", "b"))


def _open_buckets(members: DataFrame) -> DataFrame:
    """``bucket, major, c, n``: buckets of three members and more, whose members are in several components.

    ``members`` has ``bucket, node, label``.  Of buckets with the same members one
    is left: sums of hashes propose which these are, and a join of their members
    tells, so no bucket goes by chance.
    """
    per = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"), F.sum(F.shiftright(F.xxhash64("node"), 12)).alias("s"))
    per = per.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("parts")).filter("n > 2 AND parts > 1")
    per = materialize(per.select("bucket", F.col("m.label").alias("major"), F.col("m.c").alias("c"), "n", "s"))
    first = per.groupBy("n", "s").agg(F.min("bucket").alias("first"))
    like = materialize(per.join(first, ["n", "s"]).filter("bucket <> first").select("bucket", "first"))
    mine = members.join(like, "bucket").select("bucket", "first", "node")
    same = mine.join(members.select(F.col("bucket").alias("first"), "node"), ["first", "node"]).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return materialize(per.join(same, ["bucket", "n"], "left_anti").select("bucket", "major", "c", "n"))


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """``rows(bucket, node, out, ca, co, ...)`` copied to the blocks ``kind, i, j`` that hold them.

    ``out`` tells members outside their bucket's largest component, ``ca`` and ``co``
    count members inside and outside.  Those inside needn't meet each other; blocks
    of those outside meet theirs and each other.
    """
    rows = rows.withColumns({n: F.ceil(F.col(n) / size).cast("int") for n in ("ca", "co")})
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.when(F.col("out"), F.col("co")).otherwise(F.col("ca")))).cast("int"))
    at = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.col(n)), lambda x: x < F.col(n))
    # a block of those outside meets itself where it meets the first inside, or alone where none is inside
    within = F.filter(upto("co"), lambda x: (x != F.col("chunk")) | (F.col("ca") == 0))
    mixed = F.concat(
        F.transform(upto("ca"), lambda x: at("oa", F.col("chunk"), x)),
        F.transform(within, lambda x: at("oo", F.least("chunk", x), F.greatest("chunk", x))))
    plain = F.transform(upto("co"), lambda x: at("oa", x, F.col("chunk")))
    return rows.select("bucket", "node", "label", "out", F.inline(F.when(F.col("out"), mixed).otherwise(plain)), *(c for c in ("sig",) if c in rows.columns))


def _near_rows(block: pa.Table) -> pa.Table:
    """The nodes of a block that agree with one of another component in ``SCREEN`` of the registers."""
    n, label = block.num_rows, block.column("label").to_numpy()
    out = np.array(block.column("out").to_pylist(), bool)
    sig = np.frombuffer(b"".join(block.column("sig").to_pylist()), "<u4").reshape(n, M)
    left, hit = np.flatnonzero(out), np.zeros(n, bool)
    least = int(np.ceil(SCREEN * M - 1e-9))
    columns = np.ascontiguousarray(sig.T)
    for a in range(0, len(left), 256):
        rows = left[a : a + 256]
        agree = np.zeros((len(rows), n), np.uint8)
        for r in columns:
            agree += r[rows][:, None] == r[None]
        near = (agree >= least) & (label[rows][:, None] != label[None])
        hit[rows] |= near.any(1)
        hit |= near.any(0)
    at = np.flatnonzero(hit)
    return block.select(["bucket", "node", "label", "out"]).take(pa.array(at))


def _apart(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """``bucket, kind, i, j, node, label, out``: the texts' comparisons that the stars leave open, in blocks."""
    one = _open_buckets(members)
    rows = members.select("bucket", "node", "label").join(one, "bucket").select("bucket", "node", "label", (F.col("label") != F.col("major")).alias("out"), F.col("c").alias("ca"), (F.col("n") - F.col("c")).alias("co"))
    signed = _dealt(rows.join(nodes.select("node", "sig"), "node"), SIGNS).groupBy("bucket", "kind", "i", "j")
    near = materialize(signed.applyInArrow(_near_rows, "bucket long, node long, label long, out boolean")).distinct()
    count = near.groupBy("bucket").agg(F.sum((~F.col("out")).cast("long")).alias("ca"), F.sum(F.col("out").cast("long")).alias("co"))
    return _dealt(near.join(materialize(count), "bucket"), CHUNK)


def _block(threshold: float, k: int):
    """Links between different components among the rows of a block, one for each node and component."""

    def run(block: pa.Table) -> pa.Table:
        node, label = block.column("node").to_numpy(), block.column("label").to_numpy()
        out = np.array(block.column("out").to_pylist(), bool)
        memo = _Words()
        doc, h, w = shingle_counts([hashed_words(t, memo) for t in block.column("text").to_pylist()], k)
        size = np.bincount(doc, weights=w, minlength=len(node))
        # the c-th copy of a shingle is an element of its own: sets with the multisets' overlap
        copy = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        element, owner = mix(np.repeat(h, w) + copy.astype(np.uint64)), np.repeat(doc, w)
        _, column, count = np.unique(element, return_inverse=True, return_counts=True)
        shared = count[column] > 1  # the others overlap with nothing
        column, owner = column[shared], owner[shared]
        column = np.unique(column, return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        left = np.flatnonzero(out)
        overlap = np.zeros((len(left), len(node)), np.float32)
        width = 4096
        for a in range(0, int(column.max()) + 1 if len(column) else 0, width):
            z = slice(*np.searchsorted(column, (a, a + width)))
            x = np.zeros((len(node), width), np.float32)
            x[owner[z], column[z] - a] = 1
            overlap += x[left] @ x.T
        total = size[left][:, None] + size[None]
        linked = (overlap >= threshold * (total - overlap) * (1 - 1e-6)) & (label[left][:, None] != label[None]) & (overlap > 0)
        found = {}
        for i, j in zip(*np.nonzero(linked)):
            shared_n = float(overlap[i, j])
            if shared_n / (size[left[i]] + size[j] - shared_n) >= threshold:
                found.setdefault((left[i], label[j]), j)
        return pa.table({"a": pa.array([node[i] for i, _ in found], pa.int64()), "b": pa.array([node[j] for j in found.values()], pa.int64())})

    return run


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest node that each node of some links can reach through them."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while top.setdefault(root, root) != root:
            root = top[root]
        while top[x] != root:
            top[x], x = root, top[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    nodes = list(top)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "label"])


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links(a, b)``: the smallest node that it can reach."""
    if links.count() <= FEW:
        return materialize(links.select("a", "b").coalesce(1).mapInArrow(_joined_up, "node long, label long"))
    edges = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    labels = materialize(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("seen"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "seen").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        step = materialize(step.join(jump, "next").select("node", "label", F.least("next", "far").alias("next")))
        moved = not step.filter("label <> next").isEmpty()
        labels = step.select("node", F.col("next").alias("label"))
        if not moved:
            return labels


def _elect(members: DataFrame) -> DataFrame:
    """Add ``centre``, the member of each bucket that meets most others.

    The choice is checkpointed: with an aggregate in the join's stage a hot bucket couldn't be split.
    """
    best = materialize(members.groupBy("bucket").agg(F.max(F.struct("fame", "node")).alias("m")).select("bucket", F.col("m.node").alias("centre")))
    return members.select("bucket", "node").join(best, "bucket")


def _texts(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, text`` of the nodes that share a bucket."""
    with_digest = base.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    return materialize(with_digest.join(materialize(wanted), "digest").groupBy("node").agg(F.first("text").alias("text")))


def _classes(docs: DataFrame, threshold: float, k: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``(doc_id, digest, row)`` and nodes ``(digest, node, label)``."""
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    signed = materialize(base.mapInArrow(_sign(k), NODE).withColumn("row", F.monotonically_increasing_id()))
    rows = signed.select("doc_id", "digest", "row")
    nodes = signed.groupBy("digest").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()))
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    crowd = materialize(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    state = materialize(members.join(crowd, "bucket"))
    # a node that meets many others is the best centre of a star
    fame = materialize(state.groupBy("node").agg(F.sum("n").alias("fame")))
    state = materialize(_elect(materialize(state.join(fame, "node"))))
    texts = _texts(base, nodes.join(fame.select("node"), "node").select("node", "digest"))
    tidy(docs.sparkSession)
    pairs = state.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    links = _linked(pairs, nodes, texts, threshold, k)
    tidy(docs.sparkSession)
    labels = None if links.isEmpty() else components(links)
    of = fame.select("node", F.col("node").alias("label")) if labels is None else fame.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    apart = materialize(_apart(materialize(state.join(materialize(of), "node")), nodes))
    tidy(docs.sparkSession)
    if not apart.isEmpty():
        held = apart.join(texts, "node").groupBy("bucket", "kind", "i", "j")
        more = materialize(held.applyInArrow(_block(threshold, k), "a long, b long"))
        if not more.isEmpty():
            labels = components(more if labels is None else links.unionByName(more))
    if labels is None:
        return rows, nodes.select("digest", "node", F.col("node").alias("label"))
    named = nodes.select("digest", "node").join(labels, "node", "left").select("digest", "node", F.coalesce("label", "node").alias("label"))
    return rows, materialize(named)


def _kept(of: DataFrame) -> DataFrame:
    """``label, kept, class_size``: the row of each class of ``of(doc_id, digest, row, label)`` that stays, by id, then digest, then row."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "row"))
    return materialize(of.groupBy("label").agg(first.alias("kept"), F.count(F.lit(1)).alias("class_size")))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, class_size, kept`` for every row; the class id is its smallest doc_id.

    One row of a class is kept, also of rows that are repeated as a whole.
    """
    rows, nodes = _classes(docs, threshold, k, id_col, text_col)
    of = materialize(rows.join(nodes.select("digest", "label"), "digest"))
    return of.join(_kept(of), "label").select("doc_id", F.col("kept.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("kept.row")).alias("kept"))


def deduplicate(docs: DataFrame, threshold: float = 0.8, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, that with the smallest id, with all its columns."""
    rows, nodes = _classes(docs, threshold, k, id_col, text_col)
    of = materialize(rows.join(nodes.select("digest", "label"), "digest"))
    # rows with the id and text of one that stays: ids and digests fold before the shuffle
    alike = of.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("a0"), F.col("digest").alias("a1"))
    stay = _kept(of).select(F.col("kept.doc_id").alias("s0"), F.col("kept.digest").alias("s1"))
    stay = materialize(stay.join(alike, stay["s0"].eqNullSafe(alike["a0"]) & (stay["s1"] == alike["a1"]), "left").select("s0", "s1", F.col("a1").isNotNull().alias("several")))
    i, d = fresh(docs, "id", "digest")
    out = docs.withColumns({i: F.col(id_col).cast("long"), d: F.sha2(text_of(text_col).cast("binary"), 256)})

    def among(found: DataFrame) -> DataFrame:
        return out.join(found, out[i].eqNullSafe(found["s0"]) & (out[d] == found["s1"]), "left_semi")

    several = stay.filter("several")
    if several.isEmpty():
        return among(stay).select(*quoted(docs))
    return among(stay.filter("NOT several")).select(*quoted(docs)).unionByName(among(several).dropDuplicates([d]).select(*quoted(docs)))
