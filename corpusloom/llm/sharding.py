"""Byte-balanced sharding by Karmarkar-Karp differencing.

Groups of equal texts are indivisible: all their rows share a shard.  A group
larger than an ideal shard makes its shard the largest, and no assignment could
do otherwise; ``shard_bytes`` tells the size of every row's shard, so that the
imbalance can be seen.

Shape of the plan: the JVM sums bytes by digest (with map-side partial sums);
chunks of a bounded number of groups are differenced in parallel, each giving
a partial partition of ``shards`` sums; partial partitions are then differenced
in a tree of bounded fan-in until one is left.  Only sums travel up the tree,
and bin numbers come down by joins.

Edge cases: a null text has no bytes (size 1) and groups with the empty text;
null and repeated ``doc_id`` values are ordinary rows; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import materialize, ship, text_of

CHUNK = 4000  # groups differenced by one task
FAN_IN = 64  # partial partitions combined by one task
SLICE = 2000  # rows numbered by one window partition
SALT = 1024


def difference(partials: list[list[int]], shards: int) -> tuple[list[int], list[list[int]]]:
    """Combine partial partitions by largest differencing.

    Each partial is a list of ``shards`` sums.  The two with the largest
    spread are added with opposite order until one is left.  Returns the final
    sums and, for each partial, the final bin of each of its bins.
    """
    heap, nodes = [], []
    for k, sums in enumerate(partials):
        order = sorted(range(shards), key=lambda b: (-sums[b], b))
        nodes.append((k, order))
        ranked = [sums[b] for b in order]
        heapq.heappush(heap, (-(ranked[0] - ranked[-1]), k, ranked))
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        merged = [x[i] + y[shards - 1 - i] for i in range(shards)]
        order = sorted(range(shards), key=lambda i: (-merged[i], i))
        nodes.append(((a, b), order))
        ranked = [merged[i] for i in order]
        heapq.heappush(heap, (-(ranked[0] - ranked[-1]), len(nodes) - 1, ranked))
    if not heap:
        return [0] * shards, []
    _, top, ranked = heap[0]
    bins: list[list[int]] = [[] for _ in partials]
    stack = [(top, list(range(shards)))]  # a node and the final bin of each of its ranks
    while stack:
        node, final = stack.pop()
        what, order = nodes[node]
        place = [0] * shards  # by position before ranking
        for rank, at in enumerate(order):
            place[at] = final[rank]
        if isinstance(what, tuple):
            stack.append((what[0], place))
            stack.append((what[1], place[::-1]))
        else:
            bins[what] = place
    return ranked, bins


def _chunk_solver(shards: int):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "digest"], ascending=[False, True])
        empty = [0] * (shards - 1)
        _, bins = difference([[int(x), *empty] for x in pdf["bytes"]], shards)
        return pd.DataFrame({"digest": pdf["digest"], "bytes": pdf["bytes"], "many": pdf["many"], "chunk": pdf["chunk"], "bin": [b[0] for b in bins]})

    return solve


def _tree_solver(shards: int):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(pdf["node"].unique())
        sums = {n: [0] * shards for n in nodes}
        for n, b, s in zip(pdf["node"], pdf["bin"], pdf["bytes"]):
            sums[n][b] += int(s)
        total, bins = difference([sums[n] for n in nodes], shards)
        rows = [(int(n), b, int(pdf["parent"].iloc[0]), bins[i][b], sums[n][b]) for i, n in enumerate(nodes) for b in range(shards)]
        return pd.DataFrame(rows, columns=["node", "bin", "parent", "up", "bytes"])

    return solve


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, digest, shard, slot, shard_bytes`` for every row.

    ``size`` is the UTF-8 length plus 1; ``slot`` numbers a shard's rows without gaps, by
    hashes of id and text.  Neither depends on the layout of the files, but for slots
    where more than ``SLICE`` rows have one text: these are dealt to ``SALT`` slices.
    """
    spark = docs.sparkSession
    ship(spark)
    text = text_of(text_col)
    raw = text.cast("binary")
    keys = materialize(docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.sha2(raw, 256).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    ))
    rows = keys.count()
    units = keys.groupBy("digest").agg(F.sum("size").alias("bytes"), (F.count(F.lit(1)) > SLICE).alias("many"))
    chunks = max(1, math.ceil(rows / CHUNK))
    solved = materialize(
        units.withColumn("chunk", F.pmod(F.xxhash64("digest"), F.lit(chunks)).cast("long"))
        .groupBy("chunk").applyInPandas(_chunk_solver(shards), "digest string, bytes long, many boolean, chunk long, bin int")
        .coalesce(chunks)  # no more files than chunks
    )
    # up the tree: sums of the bins of each node
    level = solved.groupBy(F.col("chunk").alias("node"), "bin").agg(F.sum("bytes").alias("bytes"))
    maps, n = [], chunks
    while n > 1:
        step = materialize(
            level.withColumn("parent", F.floor(F.col("node") / FAN_IN).cast("long"))
            .groupBy("parent").applyInPandas(_tree_solver(shards), "node long, bin int, parent long, up int, bytes long")
            .coalesce(math.ceil(n / FAN_IN))
        )
        maps.append(step.select("node", "bin", "parent", "up"))
        level = step.groupBy(F.col("parent").alias("node"), F.col("up").alias("bin")).agg(F.sum("bytes").alias("bytes"))
        n = math.ceil(n / FAN_IN)
    # down again: the final bin of every chunk's bins
    placed = solved.select("digest", "many", F.col("chunk").alias("node"), "bin")
    if maps:
        route = maps[0]
        for m in maps[1:]:
            up = m.select(F.col("node").alias("parent"), F.col("bin").alias("up"), F.col("parent").alias("p2"), F.col("up").alias("u2"))
            route = route.join(up, ["parent", "up"]).select("node", "bin", F.col("p2").alias("parent"), F.col("u2").alias("up"))
        placed = placed.join(route.select("node", "bin", F.col("up").alias("shard")), ["node", "bin"]).select("digest", "many", "shard")
    else:
        placed = placed.select("digest", "many", F.col("bin").alias("shard"))
    # read twice below; both readers share its exchanges, and every input of it is checkpointed
    out = keys.join(placed, "digest").select("doc_id", "size", "text_crc32", "digest", "row", "shard", F.when(F.col("many"), F.pmod("row", F.lit(SALT))).otherwise(0).alias("salt"))
    # gapless slots without sorting a whole shard in one task
    slices = max(64, math.ceil(rows / shards / SLICE))
    out = out.withColumn("slice", F.pmod(F.xxhash64("doc_id", "digest", "salt"), F.lit(slices)).cast("int"))
    first = out.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    first = first.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
    first = first.withColumn("shard_bytes", F.sum("b").over(Window.partitionBy("shard")))
    number = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("doc_id", "digest", "row"))
    return out.withColumn("at", number).join(first.select("shard", "slice", "before", "shard_bytes"), ["shard", "slice"]).select(
        "doc_id", "size", "text_crc32", "digest", "shard",
        (F.coalesce(F.col("before"), F.lit(0)) + F.col("at") - 1).cast("long").alias("slot"), "shard_bytes")
