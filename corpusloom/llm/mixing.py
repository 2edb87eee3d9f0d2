"""Mixing sources to target weights by temperature.

A source with token share ``p`` gets weight ``q`` proportional to ``p ** a``.
The exponent is bisected: for a repetition limit, to the smallest ``a`` at
which no source is repeated more than ``max_repeats`` times; for a target
entropy (in nats), to the ``a`` whose weights have it.  With both, the larger
exponent holds.  No document is lost: the total budget is the least at which
every source passes at least once, so the source with the largest share passes
exactly once and the others ``repeats = (p_max / p) ** (1 - a)`` times.

Whole passes take all documents of a source.  The last, partial pass takes the
documents of a seeded permutation while their tokens stay within the budget;
as the permutation is an order of hashes, a source's cut is one hash value, and
applying a mixture neither sorts nor shuffles texts.

:func:`schedule` lays the passes out in blocks of ``block_tokens``: within a
block every source has its weight's share of the tokens, and the documents of a
block stand in a seeded order.  Running sums go by slices of the permutation of
a bounded number of rows, so a source with a third of all rows is spread.

Tokens of a document are its words (runs without ASCII white space) plus one end.

Edge cases: a null source is a source of its own; null and empty texts have one
token; null and repeated ids are ordinary rows; an empty table gives an empty
result; extra columns are returned untouched by :func:`apply` and ignored by
:func:`schedule`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import fresh, materialize, quoted, text_of

SLICE = 2000  # rows of a source that one window partition sums
BROADCAST_BYTES = 8 << 20  # the largest table of sources that is broadcast
NO_SOURCE = "\u0000"


def bisect_repeats(p_max: float, p_min: float, limit: float) -> float:
    """The smallest exponent in [0, 1] at which the rarest source repeats at most ``limit`` times."""
    worst = lambda a: (p_max / p_min) ** (1 - a)
    if limit < 1:
        raise ValueError("a repetition limit below 1 would lose documents")
    if worst(0.0) <= limit:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if worst(mid) > limit else (low, mid)
    return high


def bisect_entropy(sources: DataFrame, target: float, passes: int = 5, grid: int = 16) -> float:
    """The exponent in [0, 1] whose weights have the target entropy.

    Entropy falls as the exponent grows.  Each pass asks for ``grid`` exponents
    in one aggregate over the sources, so nothing but sums reaches the driver.
    """
    low, high = 0.0, 1.0
    for _ in range(passes):
        tries = [low + (high - low) * k / grid for k in range(grid + 1)]
        sums = []
        for k, a in enumerate(tries):
            w = F.pow("share", F.lit(a))
            sums += [F.sum(w).alias(f"z{k}"), F.sum(w * F.log("share")).alias(f"l{k}")]
        row = sources.agg(*sums).first()
        entropy = [math.log(row[f"z{k}"]) - a * row[f"l{k}"] / row[f"z{k}"] for k, a in enumerate(tries)]
        at = max([k for k, h in enumerate(entropy) if h >= target], default=None)
        if at is None:
            return low
        if at == grid:
            return high
        low, high = tries[at], tries[at + 1]
    return (low + high) / 2


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("source"),
        (F.regexp_count(text, F.lit(r"[^ \t-\r]+")) + 1).cast("long").alias("tokens"),
        F.xxhash64(text).alias("print"))


def _turn(epoch: Column, doc_id: Column, mark: Column, seed: int) -> Column:
    """The place of a row in the permutation of a pass."""
    return F.xxhash64(F.lit(seed), epoch.cast("long"), doc_id, mark)


def _slice(turn: Column, slices: Column) -> Column:
    return F.least(F.floor((turn / F.lit(2.0**64) + 0.5) * slices), slices - 1).cast("long")


def _running(rows: DataFrame) -> DataFrame:
    """Add ``before``: the tokens that precede a row in its source and pass."""
    key = ["source", "epoch"]
    # dealt by slices, whatever joined the rows to their sources: else a hot source would stay in one task
    rows = rows.withColumn("part", _slice(F.col("turn"), F.col("slices"))).repartition(*key, "part")
    sums = rows.groupBy(*key, "part").agg(F.sum("tokens").alias("t"))
    sums = sums.withColumn("offset", F.coalesce(F.sum("t").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    w = Window.partitionBy(*key, "part").orderBy("turn", "doc_id", "print").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    return rows.join(sums, [*key, "part"]).withColumn("before", F.col("offset") + F.col("inner")).drop("part", "offset", "inner")


def _beside(table: DataFrame, name: str) -> DataFrame:
    """The table of sources, broadcast where it is measured to be small; else a join by shuffle."""
    size = table.agg(F.sum(F.octet_length(name).cast("long") + 100)).first()[0]
    return F.broadcast(table) if (size or 0) <= BROADCAST_BYTES else table


def plan(docs: DataFrame, max_repeats: float | None = 2.0, target_entropy: float | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The table of sources, and the rows that it was made from.

    ``source, share, weight, repeats, whole, cut``: a source passes ``whole``
    times, and then the rows whose hash is at most ``cut`` pass once more.
    """
    rows = materialize(_rows(docs, id_col, text_col, source_col))
    sources = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    sources = materialize(sources)
    total, largest, least = sources.agg(F.sum("tokens"), F.max("tokens"), F.min("tokens")).first()
    if not total:
        empty = sources.select("source", "tokens", *(F.lit(0.0).alias(n) for n in ("share", "weight", "repeats")), F.lit(0).cast("long").alias("whole"), F.lit(0).cast("long").alias("cut"), F.lit(1).cast("long").alias("slices"))
        return empty, rows
    sources = sources.withColumn("share", F.col("tokens") / F.lit(total))
    exponent = 0.0
    if max_repeats is not None:
        exponent = bisect_repeats(largest / total, least / total, max_repeats)
    if target_entropy is not None:
        exponent = max(exponent, bisect_entropy(sources, target_entropy))
    norm = sources.agg(F.sum(F.pow("share", F.lit(exponent)))).first()[0]
    sources = sources.withColumn("weight", F.pow("share", F.lit(exponent)) / F.lit(norm)).withColumn("repeats", F.pow(F.lit(largest / total) / F.col("share"), F.lit(1 - exponent)))
    sources = sources.withColumn("whole", F.floor(F.col("repeats") + 1e-9).cast("long")).withColumn("slices", F.ceil(F.col("rows") / SLICE).cast("long"))
    budget = ((F.col("repeats") - F.col("whole")) * F.col("tokens")).alias("budget")
    part = rows.join(_beside(sources.select("source", "slices", F.col("whole").alias("epoch"), budget), "source"), "source")
    part = _running(part.withColumn("turn", _turn(F.col("epoch"), F.col("doc_id"), F.col("print"), seed)))
    # the rows of the partial pass are a prefix of the permutation: the first that doesn't fit ends it
    stop = part.filter(F.col("before") + F.col("tokens") > F.col("budget")).groupBy("source").agg(F.min("turn").alias("stop"))
    table = sources.join(stop, "source", "left").withColumn("cut", F.coalesce(F.col("stop") - 1, F.lit(2**63 - 1))).select("source", "tokens", "share", "weight", "repeats", "whole", "cut", "slices")
    return materialize(table), rows


def apply(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mixture, with the columns of ``docs``; a repeated document is a repeated row."""
    table, _ = plan(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    of, whole, cut, epoch = fresh(docs, "source_key", "whole", "cut", "epoch")
    table = _beside(table.select(F.col("source").alias(of), F.col("whole").alias(whole), F.col("cut").alias(cut)), of)
    out = docs.withColumn(of, F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE))).join(table, of)
    turn = _turn(F.col(whole), F.col(id_col).cast("long"), F.xxhash64(text_of(text_col)), seed)
    copies = F.col(whole) + (turn <= F.col(cut)).cast("long")
    return out.withColumn(epoch, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*quoted(docs))


def schedule(docs: DataFrame, block_tokens: int = 1 << 20, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per pass of a document: ``doc_id, source, tokens, epoch, weight, repeats, block, slot``."""
    table, rows = plan(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    part = table.select("source", "whole", "cut", "slices", "weight", "repeats", F.col("tokens").alias("of_source"))
    out = rows.join(_beside(part, "source"), "source").withColumn("copies", F.col("whole") + (_turn(F.col("whole"), F.col("doc_id"), F.col("print"), seed) <= F.col("cut")).cast("long"))
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("turn", _turn(F.col("epoch"), F.col("doc_id"), F.col("print"), seed))
    out = _running(out).withColumn("at", F.col("epoch") * F.col("of_source") + F.col("before"))
    out = out.withColumn("block", F.floor(F.col("at") / (F.col("weight") * F.lit(block_tokens))).cast("long"))
    order = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "print", "epoch"), "doc_id", "epoch", "print")
    back = F.when(F.col("source") != NO_SOURCE, F.col("source"))
    return out.withColumn("slot", (F.row_number().over(order) - 1).cast("long")).select("doc_id", back.alias("source"), "tokens", "epoch", "weight", "repeats", "block", "slot")
