"""Document fingerprints from closed syncmers, by DataFrame expressions alone.

A text is read as a sequence of tokens: runs of characters other than ASCII
white space, cut after 16 characters; a CJK character is a token of its own.
Four sentinels stand before the first token.  Of every window of ``K = 5``
tokens the inner windows of ``S = 3`` tokens are hashed; the window is a closed
syncmer if the smallest inner hash lies at its first or last place.  Whether a
window is chosen depends on that window alone, so an edit disturbs only the
windows that it touches and the anchors elsewhere keep their hashes.

The fingerprint is the 64 anchors with the smallest hashes, each with the
position of its first occurrence: 16 hexadecimal digits an anchor, ten of hash
and six of token position (which stops at 2**24 - 1).  Likeness is the
bottom-64 estimate of the Jaccard coefficient of the anchor sets.

Edge cases: a null text counts as empty; an empty text has the empty
fingerprint, likeness 1 to another empty text and 0 to any other; null ids sort
last, rows of one id by the hash of their texts; repeated rows follow each other;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import text_of

K, S, KEEP = 5, 3, 64
POSITION_BITS = 24
CJK = "\\u3040-\\u30ff\\u3400-\\u9fff\\uac00-\\ud7af"
TOKEN = f"[{CJK}]|[^ \\t-\\r{CJK}]{{1,16}}"
MAX_BUCKETS = 65536  # at 100 TB a bucket has 1.5 GB, which a window sorts and spills
BUCKET_ROWS = 500  # and an id with more rows than this is split


def with_anchors(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add ``out``: array of packed anchors (hash in the high 40 bits, position below).

    Every intermediate array is a column of its own: a lambda that reads an
    outer expression would evaluate it once for each element.
    """
    h, s, a = f"__{out}_h", f"__{out}_s", f"__{out}_a"
    tokens = F.expr(f"transform(regexp_extract_all({text_col}, r'{TOKEN}', 0), t -> xxhash64(t))")
    low = (1 << POSITION_BITS) - 1
    packed = f"((xxhash64(x, get({s}, i + 2)) & ~{low}L) | least(cast(i as bigint), {low}L))"
    df = df.withColumn(h, F.concat(F.array_repeat(F.lit(0).cast("long"), K - 1), tokens))
    df = df.withColumn(s, F.expr(f"transform(slice({h}, 1, greatest(size({h}) - {S - 1}, 0)), (x, i) -> xxhash64(x, get({h}, i + 1), get({h}, i + 2)))"))
    # closed: the middle inner window isn't strictly the smallest
    df = df.withColumn(a, F.expr(f"sort_array(filter(transform(slice({s}, 1, greatest(size({s}) - {K - S}, 0)), (x, i) -> if(get({s}, i + 1) >= least(x, get({s}, i + 2)), {packed}, null)), x -> x is not null))"))
    df = df.withColumn(out, F.expr(f"slice(filter({a}, (x, i) -> i = 0 or shiftright(x, {POSITION_BITS}) <> shiftright(get({a}, i - 1), {POSITION_BITS})), 1, {KEEP})"))
    return df.drop(h, s, a)


def as_string(anchors: str) -> Column:
    return F.expr(f"array_join(transform({anchors}, x -> lpad(hex(x), 16, '0')), '')")


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add the likeness of two anchor columns, 0 to 1."""
    x, y, u = f"__{out}_x", f"__{out}_y", f"__{out}_u"
    df = df.withColumn(x, F.expr(f"transform({a}, v -> shiftright(v, {POSITION_BITS}))")).withColumn(y, F.expr(f"transform({b}, v -> shiftright(v, {POSITION_BITS}))"))
    df = df.withColumn(u, F.slice(F.sort_array(F.array_union(x, y)), 1, KEEP))
    same = F.size(F.array_intersect(F.array_intersect(x, y), F.col(u))) / F.size(u)
    return df.withColumn(out, F.when(F.size(u) == 0, 1.0).otherwise(same).cast("double")).drop(x, y, u)


def match_positions(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add ``out``: array of ``(left, right)`` token positions of the shared anchors."""
    low = (1 << POSITION_BITS) - 1
    return df.withColumn(out, F.expr(
        f"filter(transform({a}, v -> struct(v & {low}L as left, get(transform(filter({b}, w -> shiftright(w, {POSITION_BITS}) = shiftright(v, {POSITION_BITS})), w -> w & {low}L), 0) as right)), p -> p.right is not null)"))


def _bucket(bounds: list[int], of: Column) -> Column:
    """How many bounds lie below, by binary search over a literal array."""
    if not bounds:
        return F.when(of.isNull(), -1).otherwise(0)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    arr, size = F.array(*[F.lit(b).cast("long") for b in bounds]) if len(bounds) <= 64 else F.from_json(F.lit("[" + ",".join(map(str, bounds)) + "]"), "array<bigint>"), len(bounds)
    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda acc, s: F.when((acc + s <= size) & (F.get(arr, acc + s - 1) < of), acc + s).otherwise(acc))
    return F.when(of.isNull(), -1).otherwise(found)


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and two likenesses.

    The edited text has its last ``n // 2`` code points replaced by the first
    as many of the next document by descending id (after the last: the first).
    Neighbours meet in buckets of consecutive ids; the last row of a bucket
    takes the first row of the bucket below, of which there is one a bucket.  An id
    (or null) with more than ``BUCKET_ROWS`` rows is a bucket that is parted by ranges
    of the hashes of texts; its equal rows are one row with a count until the end.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = docs.count()
    # ids with many rows, of which there are at most MAX_BUCKETS
    many = max(BUCKET_ROWS, math.ceil(rows / MAX_BUCKETS))
    hot = base.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > many).collect() if rows > many else []
    buckets = min(MAX_BUCKETS, math.ceil(rows / BUCKET_ROWS))
    bounds: list[int] = []
    if buckets > 1:
        cuts = [k / buckets for k in range(1, buckets)]
        got = base.agg(F.percentile_approx("doc_id", cuts, max(10000, 20 * buckets)).alias("b")).first()[0] or []
        bounds = sorted(set(got) | {x for r in hot if r["doc_id"] is not None for x in (r["doc_id"] - 1, r["doc_id"]) if x >= -(2**63)})
    base = base.withColumn("bucket", _bucket(bounds, F.col("doc_id"))).withColumn("tie", F.xxhash64("text"))
    base = _parted(base, {r["doc_id"]: math.ceil(r["n"] / many) for r in hot})
    full = with_anchors(base, "text", "fp")
    # one row a bucket: ids first, then the texts of those rows alone
    place = ["bucket", "part"]
    first = base.groupBy(*place).agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("i"), "tie")).alias("m"))
    order = Window.orderBy(F.desc("bucket"), "part")  # one row a bucket or part of one
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole))
    first = first.select(*place, "m.i", "m.tie", after("bucket").alias("below"), after("part").alias("below_part"))
    heads = base.withColumn("i", F.coalesce("doc_id", F.lit(-(2**63)))).join(F.broadcast(first.select(*place, "i", "tie")), [*place, "i", "tie"], "left_semi")
    heads = with_anchors(heads.dropDuplicates(place), "text", "fp").select(F.col("bucket").alias("below"), F.col("part").alias("below_part"), F.col("text").alias("head_text"), F.col("fp").alias("head_fp"))
    heads = first.select(*place, "below", "below_part").join(heads, ["below", "below_part"]).select(F.col("bucket").alias("hb"), F.col("part").alias("hp"), "head_text", "head_fp")
    w = Window.partitionBy(*place).orderBy(F.desc_nulls_last("doc_id"), F.desc("tie"))
    out = full.withColumn("next_text", F.lead("text").over(w)).withColumn("next_fp", F.lead("fp").over(w))
    out = out.join(heads, (F.col("bucket") == F.col("hb")) & (F.col("part") == F.col("hp")) & F.col("next_text").isNull(), "left")
    out = out.withColumn("next_fp", F.coalesce("next_fp", "head_fp")).withColumn("next_text", F.coalesce("next_text", "head_text"))
    if hot:
        # of equal rows the last one is followed by another text, the others by their own
        own = F.struct(F.col("text").alias("next_text"), F.col("fp").alias("next_fp"))
        nexts = F.concat(F.array(F.struct("next_text", "next_fp")), F.array_repeat(own, (F.col("copies") - 1).cast("int")))
        out = out.withColumn("x", F.explode(nexts)).drop("next_text", "next_fp").select("*", "x.next_text", "x.next_fp")
    n = F.length("text")
    out = out.withColumn("n_chars", n.cast("long"))
    out = out.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next_text, 1, cast(n_chars div 2 as int)))"))
    out = out.select("doc_id", "n_chars", "edited", "fp", "next_fp")
    out = with_anchors(out, "edited", "edited_fp")
    out = with_likeness(with_likeness(out, "fp", "edited_fp", "near_edited"), "fp", "next_fp", "near_next")
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_string("fp").alias("fingerprint"), as_string("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next")


def _parted(base: DataFrame, hot: dict) -> DataFrame:
    """Add ``part`` and ``copies``: 0 and 1, but for ids with many rows.

    Their equal rows fold to one with a count, map-side first; the others are
    dealt to parts by their hashes, which fall from part to part as in the order.
    """
    plain = base.withColumns({"part": F.lit(0), "copies": F.lit(1).cast("long")})
    if not hot:
        return plain
    ids = base.sparkSession.createDataFrame(list(hot.items()), "hot_id long, parts long")
    many = base.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("hot_id")))
    # equal texts have equal hashes; should two texts share one, they stay apart here and in one part
    many = many.groupBy("doc_id", "text", "bucket", "tie", "parts").agg(F.count(F.lit(1)).alias("copies"))
    part = F.least(F.floor((F.lit(0.5) - F.col("tie") / F.lit(2.0**64)) * F.col("parts")), F.col("parts") - 1).cast("int")
    return plain.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("hot_id")), "left_anti").unionByName(many.withColumn("part", F.greatest(F.lit(0), part)).drop("parts"))
