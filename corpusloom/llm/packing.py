"""Best-fit packing of token sequences by hierarchical residual packing.

A text becomes its subword ids followed by one end id.  Only texts longer than
``width`` are cut, into pieces of ``width`` ids whose first piece may be
shorter.  Each scan partition packs its pieces best-fit (longest first) and
hands out nearly full bins; underfull bins become the items of repeated
best-fit rounds over ever fewer groups, each of a bounded number of bins.

Ids are those of the ``tokenizers`` file.  The byte-level file has the same
vocabulary as ranks, which encode the same text to the same ids several times
faster; texts that hold the string of a special token go through ``tokenizers``
itself.

Edge cases: a null or empty text is one piece of the end id alone; repeated
rows are separate pieces; a null ``doc_id`` stays null; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, ship, text_of

GROUP = 20_000  # underfull bins that one task packs in a round
_encoders: dict = {}


def encoder(path: str):
    """A function from a text to a numpy array of ids, kept per worker.

    The tokenizer file itself is loaded with the first text that needs it.
    """
    if path in _encoders:
        return _encoders[path]
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    exact = functools.cache(lambda: Tokenizer.from_file(path))
    ranks = path[: -len(".json")] + ".tiktoken"
    try:
        import public_tokenizers

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    except (ImportError, FileNotFoundError):
        fast = None

    def encode(text: str) -> np.ndarray:
        if fast is None or any(s in text for s in special):
            return np.array(exact().encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)

    _encoders[path] = encode
    return encode


def cut(n: int, width: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; the first takes the remainder."""
    if n <= width:
        return [(0, n)]
    head = n % width
    starts = list(range(head, n, width))
    return ([(0, head)] if head else []) + [(s, width) for s in starts]


def best_fit(lengths: list[int], width: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing.  Returns bin and offset of each item, and the fill of each bin."""
    room: list[list[int]] = [[] for _ in range(width + 1)]  # bins by what is free in them
    free = 0  # bit r is set if a bin with r free exists
    where, offset, fill = [0] * len(lengths), [0] * len(lengths), []
    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[k]
        fits = free >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
        else:
            b = len(fill)
            fill.append(0)
        where[k], offset[k] = b, fill[b]
        fill[b] += size
        left = width - fill[b]
        if left:
            room[left].append(b)
            free |= 1 << left
    return where, offset, fill


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def _local(path: str, width: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        part = TaskContext.get().partitionId() << 40
        ids, piece, start, length, crc = [], [], [], [], []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seq = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                for k, (s, n) in enumerate(cut(len(seq), width)):
                    ids.append(doc)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(seq[s : s + n].tobytes()))
        where, offset, fill = best_fit(length, width)
        for a in range(0, max(1, len(ids)), 16384):
            z = slice(a, a + 16384)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[z], pa.int64()), pa.array(piece[z], pa.int32()), pa.array(start[z], pa.int64()), pa.array(length[z], pa.int64()),
                pa.array(crc[z], pa.int64()), pa.array([part + b for b in where[z]], pa.int64()), pa.array(offset[z], pa.int64()), pa.array([fill[b] for b in where[z]], pa.int64()),
            ], names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"])

    return run


def _round(width: int, salt: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        fills = [int(x) for x in pdf["fill"]]
        names = [int(x) for x in pdf["bin"]]
        where, offset, fill = best_fit(fills, width)
        owner: dict[int, int] = {}
        for k, b in enumerate(where):
            owner.setdefault(b, names[k])  # a merged bin takes the name of one of its parts
        return pd.DataFrame({"bin": names, "to": [owner[b] for b in where], "base": offset, "filled": [fill[b] for b in where]})

    return run


def pack(docs: DataFrame, tokenizer: str, width: int = 2048, end_id: int = 0, nearly_full: float = 0.999, rounds: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    ship(docs.sparkSession)
    pieces = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(_local(tokenizer, width, end_id), PIECES))
    under = int(width * nearly_full)
    # every bin has exactly one piece at offset 0
    state = pieces.filter((F.col("offset") == 0) & (F.col("fill") < under)).select("bin", F.col("bin").alias("now"), F.lit(0).cast("long").alias("base"))
    bins = materialize(pieces.filter((F.col("offset") == 0) & (F.col("fill") < under)).select("bin", "fill"))
    n = bins.count()
    for k in range(rounds):
        groups = math.ceil(n / GROUP)
        if n < 2:
            break
        step = materialize(
            bins.withColumn("g", F.pmod(F.xxhash64("bin", F.lit(k)), F.lit(groups)))
            .groupBy("g").applyInPandas(_round(width, k), "bin long, to long, base long, filled long")
        )
        state = state.join(step.select(F.col("bin").alias("now"), "to", F.col("base").alias("add")), "now", "left").select(
            "bin", F.coalesce("to", "now").alias("now"), (F.col("base") + F.coalesce("add", F.lit(0))).alias("base"))
        bins = step.filter(F.col("bin") == F.col("to")).filter(F.col("filled") < under).select("bin", F.col("filled").alias("fill"))
        left = bins.count()
        if groups == 1 or left > 0.98 * n:
            break
        n = left
    moved = materialize(state)
    return pieces.join(moved, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("now", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))
