"""Packing as an exact round trip over ids."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from cases import ROWS, documents, empty, read, table
from tokenizers import Tokenizer

from corpusloom.llm import packing as pk

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, got, width):
    exact = Tokenizer.from_file(PATH)
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == texts.keys()
    total = 0
    for i, seqs in texts.items():
        total += sum(map(len, seqs))
        assert sum(r["length"] for r in pieces[i]) == sum(map(len, seqs))
        assert sum(r["piece"] == 0 for r in pieces[i]) == len(seqs)
        for r in pieces[i]:
            fits = [s for s in seqs if zlib.crc32(s[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]]
            assert fits and any(len(s) <= width and r["piece"] == 0 and r["length"] == len(s) or len(s) > width for s in fits)
            assert r["length"] == width or r["piece"] == 0
    for at in places.values():
        at.sort()
        end = 0
        for o, n in at:
            assert o == end
            end += n
        assert end <= width
    return len(places), math.ceil(total / width)


def test_round_trip(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    n, least = check(rows, read(pk.pack(docs, PATH)), 2048)
    assert n <= least * 1.02 + 1
    check(rows, read(pk.pack(docs, PATH, width=100)), 100)


def test_merging_rounds_over_several_groups(spark, monkeypatch):
    monkeypatch.setattr(pk, "GROUP", 7)
    rng = random.Random(1)
    rows = [(k, "a " * rng.randrange(1, 60), "en", "a", 1) for k in range(400)]
    n, least = check(rows, read(pk.pack(table(spark, rows).repartition(12), PATH, width=64)), 64)
    assert n <= least * 1.1 + 1


def test_edges(spark):
    check(ROWS, read(pk.pack(table(spark), PATH)), 2048)
    assert read(pk.pack(empty(spark), PATH)) == []


def test_ids_are_those_of_the_tokenizer_file(spark):
    """Both encoders on every text of sf0.1 and on odd ones."""
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    texts += [r[1] or "" for r in ROWS] + ["\r\n\t \x0b\x0c", "a\u00a0b\u2003c", "it's we'LL 'Tis", "\u0000\ufffd\ufeff", "1234567890 ½ ² ٣", "e\u0301 \u200d \U0001f468\u200d\U0001f469", "x" * 5000, " " * 3000, "<|endoftext|>", "a <|endoftext|> b"]
    encode, exact = pk.encoder(PATH), Tokenizer.from_file(PATH)
    for a in range(0, len(texts), 1000):
        want = exact.encode_batch(texts[a : a + 1000], add_special_tokens=False)
        assert all(w.ids == encode(t).tolist() for w, t in zip(want, texts[a : a + 1000]))


def test_cut():
    assert pk.cut(5, 5) == [(0, 5)] and pk.cut(6, 5) == [(0, 1), (1, 5)] and pk.cut(10, 5) == [(0, 5), (5, 5)]


def test_best_fit_takes_the_tightest_bin():
    where, offset, fill = pk.best_fit([6, 5, 4, 3, 2], 10)
    assert fill == [10, 10] and [where[k] for k in (0, 2)] == [0, 0] and offset[2] == 6
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randrange(1, 101) for _ in range(rng.randrange(1, 80))]
        where, offset, fill = pk.best_fit(sizes, 100)
        assert sum(fill) == sum(sizes) and max(fill) <= 100
        assert len(fill) <= math.ceil(11 / 9 * max(math.ceil(sum(sizes) / 100), sum(s > 50 for s in sizes)) + 4)
