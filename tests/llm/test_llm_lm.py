"""Language-model scores against counting by hand and windows one at a time."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from cases import ROWS, documents, empty, read, table

from corpusloom.llm import lm
from corpusloom.llm.packing import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
V = 50257


@pytest.fixture(scope="module")
def model():
    encode = encoder(PATH)
    texts = [f"the {a} of the {b} and the {a}" for a in ("house", "river", "garden") for b in ("city", "stone", "forest")] * 6
    out = lm.train([encode(lm.joined(lm.words_of(t))).astype(np.int64) for t in texts], V, steps=80)
    out.set_counts(np.arange(V + 1) % 7)
    return out


def one_at_a_time(model, ids):
    """log10 probabilities by plain softmax attention over each window."""
    w, back = model.w, lm.WINDOW - lm.STRIDE
    start = model.inputs.max() + 1
    row = [start + 1] * back + [start] + list(model.inputs[ids]) + [start + 1] * lm.WINDOW
    out = []
    for t, target in enumerate([*ids, V]):
        first = t // lm.STRIDE * lm.STRIDE
        x = np.array([w["E"][row[first + k]] + w["P"][k] for k in range(lm.WINDOW)], np.float64)
        at = back + t - first
        k, v = x @ w["KV"][:, : lm.WIDTH], x @ w["KV"][:, lm.WIDTH :]
        e = np.exp(np.minimum(k[: at + 1] @ (x[at] @ w["Q"]), 15))
        h = e @ v[: at + 1] / e.sum()
        z = np.tanh(x[at] @ w["A"] + h @ w["B"] + w["b"]) @ w["C"] + w["c"]
        p = np.exp(z) / np.exp(z).sum()
        out.append((math.log(p[model.classes[target]]) + model.emission[target]) / math.log(10))
    return np.array(out)


def test_windows(model):
    encode = encoder(PATH)
    texts = ["", " the", " " + " ".join(f"word{k} of the house" for k in range(40))]
    ids = [encode(t).astype(np.int64) for t in texts]
    got = model.score(ids, chunk=3)
    want = np.concatenate([one_at_a_time(model, x) for x in ids])
    assert len(got) == len(want) and np.abs(got - want).max() < 1e-3


def test_it_is_a_distribution(model):
    """Over all ids and the end, in a context."""
    assert abs(np.bincount(model.classes, weights=np.exp(model.emission.astype(float)), minlength=lm.CLASSES)[np.unique(model.classes)] - 1).max() < 1e-3


def test_gradients():
    rng = np.random.default_rng(0)
    d, rows = lm.WIDTH, 9
    r = lambda *s: rng.standard_normal(s) * 0.3
    p = {"E": r(rows, d), "P": r(lm.WINDOW, d), "Q": r(d, d), "KV": r(d, 2 * d), "A": r(d, d), "B": r(d, d), "b": r(d), "C": r(d, lm.CLASSES), "c": r(lm.CLASSES)}
    x, goal = rng.integers(0, rows, (2, lm.WINDOW)), rng.integers(-1, lm.CLASSES, (2, lm.STRIDE))

    def loss():
        xx = p["E"][x] + p["P"]
        k, v = (xx @ p["KV"])[..., :d], (xx @ p["KV"])[..., d:]
        xq = xx[:, lm.WINDOW - lm.STRIDE :]
        e = np.exp((xq @ p["Q"]) @ k.transpose(0, 2, 1)) * lm.MASK
        h = (e / e.sum(-1, keepdims=True)) @ v
        z = np.tanh(xq @ p["A"] + h @ p["B"] + p["b"]) @ p["C"] + p["c"]
        z = z - np.log(np.exp(z).sum(-1, keepdims=True))
        i, j = np.nonzero(goal >= 0)
        return -z[i, j, goal[i, j]].mean()

    g = lm._gradients(p, x, goal)
    for name in p:
        at = tuple(rng.integers(0, n) for n in p[name].shape)
        if name == "E":
            at = (x[0, 5], at[1])
        old, eps = p[name][at], 1e-5
        p[name][at] = old + eps
        up = loss()
        p[name][at] = old - eps
        down = loss()
        p[name][at] = old
        assert abs((up - down) / (2 * eps) - g[name][at]) < 1e-6, name


def test_scores_of_a_block_by_hand(model):
    """The final score: word by word, the unigram and the product over the word's ids, interpolated."""
    import pyarrow as pa

    encode, floor, share, ends = encoder(PATH), 2.5, 0.4, 3
    texts = ["the house of the river", "", "Zyzzyva zyzzyva umbrellas the " + "garden stone " * 30]
    known = {b"the": 9, b"house": 2, b"stone": 4}
    counts = pa.table({"key": [lm.word_hash(w) for w in known], "n": list(known.values())})
    table_ = pa.table({"doc_id": [1, 2, 3], "held_out": [True, False, False], "text": texts})
    got = lm._score_block(PATH, model, lm.opening(PATH, V), ends, floor, share)(table_, counts).to_pylist()
    for r, text in zip(got, texts):
        words = lm.words_of(text)
        own = one_at_a_time(model, encode(lm.joined(words)).astype(np.int64))
        total, at = 0.0, 0
        for w in [*words, None]:
            n = 1 if w is None else len(encode(lm.joined([w])))
            c = ends if w is None else known.get(w, 0)
            total += math.log10(share * (c + 0.1) / 10**floor + (1 - share) * 10 ** own[at : at + n].sum())
            at += n
        assert at == len(own) and abs(r["score"] - total) < 2e-3 * len(words) + 1e-3
        assert (r["n_tokens"], r["n_known"]) == (len(words) + 1, sum(w in known for w in words) + 1)


def test_the_best_share_is_found():
    rng = np.random.default_rng(3)
    x, y = rng.normal(-3, 1, 4000), rng.normal(-3, 1, 4000)
    likely = lambda s: lm.blend(x, y, s).sum()
    best = lm.best_share(x, y)
    assert all(likely(best) >= likely(s) - 1e-3 for s in np.linspace(0.01, 0.99, 50))
    assert lm.best_share(x + 3, y) > 0.95 and lm.best_share(x[:0], y[:0]) == lm.SHARE


def test_all_training_texts_are_learned_from(spark):
    """Steps, classes and embeddings come from every text, not from a sample."""
    from pyspark.sql import functions as F

    opens, encode = lm.opening(PATH, V), encoder(PATH)
    texts = [f"river {'stone ' * (k % 40)} zebra umbrella {k}" for k in range(700)] + ["", "one"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    ids = [encode(lm.joined(lm.words_of(t))).astype(np.int64) for t in texts]
    counts = np.bincount(np.concatenate(ids), minlength=V + 1)
    counts[V] = len(texts)
    got = lm._sum_rows(docs.mapInArrow(lm._neighbour_rows(PATH, opens, counts), lm.ROWS), V + 1, 2 * lm.SPREAD, "float32")
    want, basis = np.zeros((V + 1, 2 * lm.SPREAD)), lm.projection(counts)
    for x in ids:
        for a, b in zip(x, [*x[1:], V]):
            want[a, lm.SPREAD :] += basis[b]
            want[b, : lm.SPREAD] += basis[a]
    inner = np.setdiff1d(np.flatnonzero(counts), [V, *(x[0] for x in ids if len(x))])  # ids that never stand first
    assert len(inner) > 5 and np.abs(got[inner] - want[inner]).max() < 1e-2
    model = lm.train(ids[:5], V, steps=5, counts=counts, sums=got)
    umbrella = encode(" umbrella")[0]
    assert model.inputs[umbrella] < (counts[:V] > 1).sum()  # an embedding of its own
    after = lm.fit_all(docs, PATH, opens, model)
    loss = lambda w: -(setattr(model, "w", w), model.score(ids))[1].mean()
    before = model.w
    assert not np.array_equal(before["E"][model.inputs[umbrella]], after["E"][model.inputs[umbrella]]) and loss(after) < loss(before)
    same = lm.fit_all(docs.filter(F.lit(False)), PATH, opens, model)
    assert all(np.array_equal(same[k], before[k]) for k in before)


def test_the_output_layer_has_its_classes(model):
    assert model.w["C"].shape == (lm.WIDTH, 128) and model.w["c"].shape == (128,)


def check(rows, got, folds=10):
    count, words = Counter(), []
    for i, t, *_ in rows:
        w = [*(t or "").encode().lower().split(), None]
        words.append(w)
        if i is None or zlib.crc32(str(i).encode()) % folds:
            count.update(w)
    n, v = sum(count.values()), len(count)
    want = []
    for (i, *_), w in zip(rows, words):
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want.append(repr((i, i is not None and zlib.crc32(str(i).encode()) % folds == 0, len(w), sum(count[x] > 0 for x in w), n, round(base, 4))))
    assert sorted(repr((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4))) for r in got) == sorted(want)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_base_score_and_the_models_gain(spark):
    docs = documents(spark)
    got = read(lm.score(docs, PATH))
    check([(r["doc_id"], r["text"]) for r in docs.collect()], got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_edges(spark):
    got = read(lm.score(table(spark), PATH))
    check(ROWS, got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert by[5] == by[6] == by[7] and len(set(by[11])) == 1
    assert read(lm.score(empty(spark), PATH)) == []


def test_lexicon_numbers_and_ids():
    lexicon, encode = lm.Lexicon(PATH, lm.opening(PATH, V)), encoder(PATH)
    words = lm.words_of("Some words some words  odd <|endoftext|> éß x ")
    numbers = lexicon.numbers(words)
    keys, sizes, ids = lexicon.ids_of_new()
    assert numbers.tolist()[0] == 0 and len(keys) == len(sizes) == len(set(words))
    at = np.cumsum(sizes) - sizes
    for w, k in lexicon.items():
        assert ids[at[k] : at[k] + sizes[k]].tolist() == encode(lm.joined([w])).tolist() and keys[k] == lm.word_hash(w)
    assert [len(x) for x in lexicon.ids_of_new()] == [0, 0, 0]


def test_new_words_are_numbered_together():
    """In the order of their first use, without a call of Python code for each word."""
    import sys

    lexicon, calls = lm.Lexicon(PATH, lm.opening(PATH, V)), Counter()
    words = [b"w%d" % (k * k % 5003) for k in range(9000)]
    distinct = list(dict.fromkeys(words))
    sys.setprofile(lambda frame, event, _: calls.update([event]))
    try:
        first, again = lexicon.numbers(distinct[:1000]), lexicon.numbers(words)
    finally:
        sys.setprofile(None)
    assert first.tolist() == list(range(1000)) and again.tolist() == [distinct.index(w) for w in words]
    assert lexicon.new == distinct == list(lexicon) and calls["call"] < 100


def test_texts_are_split_once_for_training():
    """The first pass keeps the ids of every text; what is learned from these is learned from the texts."""
    import pyarrow as pa

    opens, encode = lm.opening(PATH, V), encoder(PATH)
    texts = ["the house", "", "odd space 　 here <|endoftext|> éß", *(f"river {'stone ' * (k % 9)} zebra {k}" for k in range(150))]
    out = list(lm._count(PATH, opens, V)(iter(pa.table({"text": texts}).to_batches(max_chunksize=70))))
    kept = [r["ids"] for b in out for r in b.to_pylist() if r["kind"] == 2]
    want = [encode(lm.joined(lm.words_of(t))).tolist() for t in texts]
    assert [np.frombuffer(x, lm.id_type(V)).tolist() for x in kept] == want
    words, ids = Counter(), Counter()
    for b in out:
        for r in b.to_pylist():
            (words if r["kind"] == 0 else ids if r["kind"] == 1 else Counter())[r["key"]] += r["n"]
    assert words == Counter(lm.word_hash(w) for t in texts for w in lm.words_of(t)) and ids == Counter(k for x in want for k in x)
    for column in (pa.array(texts), pa.array(kept, pa.binary())):
        got = list(lm.sequences(iter(pa.table({"x": column}).to_batches(max_chunksize=70)), PATH, opens))
        assert np.concatenate([x for x, _ in got]).tolist() == [k for x in want for k in x]
        assert np.concatenate([n for _, n in got]).tolist() == [len(x) for x in want]
    assert lm.id_type(1 << 16) == np.uint32


def test_texts_are_dealt_once(spark):
    """Asking for counts and scoring read the same shuffled texts."""
    out = lm.score(documents(spark), PATH)
    out.collect()
    assert "Reused" in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("scale", [0.3, 4.0])
def test_gradients_of_many_windows(scale):
    """More windows than one part holds, single ones, and weights that reach the bounds of the exponentials."""
    rng = np.random.default_rng(1)
    d, rows, n = lm.WIDTH, 30, lm.PART + 5
    r = lambda *s: rng.standard_normal(s) * scale
    p = {"E": r(rows, d), "P": r(lm.WINDOW, d), "Q": r(d, d), "KV": r(d, 2 * d), "A": r(d, d), "B": r(d, d), "b": r(d), "C": r(d, lm.CLASSES), "c": r(lm.CLASSES) * 20}
    x, goal = rng.integers(0, rows, (n, lm.WINDOW)), rng.integers(-1, lm.CLASSES, (n, lm.STRIDE))
    told = (goal >= 0).sum(1)
    all_, single = lm._gradients(p, x, goal), [lm._gradients(p, x[k : k + 1], goal[k : k + 1]) for k in range(n)]
    assert lm._bounded(p) == (scale < 1) and set(all_) == set(p)
    for k in p:
        want = sum(g[k] * (m / told.sum()) for g, m in zip(single, told))
        assert all_[k].shape == p[k].shape and np.abs(all_[k] - want).max() < 1e-9 * max(1, np.abs(want).max()), k
    assert not any(v.any() for v in lm._gradients(p, x[:3], np.full((3, lm.STRIDE), -1)).values())


def test_neighbours_of_pairs():
    rng = np.random.default_rng(2)
    for height in (50, 70_000):
        flat, basis = rng.integers(0, height, 400), rng.standard_normal((height, lm.SPREAD)).astype(np.float32)
        out, want = np.zeros((height, 2 * lm.SPREAD), np.float32), np.zeros((height, 2 * lm.SPREAD))
        lm.neighbours(flat, basis, out)
        for a, b in zip(flat[:-1], flat[1:]):
            want[a, lm.SPREAD :] += basis[b]
            want[b, : lm.SPREAD] += basis[a]
        assert np.abs(out - want).max() < 1e-4
    lm.neighbours(flat[:1], basis, out)
    lm.neighbours(flat[:0], basis, out)
    assert np.abs(out - want).max() < 1e-4


def test_blocks_go_to_different_partitions(spark):
    from pyspark.sql import functions as F

    for blocks, parts in ((1, 1), (11, 12), (300, 300)):
        numbers = lm.apart(spark, blocks, parts)
        rows = spark.createDataFrame([(k,) for k in numbers], "block long").repartition(parts, "block").select(F.spark_partition_id().alias("p")).distinct()
        assert len(set(numbers)) == blocks == rows.count()


@pytest.mark.parametrize("scale", [0.3, 1.0])
def test_steps_run_as_a_graph(scale, monkeypatch):
    """The same gradients as numpy's, also where exponentials are bounded and places tell nothing, and none of numpy's are asked for."""
    pytest.importorskip("onnxruntime")
    rng = np.random.default_rng(4)
    d, rows, n = lm.WIDTH, 30, 2 * lm.PART + 5
    r = lambda *s: (rng.standard_normal(s) * scale).astype(np.float32)
    p = {"E": r(rows, d), "P": r(lm.WINDOW, d), "Q": r(d, d), "KV": r(d, 2 * d), "A": r(d, d), "B": r(d, d), "b": r(d), "C": r(d, lm.CLASSES), "c": r(lm.CLASSES)}
    x, goal = rng.integers(0, rows, (n, lm.WINDOW)).astype(np.int32), rng.integers(-1, lm.CLASSES, (n, lm.STRIDE)).astype(np.int16)
    x[:3], goal[:3] = x[0], -1
    want = lm._gradients({k: v.astype(np.float64) for k, v in p.items()}, x, goal)
    monkeypatch.setattr(lm, "_gradients", None)
    got = lm.gradients(p, x, goal)
    assert set(got) == set(want)
    for k in want:
        assert got[k].shape == p[k].shape and got[k].dtype == np.float32 and np.abs(got[k] - want[k]).max() < 2e-4 * max(1, np.abs(want[k]).max()), k
    before = p["E"].copy()
    lm.Adam(p).step(x[:40], goal[:40], 0.01)
    assert not np.array_equal(p["E"], before)


def test_scores_run_as_a_graph(model, monkeypatch):
    """The same scores as numpy's, with and without the package."""
    pytest.importorskip("onnxruntime")
    rng = np.random.default_rng(6)
    ids = [rng.integers(0, V, n) for n in (0, 1, lm.STRIDE - 1, lm.STRIDE, 3000, 17)]
    with monkeypatch.context() as m:
        m.setattr(lm.Model, "_told_plainly", None)
        got = model.score(ids)
    monkeypatch.setattr(lm.graphs, "runtime", lambda: None)
    monkeypatch.setattr(lm.Model, "_told", None)
    plain = model.score(ids)
    assert len(got) == len(plain) == sum(len(x) + 1 for x in ids) and np.abs(got - plain).max() < 1e-4
