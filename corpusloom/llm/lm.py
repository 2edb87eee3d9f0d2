"""Language-model scores: a small causal self-attention model over subword ids.

Texts are read as lower-cased words and one end.  The *base* score is an
add-0.1 unigram over words, counted in all training texts.  The *score* is the
log10 probability under an interpolation, word by word, of that unigram and of
a causal attention layer over subword ids, whose steps and scores run as the graphs
of ``graphs``, or in numpy:

    x = embedding(id) + position,   h = masked softmax(q k') v,
    y = tanh(x A + h B + b),        P(next) = P(class | y) P(id | class)

Ids are grouped into ``CLASSES`` classes by their neighbours in all training texts;
``P(id | class)`` comes from smoothed id counts over all training texts, so the
layer is a distribution over all ids and the end.  A text is read in windows of
``WINDOW`` ids that advance by ``STRIDE``: every id is scored once, with at
least ``WINDOW - STRIDE`` ids of context after the start.  A word's probability
is the product over its ids.

The attention weights start from a sample: a stretch of at most
``SAMPLE_CHARS`` code points, at a hashed place, of each of the ``SAMPLE_DOCS``
training texts with the smallest hashes.  From there every scan partition fits
them on every window of its training texts, once each, and the results are
averaged: an embedding by its uses in the partition, the rest by windows.  So
steps grow with the corpus.  The weight of the unigram in the interpolation is
estimated on the sample, with every count less by one.  Classes come from sums over all neighbouring ids,
and the ids with embeddings of their own from counts, both of all training texts.

Plan: one pass over the training texts folds word counts within scan partitions, to be
summed by hash, and writes the texts' ids in compressed files, which all later steps
of the training read, and which are deleted after them.  Sums of neighbours and
weights fold in partitions too and are summed by slots of rows.  Texts are then dealt
into blocks of about ``BLOCK_BYTES``; a block asks for the counts of its distinct
words by a join, so a frequent word is one row a block, and meets its texts again in
a co-group.  Rows go to blocks by hashes of id and text, and each block has a
partition of its own, so neither null ids nor copies of a text fill one; only rows
repeated as a whole, id and text, share one.  Words are compared by 64-bit hashes:
among V distinct words some two meet with probability V * V / 2**65 (3e-4 for a
hundred million), and then count as one.

Edge cases: null and empty texts are one end (the score of the end alone);
null ids are in the training part; rows repeated as a whole are counted and
scored each; without training texts all counts are 0; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import graphs
from corpusloom.llm.common import discard, materialize, shared_folder, ship, text_of
from corpusloom.llm.packing import encoder

WINDOW, STRIDE, WIDTH, CLASSES = 32, 28, 16, 128
KNOWN_IDS = 4096  # ids with an embedding of their own; others share one a class
SAMPLE_DOCS, SAMPLE_CHARS = 1600, 2000
BLOCK_BYTES, SLICE_BYTES = 16 << 20, 4 << 20  # of texts that are scored, and split into words, together
STEPS, EPOCHS, BATCH = 1600, 4, 64  # of the start: at most so many steps, or passes over a smaller sample
PART, STACK = 64, 16  # windows whose gradients are computed together, and multiplied as one matrix
POOL, POOL_BATCH, RATE = 8192, 256, 0.006  # windows that are mixed, windows a step, and the rate of the steps over all texts
SLOTS, SPREAD = 64, 24  # parts in which tables of rows are summed; width of projected neighbours
ALPHA = 0.1
SHARE = 0.65  # of the unigram in the interpolation, where there is no training text to estimate it from


# -- the model ---------------------------------------------------------------
class Model:
    """Weights and look-up tables; ids run from 0 to ``vocabulary``, the last of which is the end."""

    def __init__(self, vocabulary: int, classes: np.ndarray, inputs: np.ndarray, weights: dict[str, np.ndarray]):
        self.vocabulary, self.classes, self.inputs, self.w = vocabulary, classes, inputs, weights
        self.emission = np.zeros(vocabulary + 1, np.float32)

    def set_counts(self, counts: np.ndarray) -> None:
        """ln P(id | class) from counts of all ids."""
        c = counts + 0.1
        total = np.bincount(self.classes, weights=c, minlength=CLASSES)
        self.emission = np.log(c / total[self.classes]).astype(np.float32)

    def score(self, ids: list[np.ndarray], chunk: int = 64) -> np.ndarray:
        """log10 probabilities of all ids and ends of the sequences, one after the other."""
        return self.score_flat(np.concatenate([*ids, NONE]).astype(np.int64), np.array([len(x) for x in ids], np.int64), chunk)

    def score_flat(self, x: np.ndarray, sizes: np.ndarray, chunk: int = 64) -> np.ndarray:
        """The same for sequences of these sizes that stand one after the other in ``x``."""
        flat, goal, at = laid_out(x, sizes, self.inputs, self.vocabulary)
        every = np.lib.stride_tricks.sliding_window_view
        rows, target = every(flat, WINDOW), every(goal, STRIDE)[at + WINDOW - STRIDE].ravel()
        real = np.flatnonzero(target >= 0)
        got = (self._told if graphs.runtime() else self._told_plainly)(rows, at, self.classes[target], chunk)[real]
        got += self.emission[target[real]]
        return got.astype(np.float64) / math.log(10)

    def _told(self, rows: np.ndarray, at: np.ndarray, classes: np.ndarray, chunk: int) -> np.ndarray:
        """ln P(class) at all places of the windows that begin ``at``."""
        run, goal, out = graphs.scorer(WINDOW, STRIDE, WIDTH).run, classes.astype(np.int64).reshape(-1, 1), np.empty(len(classes), np.float32)
        for a in range(0, len(at), chunk):
            here = slice(a * STRIDE, (a + chunk) * STRIDE)
            out[here] = run(None, {**self.w, "ids": rows[at[a : a + chunk]], "goal": goal[here]})[0][:, 0]
        return out

    def _told_plainly(self, rows: np.ndarray, at: np.ndarray, classes: np.ndarray, chunk: int) -> np.ndarray:
        """The same in numpy."""
        at = np.append(at, np.zeros(-len(at) % STACK, np.int64))  # whole stacks; what is added isn't told
        w, back, d, chunk, places = self.w, WINDOW - STRIDE, WIDTH, -(-chunk // STACK) * STACK, len(classes)
        joint, last, safe = np.concatenate([w["KV"], w["Q"], w["A"]], 1), np.vstack([w["C"], w["c"]]), _bounded(w)
        ones, every, bias = np.ones(WINDOW, np.float32), np.ones(CLASSES, np.float32), np.tile(w["b"], STRIDE)
        space, told, row = np.empty((chunk * STRIDE, CLASSES), np.float32), np.ones((chunk * STRIDE, d + 1), np.float32), np.arange(chunk * STRIDE)
        own, total = np.empty(len(at) * STRIDE, np.float32), np.empty(len(at) * STRIDE, np.float32)
        classes = np.append(classes, np.zeros(len(own) - places, np.int64))
        for a in range(0, len(at), chunk):
            e = w["E"].take(rows[at[a : a + chunk]], axis=0)
            e += w["P"]
            m = len(e)
            r = m // STACK
            z = np.matmul(e.reshape(r, -1, d), joint).reshape(m, WINDOW, 4 * d)
            s = np.matmul(z[:, back:, 2 * d : 3 * d], np.ascontiguousarray(z[:, :, :d].transpose(0, 2, 1)))
            if s.max() > 15:
                np.minimum(s, 15, out=s)
            np.exp(s, out=s)
            s *= MASK
            h = np.matmul(s, z[:, :, d : 2 * d])
            h *= (1 / (s.reshape(-1, WINDOW) @ ones + np.float32(1e-30))).reshape(m, STRIDE, 1)
            h = np.matmul(h.reshape(r, -1, d), w["B"]).reshape(m, STRIDE, d)
            h += z[:, back:, 3 * d :]
            h.reshape(m, -1)[...] += bias
            y, logits = told[: m * STRIDE], space[: m * STRIDE]
            np.tanh(h.reshape(-1, d), out=y[:, :d])
            np.matmul(y.reshape(r, -1, d + 1), last, out=logits.reshape(r, -1, CLASSES))
            if not safe:
                logits -= logits.max(1, keepdims=True)
            here = slice(a * STRIDE, (a + m) * STRIDE)
            own[here] = logits[row[: m * STRIDE], classes[here]]
            np.exp(logits, out=logits)
            total[here] = logits @ every
        return (own - np.log(total))[:places]


def _bounded(p: dict[str, np.ndarray]) -> bool:
    """Whether no output can be so large that its exponential leaves the single precision."""
    return float((np.abs(p["C"]).sum(0) + np.abs(p["c"])).max()) < 80


def laid_out(x: np.ndarray, sizes: np.ndarray, inputs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input ids and ids to tell (-1: none) in one row, and where its windows begin.

    Each sequence is pads, the start, its ids, then what its last window needs.
    """
    start, pad, back = int(inputs.max()) + 1, int(inputs.max()) + 2, WINDOW - STRIDE
    rows = sizes // STRIDE + 1
    width = back + rows * STRIDE
    first = np.cumsum(width) - width
    flat, goal = np.full(int(width.sum()), pad, np.int32), np.full(int(width.sum()), -1, np.int32)
    place = np.arange(len(x)) + np.repeat(first + back - (np.cumsum(sizes) - sizes), sizes)
    goal[place] = x
    place += 1
    flat[place] = inputs[x]
    flat[first + back] = start
    goal[first + back + sizes] = end
    return flat, goal, np.repeat(first - (np.cumsum(rows) - rows) * STRIDE, rows) + np.arange(int(rows.sum())) * STRIDE


LESS = np.full((PART * STRIDE, 1), -1, np.float32)
MASK = np.tril(np.ones((STRIDE, WINDOW), np.float32), WINDOW - STRIDE)


def projection(counts: np.ndarray, seed: int = 3) -> np.ndarray:
    """Random directions of all ids, shorter for frequent ones."""
    return (np.random.default_rng(seed).standard_normal((len(counts), SPREAD)) / np.sqrt(counts + 5.0)[:, None]).astype(np.float32)


def neighbours(flat: np.ndarray, basis: np.ndarray, out: np.ndarray) -> None:
    """Add to the rows of ``out`` the projected ids before and after each id of ``flat``."""
    height, kind = len(basis), np.uint32 if len(basis) <= 1 << 16 else np.int64  # narrow pairs sort faster
    flat = flat.astype(kind)
    for own, other, half in ((flat[1:], flat[:-1], slice(0, SPREAD)), (flat[:-1], flat[1:], slice(SPREAD, None))):
        pairs = np.sort(own * kind(height) + other)
        if not len(pairs):
            return
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        n = np.diff(np.append(first, len(pairs))).astype(np.float32)
        a, b = np.divmod(pairs[first], kind(height))
        rows = basis[b]
        rows *= n[:, None]
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        out[a[first], half] += np.add.reduceat(rows, first)


def group_ids(sums: np.ndarray, counts: np.ndarray, seed: int = 3) -> np.ndarray:
    """Classes of ids by weighted k-means over what stands before and after them."""
    rng = np.random.default_rng(seed)
    seen = np.flatnonzero(counts)
    if not len(seen):
        return np.arange(len(counts)) % CLASSES
    v = sums[seen] / np.sqrt(counts[seen])[:, None]
    v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-9
    weight = np.sqrt(counts[seen])
    centre = v[rng.choice(len(seen), min(CLASSES, len(seen)), replace=False, p=weight / weight.sum())]
    for _ in range(20):
        near = np.argmax(v @ centre.T, 1)
        for k in range(len(centre)):
            inside = near == k
            if inside.any():
                c = (v[inside] * weight[inside, None]).sum(0)
                centre[k] = c / (np.linalg.norm(c) + 1e-9)
    classes = rng.integers(0, len(centre), len(counts))  # ids that no training text has
    classes[seen] = near
    return classes.astype(np.int64)


def windows(x: np.ndarray, sizes: np.ndarray, inputs: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Input ids and classes to tell of all windows of sequences that stand one after the other in ``x``."""
    flat, goal, at = laid_out(x, sizes, inputs, len(classes) - 1)
    told = np.append(classes, -1).astype(np.int16)[goal]  # -1 is the last place, and stays -1
    every = np.lib.stride_tricks.sliding_window_view
    return every(flat, WINDOW)[at], every(told, STRIDE)[at + WINDOW - STRIDE]


class Adam:
    """Steps on the weights ``p``, which become parts of one vector."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.steps = p, 0
        self.all = np.concatenate([v.ravel() for v in p.values()])
        self.m1, self.m2, self.g = (np.zeros_like(self.all) for _ in range(3))
        self.parts, at = {}, 0
        for k, v in p.items():
            p[k], self.parts[k] = (x[at : at + v.size].reshape(v.shape) for x in (self.all, self.g))
            at += v.size

    def step(self, xs: np.ndarray, ys: np.ndarray, rate: float) -> None:
        self.steps += 1
        for k, v in gradients(self.p, xs, ys).items():
            self.parts[k][...] = v
        g, d = self.g, self.g - self.m1
        d *= 0.1
        self.m1 += d
        g *= g
        g -= self.m2
        g *= 0.01
        self.m2 += g
        np.sqrt(self.m2, out=d)
        d *= 1 / math.sqrt(1 - 0.99**self.steps)
        d += 1e-6
        np.divide(self.m1, d, out=d)
        d *= rate / (1 - 0.9**self.steps)
        self.all -= d


def train(samples: list[np.ndarray], vocabulary: int, steps: int = STEPS, seed: int = 5, counts: np.ndarray | None = None, sums: np.ndarray | None = None) -> Model:
    """Fit the attention weights on sequences of ids by Adam.

    Counts of all ids and the sums of their neighbours are those of the
    sequences where none are given.
    """
    rng = np.random.default_rng(seed)
    samples = [np.asarray(x, np.int64) for x in samples] or [np.zeros(0, np.int64)]
    if counts is None or sums is None:
        flat = np.concatenate([np.append(x, vocabulary) for x in samples])
        counts = np.bincount(flat, minlength=vocabulary + 1)
        sums = np.zeros((vocabulary + 1, 2 * SPREAD), np.float32)
        neighbours(flat, projection(counts), sums)
    classes = group_ids(sums, counts)
    counts = counts[:vocabulary]
    often = np.argsort(-counts, kind="stable")[:KNOWN_IDS]
    often = often[counts[often] > 1]
    inputs = (classes[:vocabulary] + len(often)).astype(np.int32)
    inputs[often] = np.arange(len(often))
    inputs = np.append(inputs, len(often) + CLASSES - 1).astype(np.int32)  # so that the largest is fixed
    start, pad, d = int(inputs.max()) + 1, int(inputs.max()) + 2, WIDTH
    r = lambda *shape: rng.standard_normal(shape).astype(np.float32) * 0.3
    p = {"E": r(pad + 1, d), "P": r(WINDOW, d) * 0.3, "Q": r(d, d), "KV": r(d, 2 * d), "A": r(d, d), "B": r(d, d), "b": np.zeros(d, np.float32), "C": r(d, CLASSES), "c": np.zeros(CLASSES, np.float32)}
    p["c"] = np.log(np.bincount(classes[np.concatenate(samples)], minlength=CLASSES) + 1.0).astype(np.float32)
    p["c"] -= p["c"].max()
    xs, ys = windows(np.concatenate(samples), np.array([len(x) for x in samples]), inputs, classes)
    steps = min(steps, 50 + EPOCHS * len(xs) // BATCH)
    adam = Adam(p)
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(xs), BATCH)
        adam.step(xs[pick], ys[pick], 0.02 * min(1.0, step / 30) * (1 - step / (steps + 1)) ** 0.7)
    return Model(vocabulary, classes, inputs, p)


def _gradients(p, x_ids, goal) -> dict[str, np.ndarray]:
    """Gradients of the mean loss over the classes in ``goal`` (negative: none), in the precision of the weights.

    ``PART`` windows at a time, so that their outputs stay in the processor's cache;
    products go by stacks of ``STACK`` windows, which the matrix library multiplies
    without packing.  Exponentials of the output layer aren't divided by their sums,
    as what they are multiplied with is narrower.
    """
    d, back, kind = WIDTH, WINDOW - STRIDE, p["C"].dtype
    count, safe = max(1, int(np.count_nonzero(goal >= 0))), _bounded(p)
    if len(x_ids) % STACK:  # whole stacks; what is added tells nothing
        more = ((0, -len(x_ids) % STACK), (0, 0))
        x_ids, goal = np.pad(x_ids, more), np.pad(goal, more, constant_values=-1)
    n = len(x_ids)
    joint, last = np.concatenate([p["KV"], p["Q"], p["A"]], 1), np.vstack([p["C"], p["c"]])
    joint_t, last_t, b_t = (np.ascontiguousarray(w.T) for w in (joint, p["C"], p["B"]))
    g = {k: np.zeros_like(p[k]) for k in ("E", "B", "b")}
    g_last, g_joint, dx_all, size = np.zeros_like(last), np.zeros_like(joint), np.empty((n, WINDOW, d), kind), min(n, PART)
    space, y_all, dz_all = np.empty((size * STRIDE, CLASSES), kind), np.ones((size * STRIDE, d + 1), kind), np.zeros((size, WINDOW, 4 * d), kind)
    row, all_ones, bias = np.arange(size * STRIDE), np.ones(size * STRIDE, kind), np.tile(p["b"], STRIDE)
    ones, places = np.ones(WINDOW, kind), np.ones(CLASSES, kind)
    for a in range(0, n, PART):
        m = min(PART, n - a)
        r = m // STACK
        x = p["E"].take(x_ids[a : a + m], axis=0)
        x += p["P"]
        x = x.reshape(r, -1, d)
        z = np.matmul(x, joint).reshape(m, WINDOW, 4 * d)
        k, v, q = z[:, :, :d], z[:, :, d : 2 * d], z[:, back:, 2 * d : 3 * d]
        e = np.matmul(q, np.ascontiguousarray(k.transpose(0, 2, 1)))
        clipped = e.max() >= 15
        if clipped:
            open_ = e < 15
            np.minimum(e, 15, out=e)
        np.exp(e, out=e)
        e *= MASK
        e *= (1 / (e.reshape(-1, WINDOW) @ ones + 1e-30)).reshape(m, STRIDE, 1)
        h = np.matmul(e, v)
        pre = np.matmul(h.reshape(r, -1, d), p["B"]).reshape(m, STRIDE, d)
        pre += z[:, back:, 3 * d :]
        pre.reshape(m, -1)[...] += bias
        y = y_all[: m * STRIDE]  # with a column of ones
        np.tanh(pre.reshape(-1, d), out=y[:, :d])
        # the output layer; places with nothing to tell have no weight
        out = space[: m * STRIDE]
        stack = out.reshape(r, -1, CLASSES)
        np.matmul(y.reshape(r, -1, d + 1), last, out=stack)
        if not safe:
            out -= out.max(1, keepdims=True)
        np.exp(out, out=out)
        total = out @ places
        target = goal[a : a + m].ravel()
        out[row[: m * STRIDE], target] -= total
        weight = ((target >= 0) / (total * count)).astype(kind)
        scaled = y * weight[:, None]
        g_last += np.matmul(scaled.reshape(r, -1, d + 1).transpose(0, 2, 1), stack).sum(0)
        dy = np.matmul(stack, last_t)
        scaled *= y
        dy *= np.subtract(weight[:, None], scaled[:, :d]).reshape(r, -1, d)  # with the slope of tanh, 1 - y * y
        g["B"] += np.matmul(h.reshape(r, -1, d).transpose(0, 2, 1), dy).sum(0)
        g["b"] += all_ones[: m * STRIDE] @ dy.reshape(-1, d)
        # back through attention
        dh = np.matmul(dy, b_t).reshape(m, STRIDE, d)
        ds = np.matmul(dh, np.ascontiguousarray(v.transpose(0, 2, 1)))
        ds -= np.einsum("ij,ij->i", dh.reshape(-1, d), h.reshape(-1, d)).reshape(m, STRIDE, 1)
        ds *= e
        if clipped:
            ds *= open_
        dz = dz_all[:m]
        np.matmul(ds.transpose(0, 2, 1), q, out=dz[:, :, :d])
        np.matmul(e.transpose(0, 2, 1), dh, out=dz[:, :, d : 2 * d])
        np.matmul(ds, k, out=dz[:, back:, 2 * d : 3 * d])
        dz[:, back:, 3 * d :] = dy.reshape(m, STRIDE, d)
        dz = dz.reshape(r, -1, 4 * d)
        g_joint += np.matmul(x.transpose(0, 2, 1), dz).sum(0)
        np.matmul(dz, joint_t, out=dx_all[a : a + m].reshape(r, -1, d))
    g |= {"C": g_last[:d], "c": g_last[d], "KV": g_joint[:, : 2 * d], "Q": g_joint[:, 2 * d : 3 * d], "A": g_joint[:, 3 * d :], "P": dx_all.sum(0)}
    ids = x_ids.ravel()
    order = np.argsort(ids)
    ids = ids[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    g["E"][ids[first]] = np.add.reduceat(dx_all.reshape(-1, d).take(order, axis=0), first, axis=0)
    return g


def gradients(p, x_ids, goal) -> dict[str, np.ndarray]:
    """The same from weights of single precision by a graph, where there is what runs it."""
    if graphs.runtime() is None or not len(x_ids):
        return _gradients(p, x_ids, goal)
    run, count, total, rows = graphs.gradients(WINDOW, STRIDE, WIDTH).run, max(1, int(np.count_nonzero(goal >= 0))), None, []
    for a in range(0, len(x_ids), PART):
        told = goal[a : a + PART].reshape(-1, 1).astype(np.int64)
        weight = (told >= 0).astype(np.float32)
        weight /= count
        *got, dx = run(None, {**p, "ids": x_ids[a : a + PART], "goal": np.maximum(told, 0), "weight": weight, "less": LESS[: len(told)]})
        total = [x + y for x, y in zip(total, got)] if total else got
        rows.append(dx.reshape(-1, WIDTH))
    g = dict(zip(graphs.ORDER, total))
    g["E"] = graphs.spread().run(None, {"table": np.zeros_like(p["E"]), "at": x_ids.reshape(-1, 1).astype(np.int64), "rows": np.concatenate(rows)})[0]
    return g


# -- counts ------------------------------------------------------------------
def words_of(text: str) -> list[bytes]:
    """Lower-cased words; the end is added where they are counted."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def joined(words: list[bytes]) -> str:
    """The text that the model reads: every word with one space before it."""
    return b" ".join([b"", *words]).decode("utf-8", "replace")


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def word_hashes(words: Collection[bytes]) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) ^ np.uint64(1 << 63)).view(np.int64)


def slices(texts: pa.Array | pa.ChunkedArray) -> Iterator[pa.Array]:
    """Runs of texts of at most some ``SLICE_BYTES``, or of one text."""
    for x in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        ends, a = np.cumsum(pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while a < len(x):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_BYTES, "right")))
            yield x.slice(a, b - a)
            a = b


def split(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of some texts, the places among these of all words, and how many words each text has.

    As ``words_of`` of each, without an object a word.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, many = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # spaces at the ends leave empty words
    if not some.all():
        many = np.bincount(np.repeat(np.arange(len(many)), many)[some], minlength=len(many))
        flat = flat.filter(pa.array(some))
    table = flat.dictionary_encode()
    held = table.dictionary.cast(pa.large_binary())
    if not len(held):
        return [], NONE, many
    _, ends, data = held.buffers()
    ends, data = np.frombuffer(ends, np.int64)[held.offset : held.offset + len(held) + 1].tolist(), data.to_pybytes()
    return [data[a:b] for a, b in zip(ends, ends[1:])], table.indices.to_numpy(zero_copy_only=False).astype(np.int64), many


def opening(path: str, vocabulary: int) -> np.ndarray:
    """For every id, and the end, whether it opens a word of a joined text."""
    from tokenizers import Tokenizer

    table = Tokenizer.from_file(path).get_vocab()
    out = np.zeros(vocabulary + 1, bool)
    for piece, k in table.items():
        out[k] = piece.startswith("\u0120")  # the byte-level sign for a space
    out[vocabulary] = True
    return out


class Grown:
    """An array that takes more at its end without a copy of the whole each time."""

    def __init__(self, kind):
        self.held, self.n = np.empty(1 << 16, kind), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.held):
            old, self.held = self.held, np.empty(2 * (self.n + len(x)), self.held.dtype)
            self.held[: self.n] = old[: self.n]
        self.held[self.n : self.n + len(x)] = x
        self.n += len(x)


class Lexicon(dict):
    """Numbers of words in the order of their first use, with the ids of each word."""

    def __init__(self, path: str, opens: np.ndarray):
        self.encode, self.opens, self.new = encoder(path), opens, []
        self.start, self.size, self.ids = Grown(np.int64), Grown(np.int64), Grown(np.int32)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(out < 0)
        if len(at):
            new = list(dict.fromkeys(map(words.__getitem__, at.tolist())))
            first = len(self)
            self.update(zip(new, range(first, first + len(new))))
            self.new += new
            # words that stand here more than once are looked up
            out[at] = np.arange(first, len(self)) if len(new) == len(at) else [self[words[k]] for k in at.tolist()]
        return out

    def learn(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words since the last call, their numbers of ids, and the ids of all of them, which are kept."""
        sizes, ids = [], []
        for a in range(0, len(self.new), 2000):  # many words in one text: no id spans two of them
            part = self.new[a : a + 2000]
            x = self.encode(joined(part)).astype(np.int32)
            first = np.flatnonzero(self.opens[x])
            if len(first) == len(part) and first[0] == 0:
                sizes.append(np.diff(np.append(first, len(x))))
                ids.append(x)
            else:  # spaces that aren't ASCII
                own = [self.encode(joined([w])).astype(np.int32) for w in part]
                sizes.append(np.array([len(y) for y in own], np.int64))
                ids += own
        new, self.new = self.new, []
        size, x = np.concatenate(sizes or [NONE]), np.concatenate(ids or [NONE])
        self.start.add(self.ids.n + np.cumsum(size) - size)
        self.size.add(size)
        self.ids.add(x)
        return new, size, x

    def ids_of_new(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and numbers of ids of the words since the last call, and the ids of all of them."""
        new, size, x = self.learn()
        return word_hashes(new), size, x

    def ids_at(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words with these numbers, one after the other, and how many each has."""
        m = self.size.held[numbers]
        shift = self.start.held[numbers]
        shift -= np.cumsum(m) - m
        at = np.repeat(shift, m)
        at += np.arange(len(at))
        return self.ids.held[at], m


NONE = np.zeros(0, np.int64)


COUNTS = "kind int, key long, n long, ids binary"


def id_type(vocabulary: int):
    """What ids are kept as."""
    return np.uint16 if vocabulary < 1 << 16 else np.uint32


def _count(path: str, opens: np.ndarray, vocabulary: int):
    """(kind, key, n, ids) of a scan partition's training texts: 0 counts of words by hash, 1 of ids, 2 a text's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, keys, times, total = Lexicon(path, opens), Grown(np.int64), NONE, np.zeros(vocabulary + 1, np.int64)

        def counted(kind, key, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n), pa.nulls(len(key), pa.binary())], names=["kind", "key", "n", "ids"])

        def kept(x, sizes):
            ends = np.append(0, np.cumsum(sizes) * np.dtype(id_type(vocabulary)).itemsize).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(x.astype(id_type(vocabulary)))])
            zeros = pa.array(np.zeros(len(sizes), np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), 2, np.int32)), zeros, zeros, ids], names=["kind", "key", "n", "ids"])

        for b in batches:
            for texts in slices(b.column(0)):
                words, at, many = split(texts)
                numbers = lexicon.numbers(words)
                keys.add(lexicon.ids_of_new()[0])
                times = np.append(times, np.zeros(len(lexicon) - len(times), np.int64))
                times[numbers] += np.bincount(at, minlength=len(words))
                x, m = lexicon.ids_at(numbers[at])
                total += np.bincount(x, minlength=len(total))
                yield kept(x, split_sizes(many, m))
                if len(lexicon) > 400_000:
                    yield counted(0, keys.held[: keys.n], times)
                    lexicon, keys, times = Lexicon(path, opens), Grown(np.int64), NONE
        yield counted(0, keys.held[: keys.n], times)
        ids = np.flatnonzero(total)
        yield counted(1, ids, total[ids])

    return run


def split_sizes(many: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many ids each text has, from how many words it has and the sizes of all words."""
    return np.diff(np.append(0, np.cumsum(m))[np.append(0, np.cumsum(many))])


def sequences(batches: Iterator[pa.RecordBatch], path: str, opens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of the texts in the first column, one after the other, and how many each has; some texts at a time.

    A binary column holds the ids themselves.
    """
    lexicon, kind = None, np.dtype(id_type(len(opens) - 1))
    for b in batches:
        if pa.types.is_binary(b.column(0).type) or pa.types.is_large_binary(b.column(0).type):
            for a in range(0, b.num_rows, 64):
                blobs = [x.as_buffer() for x in b.column(0).slice(a, 64)]
                yield np.concatenate([np.frombuffer(x, kind) for x in blobs]).astype(np.int32), np.array([x.size // kind.itemsize for x in blobs])
            continue
        for texts in slices(b.column(0)):
            if lexicon is None or len(lexicon) > 400_000:
                lexicon = Lexicon(path, opens)
            words, at, many = split(texts)
            numbers = lexicon.numbers(words)
            lexicon.learn()
            x, m = lexicon.ids_at(numbers[at])
            yield x, split_sizes(many, m)


ROWS = "slot int, at binary, x binary"


def _rows(at: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """Rows of a table, in slots."""
    slots = [np.flatnonzero(at % SLOTS == k) for k in range(SLOTS)]
    return pa.RecordBatch.from_arrays([pa.array(range(SLOTS), pa.int32()), pa.array([at[k].astype(np.int32).tobytes() for k in slots], pa.binary()), pa.array([x[k].tobytes() for k in slots], pa.binary())], names=["slot", "at", "x"])


def _sum_rows(rows: DataFrame, height: int, width: int, kind: str) -> np.ndarray:
    """The sum of all tables that ``rows`` holds, of which only the sum reaches the driver."""

    def add(out: np.ndarray, at: bytes, x: bytes) -> None:
        out[np.frombuffer(at, np.int32)] += np.frombuffer(x, kind).reshape(-1, width)

    def run(batches):
        out, seen = np.zeros((height, width), kind), set()
        for b in batches:
            for slot, at, x in zip(*(c.to_pylist() for c in b.columns)):
                seen.add(slot)
                add(out, at, x)
        at = np.array([k for k in range(height) if k % SLOTS in seen], np.int64)
        at = at[out[at].any(1)] if len(at) else at
        yield _rows(at, out[at])

    out = np.zeros((height, width), kind)
    for r in rows.repartition("slot").mapInArrow(run, ROWS).filter("length(at) > 0").toLocalIterator():
        add(out, r["at"], r["x"])
    return out


def _neighbour_rows(path: str, opens: np.ndarray, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, end = projection(counts), len(counts) - 1
        out, held, n = np.zeros((len(counts), 2 * SPREAD), np.float32), [], 0
        for x, sizes in sequences(batches, path, opens):
            held.append(np.insert(x, np.cumsum(sizes), end))
            n += len(held[-1])
            if n > 1_000_000:
                neighbours(np.concatenate(held), basis, out)
                held, n = [], 0
        if held:
            neighbours(np.concatenate(held), basis, out)
        at = np.flatnonzero(out.any(1))
        yield _rows(at, out[at])

    return run


def _pack(p: dict[str, np.ndarray], seen: np.ndarray, n: int) -> np.ndarray:
    """Weights times their uses, and the uses, as a table of ``WIDTH`` columns."""
    flat = np.concatenate([(p["E"] * seen[:, None]).ravel(), *(p[k].ravel() * float(n) for k in sorted(p) if k != "E"), seen, [n]])
    return np.append(flat, np.zeros(-len(flat) % WIDTH)).reshape(-1, WIDTH)


def _unpack(total: np.ndarray, old: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The averages; weights without a use stay as they were."""
    flat, at, parts = total.ravel(), 0, {}
    for k in ["E", *(k for k in sorted(old) if k != "E")]:
        parts[k] = flat[at : at + old[k].size].reshape(old[k].shape)
        at += old[k].size
    seen, n = flat[at : at + len(old["E"]), None], flat[at + len(old["E"])]
    out = {k: (v / n if n else old[k]).astype(np.float32) for k, v in parts.items()}
    out["E"] = np.where(seen > 0, parts["E"] / np.maximum(seen, 1), old["E"]).astype(np.float32)
    return out


def _fit_rows(path: str, opens: np.ndarray, model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, rng = {k: v.copy() for k, v in model.w.items()}, np.random.default_rng(11)
        adam, seen, total, held, n = Adam(p), np.zeros(len(p["E"])), 0, [], 0

        def spend():
            xs, ys = (np.concatenate(z) for z in zip(*held))
            np.add(seen, np.bincount(xs.ravel(), minlength=len(seen)), out=seen)
            mixed = rng.permutation(len(xs))
            for a in range(0, len(xs), POOL_BATCH):
                pick = mixed[a : a + POOL_BATCH]
                # a short batch moves by its share
                adam.step(xs[pick], ys[pick], RATE * min(1.0, (adam.steps + 1) / 30) / math.sqrt(1 + adam.steps / 200) * len(pick) / POOL_BATCH)
            return len(xs)

        for x, sizes in sequences(batches, path, opens):
            held.append(windows(x, sizes, model.inputs, model.classes))
            n += len(held[-1][0])
            if n >= POOL:
                total, held, n = total + spend(), [], 0
        if held:
            total += spend()
        if total:
            x = _pack(p, seen, total)
            yield _rows(np.arange(len(x)), x)

    return run


def fit_all(texts: DataFrame, path: str, opens: np.ndarray, model: Model) -> dict[str, np.ndarray]:
    """The weights of the model after steps on every window of ``texts(text)`` or ``(ids)``, averaged over partitions."""
    height = len(_pack(model.w, np.zeros(len(model.w["E"])), 0))
    return _unpack(_sum_rows(texts.mapInArrow(_fit_rows(path, opens, model), ROWS), height, WIDTH, "float64"), model.w)


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each block in this partition."""
    seen: dict[int, set[bytes]] = {}

    def out(block, words):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block, np.int64)), pa.array(word_hashes(words))], names=["block", "key"])

    for b in batches:
        blocks = b.column("block").to_numpy()
        for block in np.unique(blocks).tolist():
            words = seen.setdefault(block, set())
            for texts in slices(b.column("text").take(pa.array(np.flatnonzero(blocks == block)))):
                words.update(split(texts)[0])
                if len(words) > 400_000:
                    yield out(block, words)
                    words.clear()
    for block, words in seen.items():
        yield out(block, words)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double"


ZERO = math.log10(ALPHA)


def _score_block(path: str, model: Model, opens: np.ndarray, ends: int, floor: float, share: float):
    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        lexicon = Lexicon(path, opens)
        asked, n = counts.column("key").to_numpy(), counts.column("n").to_numpy()
        order = np.argsort(asked)
        asked, n = np.append(asked[order], 2**63 - 1), np.append(np.log10(n[order] + ALPHA), ZERO)
        end = math.log10(ends + ALPHA)
        logs = Grown(np.float64)  # by the number of a word: log10(count + ALPHA)
        total, known, sums, scores = [], [], [], []
        for part in slices(texts.column("text")):
            words, place, count = split(part)
            place = lexicon.numbers(words)[place]
            keys, _, _ = lexicon.ids_of_new()
            at = np.searchsorted(asked, keys)
            logs.add(np.where(asked[at] == keys, n[at], ZERO))
            first = np.append(0, np.cumsum(count))
            for a in range(0, len(count), 64):
                many, flat = count[a : a + 64], place[first[a] : first[min(a + 64, len(count))]]
                stop = np.cumsum(many)
                x, m = lexicon.ids_at(flat)
                before = np.append(0, np.cumsum(m))
                own = model.score_flat(x, split_sizes(many, m))
                # a word's ids, then one end a text
                log = np.insert(logs.held[flat], stop, end)
                text = np.repeat(np.arange(len(many)), many + 1)
                begin = np.insert(before[:-1], stop, before[stop]) + text
                total.append(many + 1)
                known.append(np.bincount(text, weights=log > ZERO, minlength=len(many)).astype(np.int64))
                sums.append(np.bincount(text, weights=log, minlength=len(many)))
                scores.append(np.bincount(text, weights=blend(log - floor, np.add.reduceat(own, begin), share), minlength=len(many)))
        flat = lambda parts, kind: pa.array(np.concatenate(parts or [NONE]).astype(kind))
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": flat(total, np.int64), "n_known": flat(known, np.int64), "base_sum": flat(sums, np.float64), "score": flat(scores, np.float64)})

    return run


def blend(unigram: np.ndarray, attention: np.ndarray, share: float) -> np.ndarray:
    """log10 of the interpolation of two probabilities given as log10."""
    x, y = unigram + math.log10(share), attention + math.log10(1 - share)
    low = np.exp(-math.log(10) * np.abs(x - y))
    return np.maximum(x, y) + np.log1p(low) / math.log(10)


def best_share(unigram: np.ndarray, attention: np.ndarray, steps: int = 40) -> float:
    """The share of the unigram that makes the interpolation likeliest, by expectation and maximisation."""
    share = SHARE
    for _ in range(steps if len(unigram) else 0):
        share = min(0.99, max(0.01, float(np.mean(10.0 ** (unigram + math.log10(share) - blend(unigram, attention, share))))))
    return share


def estimate_share(samples: list[str], words: DataFrame, path: str, opens: np.ndarray, model: Model, ids: np.ndarray, ends: int, total: int, distinct: int) -> float:
    """The unigram's share, from the training texts that attention started from.

    Both models have counted these words, so each count is less by one here: what a
    word's other occurrences say of it.
    """
    lexicon = Lexicon(path, opens)
    numbers = [lexicon.numbers(words_of(t)) for t in samples]
    keys, sizes, x = lexicon.ids_of_new()
    if not len(keys):
        return SHARE
    spark = words.sparkSession
    asked = spark.createDataFrame(pa.table({"key": keys}))  # words of the sample, which is of bounded size
    known = {r["key"]: r["n"] for r in words.join(F.broadcast(asked), "key").select("key", "n").collect()}
    n = np.array([known.get(int(k), 1) for k in keys], np.float64)
    floor = math.log10(total - 1 + ALPHA * (distinct + 1))
    log = np.log10(n - 1 + ALPHA) - floor
    start = np.cumsum(sizes) - sizes
    model.set_counts(np.maximum(ids - 1, 0))
    uni, own = [], []
    for a in range(0, len(numbers), 64):
        part = numbers[a : a + 64]
        seqs = [np.concatenate([x[start[w] : start[w] + sizes[w]] for w in p] or [NONE]).astype(np.int32) for p in part]
        got = model.score(seqs)
        at = 0
        for p, s in zip(part, seqs):
            first = np.append(np.cumsum(sizes[p]) - sizes[p], len(s)).astype(np.int64)
            own.append(np.add.reduceat(got[at : at + len(s) + 1], first))
            uni.append(np.append(log[p], math.log10(max(0, ends - 1) + ALPHA) - floor))
            at += len(s) + 1
    model.set_counts(ids)
    return best_share(np.concatenate(uni), np.concatenate(own))


def _sample(train_rows: DataFrame, n: int) -> list[str]:
    """A stretch of each of the ``SAMPLE_DOCS`` rows with the smallest hashes.

    Only rows below a bound that a few more than these should meet are sorted,
    so partitions don't send a whole sample each.
    """
    place = 1 + F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1)).cast("long"))
    rows = train_rows.select(F.xxhash64("doc_id", "text").alias("h"), F.substring("text", place.cast("int"), F.lit(SAMPLE_CHARS)).alias("t"))
    share = 1.5 * SAMPLE_DOCS / max(1, n)
    while True:
        some = rows if share >= 1 else rows.filter(F.col("h") < int((share - 0.5) * 2**64))
        got = some.orderBy("h", "t").limit(SAMPLE_DOCS).collect()
        if share >= 1 or len(got) == SAMPLE_DOCS:
            return [r["t"] for r in got]
        share *= 4


def apart(spark: SparkSession, blocks: int, parts: int) -> list[int]:
    """Numbers for so many blocks of which no two are dealt to one of ``parts`` partitions by their hash."""
    tried = 20 * parts
    while True:
        found = spark.range(tried).groupBy(F.pmod(F.hash("id"), F.lit(parts))).agg(F.min("id").alias("id")).orderBy("id").limit(blocks).collect()
        if len(found) == blocks:
            return [r["id"] for r in found]
        tried *= 2


def score(docs: DataFrame, tokenizer: str, vocabulary: int = 50257, folds: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row."""
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    base = base.withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False)))
    train_rows = base.filter(~F.col("held_out"))
    ends, rows, size = base.agg(F.sum((~F.col("held_out")).cast("long")), F.count(F.lit(1)), F.sum(F.octet_length("text").cast("long"))).first()
    ends = ends or 0
    # counts over all training texts
    opens = opening(tokenizer, vocabulary)
    kept = shared_folder(spark, "lm-ids")
    train_rows.select("text").mapInArrow(_count(tokenizer, opens, vocabulary), COUNTS).write.option("compression", "zstd").parquet(kept)
    read = spark.read.schema(COUNTS).parquet(kept)
    texts = read.filter("kind = 2").select("ids")
    counts = materialize(read.filter("kind < 2").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    ids = np.zeros(vocabulary + 1)
    for r in counts.filter("kind = 1").collect():  # at most one row for each id of the vocabulary
        ids[r["key"]] = r["n"]
    words = counts.filter("kind = 0").select("key", "n")
    distinct, total = words.agg(F.count(F.lit(1)), F.sum("n")).first()
    ids[vocabulary] = ends
    # attention weights: a start from a sample, then steps on all training texts
    sums = _sum_rows(texts.mapInArrow(_neighbour_rows(tokenizer, opens, ids), ROWS), vocabulary + 1, 2 * SPREAD, "float32")
    encode = encoder(tokenizer)
    samples = _sample(train_rows, ends)
    model = train([encode(joined(words_of(t))) for t in samples], vocabulary, counts=ids, sums=sums)
    model.w = fit_all(texts, tokenizer, opens, model)
    discard(spark, kept)
    model.set_counts(ids)
    n, v = (total or 0) + ends, distinct + (ends > 0)
    blocks = max(1, math.ceil((size or 0) / BLOCK_BYTES))
    parts = max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int") + 1
    dealt = base.withColumn("block", F.element_at(F.lit(apart(spark, blocks, parts)).cast("array<long>"), place)).repartition(parts, "block")
    # of whole rows, so that both sides read what was dealt once
    wanted = dealt.mapInArrow(_wanted, "block long, key long").join(words, "key").select("block", "key", "n")
    floor = math.log10(n + ALPHA * (v + 1))
    share = estimate_share(samples, words, tokenizer, opens, model, ids, ends, n, v)
    run = _score_block(tokenizer, model, opens, ends, floor, share)
    out = dealt.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(run, SCORES)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("base_sum") - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score")
