"""BagMinHash signatures of multisets, vectorised over many documents.

Every element (a hashed shingle) with an integer weight owns Poisson processes
over time, one for each dyadic interval of weights [0,1), [1,2), [2,4), [4,8)
and so on, with a rate proportional to the interval's length.  A point carries
a time, a register and a weight level inside its interval; it counts where the
level lies below the element's weight.  A register keeps the earliest point of
all elements.  The processes depend on the element and the interval alone, so
two registers agree with probability equal to the weighted Jaccard coefficient
``sum(min) / sum(max)``, without bias.

As the earliest points decide, a document's processes run only up to a time
bound by which all registers are full with high probability; where one is not,
the bound is doubled for that document.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_M1, _M2, _GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def _step(k: int) -> np.uint64:
    return U(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * _M1
    x = x ^ (x >> U(27))
    x = x * _M2
    return x ^ (x >> U(31))


def intervals(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element the number of its dyadic intervals, flattened: (element, interval)."""
    n = np.where(weights <= 1, 1, np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) + 1)
    element = np.repeat(np.arange(len(weights)), n)
    first = np.repeat(np.cumsum(n) - n, n)
    return element, np.arange(len(element)) - first


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """Registers, ``docs x m`` of 64-bit point identities (0 where a document is empty).

    ``doc``, ``shingle`` and ``weight`` describe the elements; ``doc`` counts from 0.
    """
    best = np.full(docs * m, np.inf)
    totals = np.bincount(doc, weights=weight, minlength=docs)
    bound = np.where(totals > 0, (np.log(m) + 4.0) / np.maximum(totals, 1), 0.0)
    todo = np.arange(len(doc))
    while len(todo):
        _run(best, doc[todo], shingle[todo], weight[todo], bound, m)
        short = np.isinf(best.reshape(docs, m)).any(1) & (totals > 0)
        bound[short] *= 2
        todo = todo[short[doc[todo]]]
    out = best.view(np.uint64).copy()
    out[np.isinf(best)] = 0
    return mix(out).reshape(docs, m)


def _run(best, doc, shingle, weight, bound, m) -> None:
    element, level = intervals(weight)
    low = np.where(level == 0, 0, 2.0 ** (level - 1))
    length = np.where(level == 0, 1.0, low)
    cover = np.minimum(1.0, (weight[element] - low) / length)
    seed = mix(shingle[element] + (level.astype(np.uint64) + U(1)) * _GOLD)
    rate, owner = length * m, doc[element]
    limit, t = bound[owner], np.zeros(len(element))
    step = 0
    while len(seed):
        step += 1
        h = mix(seed + _step(step))
        # 53 bits of a uniform number in (0, 1], then register and level from another hash
        t = t - np.log((h >> U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / rate
        live = t <= limit
        if not live.all():
            seed, rate, owner, limit, t, cover, h = (x[live] for x in (seed, rate, owner, limit, t, cover, h))
        if not len(seed):
            break
        g = mix(h + _GOLD)
        register = ((g >> U(32)) * U(m)) >> U(32)
        inside = (g & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < cover
        where = owner[inside] * m + register[inside].astype(np.int64)
        np.minimum.at(best, where, t[inside])


def shingle_counts(words: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count) of the ``k``-word shingles of hashed words.

    A text of 1 to ``k - 1`` words has one shingle, all of them; an empty one none.
    """
    n = np.array([len(w) for w in words], np.int64)
    padded = [w if len(w) >= k or not len(w) else np.concatenate([w, np.zeros(k - len(w), np.uint64)]) for w in words]
    flat = np.concatenate(padded) if padded else np.zeros(0, np.uint64)
    sizes = np.where(n == 0, 0, np.maximum(n, k))
    doc = np.repeat(np.arange(len(words)), sizes)
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = len(flat) - k + 1
    h = np.zeros(total, np.uint64)
    for j in range(k):
        h = mix(h + flat[j : j + total] + _step(j + 1))
    inside = doc[:total] == doc[k - 1 :]
    doc, h = doc[:total][inside], h[inside]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    return doc[start], h[start], np.diff(np.append(start, len(h)))


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (sorted hashes, counts); 1 for two empty ones."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (total - shared)
