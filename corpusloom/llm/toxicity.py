"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses and every clause into words.  The lexicon, a trie over
word beginnings, turns each word into one symbol: *insult* (with a weight, learned
from labels on top of a small seed list), *threat*, *target*, *negation*, *report*
(closed word lists for English, German, Spanish and French) or *other*.  Five
weighted transducers (:class:`Transducer`) read the symbols of a clause, each
what the one before wrote, and may guess what is still to come:

    negation   marks an insult or threat in the three words after a negation
    target     marks an insult with a target within four words on either side,
               and a threat with a target anywhere in the clause
    report     marks what stands in a clause with a word of reported speech
    insult     adds the weight of each insult, + 0.5 if it is aimed, x 0.25 if it
               is negated, x 0.5 if it is reported; ends *matched* after one aimed
               insult or two insults, *lone* after one that isn't aimed
    threat     adds 2 for each aimed threat, with the same factors

Their composition is a machine over tuples of states, built as clauses need it and
kept; a clause's weight is that of its best accepting path.  A text's raw score is
the sum over its matched clauses.  A lone insult is no match: it counts only in a
text in which other clauses hold insults or threats too (a sixth machine over
clauses with the states *nothing*, *one* and *several*).  A logistic curve of
``log(1 + raw)`` through the training rows gives a probability.

Learning: each distinct labelled training text counts once, however many rows
hold it (texts are compared by 64-bit hashes).  The insult trie holds every
beginning (3 to 6 letters, or whole words up to 6 letters) that occurs in at
least ``min_texts`` toxic texts, whose smoothed odds between the classes, each
relative to its size, are at least ``min_odds``, and whose log-likelihood ratio
against the classes' shares is at least ``evidence``.  Its weight is the log of
these odds.  A beginning that a shorter one with as much weight covers changes
no score and is left out; there is no other bound on their number.  The curve
is fitted on counts of distinct training texts by rounded raw score.

Edge cases: a null or empty text scores the curve's value at 0; rows whose
label is null or missing aren't learned from; of contradicting labels for one
id or one text the larger holds; repeated rows are scored each; with no labels the seed
lists and a fixed curve are used; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, ship, text_of

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")
SEED = {w: 4.0 for w in "idiot idiots moron morons stupid scum loser losers pathetic worthless disgusting bastard asshole bitch imbecile imbécile idiota estúpido estúpida imbécil cabrón connard salaud crétin débile dummkopf idioten arschloch schwachkopf abschaum".split()}
THREAT = frozenset("kill hurt destroy murder shoot stab strangle beat töten umbringen verprügeln matar golpear destruir tuer frapper détruire".split())
TARGET = frozenset("you your he she they them him her his these those people du dich dir ihr euch sie er usted ustedes ellos ella tú vosotros tu toi vous il elle ils elles".split())
NEGATION = frozenset("not no never neither nor isn aren wasn weren don doesn didn nicht kein keine nie niemals nunca tampoco jamás ne pas jamais aucun".split())
REPORT = frozenset("said says say told wrote writes quoted quote called claims claimed sagte sagt schrieb nannte dijo dice llamó escribió dit disait écrit appelé".split())
CURVE = (-3.0, 3.0)
BEFORE, AROUND = 3, 4  # words that a negation reaches, words between an insult and its target


def beginnings(word: str) -> list[str]:
    """The trie keys that a word passes: its beginnings, and itself with an end mark."""
    n = len(word)
    keys = [word[:k] for k in range(3, min(n, 6) + 1)]
    return keys + [word + "$"] if n <= 6 else keys


def counted(words: set[str], known: dict[str, list[str]] | None = None) -> set[str]:
    """The keys of a text's distinct words; ``2key`` and ``3key`` where so many words share one."""
    seen: Counter = Counter()
    for w in words:
        got = known.get(w) if known is not None else None
        if got is None:
            got = beginnings(w)
            if known is not None:
                if len(known) > 30_000:
                    known.clear()
                known[w] = got
        seen.update(got)
    return {*seen, *("2" + k for k, n in seen.items() if n >= 2), *("3" + k for k, n in seen.items() if n >= 3)}


# -- transducers ---------------------------------------------------------------
OTHER, INSULT, THREAT_, TARGET_, NEGATION_, REPORT_ = range(6)
SYMBOLS = range(6)
NEGATED, AIMED, TOLD = 8, 16, 32  # marks that transducers add to insults and threats
CHARGED = (INSULT, THREAT_)


class Transducer:
    """A finite-state transducer with weights.

    ``arcs(state, symbol)`` gives ``(next, written, factor, bonus)`` for every arc: it
    weighs ``factor`` times the word's weight, plus ``bonus``.  ``final(state)`` names
    the outcome of a path that ends there, None where it may not end.
    """

    def __init__(self, start: tuple, arcs: Callable, final: Callable):
        self.start, self.arcs, self.final = start, arcs, final


def _negation(state, symbol):
    left = BEFORE if symbol == NEGATION_ else max(0, state - 1)
    yield left, symbol | NEGATED if state and symbol in CHARGED else symbol, 0.0, 0.0


def _target(state, symbol):
    """State: words since the last target (``AROUND + 1``: too many or none), words left to a promised target, whether the clause has or was promised one."""
    since, due, has = state
    kind = symbol & 7
    if kind == TARGET_:
        yield (1, 0, 2), symbol, 0.0, 0.0  # keeps every promise
        return
    if due == 1:
        return  # the target that was promised didn't come
    after = min(since + 1, AROUND + 1), max(0, due - 1)
    yield (*after, has), symbol, 0.0, 0.0
    if kind == INSULT:
        if since <= AROUND:
            yield (*after, has), symbol | AIMED, 0.0, 0.0
        elif due:  # an earlier promise is the stricter one
            yield (*after, has), symbol | AIMED, 0.0, 0.0
        else:
            yield (after[0], AROUND, has), symbol | AIMED, 0.0, 0.0
    elif kind == THREAT_:
        yield (*after, has or 1), symbol | AIMED, 0.0, 0.0


def _report(state, symbol):
    """State: 0 no report in the clause, 1 one was promised, 2 it came."""
    if symbol & 7 == REPORT_:
        if state:
            yield 2, symbol, 0.0, 0.0
        return
    yield state, symbol | TOLD if state and symbol & 7 in CHARGED else symbol, 0.0, 0.0


def _factor(symbol: int) -> float:
    return (0.25 if symbol & NEGATED else 1.0) * (0.5 if symbol & TOLD else 1.0)


def _insult(state, symbol):
    """State: 0 nothing, 1 one insult that isn't aimed, 2 a match."""
    if symbol & 7 != INSULT:
        yield state, symbol, 0.0, 0.0
        return
    f, aimed = _factor(symbol), bool(symbol & AIMED)
    yield 2 if state or aimed else 1, symbol, f, f * 0.5 * aimed


def _threat(state, symbol):
    if symbol & 7 == THREAT_ and symbol & AIMED:
        yield 1, symbol, 0.0, 2.0 * _factor(symbol)
    else:
        yield state, symbol, 0.0, 0.0


MATCHED, LONE, NOTHING = "matched", "lone", "nothing"
#: In the order of their composition, each with its first states.
CASCADE = (
    Transducer((0,), _negation, lambda s: ""),
    Transducer(((AROUND + 1, 0, 0),), _target, lambda s: None if s[1] or s[2] == 1 else ""),
    Transducer((0, 1), _report, lambda s: None if s == 1 else ""),
    Transducer((0,), _insult, lambda s: ("", LONE, MATCHED)[s]),
    Transducer((0,), _threat, lambda s: MATCHED if s else ""),
)


class Composition:
    """The composition of a cascade, whose states and arcs are made when they are first read."""

    def __init__(self, cascade: tuple[Transducer, ...] = CASCADE):
        self.cascade = cascade
        self.start = [()]
        for t in cascade:
            self.start = [(*s, x) for s in self.start for x in t.start]
        self._arcs: dict[tuple, list[tuple]] = {}
        self._final: dict[tuple, str | None] = {}

    def arcs(self, state: tuple, symbol: int) -> list[tuple]:
        """``(next, factor, bonus)`` of all arcs."""
        got = self._arcs.get((state, symbol))
        if got is None:
            paths = [((), symbol, 0.0, 0.0)]
            for t, x in zip(self.cascade, state):
                paths = [((*head, y), written, f + g, b + c) for head, read, f, b in paths for y, written, g, c in t.arcs(x, read)]
            got = self._arcs[state, symbol] = [(s, f, b) for s, _, f, b in paths]
        return got

    def final(self, state: tuple) -> str | None:
        """The outcome of a path that ends here; None where it may not."""
        if state not in self._final:
            ends = [t.final(x) for t, x in zip(self.cascade, state)]
            self._final[state] = None if None in ends else MATCHED if MATCHED in ends else LONE if LONE in ends else NOTHING
        return self._final[state]

    def best(self, symbols: list[tuple[int, float]]) -> tuple[str, float]:
        """Outcome and weight of the best accepting path; a match is better than none whatever its weight."""
        now = dict.fromkeys(self.start, 0.0)
        for symbol, x in symbols:
            step: dict[tuple, float] = {}
            for state, total in now.items():
                for to, f, b in self.arcs(state, symbol):
                    w = total + f * x + b
                    if w > step.get(to, -1.0):
                        step[to] = w
            now = step
        ends: dict[str, float] = {}
        for state, total in now.items():
            if (end := self.final(state)) is not None:
                ends[end] = max(ends.get(end, 0.0), total)
        for end in (MATCHED, LONE):
            if end in ends:
                return end, ends[end]
        return NOTHING, 0.0


class Grammar:
    """Lexicon and composition.  ``arcs`` maps trie keys to weights.

    A key that starts with 2 or 3 accepts only from the second or third
    distinct word of the text that passes it: a counter with four states.
    """

    def __init__(self, arcs: dict[str, float]):
        self.arcs = {k: v for k, v in arcs.items() if k[0] not in "23"}
        self.repeated = {k: v for k, v in arcs.items() if k[0] in "23"}
        self.watched = {k[1:] for k in self.repeated}
        self.machine = Composition()
        self._memo: dict[str, tuple[float, tuple[str, ...]]] = {}

    def word(self, word: str) -> tuple[float, tuple[str, ...]]:
        """The weight of a word by itself, and the counted keys that it passes."""
        got = self._memo.get(word)
        if got is None:
            keys = beginnings(word)
            got = max([SEED.get(word, 0.0), *(self.arcs.get(k, 0.0) for k in keys)]), tuple(k for k in keys if k in self.watched)
            if len(self._memo) > 60_000:
                self._memo.clear()
            self._memo[word] = got
        return got

    def insults(self, words: set[str]) -> dict[str, float]:
        """The insulting ones among a text's distinct words, with their weights."""
        hot, passed = {}, {}
        seen: Counter = Counter()
        for w in words:
            x, keys = self.word(w)
            if x:
                hot[w] = x
            if keys:
                passed[w] = keys
                seen.update(keys)
        for w, keys in passed.items():
            x = max(self.repeated.get(f"{n}{k}", 0.0) for k in keys for n in range(2, min(3, seen[k]) + 1)) if any(seen[k] > 1 for k in keys) else 0.0
            if x > hot.get(w, 0.0):
                hot[w] = x
        return hot

    @staticmethod
    def symbols(words: list[str], hot: dict[str, float]) -> list[tuple[int, float]]:
        """What the transducers read: the symbol of each word, and its weight."""
        return [(INSULT, hot[w]) if w in hot else (KIND.get(w, OTHER), 0.0) for w in words]

    def clauses(self, text: str) -> list[tuple[str, float]]:
        """Outcome and weight of each clause with an insult or a threat."""
        low = text.lower()
        words = set(WORD.findall(low))
        hot = self.insults(words)
        if not hot and THREAT.isdisjoint(words):
            return []
        out = []
        for part in CLAUSE.split(low):
            tokens = WORD.findall(part)
            if not (hot.keys().isdisjoint(tokens) and THREAT.isdisjoint(tokens)):
                out.append(self.machine.best(self.symbols(tokens, hot)))
        return out

    def raw(self, text: str) -> tuple[float, int]:
        """The sum over the clauses that count, and their number."""
        found = [(end, w) for end, w in self.clauses(text) if end != NOTHING]
        if len(found) < 2:
            found = [(end, w) for end, w in found if end == MATCHED]
        return sum(w for _, w in found), len(found)


KIND = {**dict.fromkeys(REPORT, REPORT_), **dict.fromkeys(NEGATION, NEGATION_), **dict.fromkeys(TARGET, TARGET_), **dict.fromkeys(THREAT, THREAT_)}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each beginning by label, summed within the partition in bounded steps.

    Each of n equal rows counts 1 / n, wherever they are.
    """
    sums: tuple[Counter, Counter] = (Counter(), Counter())

    def flush():
        keys = list(sums[0].keys() | sums[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([sums[1][k] for k in keys], pa.float64()), pa.array([sums[0][k] for k in keys], pa.float64())], names=["key", "pos", "neg"])
        sums[0].clear()
        sums[1].clear()
        return out

    known: dict[str, list[str]] = {}
    for batch in batches:
        for label, n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            keys = counted(set(WORD.findall(text.as_py().lower())), known)
            sums[label].update(keys if n == 1 else dict.fromkeys(keys, 1 / n))
            if len(sums[0]) + len(sums[1]) > 150_000:
                yield flush()
    yield flush()


def fit_curve(points: list[tuple[float, int, int]], steps: int = 60) -> tuple[float, float]:
    """Intercept and slope of a logistic curve through (x, positives, all), by damped Newton steps."""
    a, b, ridge = 0.0, 0.0, 1.0
    for _ in range(steps):
        ga, gb, haa, hab, hbb = -1e-3 * a, -ridge * b, 1e-3, 0.0, ridge
        for x, pos, n in points:
            p = 1 / (1 + math.exp(-max(-30, min(30, a + b * x))))
            ga += pos - n * p
            gb += (pos - n * p) * x
            v = n * p * (1 - p)
            haa, hab, hbb = haa + v, hab + v * x, hbb + v * x * x
        det = haa * hbb - hab * hab
        if abs(det) < 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a + max(-2, min(2, da)), b + max(-2, min(2, db))
    return a, b


def learn(train: DataFrame, pos: int, neg: int, min_texts: int = 4, min_odds: float = 40.0, evidence: float = 12.0) -> dict[str, float]:
    """The arcs of the insult trie from ``train(label, copies, text)``, of which ``pos`` and ``neg`` texts are distinct."""
    ship(train.sparkSession)
    if not pos or not neg:
        return {}
    p, q = F.col("pos"), F.col("neg")
    odds = F.log((p + 0.5) / (pos + 1.0)) - F.log((q + 0.5) / (neg + 1.0))
    part = lambda n, share: F.when(n > 0, n * F.log(n / ((p + q) * share))).otherwise(0.0)
    gain = part(p, pos / (pos + neg)) + part(q, neg / (pos + neg))
    counts = train.select("label", "copies", "text").mapInArrow(_count, "key string, pos double, neg double").groupBy("key").agg(F.round(F.sum("pos")).alias("pos"), F.round(F.sum("neg")).alias("neg"))
    best = counts.filter(p >= min_texts).withColumn("odds", odds).filter((F.col("odds") >= math.log(min_odds)) & (gain >= evidence))
    return pruned({r["key"]: min(4.0, r["odds"]) for r in best.select("key", "odds").collect()})


def pruned(arcs: dict[str, float]) -> dict[str, float]:
    """Without the arcs that a shorter beginning of at least their weight covers."""
    heads = {k: (k[0] if k[0] in "23" else "", k.lstrip("23")) for k in arcs}
    return {k: v for k, v in arcs.items() if not any(arcs.get(heads[k][0] + heads[k][1][:j], -math.inf) >= v for j in range(3, len(heads[k][1])))}


def _raw(docs: DataFrame, arcs: dict[str, float], keep: str) -> DataFrame:
    """The columns ``keep`` with ``raw`` and ``clauses``, of rows with these and a text behind them."""

    def run(batches):
        grammar = Grammar(arcs)
        for b in batches:
            got = [grammar.raw(t.as_py()) for t in b.columns[-1]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())], names=[*b.schema.names[:-1], "raw", "clauses"])

    return docs.mapInArrow(run, f"{keep}, raw double, clauses long")


def held_out(id_col, folds: int):
    """True where the CRC of the id as text falls into the fold that isn't learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def labelled(labels: DataFrame, folds: int, id_col: str, label_col: str) -> DataFrame:
    """``doc_id, label`` of the ids to learn from, one row an id."""
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) > 0).cast("int").alias("label"))
    return materialize(marks.filter(~held_out("doc_id", folds)).groupBy("doc_id").agg(F.max("label").alias("label")))


def distinct_texts(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``doc_id, print, label, copies``: one id for each distinct labelled text of ``rows(doc_id, print)``, and its number of equal rows."""
    ids = rows.groupBy("doc_id", "print").agg(F.count(F.lit(1)).alias("copies")).join(marks, "doc_id")
    texts = ids.groupBy("print").agg(F.max("label").alias("label"), F.min(F.struct("doc_id", "copies")).alias("first"))
    return materialize(texts.select("first.doc_id", "print", "label", "first.copies"))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> tuple[dict, tuple]:
    """Arcs and curve, learned outside the held-out fold.

    Ids and hashes choose a row for each distinct text.  Texts meet its label by
    a shuffle at any size of the labels, which grow with the corpus; only labelled
    texts are scored for the curve.
    """
    ship(docs.sparkSession)
    marks = labelled(labels, folds, id_col, label_col)
    train = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("print", F.xxhash64("text")).filter(~held_out("doc_id", folds))
    chosen = distinct_texts(train.select("doc_id", "print"), marks)
    n = {r[0]: r[1] for r in chosen.groupBy("label").count().collect()}
    train = materialize(train.hint("merge").join(chosen, ["doc_id", "print"]).select("label", "copies", "text"))
    arcs = learn(train, n.get(1, 0), n.get(0, 0), **options)
    known = _raw(train.select("label", "copies", "text"), arcs, "label int, copies long")
    points = known.groupBy(F.round(F.log1p("raw"), 2).alias("x")).agg(F.round(F.sum(F.col("label") / F.col("copies"))).alias("p"), F.round(F.sum(1 / F.col("copies"))).alias("n")).collect()
    curve = fit_curve([(r["x"], r["p"], r["n"]) for r in points]) if any(r["p"] for r in points) and any(r["n"] > r["p"] for r in points) else CURVE
    return arcs, curve


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> DataFrame:
    """``doc_id, held_out, score, predicted, raw, clauses`` for every row."""
    arcs, (a, b) = fit(docs, labels, folds, id_col, text_col, label_col, **options)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    scored = _raw(base.select("doc_id", held_out("doc_id", folds).alias("held_out"), "text"), arcs, "doc_id long, held_out boolean")
    out = scored.withColumn("score", 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.log1p("raw")))))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "raw", "clauses")


def reject(docs: DataFrame, labels: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> DataFrame:
    """The rows of ``docs`` whose text isn't toxic, with all their columns."""
    arcs, (a, b) = fit(docs, labels, folds, id_col, text_col, label_col, **options)
    at = docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # names may hold dots and quotes, which the map can't read

    def run(batches):
        grammar = Grammar(arcs)
        for batch in batches:
            # a text at a time: a batch of long ones is large
            keep = [a + b * math.log1p(grammar.raw(t.as_py() or "")[0]) < 0 for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
