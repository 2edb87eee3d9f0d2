"""The grammar clause by clause, and scores on rows that nothing was learned from."""

import zlib

from cases import ROWS, empty, labels, read, table, untouched

from corpusloom.llm import toxicity as tox
from corpusloom.llm.queries import QUERIES


def raw(text, arcs=()):
    return tox.Grammar(dict(arcs)).raw(text)[0]


def test_no_isolated_word_scores():
    assert raw("the weather is fine") == 0 and raw("") == 0
    assert raw("an idiot") == 0 and raw("idiot") == 0 and raw("never an idiot") == 0
    assert raw("you idiot") == 4.5 and raw("this idiot is a moron") == 8.0
    assert raw("an idiot. the sky") == 0 and raw("an idiot. a moron") == 8.0
    assert tox.Grammar({}).clauses("an idiot. you moron!") == [("lone", 4.0), ("matched", 4.5)]


def test_transducers_compose():
    assert raw("you are never an idiot") == 0.25 * 4.5
    assert raw("they said an idiot") == 0.5 * 4.5 and raw("john said this idiot is a moron") == 4.0
    assert raw("you or someone near to that man idiot") == 0  # the target is too far
    assert raw("idiot as big as you") == 4.5 and raw("idiot as big and tall as you") == 0
    assert raw("I will kill you") == 2.0 and raw("to kill time") == 0 and raw("I will never kill you") == 0.5
    assert raw("you idiot. the sky") == raw("you idiot")
    assert tox.Grammar({}).raw("you idiot. you moron!") == (9.0, 2)


def paths(symbols):
    """Every path of the cascade, transducer by transducer: (outcomes, weight)."""
    strings = [([s for s, _ in symbols], 0.0, [])]
    for t in tox.CASCADE:
        out = []
        for string, weight, ends in strings:
            todo = [(state, [], weight) for state in t.start]
            for k, symbol in enumerate(string):
                todo = [(to, [*wrote, w], total + f * symbols[k][1] + bonus) for state, wrote, total in todo for to, w, f, bonus in t.arcs(state, symbol)]
            out += [(wrote, total, [*ends, t.final(state)]) for state, wrote, total in todo if t.final(state) is not None]
        strings = out
    return [(ends, weight) for _, weight, ends in strings]


def by_rule(symbols):
    """What the grammar says of a clause, without automata."""
    kinds = [s for s, _ in symbols]
    told = 0.5 if tox.REPORT_ in kinds else 1.0
    total, aimed_any, insults, threats = 0.0, False, 0, 0
    for k, (s, x) in enumerate(symbols):
        damp = told * (0.25 if tox.NEGATION_ in kinds[max(0, k - 3) : k] else 1.0)
        if s == tox.INSULT:
            aimed = tox.TARGET_ in kinds[max(0, k - 4) : k + 5]
            total += damp * (x + 0.5 * aimed)
            insults, aimed_any = insults + 1, aimed_any or aimed
        elif s == tox.THREAT_ and tox.TARGET_ in kinds:
            total, threats = total + damp * 2.0, threats + 1
    end = tox.MATCHED if aimed_any or insults > 1 or threats else tox.LONE if insults else tox.NOTHING
    return end, total if end != tox.NOTHING else 0.0


def test_composition_equals_all_paths():
    import random

    rng, machine = random.Random(8), tox.Composition()
    for n in range(400):
        symbols = [(s, rng.choice([1.0, 2.5, 4.0]) if s == tox.INSULT else 0.0) for s in rng.choices(tox.SYMBOLS, (4, 2, 1, 1, 1, 1), k=rng.randrange(9))]
        ends = {}
        for outcome, w in paths(symbols):
            end = tox.MATCHED if tox.MATCHED in outcome else tox.LONE if tox.LONE in outcome else tox.NOTHING
            ends[end] = max(ends.get(end, 0.0), w)
        end = next((e for e in (tox.MATCHED, tox.LONE) if e in ends), tox.NOTHING)
        got = machine.best(symbols)
        assert got[0] == end and abs(got[1] - (ends[end] if end != tox.NOTHING else 0)) < 1e-9
    for n in range(3000):
        symbols = [(s, 3.0 if s == tox.INSULT else 0.0) for s in rng.choices(tox.SYMBOLS, (9, 2, 1, 1, 1, 1), k=rng.randrange(30))]
        got, want = machine.best(symbols), by_rule(symbols)
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-9, (symbols, got, want)


def test_counted_keys_need_company():
    arcs = {"2bad": 3.0}
    assert raw("badly done", arcs) == 0 and raw("badly badger", arcs) == 6.0 and raw("badly badly", arcs) == 0
    assert raw("badly. a badger", arcs) == 6.0 and raw("you badly", arcs) == 0


def test_held_out_scores(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in read(QUERIES["op6_toxicity"](spark, sf))}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    marks = {r["doc_id"]: r["toxic"] for r in read(spark.read.parquet(f"{sf}/labels.parquet"))}
    held = [(marks[i], r["score"]) for i, r in got.items() if i in marks and r["held_out"]]
    good, bad = [s for t, s in held if t], [s for t, s in held if not t]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95
    assert sum(b >= 0.5 for b in bad) <= 0.03 * len(bad)


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    sf = "/root/testdata/sf0.001"
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F

    flipped = marks.withColumn("toxic", F.when(tox.held_out("doc_id", 5), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")})
    score = lambda d, m: {r["doc_id"]: r["score"] for r in read(tox.score(d, m))}
    assert score(docs, marks) == score(other, flipped)


def test_copies_of_one_text_do_not_hide_other_insults(spark):
    letters = "bcdfghjklmnp"
    long = " ".join(a + b + c + "ovat" for a in letters for b in letters for c in letters)
    rows = [(i, "toxic", long) for i in range(400)] + [(i, "toxic", f"you number {i} are a zorgblat indeed") for i in range(400, 430)]
    rows += [(i, "clean", f"number {i} is a sparrow indeed") for i in range(430, 1100)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, _, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    marks = labels(spark, [(i, 0, int(kind == "toxic")) for i, kind, _ in rows])
    arcs, curve = tox.fit(docs, marks)
    assert any("zorgblat".startswith(k) for k in arcs) and not any("ovat" in k or k.startswith("bbb") for k in arcs)
    got = {r["doc_id"]: r["predicted"] for r in read(tox.score(docs, marks))}
    assert all(got[i] for i in range(400, 430)) and not any(got[i] for i in range(430, 1100))
    # equal rows, ids and all, weigh as one
    assert tox.fit(docs.unionByName(docs), marks) == (arcs, curve)


def test_a_longer_arc_of_more_weight_stays():
    assert tox.pruned({"abc": 1.0, "abcd": 2.0, "abcde": 2.0, "2abc": 3.0, "2abcd": 1.0}) == {"abc": 1.0, "abcd": 2.0, "2abc": 3.0}


def test_edges(spark):
    got = read(tox.score(table(spark), labels(spark)))
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[15]["predicted"] == 1 and by[1]["predicted"] == 0 and by[5]["score"] == by[6]["score"]
    none = labels(spark, [(None, None, None)])
    assert len(read(tox.score(table(spark), none))) == len(ROWS)
    assert read(tox.score(empty(spark), labels(spark))) == [] and read(tox.score(empty(spark), labels(spark).limit(0))) == []
    docs = table(spark)
    kept = tox.reject(docs, labels(spark))
    assert kept.columns == docs.columns and untouched(kept)
    ids = [r["doc_id"] for r in read(kept)]
    assert 15 not in ids and len(ids) == len(ROWS) - 1
