"""Secret scans against the patterns as they are stated, and the Markov models on held-out samples."""

import hashlib
import random
import re

from cases import ROWS, documents, empty, read, table

from corpusloom.llm import secrets as sec

ASSIGN = re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(spans)


def check(rows, got):
    assert len(got) == len(rows)
    by = {}
    for i, t, *_ in rows:
        by.setdefault(i, set()).add(t)
    for r in got:
        wants = [brute(t) for t in by[r["doc_id"]]]
        joined = [",".join(f"{sec.KINDS[k]}:{a}:{b}" for a, k, b in w) for w in wants]
        at = [hashlib.sha256(j.encode()).hexdigest() for j in joined].index(r["base_sha256"])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in wants[at]) for k in range(3)]
        every = [x for x in r["spans"].split(",") if x]
        assert [x for x in every if not x.startswith("markov")] == [x for x in joined[at].split(",") if x]
        assert len(every) - r["n_markov"] == len(wants[at])


def test_base_spans(spark):
    docs = documents(spark)
    check([(r["doc_id"], r["text"]) for r in docs.collect()], read(sec.scan(docs)))


def test_edges(spark):
    check([r[:2] for r in ROWS], read(sec.scan(table(spark))))
    assert read(sec.scan(empty(spark))) == []
    blank = [r for r in read(sec.scan(table(spark))) if r["doc_id"] == 5][0]
    assert blank["spans"] == "" and blank["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_patterns():
    assert sec.base_spans("API-key: abcdef") == [] and sec.base_spans("apikey=abcde") == []
    assert sec.base_spans("\U0001f600 API_KEY\" : 'abcdef'") == [(2, 0, 20)]
    assert sec.base_spans("AKIA" + "A" * 15) == [] and sec.base_spans("AKIA" + "A" * 16) == [(0, 1, 20)]
    assert sec.base_spans("0" * 23) == [] and sec.base_spans("g" + "0" * 24 + "g") == [(1, 2, 25)]


def random_looking(model, token):
    return sec.method_spans(token, model, sec.EVIDENCE, []) == [(0, 3, len(token))]


def test_models_tell_random_from_ordinary():
    model = sec.train(sec.default_samples(8000, 7))
    other = [(t, y) for t, y in sec.default_samples(4000, 99) if len(t) >= sec.LEAST]
    right = sum(random_looking(model, t) == bool(label) for t, label in other)
    assert right >= 0.97 * len(other)
    rng = random.Random(5)
    token = "".join(rng.choices(sec.ALPHABET[:62], k=40)) + "7x"
    text = f"see {token} and some_ordinary_identifier_name_2 and https://example.org/path/to/page1"
    found = sec.method_spans(text, model, sec.EVIDENCE, [])
    assert [(a, b) for a, _, b in found] == [(4, 4 + len(token))]


def test_letters_alone_are_found_and_numbers_are_not():
    model, rng = sec.train(sec.default_samples()), random.Random(17)
    for alphabet, least in ((sec.ALPHABET[:26], 0.9), (sec.ALPHABET[:52], 0.97), (sec.ALPHABET[:62], 0.97), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.9)):
        assert sum(random_looking(model, "".join(rng.choices(alphabet, k=24))) for _ in range(300)) >= least * 300
    assert sum(random_looking(model, "".join(rng.choices("0123456789", k=16))) for _ in range(300)) <= 3


def test_parts_outside_base_spans_are_scored():
    model, rng = sec.train(sec.default_samples()), random.Random(6)
    left, right = ("".join(rng.choices(sec.ALPHABET[36:62] + "xyz", k=24)) + "X" for _ in range(2))
    text = left + "0123456789abcdef" * 2 + "Q" + right
    base = sec.base_spans(text)
    assert base == [(25, 2, 57)]
    assert sec.method_spans(text, model, sec.EVIDENCE, base) == [(0, 3, 25), (57, 3, len(text))]
    assert sec.method_spans(text, model, sec.EVIDENCE, [(0, 0, len(text))]) == []


def test_clean_prose_is_left_alone(spark):
    """Of the long words of the corpus, none that is letters or a number alone is taken for random."""
    model, cand = sec.train(sec.default_samples()), set()
    for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect():
        text = r["text"] or ""
        base = sec.base_spans(text)
        cand |= {text[m.start() : m.end()] for m in sec.CANDIDATE.finditer(text) if not any(a < m.end() and m.start() < b for a, _, b in base)}
    plain = [t for t in cand if t.isalpha() or t.isdigit()]
    assert len(plain) > 1000 and sum(random_looking(model, t) for t in plain) <= 0.005 * len(plain)


def test_samples_of_ones_own(spark):
    df = table(spark, [(1, "zqzqzqzqzqzqzqzqzq1 abababababababababab1", "en", "a", 1)])
    samples = [("zq" * 12 + "1", 1), ("ab" * 12 + "1", 0)] * 20
    assert [x.split(":")[:2] for x in read(sec.scan(df, samples=samples))[0]["spans"].split(",")] == [["markov", "0"]]


def test_redact(spark):
    got = {r["doc_id"]: r["text"] for r in read(sec.redact(table(spark)))}
    assert got[12].count("[SECRET]") == 3 and "abcdef123456" not in got[12] and got[5] is None and got[8] == "one"
