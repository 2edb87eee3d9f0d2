"""Secret scans: base patterns plus a character-level likelihood-ratio test.

Two Markov models of order 2 over single characters are trained from labelled
samples, one of random strings and one of ordinary identifiers, words and numbers.
A candidate is a run of at least 16 characters of base64 and base64url; what
remains of it outside the base spans, in parts of at least 16, is reported as
``markov`` when the log-likelihood ratio exceeds ``evidence + slope * length``.
Nothing but this ratio decides: a random string of letters alone is found like
any other, and a long number is ordinary because numbers are among the samples.
Base spans are always kept.

The samples are ``(string, label)`` pairs, label 1 for random.  Without samples
of one's own, :func:`default_samples` gives 8,000 seeded ones: random strings in the
usual alphabets, and identifiers, words, paths, dates, versions and numbers.

Edge cases: a null text counts as empty; an empty text has no spans and the
SHA-256 of the empty string as digest; offsets are code points of the whole
text whatever its length; repeated rows are scanned each; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ship, text_of

KINDS = ("assign", "access", "hex", "markov")


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYS = ("password", "passwd", "secret", "token")
ASSIGN = re.compile("(" + "|".join([*map(_any_case, KEYS), _any_case("api") + "_?" + _any_case("key")]) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
# a run that is too short holds no longer one, so the lower bound can stand in the pattern
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")
HINT = re.compile("passw|secret|token|api_?key")
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
EVIDENCE, SLOPE = 10.0, 0.1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, by start, then kind."""
    found = []
    if HINT.search(text.lower()):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


# -- the models --------------------------------------------------------------
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1  # the last symbol stands for the start
_CODE = np.full(128, SIZE - 1, np.int64)
for _k, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _k


def _codes(token: str) -> np.ndarray:
    return _CODE[np.frombuffer(token.encode("ascii", "replace"), np.uint8)]


def train(samples: Iterable[tuple[str, int]], smoothing: float = 0.3) -> np.ndarray:
    """Log-likelihood ratios of random to ordinary, by the two preceding characters."""
    counts = np.full((2, SIZE, SIZE, SIZE), 0.0)
    for token, label in samples:
        c = np.concatenate([[SIZE - 1, SIZE - 1], _codes(token)])
        np.add.at(counts[label], (c[:-2], c[1:-1], c[2:]), 1)
    # back off to order 1, then to uniform
    pair = counts.sum(1)
    p1 = (pair + smoothing) / (pair.sum(-1, keepdims=True) + smoothing * SIZE)
    weight = 4.0
    p2 = (counts + weight * p1[:, None]) / (counts.sum(-1, keepdims=True) + weight)
    return np.log(p2[1]) - np.log(p2[0])


def ratio(model: np.ndarray, token: str) -> float:
    """Log-likelihood ratio, positive where the token looks random."""
    c = np.concatenate([[SIZE - 1, SIZE - 1], _codes(token)])
    return float(model[c[:-2], c[1:-1], c[2:]].sum())


WORDS = """the of and to in is that for with this from are was have data user name file path line code test build value index table
query result error message server client request response config option default version number string array list object
class method function module package import export return public private static final const time date start end first last
next previous count total size length width height color image video audio text title author license copyright source
target input output read write open close create delete update insert select order group filter sort merge split join left right
inner outer upper lower max min sum average random hash key token session cookie header body content type format encode decode
la el los las una para por con del que sobre entre cuando desde hasta nuevo ciudad tiempo persona trabajo
le les des une dans pour sur avec pas est sont nous vous leur maison monde jour travail
der die das und nicht mit auf von dem den ein eine einer ist sind wir haus welt arbeit zeit stadt
ing tion ment able ness less ship heit keit lich ung schaft cion mente idad eau eux aire elle""".split()


def default_samples(n: int = 8000, seed: int = 7) -> list[tuple[str, int]]:
    """``n`` labelled samples, half of them random."""
    rng = random.Random(seed)
    hexa, b62 = "0123456789abcdef", ALPHABET[:62]
    alphabets = [hexa, b62, ALPHABET[:64], "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", hexa.upper(), b62]
    out = [("".join(rng.choices(alphabets[k % len(alphabets)], k=rng.randint(16, 64))), 1) for k in range(n // 2)]
    for k in range(n - n // 2):
        parts = rng.choices(WORDS, k=rng.randint(3, 8))
        kind = k % 9
        if kind == 0:
            s = "_".join(parts)
        elif kind == 1:
            s = parts[0] + "".join(p.capitalize() for p in parts[1:])
        elif kind == 2:
            s = "-".join(parts)
        elif kind == 3:
            s = "/".join(parts)
        elif kind == 4:
            s = "_".join(parts).upper()
        elif kind == 5:
            s = f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}-" + "-".join(parts[:3])
        elif kind == 6:
            s = "".join(parts) + str(rng.randint(0, 10 ** rng.randint(1, 4)))
        elif kind == 7:
            s = "".join(rng.choices("0123456789", k=rng.randint(8, 40)))
        else:
            s = "".join(parts)
        out.append((s, 0))
    return out


def method_spans(text: str, model: np.ndarray, evidence: float, base: list[tuple[int, int, int]], slope: float = SLOPE) -> list[tuple[int, int, int]]:
    """Spans of random strings outside the base spans (which are sorted)."""
    found = []
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        for a, _, b in [s for s in base if s[0] < end and at < s[2]] + [(end, 0, end)]:
            if a - at >= LEAST and ratio(model, text[at:a]) > evidence + slope * (a - at):
                found.append((at, 3, a))
            at = max(at, b)
    return found


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SPANS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"


def _scan(model: np.ndarray, evidence: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = x.as_py()
                base = base_spans(text)
                every = sorted(base + method_spans(text, model, evidence, base))
                n = [sum(s[1] == k for s in every) for k in range(4)]
                rows.append((doc, n[0], n[1], n[2], hashlib.sha256(_join(base).encode()).hexdigest(), _join(every), n[3]))
            names = [x.strip().split(" ")[0] for x in SPANS.split(",")]
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            kinds = [pa.int64() if x.strip().endswith("long") else pa.string() for x in SPANS.split(",")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return run


def scan(docs: DataFrame, samples: Iterable[tuple[str, int]] | None = None, evidence: float = EVIDENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the counts and places of what was found."""
    ship(docs.sparkSession)
    model = train(samples if samples is not None else default_samples())
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(_scan(model.astype(np.float32), evidence), SPANS)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", **options) -> DataFrame:
    """The documents with every span of their text replaced by ``mask``."""
    ship(docs.sparkSession)
    model = train(options.pop("samples", None) or default_samples())
    evidence = options.pop("evidence", EVIDENCE)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            base = base_spans(text)
            at, out = 0, []
            for a, _, b in sorted(base + method_spans(text, model, evidence, base)):
                if b <= at:
                    continue
                out += [text[at:a], mask] if a >= at else []
                at = b
            return "".join(out) + text[at:]

        return texts.map(one)

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))
