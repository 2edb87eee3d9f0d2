"""Text functions: Column in, Column out, all inside the JVM.

White space means what Unicode calls so plus the four ASCII separators, in one
character class that Java and RE2 read alike.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.constants import SNIPPET, STOP

SPACE = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LETTERS = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"
FOLD = ("áéíóúüñ", "aeiouun")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c) -> Column:
    """Null read as empty."""
    return F.coalesce(_col(c), F.lit(""))


def strip(c) -> Column:
    return F.regexp_replace(_col(c), f"^{SPACE}+|{SPACE}+$", "")


def compact(c) -> Column:
    """Runs of white space become one space, none at the ends."""
    return strip(F.regexp_replace(_col(c), f"{SPACE}+", " "))


def tokenize(c, language: str = "en") -> Column:
    """Accent-folded words of three letters and more that aren't stop words, with repeats."""
    if language not in STOP:
        raise ValueError(f"unknown language {language!r}, not one of {sorted(STOP)}")
    words = F.regexp_extract_all(blank(c), F.lit(f"([{LETTERS}0-9_\\-]+)"), F.lit(1))
    folded = F.transform(words, lambda w: F.translate(F.lower(w), *FOLD))
    return F.filter(folded, lambda w: w.rlike("^[a-z]{3,}$") & ~w.isin(*STOP[language]))


def lemmatizer(lemmas: Callable[[str], list[str]], language: str = "en") -> Callable[[Column], Column]:
    """A tokenizer like :func:`tokenize` over the lemmas that a function finds in a text, where the rows are.

    Lemmas are lowered and lose their accents; words of three letters and more that
    aren't stop words stay.
    """
    if language not in STOP:
        raise ValueError(f"unknown language {language!r}, not one of {sorted(STOP)}")
    stop = frozenset(STOP[language])

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            folded = ("".join(x for x in unicodedata.normalize("NFKD", w.lower()) if not unicodedata.combining(x)) for w in lemmas(text or ""))
            return [w for w in folded if len(w) > 2 and w.isalpha() and w not in stop]

        return texts.map(one)

    return lambda c: run(blank(c))


def simple_tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(blank(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def split_sentences(c) -> Column:
    parts = F.split(blank(c), rf"(?<=[.!?]){SPACE}+|\n+")
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > 0)


def api_snippet(c) -> Column:
    return strip(F.substring(F.regexp_replace(blank(c), "\n", " "), 1, SNIPPET))


def rag_snippet(c) -> Column:
    return strip(F.substring(compact(blank(c)), 1, SNIPPET))


def strip_tags(c) -> Column:
    return compact(F.regexp_replace(blank(c), "<[^>]+>", " "))


def last_at(text: Column, mark: str) -> Column:
    """0-based position of the last ``mark``, -1 where there is none."""
    at = F.length(text) - F.locate(mark[::-1], F.reverse(text)) - (len(mark) - 1)
    return F.when(F.locate(mark[::-1], F.reverse(text)) == 0, -1).otherwise(at)


def truncate_budget(c, limit: int) -> Column:
    """Cut at ``limit``, or at the last space in its last three tenths."""
    text = blank(c)
    cut = F.substring(text, 1, limit)
    space = last_at(cut, " ")
    return F.when(F.length(text) <= limit, text).otherwise(strip(F.when(space > limit * 0.7, F.substring(cut, F.lit(1), space)).otherwise(cut)))


def truncate_answer(c, limit: int) -> Column:
    """Cut after a sentence, else at a word, else anywhere; the last two add three dots."""
    text = blank(c)
    cut = F.substring(text, 1, limit)
    out = F.concat(strip(cut), F.lit("..."))
    space = last_at(cut, " ")
    out = F.when(space > limit * 0.8, F.concat(strip(F.substring(cut, F.lit(1), space)), F.lit("..."))).otherwise(out)
    for mark in ("? ", "! ", ". "):
        at = last_at(cut, mark)
        out = F.when(at > limit * 0.8, strip(F.substring(cut, F.lit(1), at + 1))).otherwise(out)
    return F.when(F.length(text) <= limit, text).otherwise(out)


def sufficient(c) -> Column:
    """False only where the first line is a JSON object whose ``sufficient`` is false."""
    return ~F.coalesce(F.get_json_object(_marker(c), "$.sufficient").isin("false", "0", "", "null"), F.lit(False))


def _marker(c) -> Column:
    first = strip(F.split_part(blank(c), F.lit("\n"), F.lit(1)))
    return F.when(first.rlike(r"^\{.*\}$"), first)


def without_marker(c) -> Column:
    """The answer after a leading sufficiency marker."""
    text = blank(c)
    rest = F.when(F.instr(text, "\n") > 0, F.substring(text, F.instr(text, "\n") + 1, F.length(text))).otherwise(F.lit(""))
    marked = F.coalesce(_marker(c).isNotNull() & F.get_json_object(_marker(c), "$.sufficient").isNotNull(), F.lit(False))
    return F.when(marked, F.regexp_replace(rest, f"^{SPACE}+", "")).otherwise(text)
