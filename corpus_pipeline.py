"""The corpus pipeline: five stages, each of which reads what the one before wrote.

Toxic documents go, equal and nearly equal documents leave one each, sources
are mixed to target weights by whole and partial repetition, and the result is
packed into sequences.  Each stage takes ``(spark, docs, sf_dir)``; all but the
last return the columns of ``documents``.

Edge cases, as the operators have them: a null text counts as empty and isn't
toxic; all empty texts are one group, of which one document stays; a null id
stays null, and loses to any other; of rows repeated as a whole one stays, until
mixing repeats it; a null source is a source of its own; documents without a label
are judged like any other; an empty table gives an empty result; extra columns,
whatever their names, come through unchanged up to the last stage, which reports
pieces.  A stage's table is deleted once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from corpusloom.llm.common import discard, shared_folder


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity grammar rejects (operator 6)."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts (operator 2)."""
    return exact_dedup.deduplicate(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each class of near-duplicates (operator 4)."""
    return near_dedup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, rare sources up to twice (operator 7)."""
    return mixing.apply(docs, max_repeats=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in sequences (operator 9)."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_equal),
    ("near_dedup", drop_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the grammar, the signatures and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
