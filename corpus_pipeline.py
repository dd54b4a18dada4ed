"""The corpus pipeline: each stage works on what the one before it kept, written as Parquet and read again.

Every stage takes nulls in any column, empty and very long texts, repeated rows and ids, and empty tables; columns that
`documents` does not have are left out. A stage's table is deleted once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from astraloom.llm import mixing, pieces, quality_rules, secrets, simhash
from astraloom.llm.common import DOCUMENT, read_table, release, written
from astraloom.llm.registry import tokenizer_path

MIX = mixing.Mix(share=70, epochs=1)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands reject go; null, empty and wordless texts are rejected."""
    return quality_rules.keep_good(docs.select(*DOCUMENT))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, similarity 0.8 or more) the document with the smallest id stays.

    Rows that repeat that id stay too, and rows without an id always stay. Texts without words are one group.
    """
    return simhash.keep_one(docs).select(*DOCUMENT)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text are replaced by their kind; n_chars is the new length, null for a null text."""
    return secrets.redact(docs).select(*DOCUMENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Seven tenths of the tokens that are left, by domain, language and source, each row once at most.

    Null languages and sources are 'none'; rows that repeat an id are taken one by one, within the budget.
    """
    return mixing.keep_mixed(docs, MIX).select(*DOCUMENT)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left; a null text is empty."""
    return pieces.round_trip(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("near dedup", near_dedup),
    ("secrets", scan_secrets),
    ("mixing", mix),
    ("encode", encode),
]
#: The stages are not SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(last)
    return STAGES[-1][1](spark, docs, sf_dir)
