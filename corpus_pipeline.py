"""The corpus pipeline: quality rules, line dedup, near-duplicate join, decontamination, source mixing.

Each stage takes any table with ``doc_id, text`` (the last one ``source`` too) and, but for the last, returns the same
columns, whatever their names. Empty tables give no rows; texts are read whole; null ids and sources are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import decontam, lines, mixing, ngrams, quality
from nearfield.llm.common import reliable, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep. A null or empty text has no words and goes; repeated rows fare alike."""
    return quality.keep(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that stand elsewhere, or nearly so. No row goes: a text may become empty, a null one
    stays null, and rows equal in id and text keep one text."""
    return lines.keep(docs)


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the first by id and text digest; of equal rows one. Texts without
    words, null or emptied, resemble none and stay."""
    return ngrams.keep(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no benchmark item contaminates. Null and empty texts have no words and stay; repeated rows fare
    alike; null and empty items match nothing."""
    return decontam.keep(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, a row for each document. A null text takes none; a null source is
    a source of its own; repeated rows have places of their own."""
    return mixing.mixture(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", ngram_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: The stages compare texts approximately, which DuckDB can't repeat; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after another; what a stage returns is stored once, in the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = reliable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
