"""The corpus pipeline: stages in order, each given all that its predecessor kept.

Every stage but the last returns the columns of documents, whatever other columns there are. Stages keep clean
documents: they drop what fails the quality rules, near duplicates but one of each group, and texts with benchmark
items; mixing then repeats or leaves out documents by its sources' budgets, and the last stage writes token files and
describes them. An empty table stays empty through all stages; very long texts are worked on whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import dac, decontaminate, mixing, quality, simhash
from corpusloom.llm.common import materialise, table
from corpusloom.llm.queries import END_ID


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a risk-controlled rule rejects go.

    A null or empty text has no words and goes; repeated rows are judged each, alike; labels with nulls are ignored.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, a similarity of about 0.8 and more.

    The smallest doc_id stays, null ones come last; rows that share a doc_id, or have none, are one document only if
    their texts are equal. Texts without words are near duplicates of each other.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null and empty texts contain nothing, null and empty items, and items without an id, are in nothing; repeated rows
    stay or go alike.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    A null source is one source, named last; a null text has no words; rows that share a doc_id are taken together.
    """
    return mixing.repeat_rows(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, described by document: (doc_id, start, n_tokens, ids_crc32).

    In ascending doc_id, null ones first, rows that share one by length and hash of their text; a null text is the end
    id alone; a document that the mix repeats is written as often.
    """
    return dac.tokenise(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("token_output", token_output),
]

#: No SQL: fingerprints, components and file formats are beyond it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
