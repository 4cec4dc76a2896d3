"""From raw documents to packed sequences: quality rules, language, near duplicates, personal data, packing.

All stages but the last give the columns of their input, whatever extra columns it has (names that begin with _ and a stage's letter, as
_q_ or _p_, are reserved). An empty table gives an empty one. Texts of any length are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomframe.llm import langid, neardup, packing, pii, quality
from loomframe.llm.shared import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the quality rules; remove lines that too many documents of a host share.

    A null or empty text has no words and goes; a null source is a host of its own; repeated rows are judged alike, and count once
    where a line's documents are counted.
    """
    return quality.clean(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is rejected.

    A null text, or one without a letter, is rejected; null lang is not learnt from; without any lang all go. Repeated rows stay or go together.
    """
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five words, similarity 0.8).

    The smallest doc_id of a group stays, of repeated rows of that id one. Texts that are null or without words are no one's
    duplicates; rows with a null doc_id all stay.
    """
    return neardup.drop_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in texts by the kind's name.

    Null texts stay null. Of overlapping spans the first one's name stands for all. Repeated rows stay alike; n_chars follows the text.
    """
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all texts into sequences of 2048 tokens; the last stage, so it returns pieces.

    Null texts are empty ones (an end token); repeated rows and ids have pieces of their own; ties in length are packed by columns' order.
    """
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("language ID", language), ("near duplicates", near_duplicates), ("personal data", personal_data), ("packing", pack)]

#: Language ID, minhash and tokenization are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
