"""A training corpus from documents: language, near-duplicates, decontamination, mixing, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is written as Parquet
and read again as the next stage's docs. All stages but the last return the columns of documents.

In every stage rows that repeat a doc_id and text stand or fall together, columns beside those of
documents come through unchanged whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fileloom.llm import decontam, langid, mixing, neardup, tokenout
from fileloom.llm.queries import table, tokenizer_path
from fileloom.llm.shared import stored

#: A language is rejected below this probability.
LEAST_SCORE = 0.34


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no language: null, without a letter, or with no clear prediction. A null lang
    teaches nothing; where none is known, no text has a language, and all go."""
    return langid.in_language(docs, langid.fit(docs), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group with 0.8 of their five-word shingles in common, that with the
    smallest doc_id. Texts without words are like no other, and rows without doc_id stay."""
    return neardup.without_copies(docs, percent=80, size=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain half of a benchmark item or more. Null and empty texts, and items
    without one, contain and match nothing."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), threshold=0.5)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources, each at least once and on average 1.5 times at most. A null
    source is a source, and a text without words has one copy where its source has no other."""
    return mixing.mix(docs, repetition=1.5)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files and returns what they hold: doc_id, start, n_tokens, ids_crc32 of every row,
    a null or empty text being the end id alone."""
    return tokenout.token_output(docs, tokenizer_path()).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("token_ids", token_ids)]

#: No SQL expresses a trained classifier or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return stored(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
