"""A corpus pipeline of five stages, each the work of one operator; a stage reads what the one before it wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import decontaminate, jaccard, language, mixing, token_files
from loomwork.llm.common import new_path, prepare, removed

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document is rejected by language ID if no language can be told, or the best one's calibrated probability is below this.
LEAST_SCORE = 0.3
WIDTH, PERCENT = 5, 80


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told.

    A null or empty text, or one without a letter, goes. A null id or source makes no difference, a null lang is not learned from. Repeated rows stay or go
    each; with nothing to learn from all rows go, and an empty table gives an empty table.
    """
    prepare(spark)
    docs = _own(docs)
    return language.identify(docs, language.fit(docs), keep=COLUMNS).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the one of the smallest id.

    Null and empty texts are in no group and stay, rows with a null id stay, repeated rows are one, and of one id with several texts each text
    is judged on its own. An empty table gives an empty table.
    """
    return jaccard.first_of_each(_own(docs), WIDTH, PERCENT).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null and empty texts hold none and stay, null and empty items are not searched. Repeated rows stay or go each; empty tables are empty or
    leave all rows.
    """
    return decontaminate.clean(_own(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources take their targets' shares.

    A null text has no words, a null source is one, a null id draws as one of its own, repeated rows draw alike. Without any words no row is taken.
    """
    prepare(spark)
    return mixing.mixed(_own(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the mix as token-id files and gives them back: doc_id, start, n_tokens, ids.

    A null or empty text has the end id alone, null ids come first, each repetition is a document of its own; an empty table gives an empty table.
    """
    prepare(spark)
    path = new_path(spark, "tokens")
    token_files.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_token_files(spark, path)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage has written is deleted when the next one has been written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            removed(spark, before)
        before = docs
    out = STAGES[-1][1](spark, docs, sf_dir)  # has written its files
    removed(spark, before)
    return out


#: Language ID is a trained model, edit distance search and tokenizing are no SQL: tests hold the stages against brute force.
ORACLE_SQL = None
