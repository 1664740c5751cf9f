"""A pipeline over ``documents``: every stage is one operator and works on all that the stage before it kept.

All stages but the last return the columns of their input, whatever else those hold. No stage needs ids: rows with a
null id and rows that repeat one are handled as each stage says. An empty table goes through all stages and gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fillgap.llm import bpe, jaccard, language, mixing, toxicity
from fillgap.llm.common import table
from fillgap.llm.queries import WORD_BPE
from fillgap.session import delete, new_path, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, learned from ``labels``. Null and empty texts stay; rows are judged one by one."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that ``lang`` teaches. Null and letterless texts go; rows are judged one by one."""
    return language.in_known_language(docs, language.fit(docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, the one with the smallest id. Rows with a null id and wordless texts stay."""
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them whole. Rows with a null or repeated id are rows of their own; a null source is a source."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of every row, as often as it is in the mix. Null texts count as empty."""
    return bpe.encode_decode(docs, public_tokenizers.path(WORD_BPE))


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", drop_unknown_language),
    ("n-gram Jaccard join", keep_one_of_each),
    ("mixing sources", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: The stages learn weights and draw copies, which SQL can't express; the tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each writes its result into the shared folder and the next one reads it."""
    return run_on(spark, table(spark, sf_dir, "documents"), sf_dir)


def run_on(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Apply the stages to any table with the columns of ``documents``; ``labels`` come from ``sf_dir``.

    What a stage leaves in the shared folder, its input included, is deleted once its result is written. The last
    result stays until ``session.clear``.
    """
    read = None
    for _, stage in STAGES:
        path = new_path(spark)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if read:
            delete(spark, [read])
        read = path
    return docs
