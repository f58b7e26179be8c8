"""The corpus pipeline: documents through five operators, each on what the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.

Edge cases: a row whose text is null, empty or without a letter has no language and goes in
the first stage, so later ones only meet texts; rows of one id are judged by their own
texts until MinHash keeps one row for the id (rows with a null id stay, each for itself);
repeated rows leave one; ties of near copies go to the smallest id; very long texts are
read whole by every stage; an empty table on either side, or one without any language to
learn, gives an empty result or keeps every row that has a letter; other columns, whatever
their names, come through all stages but the last.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skein.llm import decontaminate, language_id, line_templates, minhash, piece_bpe
from skein.llm.common import shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be in one of the learned languages; those without a
    letter, and texts that fit none of them, go."""
    return language_id.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines whose template recurs across documents."""
    return line_templates.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (at 0.80): the one with the smallest id."""
    return minhash.keep_first(docs, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of the text that they decode to."""
    return piece_bpe.digest_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language_id", language), ("line_dedup", lines), ("minhash", near_duplicates), ("decontaminate", decontaminated), ("sentencepiece", pieces)]

#: The stages' models and libraries can't be expressed in SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{n}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{n}-{name}")
    return docs
