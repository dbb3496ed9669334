"""A corpus pipeline: language ID, line dedup, near-dedup, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import Workspace, read, spread
from larder.llm.langid import keep_identified
from larder.llm.line_dedup import drop_repeated_lines
from larder.llm.packing import pack_documents
from larder.llm.simhash import keep_one_of_each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the fused evidence names."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that at least three documents share, except in the largest doc_id; n_chars follows."""
    kept = drop_repeated_lines(docs).drop("n_lines", "n_dropped")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of texts alike by 0.8 or more in five-word shingles."""
    return keep_one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of 1024-token sequences: documents are done, pieces begin."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("lang", "source"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: Packing by minimum bin slack and SimHash are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = spread(read(spark, sf_dir, "documents"))
    for name, stage in STAGES:
        docs = space.write(stage(spark, docs, sf_dir), name)
    return docs
