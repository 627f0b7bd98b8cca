"""The corpus pipeline: stages that each take the documents that the one before kept.

Defined results of every stage: columns beside those it reads are handed on as they are, whatever their names; an empty table
gives an empty one; repeated rows are rows of their own but in `simhash`, which keeps one of a group; null ids are ids like
others (of a group with ids, one with an id stays); a null text is as an empty one; very long texts are read whole, each by one
task. What a null or odd value means beyond that is said at each stage, and further in the docstrings of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamella.llm import bpe, decontaminate, line_dedup, quality, simhash
from lamella.llm._common import delete, fresh_path, read_table, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. A null or empty text has no words and goes; a null or unknown language is judged by its script."""
    return quality.keep(docs)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that ten or more have; n_chars is that of the text that is left, also where it was null. A document of
    such lines alone has an empty text then, and stays here."""
    return line_dedup.drop_lines(docs, chars_col="n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least id. Texts without words are near-duplicates of each other."""
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words with an item of the benchmark; a text without words shares none."""
    return decontaminate.remove(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document; a null or empty text has no ids."""
    return bpe.encode(docs)


STAGES = [("quality", quality_rules), ("line_dedup", drop_common_lines), ("simhash", drop_near_duplicates), ("decontaminate", drop_contaminated), ("bpe", encode)]

#: Piece and BPE vocabularies, and fingerprints, are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again. A stage's own tables go when its output is written, and that
    goes when the next stage's is, so the last output alone is left."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs
