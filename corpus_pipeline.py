"""The corpus pipeline: toxicity, language, near duplicates, mixing, packing; each stage's rows are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.llm import bagminhash, langid, mixing, packing, toxicity
from larder.llm.common import bounded_batches, drop_written, written
from larder.llm.queries import language_model, tokenizer_path, toxicity_model

#: A document goes if it has no letter, or if no language is likelier than this.
LEAST_LANGUAGE_SCORE = 0.4
MOST_TOXICITY = 0.3


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose whole text scores MOST_TOXICITY or more; the model is learned from docs and the labels.

    Null and empty texts stay; without labels (an empty table, or no labelled row in docs) only a fixed prior scores, and no
    row goes.  Repeated rows stay or go together; null ids stay; other columns, whatever their names, are handed on.
    """
    bounded_batches(spark)
    model = toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_below(docs, model, MOST_TOXICITY)


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with a letter in the text and a language likelier than LEAST_LANGUAGE_SCORE; the network is learned from docs.

    Null, empty and letterless texts go; without a labelled row the one class is certain and all others stay.  Repeated rows
    stay or go together; null ids, sources and languages do not matter.
    """
    bounded_batches(spark)
    return langid.keep_identified(docs, language_model(docs), LEAST_LANGUAGE_SCORE)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least id of each near-duplicate class of docs; repeated rows once, null ids and wordless texts all stay."""
    return bagminhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row of docs as often as its cell's raked rate asks in expectation; null sources and languages are cells of their own."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all docs in windows of 1024 tokens; null and empty texts are their end id alone, repeated rows documents of their own."""
    bounded_batches(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end=0, window=1024)


STAGES = [("toxicity", without_toxic), ("language", with_language), ("near_duplicates", one_of_each_group), ("mixing", mixed), ("packing", packed)]

#: No stage but mixing can be put in SQL; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, one after another.  A stage's rows are written and read again, and deleted when the next are written.

    Empty documents give no piece.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


__all__ = ["ORACLE_SQL", "STAGES", "run"]
