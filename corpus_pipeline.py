"""A training corpus from raw documents: each stage works on all that the one before it kept.

STAGES lists (name, function); a function takes the session, the documents so far and the folder of the tables. run
applies them to the table of documents, each stage's rows written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import leaks, mixing, quality, shared, simhash, tokens
from loomline.llm.queries import table, word_vocabulary


def without_rejected(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, words=5, least=0.8)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, entropy_share=0.98, most_passes=2.0).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed, order = mixing.in_place(docs)
    path = tokens.write(placed, shared.new_path(spark, "corpus-ids"), word_vocabulary(), order=order)
    return tokens.read(spark, path)


STAGES = [
    ("quality classifier", without_rejected),
    ("SimHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
    ("token-ID output", token_ids),
]

#: SQL can't express the trained classifier or the fingerprints; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes once the next stage's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            shared.dropped(before)
        before = docs
    return docs
