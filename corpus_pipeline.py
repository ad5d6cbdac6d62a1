"""A corpus pipeline of five of the operators: each stage works on all that the one before kept.

The result is the last stage's: where each document's ids stand in the token
files, how many they are and their checksum.

A stage's table is written and read again before the next stage is called, so each
stage begins by deleting what the one before had staged for itself.

Defined results: an empty table passes all stages and gives no rows; rows are judged
one by one, whatever ids they share; of repeated rows one stays (near copies); null
and empty texts are near copies of each other, and one of them stays with one id, its
end mark; columns that documents has beside its own pass all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import decontaminate, mixing, simhash, tokens, toxicity
from brindle.llm.common import delete, fresh_path, sweep, table
from brindle.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sweep(spark)
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sweep(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sweep(spark)
    return mixing.thin(docs, table(spark, sf_dir, "labels"))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sweep(spark)
    return tokens.encode_to_files(docs, tokenizer_path()).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_domains),
    ("tokens", write_tokens),
]

#: A learned score, a tokenizer and a fit are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, function in STAGES:
        got, path = function(spark, docs, sf_dir), fresh_path(spark, name)
        got.write.parquet(path)
        docs = spark.read.schema(got.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    sweep(spark)
    return docs
