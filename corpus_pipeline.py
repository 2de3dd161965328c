"""Corpus cleaning from documents to token ids, as five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``.

1. toxicity: documents whose expected severity reaches the operator's cut go.
2. near duplicates: one document of each group stays, the one with the smallest doc_id.
3. repeated byte strings of 200 bytes are cut out; the text left replaces the text, and n_chars is
   counted anew.
4. documents that contain a window of a benchmark item go.
5. BPE: encoded and decoded digests of every document that is left.

Rows are told apart by doc_id and text: those that share a doc_id, or have none, are cleaned like
others, and a row repeated as it is stays once. A document whose text is cut to nothing stays with an
empty text. Extra columns, whatever their names, are carried along by stages 1 to 4. An empty table
passes through; very long texts, ties and null texts are as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import bpe, decontam, minhash, suffix_dedup, toxicity
from gristmill.llm.common import materialize, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.clean(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.rewrite(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL expresses neither the classifier nor BPE; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
