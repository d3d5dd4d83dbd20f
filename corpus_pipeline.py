"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() writes each result as Parquet to
the shared folder and reads it again. All stages but the last return the columns of documents.

In every stage extra columns, whatever their names, are carried along; repeated rows share one verdict; a null doc_id is
a document like any other; an empty table gives an empty one. What null and empty texts meet is said with each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.llm import decontamination, langid, neardup, packing, toxicity
from sigmill.llm.common import crc_mod, long_texts, shared_dir
from sigmill.llm.queries import table, tokenizer_path

HELD, FOLDS = 2, 4  # as in the operators' own queries, nothing is learned from these rows
NEAR_PERCENT = 80  # near duplicates: this similarity or more of the word shingle sets; the query of operator 6 has its own, 85


def learning_rows(df: DataFrame) -> DataFrame:
    return df.where(crc_mod(F.col("doc_id"), FOLDS) != HELD)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.3 or more go. Null and empty texts score like a text without a listed word, so they stay."""
    lexicon = toxicity.learn(learning_rows(docs.select("doc_id", "text")), learning_rows(table(spark, sf_dir, "labels")))
    return toxicity.reject(docs, lexicon)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, null and empty texts among them, or whose language is unsure, go."""
    long_texts(spark)
    return langid.reject(docs, langid.learn(learning_rows(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (similarity 0.8 or more) the document with the smallest doc_id stays.

    Texts without a word, null doc_ids and all rows of a doc_id that stays are kept.
    """
    long_texts(spark)
    return neardup.keep_one(docs, percent=NEAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs go; null and empty texts and items match nothing."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences; a null or empty text is one piece with the end id."""
    long_texts(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unidentified),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

ORACLE_SQL = None  # tokenizers and learned models are beyond SQL; tests/llm holds the stages against plain versions written apart


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, from the documents table to the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    done = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if done:  # nothing reads the stage before the last any more
            path = spark._jvm.org.apache.hadoop.fs.Path(done)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        done = f"{folder}/{name}"
    return docs
