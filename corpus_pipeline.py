"""A training corpus from `documents`: toxic texts go, copies and near copies go, sources are mixed, texts become token ids.

Each stage takes (spark, docs, sf_dir) and returns a frame; run() writes it as Parquet to the shared folder
(spark.checkpoint.dir) and the next stage reads it back, so a lost executor costs a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from answerscope.llm import bpe, exact, jaccard, mixing, toxicity
from answerscope.llm.common import prepare, save, table


def toxic_texts_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the documents that the model doesn't call toxic; trained on the labels that have a document here."""
    return toxicity.drop_toxic(docs, table(prepare(spark), sf_dir, "labels"))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of equal texts the row with the smallest id."""
    return exact.drop_copies(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of linked documents the one with the smallest id."""
    return jaccard.drop_near_copies(docs)


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the words that the mix takes of each document, once, several times, in part or not at all."""
    return mixing.mixed_texts(docs)


#: Tables of the encoder (states, pieces): smaller than its own and dropped with each task, as executors have grown in the stages before.
ENCODER_TABLES = (100_000, 150_000)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: token ids of each text, with the digests of the ids and of what they decode to."""
    return bpe.digests(docs, *bpe.vocabulary(), with_ids=True, tables=ENCODER_TABLES, keep=False)


STAGES = [
    ("toxicity", toxic_texts_out),
    ("exact dedup", copies_out),
    ("n-gram Jaccard join", near_copies_out),
    ("mixing sources", sources_mixed),
    ("byte-level BPE", encoded),
]

#: The first stage is a trained model, which SQL can't express; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(prepare(spark), docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
