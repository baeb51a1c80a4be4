"""The corpus pipeline: five stages, each one operator of ``gantry.llm``, from documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  All but the
last return the columns of ``documents``, and from the mix on its decisions (``MIX``), which the result carries
beside the digests; extra columns of ``docs`` pass through.  Stages tell rows apart by their texts or by
numbers of their own, so a ``doc_id`` may repeat or be null: only copies of a text go.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.llm import byte_bpe, exact_dedup, mixing, ngram_join, quality_classifier
from gantry.llm.common import discarded, fresh, named, owned, table, written

VOCABULARY = "byte_bpe_50k.tiktoken"
# Target weights of the mix; sources without an entry share the last one.
WEIGHTS = {"src0": 1, mixing.OTHER: 3}
# What the mix decides, in the rows of the result.
MIX = ("class", "block", "phase", "slot", "in_mix")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.accepted(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, of those with the largest id."""
    return exact_dedup.deduplicated(docs)


def near_deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; rows have numbers here, as ids may repeat."""
    row = fresh("row", docs.columns)
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = ngram_join.ngram_join(numbered.select(F.col(row).alias("doc_id"), "text"))
    members = numbered.select(F.col(row).alias("member"), F.col("doc_id").cast("long").alias("known_as")).join(groups.withColumnRenamed("doc_id", "member"), "member")
    least = members.groupBy("component_id").agg(F.min(F.struct(F.col("known_as").isNull(), "known_as", "member")).alias("least"))
    return numbered.join(least.select(F.col("least.member").alias(row)), row, "left_semi").select(*map(named, docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their places in the mix: ``class, block, phase, slot``, and ``in_mix``, false once a class has run out.

    ``slot`` is the order; rows are not sorted by it here, as files are not read back in turn and texts would be shuffled once more.
    """
    return mixing.placed(docs, WEIGHTS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document and of the text they decode to, with its place in the mix."""
    return byte_bpe.digests(docs, public_tokenizers.path(VOCABULARY), carried=MIX)


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", deduplicate),
    ("n-gram Jaccard join", near_deduplicate),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", tokenize),
]
# The classifier, the similarity join and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next.

    What a stage has written for itself goes once its result is there, and a result once the next one is.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with owned(spark):
            docs = written(stage(spark, docs, sf_dir), name.split()[0], kept=True)
        if last is not None:
            discarded(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
