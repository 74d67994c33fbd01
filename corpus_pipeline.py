"""From raw documents to packed token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame
that is written as Parquet and read again as the next one's documents. All but the last return the
columns of documents; further columns stay as well, whatever their names.

In every stage an empty table gives an empty one, ids may be NULL or repeat (each row stands for itself),
and NULL, empty and very long texts are taken as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weathernorm.llm import decontamination, mixing, near_duplicates, packing, toxicity
from weathernorm.llm.common import saved, scratch_tables, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go.

    NULL and empty texts have no words and stay, unless most labelled documents are toxic; equal texts go or stay
    together; labels of NULL ids and NULL labels are not learned from; without labels of both classes the
    prior decides for all alike."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id (NULL is the largest), of those
    the one with the smallest hash of its text, of equal rows any one. Texts without a word all stay."""
    return near_duplicates.one_of_each(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; those without a word stay. NULL item ids and texts match nothing."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's target share asks for, in a global random order. A NULL source is a
    source of its own; one whose texts are all empty goes; rows of one id and text come equally often."""
    return mixing.mix(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of packed token ids. NULL and empty texts are segments without ids; long ones are cut without loss."""
    return packing.pack(docs)


STAGES = [("toxicity", clean), ("near_duplicates", single), ("decontamination", unseen), ("mixing", mixed), ("token_ids", packed)]

#: No SQL can express the models and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. What a stage writes for itself is deleted at its end, and its result when the next one
    is written; the last result stays in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch_tables(spark) as made:
            docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
            result = made.pop()
            made += before
        before = [result]
    return docs
