"""Operator 3: token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the lengths of the corpus's most frequent words (bounded by
``table_entries``); tier two is each worker's cache, filled by encoding what the table misses. No
pre-token is shuffled: to find the frequent words, each task counts all its words and hands on its
``per_task`` most frequent only. The table changes the speed, never a count.

Edge cases: NULL and empty texts have 0 bytes and 0 tokens; any id, NULL and repeated ones included,
gives one row per input row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pretokens
from .common import lean, saved, table

#: A task's counter is thinned to its larger half beyond so many words; bounds its memory.
COUNTER_WORDS = 400_000


def frequent_words(docs: DataFrame, table_entries: int = 50_000, per_task: int = 10_000) -> DataFrame:
    """(word, n): the most frequent words by the sums of the tasks' own most frequent ones."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(text.split(" "))
                    if len(seen) > COUNTER_WORDS:
                        seen = Counter(dict(seen.most_common(COUNTER_WORDS // 2)))
        top = [(w, n) for w, n in seen.most_common(per_task) if n > 1 and len(w) <= pretokens.LONGEST_KEPT and pretokens.MARK not in w]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    counted = saved(docs.select("text").mapInArrow(lean(count, 5_000), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "token-words")
    more = counted.count()
    if more > table_entries:  # what the driver sorts is about the table, however many partitions there are
        least = counted.agg(F.percentile_approx("n", 1 - table_entries / more, 10_000)).first()[0]
        counted = counted.filter(F.col("n") > least)
    return counted.orderBy(F.desc("n"), "word").limit(table_entries)


def token_counts(docs: DataFrame, model: str | None = None, max_tokens: int = 4096, table_entries: int = 50_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text.

    ``table_entries`` words of at most 48 characters bound the broadcast table to a few MB.
    """
    spark, path, name = docs.sparkSession, pretokens.model_path(model), uuid.uuid4().hex
    words = [r["word"] for r in frequent_words(docs, table_entries).collect()]
    sent = spark.sparkContext.broadcast(lengths_of(spark, words, path))

    def count(batches):
        encoder, lengths = pretokens.lengths(path, name, sent.value)
        for batch in batches:
            n = encoder.lengths(batch.column(1), lengths)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    counted = docs.select(F.col("doc_id").cast("long"), "text", n_bytes).mapInArrow(lean(count, 5_000), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > max_tokens)


def lengths_of(spark: SparkSession, words: list[str], path: str) -> dict[str, int]:
    """word -> number of ids; encoded on the workers, not on the driver."""

    def encode(batches):
        encoder = pretokens.Encoder(path)
        for batch in batches:
            ids = encoder.of(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64())], ["word", "n"])

    if not words:
        return {}
    rows = spark.createDataFrame([(w,) for w in words], "word string").mapInArrow(encode, "word string, n long").collect()
    return {r["word"]: r["n"] for r in rows}


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
