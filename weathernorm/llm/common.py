"""What the corpus operators share: tables, folds, scratch tables and bounded broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where that is unset in local mode (tests) a temporary folder is made and set; elsewhere it is refused.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-scratch-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


_watched: list[list[str]] = []


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts the lineage, prunes columns."""
    spark = df.sparkSession
    at = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    for made in _watched:
        made.append(at)
    return spark.read.schema(df.schema).parquet(at)


@contextlib.contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[list[str]]:
    """The paths of all tables that :func:`saved` writes inside; at the end those that are still listed are deleted.
    Results that read them must have been written by then."""
    made: list[str] = []
    _watched.append(made)
    try:
        yield made
    finally:
        _watched[:] = [x for x in _watched if x is not made]
        for at in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it if the table has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold_is(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``folds``, is ``fold``; NULL for a NULL id."""
    return (F.crc32(doc_id.cast("string")) % folds) == fold


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """As :func:`fold_is`; a NULL id is never held out (and never learned from either)."""
    return F.coalesce(fold_is(doc_id, folds, fold), F.lit(False))


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) with one row per id: of repeated ids the larger label; NULLs are dropped."""
    return (
        labels.select("doc_id", F.col(column).cast("int").alias("label"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )


def lean(run: Callable[[Iterator], Iterator], rows: int = 2_000) -> Callable[[Iterator], Iterator]:
    """A task's function that takes its batches in slices of ``rows``, and at its end gives back the free memory
    of its worker's process.

    Workers wait for their next task, of whatever stage, with all that their allocators have kept; a long
    job would add up the peaks of its stages.
    """

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batch.slice(k, rows) for batch in batches for k in range(0, batch.num_rows, rows))
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # not the GNU library: nothing to give back by hand
                pass

    return task


def smallest(df: DataFrame, n: int, by: str, *order: str) -> DataFrame:
    """The ``n`` rows with the smallest hashes of column ``by`` (ties by it and ``order``).

    Rows are counted first, and a bound on the hash that a little over ``n`` rows pass is set before the sort:
    what goes to one place is about ``n`` rows, not ``n`` of each partition. ``df`` is read twice. Where rows
    repeat the values of ``by``, fewer than ``n`` may pass the bound.
    """
    count, h = df.count(), F.xxhash64(by)
    if count > n:
        df = df.filter(h / F.lit(2.0**64) + 0.5 <= (n + 8 * n**0.5 + 16) / count)
    return df.orderBy(h, by, *order).limit(n)
