"""Operator 7: mixing sources to target weights by Poisson replication, in SQL functions only.

A source's target share is given, or is its size (in characters) to the power ``alpha``, normalised.
Its repetition rate is what brings the expected mixture to these shares at ``epochs`` times the
corpus's size. A document's number of copies is the Poisson distribution with that mean, inverted at a
uniform number hashed from its id, its text and the seed: the same on every run and machine. The copies are
dealt out at random over all partitions and sorted by a random key in each, a global shuffle.

Edge cases: a NULL source is a source of its own; a NULL or empty text has size 0, and a source of
size 0 gets rate 0; a NULL id hashes as an empty one; rows of the same id and text get the same number of
copies; other columns are kept, whatever their names; an empty table gives an empty result. A rate of any size is inverted exactly;
only where ``weights`` are given are rates over ``max_rate`` refused (None: never), on both paths.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound, free_name, table

#: More sources than these are joined by a shuffle, with every source's rows spread by a salt.
MAX_BROADCAST_SOURCES = 20_000
MAX_RATE = 500.0
SALTS = 64
#: Rates up to this are inverted by a table of the distribution, larger ones by a sum in each row.
TABLE_RATE = 500.0
#: Copies of a row that one array numbers at most.
EACH = 65_536


def uniform(doc_id: Column, seed: int, text: Column | None = None) -> Column:
    """52 bits of a hash of the id, the seed and the text, in [0, 1): rows without an id, or with the same, draw for themselves."""
    own = [] if text is None else [F.coalesce(text, F.lit(""))]
    bits = F.substring(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(str(seed)), *own)), 1, 13)
    return F.conv(bits, 16, 10).cast("double") / F.lit(float(16**13))


def poisson_cdf(rate: Column) -> Column:
    """Array of P(N <= k), k from 0, past the point where it is 1 in double precision."""
    last = F.ceil(rate + 10 * F.sqrt(rate) + 25).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(acc, k):
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["c"]


def poisson_count(rate: Column, u: Column) -> Column:
    """How many k have P(N <= k) <= u, for large rates: the sum starts 10 deviations below the mean, where less
    than 2^-52 lies below, with a first term by Stirling's series, and holds no array of terms."""
    low = F.floor(rate - 10 * F.sqrt(rate))
    # -rate + low * ln(rate) - ln(low!), with nothing large to cancel
    x = (rate - low) / low
    first = F.exp(low * (F.log1p(x) - x) - F.log(2 * math.pi * low) / 2 - 1 / (12 * low) + 1 / (360 * F.pow(low.cast("double"), F.lit(3.0))))
    one = F.lit(1).cast("long")
    start = F.struct(first.alias("p"), first.alias("c"), F.when(first <= u, low + one).otherwise(low).alias("n"))

    def step(acc, k):
        p = acc["p"] * rate / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.when(c <= u, acc["n"] + one).otherwise(acc["n"]).alias("n"))

    found = F.aggregate(F.sequence(low + one, F.ceil(rate + 10 * F.sqrt(rate) + 25)), start, step)["n"]
    return F.when(u > 0, found).otherwise(F.lit(0).cast("long"))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, size, share, rate): one row per source; sums over all documents, combined map-side."""
    size = F.sum(F.coalesce(F.char_length("text"), F.lit(0)).cast("double"))
    sizes = docs.select(F.col("source").alias("source"), "text").groupBy("source").agg(size.alias("size"))
    if weights is None:
        weight = F.pow("size", F.lit(float(alpha)))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), float(w)).otherwise(weight)
    weighed = sizes.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(0.0))
    total = weighed.groupBy().agg(F.sum("weight").alias("all_weight"), F.sum("size").alias("all_size"))
    # a join with a single row of totals
    joined = weighed.join(F.broadcast(total), F.lit(True))
    share = F.coalesce(F.try_divide("weight", "all_weight"), F.lit(0.0))
    rate = F.when(F.col("size") > 0, epochs * share * F.col("all_size") / F.col("size")).otherwise(0.0)
    return joined.select("source", "size", share.alias("share"), rate.alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 7, max_rate: float | None = MAX_RATE) -> DataFrame:
    """Each document ``copies`` times (``copy`` counts from 1), in a global random order. Where the table
    has columns of these names, the new ones get underscores after theirs."""
    names = docs.columns
    copies_name, copy_name, key_name, source, rate, cdf, salt, own = (free_name(docs, n) for n in ("copies", "copy", "mix_key", "mix_source", "mix_rate", "mix_cdf", "mix_salt", "mix_own"))
    spark = docs.sparkSession
    rated = source_rates(docs, weights, alpha, epochs)
    few = rated.limit(MAX_BROADCAST_SOURCES + 1).collect()
    u = uniform(F.col("doc_id"), seed, F.col("text"))
    if weights is not None and max_rate is not None:
        too_high = rated.filter(F.col("rate") > max_rate).limit(5).collect()
        if too_high:
            raise ValueError(f"repetition rate over {max_rate} for {[r['source'] for r in too_high]}")
    table_of = F.when(F.col(rate) <= TABLE_RATE, poisson_cdf(F.col(rate)))
    if len(few) <= MAX_BROADCAST_SOURCES:
        small = spark.createDataFrame([(r["source"], r["rate"]) for r in few], T.StructType([T.StructField(source, T.StringType()), T.StructField(rate, T.DoubleType())]))
        joined = docs.join(F.broadcast(small.withColumn(cdf, table_of)), F.col("source").eqNullSafe(F.col(source)))
    else:
        salts = F.array(*map(F.lit, range(SALTS)))
        small = rated.select(F.col("source").alias(source), F.col("rate").alias(rate), F.explode(salts).alias(salt)).withColumn(cdf, table_of)
        salted = docs.withColumn(own, F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int"))
        joined = salted.join(small, F.col("source").eqNullSafe(F.col(source)) & (F.col(own) == F.col(salt)))
    one = F.lit(1).cast("long")
    by_table = lambda v: F.size(F.filter(cdf, lambda c: c <= v)).cast("long")
    copies = bound(u, lambda v: F.when(F.col(rate) <= TABLE_RATE, by_table(v)).otherwise(poisson_count(F.col(rate), v)))
    counted = joined.select(*names, copies.alias(copies_name)).filter(F.col(copies_name) > 0)
    # numbered in runs, so that no array grows with a row's copies
    run_name = free_name(counted, "mix_run")
    runs = counted.withColumn(run_name, F.explode(F.sequence(one, F.col(copies_name), F.lit(EACH).cast("long"))))
    each = runs.withColumn(copy_name, F.explode(F.sequence(F.col(run_name), F.least(F.col(copies_name), F.col(run_name) + (EACH - 1))))).drop(run_name)
    # equal rows have equal keys: partitions that many of them make large are split
    keyed = each.withColumn(key_name, F.xxhash64("doc_id", "text", copy_name, F.lit(seed)))
    return keyed.hint("rebalance", F.col(key_name)).sortWithinPartitions(key_name).drop(key_name)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH sizes AS (SELECT source, sum(CAST(length(coalesce(text, '')) AS DOUBLE)) AS size FROM documents GROUP BY source),
weighed AS (SELECT source, size, CASE WHEN size > 0 THEN sqrt(size) ELSE 0 END AS weight FROM sizes),
rates AS (SELECT source, CASE WHEN size > 0 THEN weight / (SELECT sum(weight) FROM weighed) * (SELECT sum(size) FROM weighed) / size ELSE 0 END AS rate FROM weighed),
terms AS (SELECT source, k, CASE WHEN rate > 0 THEN exp(-rate + k * ln(rate) - lgamma(k + 1)) WHEN k = 0 THEN 1 ELSE 0 END AS p
          FROM (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 10 * sqrt(rate) + 25) AS BIGINT) + 1)) AS k FROM rates)),
cdf AS (SELECT source, list(c ORDER BY c) AS cs FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms) GROUP BY source),
drawn AS (SELECT d.*, CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':7:' || coalesce(d.text, '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u, cs
          FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source),
counted AS (SELECT doc_id, text, lang, source, n_chars, CAST(len(list_filter(cs, lambda c: c <= u)) AS BIGINT) AS copies FROM drawn)
SELECT doc_id, text, lang, source, n_chars, copies, unnest(range(1, copies + 1)) AS copy FROM counted WHERE copies > 0
"""
