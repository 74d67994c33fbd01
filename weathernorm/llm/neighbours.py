"""Operator 8: approximate nearest neighbours by multi-index hashing.

Codes: vectors are centred on the index's mean, turned by ``ROTATIONS`` learned rotations (each from a
random start: the rotation that brings the vectors closest to their own signs, found by turns on a
bounded sample of ``FIT_ROWS`` vectors), and each coordinate's sign is a bit. A code is split into m
substrings, each with an index of its own: postings (substring, value) of every vector, dealt by
substring and the value's first bits. Codes within a Hamming radius r differ by at most r // m bits in
one of the substrings (pigeonhole); so a query sends probes to all first bits within that many bits of
its own, and an equi-join of probes and postings by (substring, first bits) meets every code within r.
Where they meet, the values within reach are looked up among the sorted distinct ones, their codes are
compared, each code is reported under the first substring that meets it, and those within r are ranked
by their exact distances on the original vectors.

The radius is learned: on a sample of ``RADIUS_QUERIES`` queries held against every vector exactly, it
covers the codes of ``COVER`` of the true neighbours. The substrings' width is the one of ``WIDTHS`` with the
least work at that radius on the samples. Queries that find fewer than they should over all
substrings, or a neighbour at the radius itself, are searched again with a growing radius, up to the code's
length, where every vector is found.

Both sides are sized by key before they are dealt: first bits with more than ``SHARD`` postings are split by
a salt, with more than ``QUERY_BLOCK`` probes in blocks; postings that no probe reaches aren't sent at all.
Equal vectors are indexed once, with the ``k + 1`` smallest of their ids, which is all that any result
can hold, and equal queries are searched once.

Edge cases: vectors that are NULL, zero, of another length than most, or hold a NULL or a component that
isn't finite take no part; NULL ids take no part; of the vectors of one id the smallest counts, component by
component; other columns are ignored; ties go to the smaller id; with no other vector a query has no rows; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, saved, smallest, table

FIT_ROWS, RADIUS_QUERIES, COVER = 20_000, 200, 0.97
ROTATIONS, ROUNDS = 4, 20
SHARD, QUERY_BLOCK = 16_384, 2_048
#: Bits that a substring may have, and the work of looking at a value, by that of comparing a code.
WIDTHS, VALUE_WORK = (16, 32, 64), 0.1
#: Bits that the radius grows by at first; each further round doubles them.
WIDER = 8


class Codes:
    """Learned rotations; a code is a row of 64-bit words."""

    def __init__(self, x: np.ndarray, rotations: int = ROTATIONS, rounds: int = ROUNDS) -> None:
        self.mean = x.mean(0)
        z, rng = x - self.mean, np.random.default_rng(11)
        self.turns = []
        for _ in range(rotations):
            r = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
            for _ in range(rounds):
                u, _, v = np.linalg.svd(z.T @ np.where(z @ r >= 0, 1.0, -1.0))
                r = u @ v
            self.turns.append(r)
        self.words = -(-x.shape[1] * rotations // 64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = x - self.mean
        bits = np.concatenate([z @ r >= 0 for r in self.turns], 1)
        bits = np.pad(bits, ((0, 0), (0, 64 * self.words - bits.shape[1])))
        return np.packbits(bits, axis=1).view(">u8").astype(np.uint64)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of bits in which rows of words differ."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


class Substrings:
    """How codes are split, and how far each substring is probed for a radius."""

    def __init__(self, words: int, width: int, radius: int, first: int = 0) -> None:
        self.width, self.radius, self.number = width, radius, words * 64 // width
        #: Bits of a value by which postings are dealt.
        self.first = min(first, width, 16)
        each, rest = divmod(radius, self.number)
        # pigeonhole: the substrings after the rest need one bit less
        self.reach = [each if j <= rest else each - 1 for j in range(self.number)]

    def values(self, codes: np.ndarray, j: int) -> np.ndarray:
        """The values of substring ``j``."""
        word, at = divmod(j * self.width, 64)
        return (codes[:, word] >> np.uint64(64 - self.width - at)) & np.uint64((1 << self.width) - 1)

    def firsts(self, codes: np.ndarray, j: int) -> np.ndarray:
        """The first bits of the values of substring ``j``."""
        return (self.values(codes, j) >> np.uint64(self.width - self.first)).astype(np.int32) if self.first else np.zeros(len(codes), np.int32)

    def probes(self, codes: np.ndarray, j: int) -> np.ndarray:
        """A row for each code: all first bits that a value within reach of its own may have."""
        every = np.arange(1 << self.first, dtype=np.int32)
        flips = every[np.bitwise_count(every) <= self.reach[j]]
        return self.firsts(codes, j)[:, None] ^ flips[None]

    def met(self, a: np.ndarray, b: np.ndarray, j: int) -> np.ndarray:
        """Whether substring ``j`` of two codes is within reach."""
        return np.bitwise_count(self.values(a, j) ^ self.values(b, j)) <= self.reach[j] if self.reach[j] >= 0 else np.zeros(max(len(a), len(b)), bool)


class Postings:
    """One substring's values of some codes: distinct ones, sorted, and where they occur."""

    def __init__(self, codes: np.ndarray, split: Substrings, j: int) -> None:
        self.codes, self.split, self.j = codes, split, j
        values = split.values(codes, j)
        self.order = np.argsort(values, kind="stable")
        self.distinct, self.count = np.unique(values[self.order], return_counts=True)

    def within(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the codes within the radius that no earlier substring meets."""
        split = self.split
        if split.reach[self.j] < 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        probed = np.bitwise_count(self.distinct ^ split.values(code[None], self.j)) <= split.reach[self.j]
        at = self.order[np.repeat(probed, self.count)]
        h = hamming(self.codes[at], code)
        near = h <= split.radius
        at, h = at[near], h[near]
        new = np.ones(len(at), bool)
        for j in range(self.j):
            new &= ~split.met(self.codes[at], code[None], j)
        return at[new], h[new]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with v as doubles, of the vectors that take part."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(fine)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int, kind: type = np.float64) -> np.ndarray:
    """Rows of numbers from lists of doubles, or from their bytes."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)
    return np.asarray(column.flatten(), dtype=kind).reshape(-1, width)


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of a query to vectors, from the differences."""
    d = x - q
    return np.sqrt((d * d).sum(1))


def nearest_of(q: np.ndarray, x: np.ndarray, squares: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact distances of the k nearest rows, ties to the smaller id."""
    at = np.arange(len(x))
    if len(x) > 2 * k:  # by products first, with room for their rounding
        size = q @ q
        d2 = squares + size - 2 * (x @ q)
        at = np.flatnonzero(d2 <= np.partition(d2, k - 1)[k - 1] + 1e-9 * (squares.max() + size))
    d = exact(q, x[at])
    keep = np.lexsort((ids[at], d))[:k]
    return at[keep], d[keep]


def learned_radius(coded: DataFrame, codes: Codes, q: np.ndarray, k: int) -> int:
    """The Hamming radius that covers ``COVER`` of the true neighbours of sampled queries."""
    width = q.shape[1]
    sent = coded.sparkSession.sparkContext.broadcast((codes, q))

    def run(batches):
        codes, q = sent.value
        cq, best = codes(q), [(np.zeros(0), np.zeros(0, np.int32))] * len(q)
        for batch in batches:
            x, cx = _matrix(batch.column(0), width), _matrix(batch.column(1), codes.words, np.uint64)
            squares, ids = (x * x).sum(1), np.arange(len(x))
            for i in range(len(q)):
                at, d = nearest_of(q[i], x, squares, ids, k + 1)
                d, h = np.concatenate([best[i][0], d]), np.concatenate([best[i][1], hamming(cx[at], cq[i])])
                keep = np.argsort(d, kind="stable")[: k + 1]
                best[i] = (d[keep], h[keep])
        rows = [(i, float(d), int(h)) for i, (dd, hh) in enumerate(best) for d, h in zip(dd, hh, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.float64(), pa.int32()))], ["q", "d", "h"])

    local = coded.select("x", "code").mapInArrow(lean(run), "q int, d double, h int")
    # k + 1 rows a sampled query: the first is the query itself
    top = local.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "h"))), 2, k).alias("near")).toPandas()
    h = np.array([x["h"] for near in top["near"] for x in near])
    return int(np.quantile(h, COVER, method="higher")) if len(h) else 64 * codes.words


def best_width(codes: np.ndarray, queries: np.ndarray, radius: int) -> int:
    """The width of substrings with the least work for sampled queries against sampled codes."""

    def work(width: int) -> float:
        split = Substrings(codes.shape[1], width, radius)
        return sum(VALUE_WORK + float(np.mean([split.met(codes, q[None], j).mean() for q in queries])) for j in range(split.number) if split.reach[j] >= 0)

    return min(WIDTHS, key=lambda width: (work(width), width))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found of each query (ids divisible by ``every``)."""
    spark = vectors.sparkSession
    # of the vectors of one id the smallest counts
    own = usable(vectors).groupBy("vec_id").agg(F.min("v").alias("v"))
    width = own.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = width["w"]
    # a vector is known by 128 bits of hashes
    key = [F.xxhash64("v", F.lit(seed)).alias(name) for seed, name in ((1, "ka"), (2, "kb"))]
    own = own.filter(F.size("v") == width)
    ids = F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1)
    # equal vectors: salted first, so that no task gathers a hot one; k + 1 ids of each salt are enough
    salted = own.groupBy("v", F.pmod("vec_id", F.lit(64)).alias("salt")).agg(ids.alias("ids"))
    gathered = salted.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    distinct = saved(gathered.select(*key, "v", "ids"), "nn-vectors")

    def sampled(n: int, by: str) -> np.ndarray:
        return np.array(smallest(distinct, n, by, "v").select("v").toPandas()["v"].tolist(), np.float64).reshape(-1, width)

    sample, queries = sampled(FIT_ROWS, "ka"), sampled(RADIUS_QUERIES, "kb")
    codes = Codes(sample)
    sent = spark.sparkContext.broadcast(codes)

    def coding(batches):
        for batch in batches:
            x = _matrix(batch.column(2), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), _bytes(x), _bytes(sent.value(x))], ["ka", "kb", "ids", "x", "code"])

    coded = saved(distinct.select("ka", "kb", "v", "ids").mapInArrow(lean(coding), "ka long, kb long, ids array<long>, x binary, code binary"), "nn-coded")
    radius, n = learned_radius(coded, codes, queries, k), coded.count()
    bits = best_width(codes(sample[:2_000]), codes(queries[:50]), radius)
    first = max(0, math.ceil(math.log2(max(1, n) / SHARD)))

    def dealt(rows: DataFrame, split: Substrings, probing: bool) -> DataFrame:
        """A row for each substring of a code and its own first bits, or those that it probes."""

        def run(batches):
            for batch in batches:
                own = _matrix(batch.column(2), codes.words, np.uint64)
                for j in range(split.number):
                    if split.reach[j] >= 0:
                        at = split.probes(own, j) if probing else split.firsts(own, j)[:, None]
                        row = pa.array(np.repeat(np.arange(len(own)), at.shape[1]))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(np.full(at.size, j, np.int32)), pa.array(at.ravel())], ["ka", "kb", "j", "first"])

        return rows.select("ka", "kb", "code").mapInArrow(lean(run), "ka long, kb long, j int, first int")

    def within(asked: DataFrame, radius: int) -> DataFrame:
        """(ka, kb, near): of each query vector the k + 1 nearest rows found, enough for every query that equals it."""
        split = Substrings(codes.words, bits, radius, first)
        own, probes = dealt(coded, split, False), dealt(asked, split, True)
        parts = lambda rows, most: rows.groupBy("j", "first").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("n"))
        sizes = saved(parts(own, SHARD).withColumnRenamed("n", "salts").join(parts(probes, QUERY_BLOCK).withColumnRenamed("n", "blocks"), ["j", "first"]), "nn-sizes")
        number = lambda seed, parts: F.pmod(F.xxhash64("ka", "kb", F.lit(seed)), F.col(parts)).cast("int")
        each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
        group = ["j", "first", "salt", "block"]
        index = own.join(sizes, ["j", "first"]).select("ka", "kb", "j", "first", number(5, "salts").alias("salt"), each("blocks").alias("block")).join(coded, ["ka", "kb"])
        queries = probes.join(sizes, ["j", "first"]).select("ka", "kb", "j", "first", number(6, "blocks").alias("block"), each("salts").alias("salt")).join(coded.select("ka", "kb", "x", "code"), ["ka", "kb"])

        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            rows: list[list] = [[] for _ in range(6)]
            if left.num_rows and right.num_rows:
                j, x, q = left["j"][0].as_py(), _matrix(left["x"], width), _matrix(right["x"], width)
                cx, cq = (_matrix(t["code"], codes.words, np.uint64) for t in (left, right))
                ids, ka, kb = left["ids"].to_pylist(), right["ka"].to_pylist(), right["kb"].to_pylist()
                smallest_id, squares, postings = np.array([i[0] for i in ids]), (x * x).sum(1), Postings(cx, split, j)
                for i in range(len(q)):
                    at, h = postings.within(cq[i])
                    # a query's own vector may stand first: one more than k vectors
                    keep, d = nearest_of(q[i], x[at], squares[at], smallest_id[at], k + 1) if len(at) else (at, at)
                    for p, far in zip(keep.tolist(), d.tolist(), strict=True):
                        for column, value in zip(rows, (ka[i], kb[i], j, far, int(h[p]), ids[at[p]]), strict=True):
                            column.append(value)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.int64()))
            return pa.table([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["ka", "kb", "j", "d", "h", "ids"])

        near = index.groupBy(*group).cogroup(queries.groupBy(*group)).applyInArrow(search, "ka long, kb long, j int, d double, h int, ids array<long>")
        found = near.select("ka", "kb", "j", "d", "h", F.explode("ids").alias("vec_id"))
        top = lambda rows: F.slice(F.array_sort(rows), 1, k + 1).alias("near")
        by_substring = found.groupBy("ka", "kb", "j").agg(top(F.collect_list(F.struct("d", "vec_id", "h"))))
        return by_substring.groupBy("ka", "kb").agg(top(F.flatten(F.collect_list("near"))))

    wanted = own.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), *key)
    asked, step, parts = saved(coded.join(wanted.select("ka", "kb").distinct(), ["ka", "kb"], "left_semi"), "nn-asked"), WIDER, []
    while True:
        found = saved(within(asked, radius), "nn-found")
        if radius >= 64 * codes.words:
            parts.append(found)
            break
        full = (F.size("near") > k) & (F.array_max(F.transform("near", lambda p: p["h"])) < radius)
        parts.append(found.filter(full))
        asked = saved(asked.join(parts[-1], ["ka", "kb"], "left_anti"), "nn-asked")
        if asked.isEmpty():
            break
        radius, step = min(64 * codes.words, radius + step), 2 * step
    top = parts[0]
    for part in parts[1:]:
        top = top.union(part)
    others = F.slice(F.filter("near", lambda p: p["vec_id"] != F.col("query_id")), 1, k)
    ranked = wanted.join(top, ["ka", "kb"]).select("query_id", F.posexplode(others).alias("rank", "p"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), "p.vec_id", F.col("p.d").alias("score"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
