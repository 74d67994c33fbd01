"""Operator 11: hard negatives by an inverted multi-index.

Vectors are integers, floor(256 x), and a score is an inner product. Each vector is cut into two halves; each
half has a codebook (k-means on a bounded sample of ``FIT_ROWS`` rows), and a pair of codes is a cell. Every
row is in the cell of its nearest codes, and every code keeps its radius: the distance of the furthest
of all rows that have it. So the score of an anchor with any row of a cell is at most the sum of two half
bounds, each q . c + |q| r (and at least that with a minus).

An anchor visits cells in the order of these sums, in waves. The first goes down a multi-sequence heap over
its two sorted lists of half bounds until it has met ``SEED`` rows; each further one goes on until ``GROWTH``
times as many rows are met. What is found sets a threshold, the lowest score that could still enter the
result; no cell whose bound is below it is visited, and the anchor is done when none is left: what it asks for
is certified. So a wave returns some GROWTH times the rows asked for, however many rows there are. Two
searches of this kind follow each other: the positives (rows of the anchor's label), then, for each of them,
the rows of other labels in its window of scores. In the second, cells whose lower bound is above all
windows are passed over.

Rows are dealt by shards of whole cells with about ``SHARD`` rows (larger cells are split by a hash), anchors
in blocks of about ``BLOCK`` to the shards that they visit only. A shard keeps the best few rows of each
anchor or window, and Spark ranks what the shards return. Scores and thresholds are integers and exact.

Edge cases: rows with a NULL id, label or vector, a NULL or infinite component, or another length than most
take no part, nor do those with a component so large that scores don't fit 64 bits (over 6.7e7 with 64
components); of rows with one id the smallest (label, vector) counts; ties go to the smaller id; zero
vectors take part, with scores of 0; an anchor without a positive, and a positive without a negative in its
window, has no rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, saved, smallest, table

#: Rows that the codebooks are learned from; rows a cell should have; codes of a half, at most.
FIT_ROWS, CELL_ROWS, MOST_CODES, ROUNDS = 20_000, 64, 256, 12
#: Rows of a shard, anchors of a block, rows of the first wave, and by how much the waves grow.
SHARD, BLOCK, SEED, GROWTH = 1_024, 512, 512, 16
#: A negative's score is between these shares of the positive's, in tenths.
LEAST_TENTHS, MOST_TENTHS = 3, 9
#: Below every score, and above.
_NONE, _ABOVE = -(1 << 62), 1 << 62
#: Bounds are computed anew in each wave: so much apart, and a cell is visited in both.
OVERLAP = 1.0
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codes of the rows of ``x``; starts from rows spread over the sample's order."""
    codes = x[np.linspace(0, len(x) - 1, k).astype(int)].astype(np.float64)
    for _ in range(rounds):
        near, _ = nearest_codes(x, codes)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(codes)
        np.add.at(sums, near, x)
        codes[n > 0] = sums[n > 0] / n[n > 0, None]
    return codes


def nearest_codes(x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest code and its distance."""
    d2 = (codes**2).sum(1)[None] - 2 * (x @ codes.T)
    near = d2.argmin(1)
    return near, np.sqrt(((x - codes[near]) ** 2).sum(1))


class MultiIndex:
    """Two codebooks with their radii, the cells that hold rows, and the shards that hold the cells."""

    def __init__(self, books: list[np.ndarray], radii: list[np.ndarray], cells: np.ndarray, counts: np.ndarray) -> None:
        self.books, self.cells, self.counts = books, cells, counts
        self.radii = [r * (1 + 1e-9) + 1e-6 for r in radii]  # room for their rounding
        self.place = {(int(a), int(b)): k for k, (a, b) in enumerate(cells)}
        #: The first shard of each cell, and over how many it is spread.
        self.first, self.spread = np.zeros(len(cells), np.int64), np.maximum(1, -(-counts // SHARD))
        shard, held = 0, 0
        for k, n in enumerate(counts.tolist()):
            if held and (held + n > SHARD or self.spread[k] > 1):
                shard, held = shard + 1, 0
            self.first[k], held = shard, held + n
            if self.spread[k] > 1:
                shard, held = shard + int(self.spread[k]), 0
        self.shards = shard + 1

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        cut = self.books[0].shape[1]
        return [x[:, :cut], x[:, cut:]]

    def bounds(self, x: np.ndarray, sign: int = 1) -> list[np.ndarray]:
        """Half bounds of the scores with each code's rows: from above, or from below."""
        return [h @ b.T + sign * np.linalg.norm(h, axis=1)[:, None] * r[None] for h, b, r in zip(self.halves(x), self.books, self.radii, strict=True)]

    def descend(self, upper: list[np.ndarray], passed: np.ndarray, rows: int) -> float:
        """The bound at which the cells visited so far, best first, hold ``rows`` rows; -inf if all do not.
        ``passed`` marks cells that are passed over."""
        order = [np.argsort(-u, kind="stable") for u in upper]
        sums = lambda i, j: -(upper[0][order[0][i]] + upper[1][order[1][j]])
        heap, met = [(sums(0, 0), 0, 0)], 0
        while heap:
            bound, i, j = heapq.heappop(heap)
            k = self.place.get((int(order[0][i]), int(order[1][j])))
            if k is not None and not passed[k]:
                met += int(self.counts[k])
                if met >= rows:
                    return -bound
            if j + 1 < len(order[1]):
                heapq.heappush(heap, (sums(i, j + 1), i, j + 1))
            if j == 0 and i + 1 < len(order[0]):  # each pair is pushed once
                heapq.heappush(heap, (sums(i + 1, 0), i + 1, 0))
        return -math.inf

    def sweep(self, bound: np.ndarray, passed: np.ndarray, rows: int) -> float:
        """As :meth:`descend`, from the bounds of all cells: for waves that meet most of them."""
        order = np.argsort(-np.where(passed, -np.inf, bound), kind="stable")
        at = int(np.searchsorted(np.cumsum(np.where(passed, 0, self.counts)[order]), rows))
        return float(bound[order[at]]) if at < len(order) else -math.inf


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**52:
        return np.rint(q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of ``score``, with their ids: higher scores first, then smaller ids. ``ids`` is a row
    for all (ascending), or one for each row."""
    m = score.shape[1]
    if ids.ndim == 1 and m > 4 * k:
        floor = np.partition(score, m - k, axis=1)[:, m - k]
        if int((score >= floor[:, None]).sum(1).max(initial=0)) <= 4 * k:
            at = np.argpartition(-score, min(4 * k, m) - 1, axis=1)[:, : 4 * k]
            score, ids = np.take_along_axis(score, at, 1), ids[at]
    if ids.ndim == 1:
        ids = np.broadcast_to(ids, score.shape)
    at = np.lexsort((ids, -score), axis=-1)[:, :k]
    return np.take_along_axis(score, at, 1), np.take_along_axis(ids, at, 1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x): the rows that take part, with x as integers."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    rows = rows.filter("vec_id is not null and label is not null and v is not null").filter(fine).withColumn("v", F.transform("v", lambda c: F.floor(c * 256)))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("r.label") + 1) % 10).otherwise(F.col("r.label"))
    return one.select("vec_id", label.alias("label"), F.col("r.v").alias("x"))


def _rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    found = column.to_pylist()
    return np.frombuffer(b"".join(found), np.int64).reshape(len(found), -1)


def _arrow(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names)


def build(rows: DataFrame) -> tuple[DataFrame, MultiIndex] | None:
    """The coded rows (vec_id, label, x, shard, c1, c2) and the index over all of them."""
    width = rows.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None or width["w"] < 1:
        return None
    spark, width = rows.sparkSession, width["w"]
    limit = math.isqrt(2**58 // width)
    rows = saved(rows.filter((F.size("x") == width) & F.forall("x", lambda c: (c <= limit) & (c >= -limit))), "negatives-rows")
    if (n := rows.count()) == 0:
        return None
    sample = np.array(smallest(rows, FIT_ROWS, "vec_id").select("x").toPandas()["x"].tolist(), np.float64).reshape(-1, width)
    k, cut = max(1, min(MOST_CODES, len(sample), math.isqrt(max(1, n // CELL_ROWS)))), (width + 1) // 2
    books = [kmeans(sample[:, :cut], k), kmeans(sample[:, cut:], k)]
    sent = spark.sparkContext.broadcast(books)

    def code(batches):
        for batch in batches:
            x = np.asarray(batch.column(2).flatten(), np.int64).reshape(-1, width)
            (c1, d1), (c2, d2) = (nearest_codes(h.astype(np.float64), b) for h, b in zip((x[:, :cut], x[:, cut:]), sent.value, strict=True))
            data = [pa.array([r.tobytes() for r in x], pa.binary()), *(pa.array(c.astype(np.int32)) for c in (c1, c2)), pa.array(d1), pa.array(d2)]
            yield _arrow(["vec_id", "label", "x", "c1", "c2", "d1", "d2"], [batch.column(0), batch.column(1), *data])

    coded = saved(rows.mapInArrow(lean(code), "vec_id long, label long, x binary, c1 int, c2 int, d1 double, d2 double"), "negatives-coded")
    radii = []
    for j in (1, 2):  # a row a code
        own = np.zeros(k)
        for r in coded.groupBy(f"c{j}").agg(F.max(f"d{j}").alias("r")).collect():
            own[r[0]] = r["r"]
        radii.append(own)
    cells = sorted((r["c1"], r["c2"], r["count"]) for r in coded.groupBy("c1", "c2").count().collect())  # MOST_CODES ** 2 at most
    index = MultiIndex(books, radii, np.array([c[:2] for c in cells], np.int64), np.array([c[2] for c in cells], np.int64))
    where = spark.createDataFrame([(a, b, f, s) for (a, b, _), f, s in zip(cells, index.first.tolist(), index.spread.tolist(), strict=True)], "c1 int, c2 int, _first long, _spread long")
    shard = F.col("_first") + F.pmod(F.xxhash64("vec_id"), F.col("_spread"))
    dealt = coded.join(F.broadcast(where), ["c1", "c2"]).select("vec_id", "label", "x", shard.alias("shard"), "c1", "c2")
    return saved(dealt, "negatives-dealt"), index


_ASKED = "anchor_id long, label long, x binary, asked array<long>, low array<long>, high array<long>, floor array<long>"


def search(index_rows: DataFrame, index: MultiIndex, anchors: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(anchor_id, asked, vec_id, score, rank): the k best rows of each anchor and window asked for.

    ``anchors`` has the columns of ``_ASKED``: what is asked, as numbers of their own, the windows' low and high
    ends, and ``floor``, the score that a row must reach to be of use.
    """
    sent, wave, known = anchors.sparkSession.sparkContext.broadcast(index), 0, None
    blocks = max(1, -(-anchors.count() // BLOCK))
    while True:
        asked = anchors if known is None else _raised(anchors, known, k)
        dealt = saved(asked.mapInArrow(lean(_dealing(sent, wave)), _ASKED + ", least double, most double, shard long").withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.lit(blocks))), "negatives-asked")
        if known is not None and dealt.isEmpty():
            return known
        found = _visited(index_rows, sent, dealt, k, same_label)
        if known is not None:
            found = known.drop("rank").unionByName(found).dropDuplicates(["anchor_id", "asked", "vec_id"])
        known, wave = saved(ranked(found, k), "negatives-found"), wave + 1


def _raised(anchors: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """Where k rows are known, the last one's score is the least of use."""
    last = known.filter(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("asked", "score"))).alias("_last"))
    floors = F.transform(F.arrays_zip("asked", "low"), lambda w: F.greatest(w["low"], F.coalesce(F.try_element_at(F.col("_last"), w["asked"]), w["low"])))
    return anchors.join(last, "anchor_id", "left").withColumn("floor", floors).drop("_last")


def _dealing(sent, wave: int):
    """The shards that each anchor of a batch visits in this wave, and its span of cell bounds: from ``least`` to below
    ``most``."""

    def run(batches):
        index = sent.value
        place = index.cells[:, 0], index.cells[:, 1]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # an anchor may visit every shard
                batch = whole.slice(at, 256)
                x, floor, high = _rows(batch.column(2)), batch.column(6).to_pylist(), batch.column(5).to_pylist()
                upper, under = index.bounds(x), index.bounds(x, -1)
                least, most, who, shards = np.empty(len(x)), np.full(len(x), math.inf), [], []
                for i in range(len(x)):
                    bound = upper[0][i][place[0]] + upper[1][i][place[1]]
                    passed = under[0][i][place[0]] + under[1][i][place[1]] > max(high[i], default=_NONE)
                    least[i] = index.sweep(bound, passed, SEED * GROWTH**wave) if wave else index.descend([u[i] for u in upper], passed, SEED)
                    if wave:
                        most[i] = index.sweep(bound, passed, SEED * GROWTH ** (wave - 1)) + OVERLAP
                    least[i] = max(least[i], min(floor[i], default=_ABOVE))
                    seen = np.flatnonzero((bound >= least[i]) & (bound < most[i]) & ~passed)
                    own = np.unique(np.repeat(index.first[seen], index.spread[seen]) + _within(index.spread[seen]))
                    who.append(np.full(len(own), i))
                    shards.append(own)
                take = np.concatenate(who)
                columns = [c.take(pa.array(take)) for c in batch.columns]
                yield _arrow([*batch.schema.names, "least", "most", "shard"], [*columns, pa.array(least[take]), pa.array(most[take]), pa.array(np.concatenate(shards))])

    return run


def _visited(index_rows: DataFrame, sent, dealt: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(anchor_id, asked, vec_id, score): of each shard, the k best rows of each anchor and window."""
    wanted = dealt.select(F.col("shard").alias("_shard"), F.col("block").alias("_block")).distinct()
    rows = index_rows.join(wanted, F.col("shard") == F.col("_shard"))

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _found([], [], [], [])
        index = sent.value
        ids, label, cell = left["vec_id"].to_numpy(), left["label"].to_numpy(), np.array([index.place[c] for c in zip(left["c1"].to_pylist(), left["c2"].to_pylist(), strict=True)])
        order = np.lexsort((ids, cell))
        ids, label, cell, x = ids[order], label[order], cell[order], _rows(left["x"])[order]
        q, who, own = _rows(right["x"]), right["anchor_id"].to_numpy(), right["label"].to_numpy()
        least, most = right["least"].to_numpy(), right["most"].to_numpy()
        asked, low, high, floor = (right[c].to_pylist() for c in ("asked", "low", "high", "floor"))
        # a line for each window of each anchor
        of = np.repeat(np.arange(len(q)), [len(a) for a in asked])
        flat = lambda lists: np.array([v for one in lists for v in one], np.int64)
        low, high, floor = flat(low), flat(high), flat(floor)
        top_score, top_id = np.full((len(of), k), _NONE), np.full((len(of), k), _ABOVE)
        upper, under = index.bounds(q), index.bounds(q, -1)
        cells, starts = np.unique(cell, return_index=True)
        ends = np.append(starts[1:], len(cell))
        reach = np.stack([upper[0][:, a] + upper[1][:, b] for a, b in index.cells[cells]], 1)
        below = np.stack([under[0][:, a] + under[1][:, b] for a, b in index.cells[cells]], 1)
        for c in np.argsort(-reach.max(0), kind="stable").tolist():
            bound = reach[:, c]
            # certified windows are done: no row of the cell can enter them
            line = np.flatnonzero(((bound >= least) & (bound < most))[of] & (bound[of] >= np.maximum(floor, top_score[:, -1])) & (bound[of] >= low) & (below[of, c] <= high))
            if not len(line):
                continue
            part = slice(starts[c], ends[c])
            anchors_here, back = np.unique(of[line], return_inverse=True)
            s = scores(q[anchors_here], x[part])
            mine = own[anchors_here, None] == label[part][None]
            fits = (mine & (who[anchors_here, None] != ids[part][None])) if same_label else ~mine
            s = np.where(fits, s, _NONE)[back]
            # rows below the floor are of no use: enough better ones are known
            s = np.where((s >= np.maximum(low, floor)[line, None]) & (s <= high[line, None]), s, _NONE)
            new_score, new_id = best(s, ids[part], k)
            top_score[line], top_id[line] = best(np.concatenate([top_score[line], new_score], 1), np.concatenate([top_id[line], new_id], 1), k)
        line, rank = np.nonzero(top_score != _NONE)
        numbers = flat(asked)
        return _found(who[of[line]], numbers[line], top_id[line, rank], top_score[line, rank])

    met = rows.groupBy("_shard", "_block").cogroup(dealt.groupBy("shard", "block"))
    return met.applyInArrow(visit, "anchor_id long, asked long, vec_id long, score long")


def _within(spread: np.ndarray) -> np.ndarray:
    """0, 1 ... below each number, one after the other."""
    return np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread)


def _found(*columns) -> pa.Table:
    return pa.table([pa.array(np.asarray(c, np.int64)) for c in columns], names=["anchor_id", "asked", "vec_id", "score"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each anchor and window, numbered."""
    w = Window.partitionBy("anchor_id", "asked").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10) -> DataFrame:
    """Of each anchor (ids divisible by ``every``) and each of its ``positives`` best rows of its label, the
    ``negatives`` best rows of other labels in the window of the positive's score."""
    spark = vectors.sparkSession
    built = build(usable(vectors))
    if built is None:
        return spark.createDataFrame([], RESULT)
    rows, index = built
    anchors = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), "label", "x")
    lowest, highest = F.lit(_NONE + 1), F.lit(_ABOVE)

    whole = anchors.select("*", F.array(F.lit(0).cast("long")).alias("asked"), *(F.array(v.cast("long")).alias(c) for c, v in (("low", lowest), ("high", highest), ("floor", lowest))))
    found = search(rows, index, whole, positives, True).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = found.filter("positive_score >= 0").groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("positive_id", "positive_score"))).alias("p"))  # ``positives`` at most
    # a positive's id is what is asked; below 0 a window is empty
    ends = {"asked": "w.positive_id", "low": f"(w.positive_score * {LEAST_TENTHS} + 9) div 10", "high": f"(w.positive_score * {MOST_TENTHS}) div 10"}
    asked = anchors.join(windows, "anchor_id").select("anchor_id", "label", "x", *(F.expr(f"transform(p, w -> {e})").alias(c) for c, e in ends.items())).withColumn("floor", F.col("low"))
    near = search(rows, index, asked, negatives, False).select("anchor_id", F.col("asked").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(found, ["anchor_id", "positive_id"]).select(*(c.split()[0] for c in RESULT.split(", ")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH raw AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, x FROM raw),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank
    FROM p JOIN pairs USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
