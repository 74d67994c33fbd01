"""Operator 1: quality by a generalised additive model with pairwise interactions.

Each text becomes a few counts and shares (bytes by class, words, lines, repeats), computed over the
whole text. Cyclic boosting goes round the features, each time adding a shallow tree (at most three
splits) of one feature's histogram, at a small rate, to that feature's lookup table; then pairs, ranked
by how much a 2 x 2 split of the residuals gains, get tables of their own from trees that split both
features. A score is the sum of the tables' entries at a text's bins, through a logistic function.

The model is fitted on the driver from a bounded sample of labelled rows (``fit_rows``, the rows with the
smallest hashes of their ids; 40 numbers a row): the texts of the whole corpus are read once, in
tasks, and their features are kept in the shared folder.

Edge cases: NULL and empty texts have features of their own (all 0) and get a score; NULL ids are
scored and never learned from; rows with the same id are scored one by one; NULL labels are
dropped; labels of one class only, or none, give a constant score; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, labels_of, lean, saved, smallest, table

FEATURES = (
    "log_bytes", "log_words", "word_length", "line_length", "log_lines", "upper", "lower", "digit", "space", "punct", "other_ascii", "high", "symbols_a_word", "bars", "marks",
    "distinct_words", "distinct_lines", "longest_word", "repeated_neighbours", "top_byte", "byte_entropy", "capital_words", "ends_in_symbol", "short_lines", "braces",
)


def _classes() -> np.ndarray:
    out = np.zeros((9, 256))
    for c in range(256):
        ch = chr(c)
        k = 6 if c >= 128 else 0 if ch.isupper() else 1 if ch.islower() else 2 if ch.isdigit() else 3 if ch in " \t\r\n" else 4 if ch in ".,;:?'\"-()" else 5
        out[k, c] = 1
    out[7, [ord(c) for c in "|\t<>"]] = 1
    out[8, [ord(c) for c in "!#$%&*@^~"]] = 1
    return out


_CLASSES = _classes()
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_ENDS = np.isin(np.arange(256), list(b"!#$%&*|"))
_BRACES = [ord(c) for c in "{}[]=_\\/"]


def text_features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(FEATURES)
    n, buf = len(raw), np.frombuffer(raw, np.uint8)
    hist = np.bincount(buf, minlength=256)
    upper, lower, digit, space, punct, other, high, bars, marks = (_CLASSES @ hist / n).tolist()
    blank = np.concatenate([[True], _BLANK[buf], [True]])
    border = np.flatnonzero(blank[1:] != blank[:-1])  # starts and ends of words, by turns
    starts, ends = border[::2], border[1::2]
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m, k = max(1, len(starts)), max(1, len(lines))
    p = hist[hist > 0] / n
    capital = np.count_nonzero(_CLASSES[0][buf[starts]]) / m
    symbol = np.count_nonzero(_ENDS[buf[ends - 1]]) / m
    longest = int((ends - starts).max(initial=0))
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        math.log1p(n), math.log1p(len(starts)), n / m, n / k, math.log1p(len(lines)), upper, lower, digit, space, punct, other, high, (marks + bars) * n / m, bars, marks,
        len(set(words)) / m**0.8, len(set(lines)) / k, longest, same / m, hist.max() / n, float(-(p @ np.log2(p))), capital, symbol, sum(len(x) < 20 for x in lines) / k, float(hist[_BRACES].sum()) / n,
    ]


class AdditiveModel:
    """Lookup tables by feature and by pair; see the module."""

    def __init__(self, bins: int = 32, rounds: int = 200, rate: float = 0.1, pairs: int = 8, pair_bins: int = 8, pair_rounds: int = 60, least: int = 15) -> None:
        self.bins, self.rounds, self.rate, self.n_pairs, self.pair_bins, self.pair_rounds, self.least = bins, rounds, rate, pairs, pair_bins, pair_rounds, least
        self.edges: list[np.ndarray] = []
        self.coarse: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.start = 0.0

    @staticmethod
    def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.array([])

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)

    def _tree(self, g: np.ndarray, h: np.ndarray, c: np.ndarray, splits: int) -> np.ndarray:
        """Values by bin of a tree of at most ``splits`` best-first splits of a histogram."""
        g0, h0, c0 = (np.concatenate([[0], np.cumsum(x)]) for x in (g, h, c))

        def best(a: int, b: int):
            if b - a < 2:
                return -1.0, a, a, b
            k = np.arange(a + 1, b)
            lg, lh, rg, rh = g0[k] - g0[a], h0[k] - h0[a], g0[b] - g0[k], h0[b] - h0[k]
            gain = lg**2 / (lh + 1) + rg**2 / (rh + 1) - (g0[b] - g0[a]) ** 2 / (h0[b] - h0[a] + 1)
            gain[(c0[k] - c0[a] < self.least) | (c0[b] - c0[k] < self.least)] = -1
            i = int(np.argmax(gain))
            return float(gain[i]), int(k[i]), a, b

        leaves, out = [best(0, len(g))], np.zeros(len(g))
        for _ in range(splits):
            gain, k, a, b = max(leaves)
            if gain <= 1e-9:
                break
            leaves.remove((gain, k, a, b))
            leaves += [best(a, k), best(k, b)]
        for _, _, a, b in leaves:
            out[a:b] = (g0[b] - g0[a]) / (h0[b] - h0[a] + 1)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        prior = (y.sum() + 1) / (len(y) + 2)
        self.start = math.log(prior / (1 - prior))
        self.edges = [self._cuts(x[:, j], self.bins) for j in range(x.shape[1])]
        self.coarse = [self._cuts(x[:, j], self.pair_bins) for j in range(x.shape[1])]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        if not 0 < y.sum() < len(y):
            return self
        b, f = self._binned(x), np.full(len(y), self.start)
        counts = [np.bincount(b[:, j], minlength=len(t)) for j, t in enumerate(self.tables)]
        for _ in range(self.rounds):
            for j, t in enumerate(self.tables):
                p = 1 / (1 + np.exp(-f))
                step = self.rate * self._tree(np.bincount(b[:, j], y - p, len(t)), np.bincount(b[:, j], p * (1 - p), len(t)), counts[j], 3)
                t += step
                f += step[b[:, j]]
        self._fit_pairs(x, y, f)
        return self

    def _fit_pairs(self, x: np.ndarray, y: np.ndarray, f: np.ndarray) -> None:
        c = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.coarse)], 1)
        size, p = [len(e) + 1 for e in self.coarse], 1 / (1 + np.exp(-f))
        ranked = []
        for i in range(x.shape[1]):
            for j in range(i + 1, x.shape[1]):
                cell = c[:, i] * size[j] + c[:, j]
                g, h = (np.bincount(cell, v, size[i] * size[j]).reshape(size[i], size[j]).cumsum(0).cumsum(1) for v in (y - p, p * (1 - p)))
                # the best 2 x 2 split
                quarters = [(a, a[-1:, :] - a, a[:, -1:] - a, a[-1, -1] - a[-1:, :] - a[:, -1:] + a) for a in (g, h)]
                ranked.append((float(sum(qg**2 / (qh + 1) for qg, qh in zip(*quarters, strict=True)).max()), i, j))
        for _, i, j in sorted(ranked, reverse=True)[: self.n_pairs]:
            self.pairs.append((i, j, np.zeros((size[i], size[j]))))
        for _ in range(self.pair_rounds):
            for i, j, t in self.pairs:
                p = 1 / (1 + np.exp(-f))
                cell = c[:, i] * size[j] + c[:, j]
                g, h, n = (np.bincount(cell, v, t.size).reshape(t.shape) for v in (y - p, p * (1 - p), np.ones(len(y))))
                # split the first feature once, then the second in either half
                first = self._tree(g.sum(1), h.sum(1), n.sum(1), 1)
                step = np.zeros_like(t)
                for value in np.unique(first):
                    half = first == value
                    step[half] = self._tree(g[half].sum(0), h[half].sum(0), n[half].sum(0), 2)
                step *= self.rate
                t += step
                f += step[c[:, i], c[:, j]]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b, out = self._binned(x), np.full(len(x), self.start)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        if self.pairs:
            c = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.coarse)], 1)
            for i, j, t in self.pairs:
                out += t[c[:, i], c[:, j]]
        return 1 / (1 + np.exp(-out))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the features of every whole text."""

    def run(batches):
        for batch in batches:
            x = np.array([text_features(t) for t in batch.column(1).to_pylist()], dtype=np.float64).reshape(-1, len(FEATURES))
            flat = pa.array(x.ravel(), pa.float64())
            offsets = pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "x"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(run), "doc_id long, x array<double>")


def quality(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; fold 0 of ``folds`` is never learned from."""
    spark = docs.sparkSession
    kept = saved(features(docs), "quality-features")
    known = labels_of(labels, "quality").filter(~held_out(F.col("doc_id"), folds, 0))
    labelled = saved(kept.join(known, "doc_id"), "quality-labelled")
    sample = smallest(labelled, fit_rows, "doc_id", "x").select("x", "label").toPandas()
    x = np.array(sample["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    sent = spark.sparkContext.broadcast(AdditiveModel().fit(x, sample["label"].to_numpy(dtype=np.float64)))

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(x), pa.float64())], ["doc_id", "score"])

    scored = kept.mapInArrow(lean(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
