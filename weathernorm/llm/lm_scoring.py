"""Operator 13: scores of texts under a log-bilinear language model.

Tokens are words between white space, A-Z lower-cased, and one end a text. The counts of all words of all
learning texts give the base score, a smoothed unigram. The model predicts a symbol from the two before it:
the end, the ``SHORTLIST`` most frequent words, and ``BUCKETS`` classes of all other words by their last two
bytes. A symbol has a vector as context (R) and one as target (Q) with a bias b, and each of the two places a
matrix (C1, C2): log P(w | v1, v2) = (R[v1] C1 + R[v2] C2) . Q[w] + b[w] - log Z(v1, v2). A word of a class also
takes its smoothed share of the class' count, with one share for a word never seen; so the probabilities
of all words (and one unseen a class) sum to 1.

Training is noise-contrastive estimation in numpy over every learning text: in each of ``EPOCHS`` rounds each
task takes the broadcast parameters through all of its texts by steps of AdaGrad, and the tasks' parameters are
averaged by their numbers of tokens (as whole numbers, whose sums don't depend on their order). What is
averaged is summed by blocks of the parameters, in two steps, by Spark. With two places Z is exact and cheap:
the terms of the two places are two tables by (symbol, target), and all Z are one product of their
exponentials; so a token's normalised log-probability is three look-ups.

Words: the ``FREQUENT`` most frequent ones (in all texts) are broadcast with their counts, which only spares
work; other words go to a join with the table of all counts. Texts are cut once, into symbols in the shared
folder, that training and scoring read.

Edge cases: a NULL or empty text is one end; rows with a NULL id are scored, not held out, never learned from;
rows that repeat an id count one by one; very long texts are a slice of their own, and words of any length
are words; without learning texts every count is 0 and the model uniform over the classes; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import string
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_is, held_out, lean, saved, table
from .pretokens import LONGEST_KEPT, slices

#: Symbols of the model besides the end, and the words whose counts are broadcast.
SHORTLIST, BUCKETS, FREQUENT = 1_000, 256, 200_000
#: Numbers of a vector, tokens of a step, noise symbols shared by a step, the rate, and rounds over all texts.
WIDTH, STEP, NOISE, RATE, EPOCHS = 12, 1_024, 32, 0.5, 2
#: Fixed value: what is added to each count.
ADDED = 0.1
#: Different words that a task counts before its sums go on to the shuffle.
COUNTER_WORDS = 300_000
END = b""
_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: Parameters as whole numbers, and how many of them are summed together.
_UNIT, _BLOCK, _FAN = 2.0**40, 1 << 13, 256


def tokens(text: bytes | None) -> list[bytes]:
    """Words, then the end."""
    return [*(text or b"").translate(_LOWER).split(), END]


def texts_of(batch: pa.RecordBatch, column: int):
    """Slices of a batch by bytes: (first row, the rows' texts as bytes)."""
    at = 0
    for part in slices(batch.column(column)):
        yield at, part.cast(pa.large_binary() if pa.types.is_large_string(part.type) else pa.binary()).to_pylist()
        at += len(part)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n_all, n): how often each word is in all texts, and in those with ``learned``; the end is a word."""

    def run(batches):
        seen = (Counter(), Counter())

        def emit():
            for learned, counts in enumerate(seen):
                words, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
                for k in range(0, len(words), 100_000):
                    part = n[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(words[k : k + 100_000], pa.binary()), pa.array(part), pa.array(part * learned)], ["word", "n_all", "n"])
                counts.clear()

        for batch in batches:
            learned = batch.column(1).to_pylist()
            for at, texts in texts_of(batch, 0):
                for k, text in enumerate(texts, at):
                    seen[learned[k]].update(tokens(text))
                if len(seen[0]) + len(seen[1]) > COUNTER_WORDS:
                    yield from emit()
        yield from emit()

    return docs.select("text", "learned").mapInArrow(lean(run), "word binary, n_all long, n long").groupBy("word").agg(F.sum("n_all").alias("n_all"), F.sum("n").alias("n"))


class Vocabulary:
    """Symbols of words, and what the frequent ones add to a score."""

    def __init__(self, words: list[tuple[bytes, int]], shortlist: list[bytes], sums: dict[int, tuple[int, int]], total: int, buckets: int) -> None:
        #: ``words`` has the counts of the frequent words and of the shortlist, ``sums`` count and kinds of each class.
        self.shortlist, self.total, self.buckets = shortlist, total, buckets
        self.first = 1 + len(shortlist)  # the first class
        self.size = self.first + buckets
        self.words = words
        n = np.array([sums.get(k, (0, 0))[0] for k in range(buckets)], np.float64)
        kinds = np.array([sums.get(k, (0, 0))[1] for k in range(buckets)], np.float64)
        #: Of each class, the logarithm of its words' counts with what is added.
        self.spread = np.log10(n + ADDED * (kinds + 1))
        self.counts = np.zeros(self.size)
        self.counts[self.first :] = n
        known = dict(words)
        for k, word in enumerate([END, *shortlist]):
            self.counts[k] = known.get(word, 0)
        self._table = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}  # each worker makes its own

    def bucket(self, word: bytes) -> int:
        return zlib.crc32(word[-2:]) % self.buckets

    @property
    def table(self) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
        """word -> place, and by place the symbol, the logarithm of the count, and whether the word is known."""
        if self._table is None:
            own = {w: k for k, w in enumerate([END, *self.shortlist])}
            symbol = np.array([own[w] if w in own else self.first + self.bucket(w) for w, _ in self.words], np.int64)
            n = np.array([c for _, c in self.words], np.float64)
            self._table = ({w: k for k, (w, _) in enumerate(self.words)}, symbol, np.log10(n + ADDED), n > 0)
        return self._table


def vocabulary(counts: DataFrame, total: int, shortlist: int, buckets: int, frequent: int) -> Vocabulary:
    """From the counts of all words; what comes to the driver is bounded by the three numbers."""
    own = counts.filter((F.octet_length("word") > 0) & (F.octet_length("word") <= LONGEST_KEPT))
    short = [bytes(r["word"]) for r in own.filter("n > 0").orderBy(F.desc("n"), "word").limit(shortlist).collect()]
    more, kept = own.count(), own
    if more > frequent:  # a threshold first: what is sorted is about the table, however many partitions there are
        kept = own.filter(F.col("n_all") >= own.agg(F.percentile_approx("n_all", 1 - frequent / more, 10_000)).first()[0])
    words = {bytes(r["word"]): r["n"] for r in kept.orderBy(F.desc("n_all"), "word").limit(frequent).select("word", "n").collect()}
    spark = counts.sparkSession
    listed = spark.createDataFrame([(bytearray(w),) for w in [END, *short]], "word binary")
    for r in counts.join(F.broadcast(listed), "word").select("word", "n").collect():  # the end, and the shortlist if it is not among the frequent
        words[bytes(r["word"])] = r["n"]
    words.setdefault(END, 0)
    bucket = (F.crc32(F.substring("word", -2, 2)) % buckets).cast("int")
    rest = counts.join(F.broadcast(listed), "word", "left_anti").groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("kinds"))
    return Vocabulary(list(words.items()), short, {r["bucket"]: (r["n"], r["kinds"]) for r in rest.collect()}, total, buckets)


_ENCODED = "row long, doc_id long, held_out boolean, learned boolean, n_tokens long, n_known long, counted double, spread double, symbols binary, missing array<binary>"


def encoded(docs: DataFrame, vocab) -> DataFrame:
    """Texts as symbols (16 bits each), with the sums over the frequent words (``counted``: logarithms of counts;
    ``spread``: of their classes) and the words whose counts are not at hand."""

    def run(batches):
        v, row = vocab.value, TaskContext.get().partitionId() << 33
        places, symbol_of, log_of, known_of = v.table
        for batch in batches:
            for at, texts in texts_of(batch, 3):
                words, size = [], np.empty(len(texts), np.int64)
                for k, text in enumerate(texts):
                    own = tokens(text)
                    size[k] = len(own)
                    words += own
                place = np.fromiter(map(places.get, words, repeat(-1)), np.int64, len(words))
                lost = np.flatnonzero(place < 0)
                missing = [words[k] for k in lost.tolist()]
                del words
                symbol, starts = symbol_of[place], np.cumsum(size) - size
                symbol[lost] = np.fromiter(map(v.bucket, missing), np.int64, len(missing)) + v.first
                log, known = log_of[place], known_of[place].astype(np.int64)
                log[lost], known[lost] = 0, 0
                in_class = symbol >= v.first
                log_all, spread = np.add.reduceat(log, starts), np.add.reduceat(np.where(in_class, v.spread[np.maximum(symbol - v.first, 0)], 0.0), starts)
                counted = np.add.reduceat(np.where(in_class, log, 0.0), starts)  # a listed word's count is in its symbol
                ends = np.append(starts, len(symbol))
                own = batch.slice(at, len(texts))
                data = [own.column(0), own.column(1), own.column(2), pa.array(size), pa.array(np.add.reduceat(known, starts)), pa.array(log_all), pa.array(counted - spread)]
                packed = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(symbol.astype("<u2"))])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(lost, ends).astype(np.int32)), pa.array(missing, pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(texts))), *data, packed, lists], [c.split()[0] for c in _ENCODED.split(", ")])
                row += len(texts)

    return docs.select("doc_id", "held_out", "learned", "text").mapInArrow(lean(run), _ENCODED)


class LogBilinear:
    """Parameters R, Q, b, C1, C2; see the module."""

    def __init__(self, counts: np.ndarray, width: int = WIDTH, seed: int = 13) -> None:
        rng, m = np.random.default_rng(seed), len(counts)
        self.noise = (counts + ADDED) / (counts.sum() + ADDED * m)
        self.r = rng.normal(0, 0.3, (m, width))
        self.q = np.zeros((m, width))
        self.b = np.log(self.noise)  # starts as the unigram
        self.c = np.stack([np.eye(width), 0.5 * np.eye(width)])

    @property
    def parts(self) -> tuple[np.ndarray, ...]:
        return self.r, self.q, self.b, self.c

    def packed(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.parts:
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def hidden(self, before: np.ndarray) -> np.ndarray:
        """Of rows (last symbol, the one before it)."""
        return self.r[before[:, 0]] @ self.c[0] + self.r[before[:, 1]] @ self.c[1]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms by (last symbol, target) and by (the one before, target), and log Z by (last symbol, the one before)."""
        near, far = self.r @ self.c[0] @ self.q.T, self.r @ self.c[1] @ self.q.T + self.b
        tops = near.max(1), far.max(1)
        z = np.exp(near - tops[0][:, None]) @ np.exp(far - tops[1][:, None]).T
        return near.astype(np.float32), far.astype(np.float32), np.log(np.maximum(z, 1e-300)) + tops[0][:, None] + tops[1][None]


class Trainer:
    """Noise-contrastive estimation by steps of AdaGrad, in single precision."""

    def __init__(self, model: LogBilinear, seed: int, noise: int = NOISE, rate: float = RATE) -> None:
        self.rng, self.k, self.rate = np.random.default_rng(seed), noise, rate
        self.r, self.q, self.b, self.c = (p.astype(np.float32) for p in model.parts)
        self.seen = [np.full(p.shape, 1e-2, np.float32) for p in (self.r, self.q, self.b, self.c)]
        self.shift = np.log(noise * model.noise).astype(np.float32)
        self.cumulative = np.cumsum(model.noise)

    def _move(self, part: np.ndarray, seen: np.ndarray, gradient: np.ndarray) -> None:
        seen += gradient * gradient
        part += self.rate * gradient / np.sqrt(seen)

    def _scatter(self, rows: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        m, d = self.r.shape
        return np.bincount((rows[:, None] * d + np.arange(d)).ravel(), gradient.ravel(), m * d).reshape(m, d).astype(np.float32)

    @np.errstate(over="ignore")
    def step(self, before: np.ndarray, target: np.ndarray) -> None:
        near, far = self.r[before[:, 0]], self.r[before[:, 1]]
        h = near @ self.c[0] + far @ self.c[1]
        drawn = np.minimum(np.searchsorted(self.cumulative, self.rng.random(self.k)), len(self.b) - 1)
        sigmoid = lambda x: 1 / (1 + np.exp(-x))  # noqa: E731  0 where the exponential is infinite
        qt, qn = self.q[target], self.q[drawn]
        up = 1 - sigmoid((h * qt).sum(1) + self.b[target] - self.shift[target])
        down = -sigmoid(h @ qn.T + self.b[drawn] - self.shift[drawn])
        gh = up[:, None] * qt + down @ qn
        n, m = np.float32(len(target)), len(self.b)
        gq = self._scatter(np.concatenate([target, drawn]), np.concatenate([up[:, None] * h, down.T @ h]))
        gb = np.bincount(np.concatenate([target, drawn]), np.concatenate([up, down.sum(0)]), m).astype(np.float32)
        gr = self._scatter(before.T.ravel(), np.concatenate([gh @ self.c[0].T, gh @ self.c[1].T]))
        gc = np.stack([near.T @ gh, far.T @ gh])
        for part, seen, gradient in zip((self.r, self.q, self.b, self.c), self.seen, (gr, gq, gb, gc), strict=True):
            self._move(part, seen, gradient / n)

    def read(self, symbols: np.ndarray, starts: np.ndarray) -> None:
        """Steps through all tokens of a slice of texts, shuffled."""
        before = contexts(symbols, starts)
        order = self.rng.permutation(len(symbols))
        for k in range(0, len(order), STEP):
            at = order[k : k + STEP]
            self.step(before[at], symbols[at])

    def packed(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in (self.r, self.q, self.b, self.c)]).astype(np.float64)


def contexts(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The two symbols before each one; before a text there are ends."""
    out = np.zeros((len(symbols), 2), np.int64)
    out[1:, 0], out[2:, 1] = symbols[:-1], symbols[:-2]
    out[starts] = 0  # what stands before is the end of another text
    return out


def _unpacked(column: pa.Array):
    """The symbols of some texts, and where each begins."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    symbols = np.frombuffer(column.buffers()[2], "<u2", int(ends[-1] - ends[0]) // 2, int(ends[0]))
    return symbols.astype(np.int64), ((ends[:-1] - ends[0]) // 2).astype(np.int64)


def trained(learning: DataFrame, model: LogBilinear, total: int, epochs: int = EPOCHS) -> LogBilinear:
    """Rounds over all texts of ``learning`` (column symbols), ``total`` tokens in all."""
    spark = learning.sparkSession
    for epoch in range(epochs):
        sent = spark.sparkContext.broadcast(model)

        def run(batches, epoch=epoch, sent=sent):
            task = TaskContext.get().partitionId()
            trainer, n = Trainer(sent.value, 1_000_003 * epoch + task), 0
            for batch in batches:
                for part in slices(batch.column(0)):
                    symbols, starts = _unpacked(part)
                    trainer.read(symbols, starts)
                    n += len(symbols)
            if n:
                flat = np.rint(trainer.packed() * (n / total) * _UNIT).astype(np.int64)
                blocks = [flat[k : k + _BLOCK].tobytes() for k in range(0, len(flat), _BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([task % _FAN] * len(blocks), pa.int32()), pa.array([n] * len(blocks), pa.int64()), pa.array(blocks, pa.binary())], ["block", "fan", "n", "numbers"])

        def add(part: pa.Table) -> pa.Table:
            numbers = sum(np.frombuffer(x, np.int64) for x in part["numbers"].to_pylist())
            return pa.table({"block": part["block"][:1], "n": pa.array([sum(part["n"].to_pylist())], pa.int64()), "numbers": pa.array([numbers.tobytes()], pa.binary())})

        own = learning.select("symbols").mapInArrow(lean(run), "block int, fan int, n long, numbers binary")
        sums = own.groupBy("block", "fan").applyInArrow(add, "block int, n long, numbers binary").groupBy("block").applyInArrow(add, "block int, n long, numbers binary")
        found = sorted(((r["block"], r["n"], r["numbers"]) for r in sums.collect()), key=lambda r: r[0])
        if found:
            model.unpack(np.concatenate([np.frombuffer(x, np.int64) / _UNIT * (total / n) for _, n, x in found]))
    return model


def lm_scores(docs: DataFrame, folds: int = 10, fold: int = 0, shortlist: int = SHORTLIST, buckets: int = BUCKETS, frequent: int = FREQUENT, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text; ``fold`` of ``folds`` is
    held out."""
    spark = docs.sparkSession
    learned = F.coalesce(~fold_is(F.col("doc_id"), folds, fold), F.lit(False)).alias("learned")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), folds, fold).alias("held_out"), learned, "text")
    counts = saved(word_counts(rows), "lm-counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("kinds")).first()
    total, each = sums["n"], math.log10(sums["n"] + ADDED * (sums["kinds"] + 1))
    vocab = vocabulary(counts, total, shortlist, buckets, frequent)
    cut = saved(encoded(rows, spark.sparkContext.broadcast(vocab)), "lm-encoded")
    model = trained(cut.filter("learned"), LogBilinear(vocab.counts), total, epochs)
    sent = spark.sparkContext.broadcast(model.tables())

    def run(batches):
        near, far, z = sent.value
        for batch in batches:
            at = 0
            for part in slices(batch.column(7)):
                symbols, starts = _unpacked(part)
                before = contexts(symbols, starts)
                log = near[before[:, 0], symbols].astype(np.float64) + far[before[:, 1], symbols] - z[before[:, 0], before[:, 1]]
                own = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays([*own.columns[:7], pa.array(np.add.reduceat(log, starts) / math.log(10))], [*own.schema.names[:7], "model"])

    kept = cut.select("row", "doc_id", "held_out", "n_tokens", "n_known", "counted", "spread", "symbols")
    scored = kept.mapInArrow(lean(run), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, counted double, spread double, model double")
    # words whose counts were not broadcast: how often a text has one is summed before counts are looked up
    words = cut.select(F.col("row").alias("of"), F.explode("missing").alias("word")).join(counts.select("word", "n"), "word")
    looked = words.groupBy("of").agg(F.sum(F.log10(F.col("n") + ADDED)).alias("more"), F.count(F.when(F.col("n") > 0, 1)).alias("known"))
    out = scored.join(looked, F.col("row") == F.col("of"), "left")
    more, known = (F.coalesce(c, F.lit(0)) for c in ("more", "known"))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + known).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("counted") + more - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        (F.col("model") + F.col("spread") + more).alias("score"),
    )


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
