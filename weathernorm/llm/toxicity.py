"""Operator 10: toxicity by a noisy channel.

A character trigram model is counted over the words of all documents (each task hands on one table of at
most ``LETTERS`` ** 3 counts). Suspicious spans - letters mixed with look-alike digits and signs, letters
set apart by blanks or points, letters repeated three times and more - become lattices of what they may
stand for, and a Viterbi search finds the likeliest reading under the model. The words of a text and
its restored spans are then scored: a logistic regression over a lexicon of words that are more frequent
in toxic texts, both learned from a bounded sample of labelled rows (``fit_rows``, those with the smallest
hashes of their ids); texts with the same words are one row of the fit, which counts all their labels.

Edge cases: NULL and empty texts have no words and score as the regression's constant; NULL ids are
scored and never learned from; rows with the same id are scored one by one; NULL labels are dropped;
with labels of one class, or none, all scores are one constant of at most ``UNTOLD``; other columns are kept or
ignored; very long texts are read whole.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, held_out, labels_of, lean, saved, smallest, table

#: Letters of the model: 0 is a word's border, 1 any other letter.
LETTERS = 64
#: The letters that the model tells apart, and what signs may stand for.
ALPHABET = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h"}
#: Defaults of the fit: labelled rows, the share of the sample's different toxic texts that a word needs (of few texts
#: one), and how much more frequent than in other texts it must be in them. The share bounds the lexicon: 100
#: times the words of a toxic text.
FIT_ROWS, LEAST_SHARE, LEAST_LIFT = 40_000, 0.01, 4.0
#: What a word of a single toxic text adds to the ridge of its weight; of more texts, less by their square.
RARE = 4.0
#: The score's chance without labels of both classes: nothing tells toxic texts then, and none is called so.
UNTOLD = 0.25
#: Steps to a Newton step, at most.
CG_ROUNDS = 200
CACHE_ENTRIES = 100_000
#: Longer spans are read each time: bounds the cache.
CACHE_LETTERS = 60
#: Channel cost of a word's end between letters set apart.
NEW_WORD = 1.0

_INDEX = {c: k for k, c in enumerate(ALPHABET, 2)}
_WORD = re.compile(r"[^\W\d_]+")
_SIGNS = "0-9@$!|+(€£*#"
# a run of signs without a letter after it is passed over at once: no part of it starts a span
_MIXED = re.compile(rf"(?<![\w@$€£])(?:[{_SIGNS}]++(?![^\W\d_])|(?P<span>(?=[{_SIGNS}]*[^\W\d_])(?=[^\W\d_]*[{_SIGNS}])(?:[^\W_]|[{_SIGNS}]){{3,}}))")
# what may set letters apart: any run of these
_GAP = r"[ \t\xa0.\-_*]+"
_GAPS = re.compile(_GAP)
_SPACED = re.compile(rf"(?<!\w)(?:(?:[^\W_]|[@$!|]){_GAP}){{2,}}(?:[^\W_]|[@$!|])(?!\w)")
_TOKEN = re.compile(r"\w+")
_REPEATED = re.compile(r"([^\W\d_])\1\1")
_HAS_SIGN = re.compile(rf"[{_SIGNS}]")
_TRAILING = re.compile(r"[^\w$]+$")


def _letter_table() -> np.ndarray:
    out = np.zeros(0x3000, np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        out[c] = _INDEX.get(ch, 1) if ch.isalpha() else 0
    return out


_letters: list[np.ndarray] = []


def codes(text: str) -> np.ndarray:
    """Letters of the model, 0 for what is no letter; characters past U+2FFF count as other letters."""
    if not _letters:
        _letters.append(_letter_table())
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    return np.where(cp < 0x3000, _letters[0][np.minimum(cp, 0x2FFF)], 1)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n) over all words of all documents."""

    def run(batches):
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for k in range(0, len(text or ""), 1 << 20):  # a very long text in slices
                    c = codes(f" {text[max(0, k - 2) : k + (1 << 20)]} ").astype(np.int32)
                    gram = (c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:]
                    total += np.bincount(gram[(c[1:-1] > 0) | (c[2:] > 0)], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["gram", "n"])

    return docs.select("text").mapInArrow(lean(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class CharModel:
    """Log-probabilities of trigrams, interpolated with bigrams and letters."""

    def __init__(self, gram: np.ndarray, n: np.ndarray) -> None:
        c = np.zeros(LETTERS**3)
        c[gram] = n
        c = c.reshape(LETTERS, LETTERS, LETTERS)
        one = (c.sum((0, 1)) + 1) / (c.sum() + LETTERS)
        two = (c.sum(0) + 5 * one) / (c.sum((0, 2))[:, None] + 5)
        self.log = np.log((c + 5 * two[None]) / (c.sum(2)[:, :, None] + 5)).astype(np.float32)


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """For each run of one character of a span: the readings and their channel costs."""
    out, k = [], 0
    while k < len(span):
        c, r = span[k], 1
        while k + r < len(span) and span[k + r] == c:
            r += 1
        letters = [(x, 0.0) for x in LOOKALIKES.get(c, c)] if not c.isalpha() else [(c, 0.0)]
        if c.isalpha():
            copies = [(r, 0.0)] if r <= 2 else [(1, 0.3), (2, 0.6)]
        else:
            copies = [(r, 0.2)] if r <= 2 else [(1, 0.3), (2, 0.3)]
        out.append([(x * m, cost + extra) for x, cost in letters for m, extra in copies])
        k += r
    return out


def viterbi(span: str, model: CharModel, apart: bool = False) -> str:
    """The likeliest reading of a span: states are the last two letters. In a span that was set apart letter
    by letter, a word may end before any letter ("a i d i o t")."""
    # what a state said is a chain of readings, the last first: a span of any length is read in linear time
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for k, readings in enumerate(lattice(span)):
        if apart and k:
            readings = [*readings, *((f" {x}", cost + NEW_WORD) for x, cost in readings)]
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, said) in states.items():
            for reading, cost in readings:
                x, y, s = a, b, score - cost
                for ch in reading:
                    z = 0 if ch == " " else _INDEX.get(ch, 1)
                    s += float(model.log[x, y, z])
                    x, y = y, z
                if (x, y) not in new or s > new[x, y][0]:
                    new[x, y] = (s, (said, reading))
        states = new
    ends = [(s + float(model.log[a, b, 0]), said) for (a, b), (s, said) in states.items()]
    top = max(s for s, _ in ends)
    return max(_said(said) for s, said in ends if s == top)


def _said(chain: tuple | None) -> str:
    out = []
    while chain:
        chain, reading = chain
        out.append(reading)
    return "".join(reversed(out))


class Restorer:
    """Finds suspicious spans and restores them; keeps a bounded cache of restored spans."""

    def __init__(self, model: CharModel) -> None:
        self.model, self.cache = model, {}

    def read(self, span: str, apart: bool = False) -> str:
        if len(span) > CACHE_LETTERS:
            return viterbi(span, self.model, apart)
        got = self.cache.get((span, apart))
        if got is None:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            got = self.cache[span, apart] = viterbi(span, self.model, apart)
        return got

    def restored(self, low: str) -> list[str]:
        out = []
        if _HAS_SIGN.search(low):
            for m in _MIXED.finditer(low):
                span = m["span"]
                if span is None:
                    continue
                out.append(self.read(span))
                bare = _TRAILING.sub("", span)
                if bare != span and len(bare) > 2 and not bare.isalpha():
                    out.append(self.read(bare))
        c = codes(low)
        if len(c) > 4:
            on = c > 0
            if np.any(on[1:-1] & (c[1:-1] == c[:-2]) & (c[1:-1] == c[2:])):
                out += [self.read(m.group()) for m in _TOKEN.finditer(low) if _REPEATED.search(m.group())]
            solid = np.concatenate([[False], on | _is_sign(low), [False]])
            lone = solid[1:-1] & ~solid[:-2] & ~solid[2:]  # characters that stand alone
            alone = lone[solid[1:-1]]
            if len(alone) > 2 and np.any(alone[:-2] & alone[1:-1] & alone[2:]):
                spans = [_GAPS.sub("", m.group()) for m in _SPACED.finditer(low)]
                out += [self.read(x, apart) for x in spans for apart in (False, True)]  # as one word, and as several
        return out

    def words(self, text: str | None) -> set[str]:
        """The distinct words of a text and of its restored spans, lower-cased."""
        if not text:
            return set()
        low = text.lower()
        found = set(_WORD.findall(low))
        for said in self.restored(low):
            found.update(_WORD.findall(said))
        return found


_sign_table = np.isin(np.arange(128), [ord(c) for c in "0123456789@$!|"])


def _is_sign(low: str) -> np.ndarray:
    cp = np.frombuffer(low.lower().encode("utf-32-le", "replace"), np.uint32)
    return (cp < 128) & _sign_table[np.minimum(cp, 127)]


def char_model(docs: DataFrame) -> CharModel:
    rows = trigram_counts(docs).toPandas()  # at most LETTERS ** 3 rows
    return CharModel(rows["gram"].to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.float64))


def fit_words(x: list[list[int]], n: np.ndarray, t: np.ndarray, size: int, ridge: float | np.ndarray = 1.0, rounds: int = 30) -> tuple[float, np.ndarray]:
    """Logistic regression over the words that documents have, by Newton steps: constant and weights. A row of ``x``
    stands for ``n`` documents, ``t`` of them toxic."""
    both = 0 < t.sum() < n.sum()
    prior = (t.sum() + 0.5) / (n.sum() + 1.0) if both else min(UNTOLD, (t.sum() + 0.5) / (n.sum() + 1.0))
    w = np.zeros(size + 1)
    w[0] = math.log(prior / (1 - prior))
    if not size or not both:
        return float(w[0]), w[1:]
    # a row is the list of its words, after the constant
    size_of = np.array([len(r) + 1 for r in x])
    row, first = np.repeat(np.arange(len(x)), size_of), np.cumsum(size_of) - size_of
    word = np.concatenate([np.array([0, *(k + 1 for k in r)], np.int64) for r in x])
    keep = np.concatenate([[1e-3], np.broadcast_to(ridge, size)])

    def curved(v: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The second derivatives times ``v``, by the rows' words alone."""
        return np.bincount(word, (c * np.add.reduceat(v[word], first))[row], size + 1) + keep * v

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[word], first), -30, 30)))
        c = n * p * (1 - p)
        slope = np.bincount(word, (t - n * p)[row], size + 1) - keep * np.concatenate([[0], w[1:]])
        scale = np.bincount(word, c[row], size + 1) + keep
        # conjugate gradients, scaled by the diagonal
        step, left = np.zeros(size + 1), slope.copy()
        z = left / scale
        way, size_now = z.copy(), float(left @ z)
        for _ in range(CG_ROUNDS):
            if size_now < 1e-18:
                break
            bent = curved(way, c)
            far = size_now / float(way @ bent)
            step, left = step + far * way, left - far * bent
            z = left / scale
            size_now, before = float(left @ z), size_now
            way = z + size_now / before * way
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-5:
            break
    return float(w[0]), w[1:]


def learn(docs: DataFrame, labels: DataFrame, sent_model, folds: int, fit_rows: int = FIT_ROWS, lexicon: int | None = None, least_texts: int | None = None, least_lift: float = LEAST_LIFT) -> tuple[float, dict[str, float]]:
    """The constant and the lexicon's weights, from at most ``fit_rows`` labelled documents. ``lexicon`` and ``least_texts``
    are bounds for callers who want them: words at most, and toxic texts that a word needs (None: ``LEAST_SHARE``)."""
    known = labels_of(labels, "toxic").filter(~held_out(F.col("doc_id"), folds, 0))
    sample = smallest(known, fit_rows, "doc_id")  # bounded by fit_rows: 16 bytes each

    def run(batches):
        restorer = Restorer(sent_model.value)
        for batch in batches:
            words = [sorted(restorer.words(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(words, pa.list_(pa.string()))], ["label", "words"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("text", "label")
    # texts with the same words are one row, with all their labels
    read = chosen.mapInArrow(lean(run), "label int, words array<string>").groupBy(F.xxhash64("words").alias("same")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("t"), F.first("words").alias("words"))
    read = saved(read.select("n", "t", "words"), "toxicity-words")
    sums = read.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("t"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("texts"), F.count(F.when(F.col("t") * 2 > F.col("n"), 1)).alias("toxic")).first()
    if not 0 < sums["t"] < sums["n"]:
        return fit_words([], np.array([float(sums["n"])]), np.array([float(sums["t"])]), 0)[0], {}
    least_texts = max(1, math.ceil(LEAST_SHARE * sums["toxic"])) if least_texts is None else least_texts
    # the lexicon is of different texts: one that is copied often counts once
    by_word = read.select((F.col("t") * 2 > F.col("n")).cast("int").alias("toxic"), F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"))
    lift = (F.col("t") + 0.5) / (F.col("n") - F.col("t") + 0.5) * ((sums["texts"] - sums["toxic"] + 1.0) / (sums["toxic"] + 1.0))
    ranked = by_word.filter(F.col("t") >= least_texts).withColumn("lift", lift).filter(F.col("lift") > least_lift).orderBy(F.desc(F.col("t") * F.log("lift")), "word")
    lexicon_rows = (ranked if lexicon is None else ranked.limit(lexicon)).select("word", "t").collect()
    chosen_words = [r["word"] for r in lexicon_rows]
    # a word of few texts may be theirs alone: it is shrunk more
    ridge = 1 + RARE / np.array([max(1, r["t"]) for r in lexicon_rows], np.float64) ** 2
    index = {w: k for k, w in enumerate(chosen_words)}
    own = F.array_intersect("words", F.split(F.lit(" ".join(chosen_words)), " "))  # words are letters alone
    has = read.select("n", "t", F.array_sort(own).alias("words")).groupBy("words").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).orderBy("words").toPandas()
    constant, w = fit_words([[index[x] for x in r] for r in has["words"]], has["n"].to_numpy(np.float64), has["t"].to_numpy(np.float64), len(index), ridge)
    return constant, {x: float(w[k]) for x, k in index.items()}


def with_score(docs: DataFrame, labels: DataFrame, folds: int = 5, column: str = "toxicity", **fit) -> DataFrame:
    """``docs`` with a score column; every whole text is scored where its row lies. ``fit``: options of :func:`learn`."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(char_model(docs))
    constant, weights = learn(docs, labels, model, folds, **fit)
    sent = spark.sparkContext.broadcast((constant, weights))
    names = [*docs.columns, column]

    def run(batches):
        restorer = Restorer(model.value)
        constant, weights = sent.value
        keys = weights.keys()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            z = [constant + sum(weights[w] for w in keys & restorer.words(t)) for t in batch.column(at).to_pylist()]
            score = 1 / (1 + np.exp(-np.clip(np.array(z, dtype=np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names)

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.5, **fit) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; fold 0 of ``folds`` is never learned from."""
    scored = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, folds, "score", **fit)
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.5, **fit) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    name = free_name(docs, "toxicity_score")
    return with_score(docs, labels, folds, name, **fit).filter(F.col(name) < threshold).drop(name)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
