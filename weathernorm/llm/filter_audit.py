"""Operator 12: an audit of how filters interact.

Five filters look at every whole text: A too few words, B too many repeated words, C too many capitals,
D a listed symbol, E the same text under a smaller id. For each part (language), each order of the
filters and each step, the audit counts what stays, what is removed, what was removed before, what only
this filter would remove, and which good and toxic documents go.

One pass of a byte transducer gives all that A to D need: a table maps each byte of a text to its class, a
second one maps (state, class) to marks (a word begins, a word ends, a capital, a symbol, a code point
begins). The state after a byte depends on that byte's class alone, so numpy looks up a slice of texts
at once. The words between the marks go into an open-addressing hash table that is verified: a word that
meets another in its slot is compared with it, byte by byte.

The rest is SQL: texts are known by their SHA-256 digest. Equal texts of a language and labels are summed
in each partition first, so the copies of a hot text are never gathered. Documents are summed by the set
of the filters that they fail, and the audit is read off these sums (32 sets a part).

Edge cases: a NULL text is an empty one, a NULL language the empty part; rows with a NULL id are counted,
fail E never and make no other row fail it; rows that repeat an id and a text are no copies of each other
(neither id is smaller); of labels with one id the largest count; very long texts are read whole, in a slice
of their own; other columns are ignored; an empty table has no parts and gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table
from .pretokens import slices

FILTERS = "ABCDE"
#: Fewer words fail A; B asks for a share of distinct words, C for a share of capitals, in per cent.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 3, b"#$%&*|"

# classes of bytes, states, and the marks of a move
_BLANK, _OTHER, _CAPITAL, _SYMBOL, _TAIL = range(5)
_OUTSIDE, _INSIDE = range(2)
_BEGINS, _ENDS, _IS_CAPITAL, _IS_SYMBOL, _IS_TAIL = (1 << k for k in range(5))

_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _BLANK
_CLASS[ord("A") : ord("Z") + 1] = _CAPITAL
_CLASS[list(SYMBOLS)] = _SYMBOL
_CLASS[0x80:0xC0] = _TAIL  # goes on with a code point
#: The state after a byte, by its class.
_NEXT = np.array([_OUTSIDE, _INSIDE, _INSIDE, _INSIDE, _INSIDE], np.uint8)
#: The marks of a move, by 8 * state + class.
_MARKS = np.zeros(16, np.uint8)
for _state, _class in itertools.product((_OUTSIDE, _INSIDE), range(5)):
    _border = 0 if _NEXT[_class] == _state else _BEGINS if _state == _OUTSIDE else _ENDS
    _MARKS[8 * _state + _class] = _border | {_CAPITAL: _IS_CAPITAL, _SYMBOL: _IS_SYMBOL, _TAIL: _IS_TAIL}.get(_class, 0)

#: Words up to so many bytes are hashed and compared in blocks of 8, all at once; longer ones one by one.
_LONG = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of a slice of texts, and how many different ones each text has."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray) -> None:
        self.raw = np.concatenate([buf, np.zeros(8, np.uint8)])
        self.starts, self.length, self.text = starts, ends - starts, text
        self.windows = np.lib.stride_tricks.sliding_window_view(self.raw, 8)

    def _block(self, words: np.ndarray, at: np.ndarray | int) -> np.ndarray:
        """Eight bytes of each word as a number, those past its end 0."""
        left = np.clip(self.length[words] - at, 0, 8)
        value = np.ascontiguousarray(self.windows[self.starts[words] + at]).view("<u8").ravel()
        return np.where(left < 8, value & ((np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1)), value)

    def _bytes(self, word: int) -> bytes:
        return self.raw[self.starts[word] : self.starts[word] + self.length[word]].tobytes()

    def hashes(self) -> np.ndarray:
        """Of the text's number, the length and every byte of a word."""
        h = (self.text.astype(np.uint64) << np.uint64(20)) ^ self.length.astype(np.uint64)
        h *= _MIX
        for k in np.flatnonzero(self.length > _LONG).tolist():
            h[k] ^= np.uint64(hash(self._bytes(k)) & (1 << 64) - 1)
        left, at = np.flatnonzero((self.length > 0) & (self.length <= _LONG)), 0
        while len(left):
            x = (h[left] ^ self._block(left, at)) * _MIX
            h[left] = x ^ (x >> np.uint64(29))
            at += 8
            left = left[self.length[left] > at]
        h *= _MIX
        return h ^ (h >> np.uint64(32))

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words ``a`` and ``b`` stand in one text and have the same bytes."""
        same = (self.text[a] == self.text[b]) & (self.length[a] == self.length[b])
        for k in np.flatnonzero(same & (self.length[a] > _LONG)).tolist():
            same[k] = self._bytes(int(a[k])) == self._bytes(int(b[k]))
        left, at = np.flatnonzero(same & (self.length[a] <= _LONG)), 0
        while len(left):
            match = self._block(a[left], at) == self._block(b[left], at)
            same[left[~match]] = False
            at += 8
            left = left[match]
            left = left[self.length[a[left]] > at]
        return same

    def distinct(self, texts: int) -> np.ndarray:
        """By text, how many words found no equal one in the table."""
        n = len(self.starts)
        slots = np.full(1 << max(3, int(2 * n).bit_length()), -1, np.int64)
        mask = len(slots) - 1
        waiting, at, kept = np.arange(n), (self.hashes() & np.uint64(mask)).astype(np.int64), []
        while len(waiting):
            free = slots[at] < 0
            slots[at[free]] = waiting[free]  # of several that take a slot, one stays there
            there = slots[at]
            own = there == waiting
            kept.append(waiting[own])
            again = np.flatnonzero(~own)
            again = again[~self.equal(waiting[again], there[again])]
            waiting, at = waiting[again], (at[again] + 1) & mask
        return np.bincount(self.text[np.concatenate(kept)] if kept else np.zeros(0, np.int64), minlength=texts)


def counted(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """By text: words, distinct words, capitals, code points, and listed symbols."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    size = int(offsets[-1] - offsets[0])
    buf = np.frombuffer(texts.buffers()[2], np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = _CLASS[buf]
    state = np.empty(size + 1, np.uint8)
    state[1:] = _NEXT[kind]
    state[offsets] = _OUTSIDE  # every text begins outside a word
    marks = _MARKS[(state[:-1] << 3) + kind]
    starts, ends = np.flatnonzero(marks & _BEGINS), np.flatnonzero(marks & _ENDS)
    # words that reach to the end of their text have no mark there
    last = offsets[1:][np.diff(offsets) > 0]
    ends = np.sort(np.concatenate([ends, last[_NEXT[kind[last - 1]] == _INSIDE]]))
    text = np.searchsorted(offsets, starts, side="right") - 1
    count = lambda mark: np.diff(np.searchsorted(np.flatnonzero(marks & mark), offsets))
    words = np.diff(np.searchsorted(starts, offsets))
    return words, Words(buf, starts, ends, text).distinct(len(texts)), count(_IS_CAPITAL), np.diff(offsets) - count(_IS_TAIL), count(_IS_SYMBOL)


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, digest of the text, its counts, and ``fails``: the bits of A to D."""

    def run(batches):
        for batch in batches:
            at = 0
            for part in slices(batch.column(2)):
                words, distinct, capitals, points, symbols = counted(part)
                fails = (words < LEAST_WORDS) * 1 + (100 * distinct < DISTINCT_PERCENT * words) * 2 + (100 * capitals > CAPITAL_PERCENT * points) * 4 + (symbols > 0) * 8
                digests = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest() for t in part.to_pylist()]
                own = batch.slice(at, len(part))
                at += len(part)
                columns = [own.column(0), own.column(1), pa.array(digests, pa.binary()), *(pa.array(x, pa.int64()) for x in (words, distinct, capitals, points, symbols)), pa.array(fails, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, _COLUMNS)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, lang string, digest binary, n_words long, n_distinct long, n_capitals long, n_points long, n_symbols long, fails int")


_COLUMNS = ["doc_id", "lang", "digest", "n_words", "n_distinct", "n_capitals", "n_points", "n_symbols", "fails"]


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic): one row per id."""
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    return labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))


def failure_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, n, good, toxic): documents by language and the bits of all five filters."""
    rows = failures(docs).select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "digest", "fails")
    rows = rows.join(_known(labels), "doc_id", "left").select("doc_id", "part", "digest", "fails", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    kind = ["digest", "part", "fails", "good", "toxic"]
    # rows of one id and text first, then those of one text: each sum begins in its partition
    by_id = rows.groupBy("doc_id", *kind).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    by_text = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), first.alias("first"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"))
    smallest = by_text.groupBy("digest").agg(F.min("first.doc_id").alias("smallest"))
    both = by_text.join(smallest, "digest")
    fine = F.col("n_null") + F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(F.lit(0))
    kinds = F.array(F.struct(F.lit(0).alias("bit"), fine.alias("n")), F.struct(F.lit(16).alias("bit"), (F.col("n") - fine).alias("n")))
    each = both.select("part", "fails", "good", "toxic", F.explode(kinds).alias("k")).filter("k.n > 0")
    when = lambda c: F.sum(F.when(F.col(c), F.col("k.n")).otherwise(F.lit(0)))
    return each.groupBy("part", (F.col("fails") + F.col("k.bit")).alias("fails")).agg(F.sum("k.n").alias("n"), when("good").alias("good"), when("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    bit: Column = F.col("fails").bitwiseAND(F.col("own")) != 0
    before: Column = F.col("fails").bitwiseAND(F.col("earlier")) != 0
    # of the 120 orders, a filter comes first of those that a document fails in 120 / their number
    share = F.when(F.bit_count("fails") > 0, F.lit(120) / F.bit_count("fails")).otherwise(F.lit(0)).cast("long")
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(F.lit(0)))
    # at most 32 rows a part, each to the five steps of the 120 orders
    orders = F.split(F.lit(",".join(map("".join, itertools.permutations(FILTERS)))), ",")
    bits = lambda names: F.aggregate(names, F.lit(0), lambda total, f: total + F.pow(F.lit(2), F.ascii(f) - ord("A")).cast("int"))
    met = failure_sets(docs, labels).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letters = F.split("filter_order", "")
    met = met.withColumns({"own": bits(F.slice(letters, F.col("step"), 1)), "earlier": bits(F.slice(letters, 1, F.col("step") - 1))})
    return met.groupBy("part", "filter_order", "step").agg(
        total(~bit & ~before).alias("kept"),
        total(bit & ~before).alias("removed"),
        total(bit & before).alias("redundant"),
        total(F.col("fails") == F.col("own")).alias("unique_fails"),
        total(bit & ~before, "good").alias("good_lost"),
        total(bit & ~before, "toxic").alias("toxic_lost"),
        F.sum(F.when(bit, F.col("n") * share).otherwise(F.lit(0))).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
known AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
failing AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    len(w) < 200 AS A, 100 * len(list_distinct(w)) < 50 * len(w) AS B, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS C,
    regexp_matches(text, '[#$%&*|]') AS D, coalesce(min(words.doc_id) OVER (PARTITION BY text) < words.doc_id, false) AS E FROM words LEFT JOIN known USING (doc_id)),
bits AS (SELECT part, good, toxic, CAST(A AS INT) + 2 * CAST(B AS INT) + 4 * CAST(C AS INT) + 8 * CAST(D AS INT) + 16 * CAST(E AS INT) AS fails FROM failing),
sums AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM bits GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(name, bit)),
orders AS (SELECT [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits, a.name || b.name || c.name || d.name || e.name AS filter_order FROM f a, f b, f c, f d, f e
    WHERE len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step) s),
counts AS (SELECT part, filter_order, step, own,
    CAST(sum(n) FILTER (fails & own = 0 AND fails & earlier = 0) AS BIGINT) AS kept, CAST(sum(n) FILTER (fails & own > 0 AND fails & earlier = 0) AS BIGINT) AS removed,
    CAST(sum(n) FILTER (fails & own > 0 AND fails & earlier > 0) AS BIGINT) AS redundant, CAST(sum(n) FILTER (fails = own) AS BIGINT) AS unique_fails,
    CAST(sum(good) FILTER (fails & own > 0 AND fails & earlier = 0) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (fails & own > 0 AND fails & earlier = 0) AS BIGINT) AS toxic_lost
    FROM sums, steps GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
    coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley FROM counts
"""
