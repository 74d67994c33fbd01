"""Operator 4: language identification by interpolated Kneser-Ney character models.

Texts are letters, lower-cased, and one blank for each run of anything else. Each task counts the
4-grams of its learning texts by language; the sums over the whole corpus give, by language, discounted
4-gram counts and continuation counts of the shorter ones, all computed in Spark over every gram. A
language's model is a set of sorted arrays of packed grams (four 16-bit characters; those past U+FFFF are
hashed into 16 bits) with their terms, found by binary search: files in the shared folder, which workers
map. What the most frequent grams take is also computed once and broadcast. A text gets the language of the lowest cross-entropy a character; ``rejected``
tells that this is further above what the language's own learning texts need than chance explains.

Edge cases: NULL texts and texts without a letter are ``und`` with score 0; rows with a NULL language or
id are never learned from; NULL ids are predicted and not held out; other columns are ignored; nothing
to learn from gives ``und`` everywhere; ties go to the first language by name.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_is, held_out, lean, saved, scratch_dir, table

ORDER = 4
#: Of about so many 4-grams of a language at most, the most frequent ones, the bits are broadcast, and so many
#: bits of all grams in all languages. Those of others are computed from the stored models where they
#: occur, with the same result.
GRAMS, BITS = 300_000, 20_000_000
#: Characters that a score's confidence counts at most, and the z-score of a rejection.
CONFIDENT, REJECT_Z = 40, 6.0
_SLICE = 1 << 20
_fold: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    """A letter's 16-bit code, or 32 for anything else."""
    if not _fold:
        known = np.full(0x110000, 32, np.uint16)
        for c in range(0x110000):
            if chr(c).isalpha():
                known[c] = c if c < 0x10000 else 0x8000 | (c * 40503 >> 3 & 0x7FFF)
        _fold.append(known)
    return _fold[0][np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]


def grams(text: str | None):
    """Packed 4-grams of a text, slice by slice; its first letters follow three blanks."""
    held = np.full(ORDER - 1, 32, np.uint64)
    for k in range(0, len(text or ""), _SLICE):
        last = k + _SLICE >= len(text)
        c = _codes(text[k : k + _SLICE])
        blank = c == 32
        before = np.concatenate([[held[-1] == 32], blank[:-1]])
        c = c[~(blank & before)].astype(np.uint64)
        if last and len(c) and c[-1] != 32:
            c = np.append(c, np.uint64(32))
        s = np.concatenate([held, c])
        held = s[-(ORDER - 1) :]
        if len(c):
            g = s[3:].copy()
            for j in range(1, ORDER):
                g |= s[3 - j : len(s) - j] << np.uint64(16 * j)
            yield g


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts."""

    def emit(kept: dict):
        for lang, (g, n) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    def run(batches):
        kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def fold(lang: str) -> None:
            size[lang] = 0
            g, n = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
            if lang in kept:
                all_g, all_n = np.concatenate([kept[lang][0], g]), np.concatenate([kept[lang][1], n])
                g, at = np.unique(all_g, return_inverse=True)
                n = np.bincount(at, all_n).astype(np.int64)
            kept[lang] = (g, n.astype(np.int64))

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for g in grams(text):
                    waiting.setdefault(lang, []).append(g)
                    size[lang] = size.get(lang, 0) + len(g)
                    if size[lang] > 2_000_000:
                        fold(lang)
            if sum(len(g) for g, _ in kept.values()) > 3_000_000:  # a bounded task: sums go on to the shuffle
                for lang in list(waiting):
                    fold(lang)
                yield from emit(kept)
                kept.clear()
        for lang in list(waiting):
            fold(lang)
        yield from emit(kept)

    return docs.select("lang", "text").mapInArrow(lean(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, values, len(u))


def _at(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(asked), default)
    i = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[i] == asked, values[i], default)


class KneserNey:
    """Interpolated Kneser-Ney from 4-gram counts, as sorted arrays of packed grams and their terms."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, alphabet: int = 65536) -> None:
        order = np.argsort(gram)
        keys, counts = gram[order].astype(np.uint64), n[order].astype(np.float64)
        self.levels: list[tuple] = []
        self.alphabet = alphabet
        for k in range(ORDER, 0, -1):
            once, twice = (counts == 1).sum(), (counts == 2).sum()
            d = min(0.95, max(0.1, once / (once + 2 * twice) if once else 0.5))
            context, total = _sums(keys >> np.uint64(16), counts)
            _, kinds = _sums(keys >> np.uint64(16), np.ones(len(keys)))
            share = np.maximum(counts - d, 0) / _at(context, total, keys >> np.uint64(16), 1.0)
            self.levels.append((k, keys, share, context, d * kinds / total))
            # a shorter gram counts the different characters before it
            keys, counts = _sums(keys & np.uint64((1 << 16 * (k - 1)) - 1), np.ones(len(keys)))

    def chance(self, asked: np.ndarray) -> np.ndarray:
        p = np.full(len(asked), 1.0 / self.alphabet)
        for k, keys, share, context, rest in reversed(self.levels):
            g = asked & np.uint64((1 << 16 * k) - 1 if k < 4 else 0xFFFFFFFFFFFFFFFF)
            p = _at(keys, share, g, 0.0) + _at(context, rest, g >> np.uint64(16), 1.0) * p
        return p


_SIDES = ("gram", "context")


def stored(counted: DataFrame) -> str:
    """Writes the levels of every language's model (:class:`KneserNey`, over all grams of (number, gram, n)) as
    sorted arrays to a folder, and gives its name. A task sorts and streams one array at a time."""
    spark = counted.sparkSession
    at = f"{scratch_dir(spark)}/language-models-{uuid.uuid4().hex}"
    filesystem, path = pafs.FileSystem.from_uri(at)
    filesystem.create_dir(path)
    found, arrays = counted, []
    for k in range(ORDER, 0, -1):
        once, twice = F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1))
        d = F.greatest(F.lit(0.1), F.least(F.lit(0.95), F.when(once > 0, once / (once + 2 * twice)).otherwise(0.5)))
        discount = F.broadcast(found.groupBy("number").agg(d.alias("d")))
        by_context = found.withColumn("context", F.shiftrightunsigned("gram", 16))
        context = saved(by_context.groupBy("number", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).join(discount, "number"), "language-contexts")
        share = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")
        arrays.append(by_context.join(context, ["number", "context"]).select("number", F.lit(k).alias("level"), F.lit(0).alias("side"), F.col("gram").alias("key"), share.alias("value")))
        arrays.append(context.select("number", F.lit(k), F.lit(1), "context", F.col("d") * F.col("kinds") / F.col("total")))
        # a shorter gram counts the different characters before it
        if k > 1:
            found = saved(found.groupBy("number", F.col("gram").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "language-shorter")

    def write(batches):
        filesystem, path = pafs.FileSystem.from_uri(at)
        own, now, files, rows = uuid.uuid4().hex, None, [], 0

        def close():
            for name, file in files:  # whole arrays only get their names; a task that runs again replaces them
                file.close()
                filesystem.move(f"{path}/{name}.{own}", f"{path}/{name}")

        for batch in batches:
            which = [batch.column(c).to_numpy() for c in range(3)]
            cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in which], axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                number, level, side = (int(c[a]) for c in which)
                if (number, level, side) != now:
                    close()
                    now, names = (number, level, side), [f"{number}-{level}-{_SIDES[side]}.{x}" for x in ("keys", "values")]
                    files = [(name, filesystem.open_output_stream(f"{path}/{name}.{own}")) for name in names]
                for (_, file), c in zip(files, (3, 4), strict=True):
                    file.write(batch.column(c).slice(a, b - a).to_numpy().tobytes())
                rows += b - a
        close()
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["rows"])

    every = arrays[0]
    for x in arrays[1:]:
        every = every.union(x)
    # unsigned order: packed grams from 2^63 on are negative as long
    dealt = every.repartition("number", "level", "side").sortWithinPartitions("number", "level", "side", F.col("key") < 0, "key")
    dealt.mapInArrow(lean(write, 1 << 20), "rows long").agg(F.sum("rows")).collect()
    return at


def stored_model(at: str, number: int) -> KneserNey:
    """A model whose arrays are mapped from the files, or read where the folder can't be mapped."""
    filesystem, path = pafs.FileSystem.from_uri(at)

    def array(name: str, kind: type) -> np.ndarray:
        if isinstance(filesystem, pafs.LocalFileSystem):
            return np.asarray(np.memmap(f"{path}/{name}", kind, "r"))
        with filesystem.open_input_file(f"{path}/{name}") as file:
            return np.frombuffer(file.read(), kind)

    out = KneserNey.__new__(KneserNey)
    out.alphabet = 65536
    out.levels = [(k, *(array(f"{number}-{k}-{side}.{x}", t) for side in _SIDES for x, t in (("keys", np.uint64), ("values", np.float64)))) for k in range(ORDER, 0, -1)]
    return out


class Languages:
    """The stored models of all languages, and one table of the bits that each frequent 4-gram takes in each."""

    def __init__(self, names: list[str], at: str | None, frequent: np.ndarray) -> None:
        self.names, self.at, self._models = names, at, None
        self.known = frequent
        self.bits = np.stack([-np.log2(m.chance(frequent)) for m in self.models], 1).astype(np.float32) if names else np.zeros((0, 0), np.float32)
        self.own, self.spread = [], []

    @property
    def models(self) -> list[KneserNey]:
        if self._models is None:
            self._models = [stored_model(self.at, j) for j in range(len(self.names))]
        return self._models

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_models": None}  # a worker maps the files itself

    def measure(self, counted: DataFrame) -> None:
        """What a language's learning texts take, a character: mean and deviation of the bits over all grams."""
        sent = counted.sparkSession.sparkContext.broadcast(self)

        def run(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                number, g, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy().astype(float)
                for j in np.unique(number).tolist():
                    own = number == j
                    b = -np.log2(sent.value.models[j].chance(g[own]))
                    sums[j] = sums.get(j, 0) + np.array([n[own].sum(), (n[own] * b).sum(), (n[own] * b * b).sum()])
            rows = [(j, *map(float, x)) for j, x in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), *[pa.float64()] * 3))], ["number", "n", "b", "bb"])

        parts = counted.select("number", "gram", "n").mapInArrow(lean(run), "number int, n double, b double, bb double")
        for r in parts.groupBy("number").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("bb").alias("bb")).orderBy("number").collect():
            mean = r["b"] / r["n"]
            # the order of the sums isn't fixed: rounded
            self.own.append(round(mean, 9))
            self.spread.append(round(max(0.0, r["bb"] / r["n"] - mean * mean) ** 0.5, 6))

    def cost(self, g: np.ndarray) -> np.ndarray:
        """Bits of all grams together, by language."""
        at = np.minimum(np.searchsorted(self.known, g), max(0, len(self.known) - 1))
        hit = self.known[at] == g if len(self.known) else np.zeros(len(g), bool)
        out = np.array([float(x) for x in self.bits[at[hit]].sum(0, dtype=np.float64)])
        if not hit.all():
            u, n = np.unique(g[~hit], return_counts=True)
            # in single precision, as the table is
            out += np.array([float((-np.log2(m.chance(u)).astype(np.float32) * n.astype(np.float64)).sum()) for m in self.models])
        return out

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, confidence, and whether the text is unlike all that was learned."""
        total, n, letters = np.zeros(len(self.names)), 0, False
        for g in grams(text):
            letters = letters or bool(((g & np.uint64(0xFFFF)) != 32).any())
            if self.names:
                total, n = total + self.cost(g), n + len(g)
        if not letters or not self.names:
            return "und", 0.0, True
        each = total / n
        best = int(np.argmin(each))
        others = np.delete(each, best) - each[best]
        score = float(1 / (1 + np.exp2(-np.minimum(others * min(n, CONFIDENT), 1000)).sum()))
        z = (each[best] - self.own[best]) / (np.hypot(self.spread[best] / np.sqrt(n), 0.05 * self.own[best]) or 1)
        return self.names[best], score, bool(z > REJECT_Z)


def learn(docs: DataFrame) -> Languages:
    """Models of all languages of ``docs``."""
    counted = saved(gram_counts(docs), "language-grams")
    names = [r["lang"] for r in counted.select("lang").distinct().orderBy("lang").collect()]
    if not names:
        return Languages([], None, np.zeros(0, np.uint64))
    numbers = docs.sparkSession.createDataFrame(list(enumerate(names)), "number int, lang string")
    numbered = counted.join(F.broadcast(numbers), "lang").select("number", "gram", "n")
    # grams over a count that so few of a language have: about as many as may be sent, from however many partitions
    most = max(1, min(GRAMS, BITS // len(names) ** 2))
    cuts = numbered.groupBy("number").agg(F.count(F.lit(1)).alias("kinds"), F.percentile_approx("n", [q / 1000 for q in range(1001)], 10_000).alias("quantiles"))
    least = F.when(F.col("kinds") <= most, F.lit(0)).otherwise(F.element_at("quantiles", F.ceil(1000 * (1 - F.lit(most) / F.col("kinds"))).cast("int") + 1))
    common = numbered.join(F.broadcast(cuts.select("number", least.alias("least"))), "number").filter("n > least").select("gram").distinct()
    frequent = np.sort(common.toPandas()["gram"].to_numpy(dtype=np.int64).view(np.uint64))
    out = Languages(names, stored(numbered), frequent)
    out.measure(numbered)
    return out


def languages(docs: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document."""
    spark = docs.sparkSession
    learning = docs.filter(~fold_is(F.col("doc_id"), folds, fold) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sent = spark.sparkContext.broadcast(learn(learning))

    def run(batches):
        for batch in batches:
            found = [sent.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_())))], ["doc_id", "lang_pred", "score", "rejected"])

    found = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "lang_pred", "score", "rejected")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))
