"""Configurations, splits as bitmaps, and the fan-out of fits: a task fits a block of series, folds side by side."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Mapping, Sequence
from dataclasses import astuple, dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.columns import finite
from .boost import Booster, fit_all, keep_memory

ENGINES = ("gbm", "mllib")
# Prefixes of fire variables, the longest first.
FIRE_PREFIXES = ("pm25_emission", "fire_count", "fire_frp")


def lag_names(columns: Sequence[str], lags: int) -> list[str]:
    return [*columns, *(f"{c}_lag{n}" for c in columns for n in range(1, lags + 1))]


def fire_groups(names: Sequence[str], prefixes: Sequence[str] = FIRE_PREFIXES) -> dict[str, list[str]]:
    """Fire variables by region suffix ("" is all regions), base variables before their lags."""
    out: dict[str, list[str]] = {}
    for name in names:
        base, _, lag = name.partition("_lag")
        prefix = next((p for p in sorted(prefixes, key=len, reverse=True) if base.startswith(p)), None)
        if prefix is not None and (not lag or lag.isdigit()):
            out.setdefault(base[len(prefix) :], []).append(name)
    return {k: sorted(v, key=lambda n: ("_lag" in n, names.index(n))) for k, v in out.items()}


@dataclass(frozen=True)
class Config:
    """One configuration of a fit: a row of a grid."""

    config_id: int = 0
    output: str = "anomaly"
    trees: int = 10_000
    lag: int = 1
    training_fraction: float = 0.9
    add_fire: bool = False
    engine: str = "gbm"
    link: str = "linear"
    learning_rate: float = 0.01
    interaction_depth: int = 2
    cv_folds: int = 3
    ntrainings: int = 1
    time_vars: tuple[str, ...] = ()
    weather_vars: tuple[str, ...] = ()
    training_start: str | None = None
    training_end: str | None = None
    excluded: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.engine not in ENGINES:
            raise ValueError(f"unknown engine {self.engine!r}")

    @property
    def columns(self) -> list[str]:
        """The variables that the model may use."""
        weather = [v for v in self.weather_vars if self.add_fire or not v.startswith(FIRE_PREFIXES)]
        return [*self.time_vars, *lag_names(weather, self.lag)]


def config_grid(outputs: Mapping[str, Mapping[str, object]], weather_vars: Sequence[str] = (), **options: object) -> list[Config]:
    """A configuration for every combination: each output ("anomaly", "trend") with its own training dates and time
    variables, crossed with the options of :class:`Config` (a value or a list of values)."""
    names = [f.name for f in fields(Config) if f.name in options]
    if unknown := set(options) - set(names):
        raise TypeError(f"unknown options: {', '.join(sorted(unknown))}")
    values = [v if isinstance(v := options[n], list) else [v] for n in names]
    out = []
    for output, own in outputs.items():
        time_vars = own.get("time_vars", ["date_unix", "yday", "wday"] if output == "trend" else [])
        for combination in itertools.product(*values):
            row = dict(zip(names, combination, strict=True))
            out.append(Config(len(out), output, time_vars=tuple(time_vars), weather_vars=tuple(weather_vars), training_start=own.get("training_start"), training_end=own.get("training_end"), excluded=tuple(own.get("excluded", ())), **row))
    return out


def config_table(spark: SparkSession, configs: Sequence[Config]) -> DataFrame:
    """The configurations as a table."""
    types = "config_id int, output string, trees int, lag int, training_fraction double, add_fire boolean, engine string, link string, learning_rate double, interaction_depth int, cv_folds int, ntrainings int, time_vars array<string>, weather_vars array<string>, training_start string, training_end string, excluded array<string>"
    return spark.createDataFrame([tuple(list(v) if isinstance(v, tuple) else v for v in astuple(c)) for c in configs], types)


def _before(end: Column) -> Column:
    return F.col("date") <= F.coalesce(end, F.lit("2099-01-01").cast("date"))


def _candidate(end: Column, start: Column, excluded: Column) -> Column:
    return _before(end) & ~F.coalesce(F.array_contains(excluded, F.col("date")), F.lit(False)) & F.coalesce(F.col("date") >= start, F.lit(True))


def _order(identity: Sequence[str], seed: int, replicate: int) -> Column:
    """The hash that orders the rows of a series; ``identity`` names the series in it."""
    return F.md5(F.concat_ws("~", *(F.col(k).cast("string") for k in identity), F.col("date").cast("string"), F.lit(str(seed)), F.lit(str(replicate))))


def _dates(*values: str | None) -> list[Column]:
    return [F.lit(d).cast("date") for d in values]


def split_sets(df: DataFrame, key: Sequence[str], fraction: float = 0.9, training_end: str | None = None, training_start: str | None = None, excluded: Sequence[str] = (), seed: int = 42, replicate: int = 0) -> DataFrame:
    """Adds ``set``: after ``training_end`` is prediction; of the rows up to it, ``fraction`` of their number
    (1 at least) of those that are neither excluded nor before ``training_start`` are training, in the
    order of a hash; the rest is testing. A fraction of 1 takes all rows before the cut for training."""
    own = Split(training_end, training_start, tuple(excluded), fraction, replicate)
    return with_set(with_splits(df, key, [own], seed), 0)


@dataclass(frozen=True)
class Split:
    """What decides which rows of a series a fit learns from; fits that differ in other options share it."""

    end: str | None
    start: str | None
    excluded: tuple[str, ...]
    fraction: float
    replicate: int


#: Bits of a number in the two columns that say what each split makes of a row.
WORD = 62
TRAINS, AFTER = "_trains", "_after"


def with_splits(df: DataFrame, key: Sequence[str], splits: Sequence[Split], seed: int = 42) -> DataFrame:
    """Adds two bitmaps to each row, of the splits that train on it and of those that come before it. However many splits
    there are, a row stays one row; the splits of a replicate share one sort of their series."""
    excluded = lambda s: F.array(*_dates(*s.excluded)) if s.excluded else F.array().cast("array<date>")
    whole, trains = Window.partitionBy(*key), {}
    for replicate in sorted({s.replicate for s in splits}):
        # of the candidates in the order of the hash, the first n
        w = whole.orderBy(_order(key, seed, replicate), "date").rowsBetween(Window.unboundedPreceding, 0)
        for i, s in enumerate(splits):
            if s.replicate == replicate:
                ok = _candidate(*_dates(s.end, s.start), excluded(s))
                n = F.greatest(F.lit(1), F.floor(F.lit(s.fraction) * F.sum(_before(*_dates(s.end)).cast("int")).over(whole)))
                trains[i] = ok & (F.sum(ok.cast("int")).over(w) <= n)
    after = {i: ~_before(*_dates(s.end)) for i, s in enumerate(splits)}

    def bitmap(flags: Mapping[int, Column]) -> Column:
        words = []
        for first in range(0, len(splits), WORD):
            bits = [F.when(F.coalesce(flags[i], F.lit(False)), F.lit(1 << (i - first))).otherwise(F.lit(0)).cast("long") for i in range(first, min(first + WORD, len(splits)))]
            words.append(functools.reduce(lambda x, y: x.bitwiseOR(y), bits))
        return F.array(*words)

    return df.withColumns({TRAINS: bitmap(trains), AFTER: bitmap(after)})


def _bit(column: str, split: Column | int) -> Column:
    split = F.lit(split) if isinstance(split, int) else split
    word = F.get(F.col(column), F.floor(split / WORD).cast("int"))
    return F.call_function("shiftright", word, F.pmod(split, F.lit(WORD))).bitwiseAND(F.lit(1)) == 1


def with_set(rows: DataFrame, split: Column | int) -> DataFrame:
    """The bitmaps opened for one split: ``set`` in their place."""
    which = F.when(_bit(AFTER, split), "prediction").when(_bit(TRAINS, split), "training").otherwise("testing")
    return rows.withColumn("set", which).drop(TRAINS, AFTER)


def untrainable(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Series of which no row is for training."""
    return df.groupBy(*key).agg(F.count(F.when(F.col("set") == "training", 1)).alias("n")).filter("n = 0").select(*key)


def predictors(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The variables of each series that have a value in its training rows."""
    seen = [F.when(F.count(F.when(F.col("set") == "training", F.col(c))) > 0, F.lit(c)) for c in columns]
    return df.groupBy(*key).agg(F.filter(F.array(*seen), lambda x: x.isNotNull()).alias("predictors"))


def _numbers(pdf: pd.DataFrame, columns: Sequence[str]) -> np.ndarray:
    return pdf[list(columns)].to_numpy(dtype=np.float64, na_value=np.nan)


def _schema(df: DataFrame, key: Sequence[str], more: str) -> T.StructType:
    return T.StructType([df.schema[k] for k in key] + T._parse_datatype_string(more).fields)


def fit(df: DataFrame, key: Sequence[str], columns: Sequence[str], trees: int = 200, rate: float = 0.1, splits: int = 2, cv_folds: int = 3, link_name: str = "linear", replicates: int = 1, fraction: float = 0.9, training_end: str | None = None, training_start: str | None = None, excluded: Sequence[str] = (), seed: int = 42, config_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """:func:`fit_configs` with one configuration."""
    one = Config(config_id, trees=trees, lag=0, training_fraction=fraction, link=link_name, learning_rate=rate, interaction_depth=splits, cv_folds=cv_folds, ntrainings=replicates, time_vars=tuple(columns), training_start=training_start, training_end=training_end, excluded=tuple(excluded))
    return fit_configs(df, key, [one], seed)


def fit_configs(df: DataFrame, key: Sequence[str], configs: Sequence[Config], seed: int = 42, patience: int | None = 1_000, clustered: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows, with bitmaps of the splits that train on them (:func:`with_splits`), and the models: a row a (series,
    config_id, replicate) with the number of its split, n_trees_opt, n_training, status ("ok" or "failed"),
    message, link, the model (:class:`Booster`) and ``errors``, the mean squared error by number of trees.

    All configurations are one plan: a row is prepared, persisted and shuffled once, whatever the grid. Series
    are dealt in blocks of ``BLOCK_ROWS`` rows at most, about, and a block's task grows the trees of all its fits, folds
    included, side by side from one copy of the rows; where there are few series, the fits are dealt out as well
    (``lanes``). The number of trees is where the mean error over the folds is least; a fit stops looking when its
    curve has turned: the least is ``patience`` trees back, and as many as came before it (None: never). Without
    folds the out-of-bag estimate decides. A fit that fails, or has nothing to learn from, is a row with its
    message; it touches no other.

    ``clustered`` says that each partition of ``df`` has whole series, as tables in buckets of (some of) the key's columns
    do (``sources.tables.write_bucketed``): then blocks are made where the rows lie, and nothing is shuffled.

    Both tables are persisted: call ``unpersist()`` on them when all results are written.
    """
    key, by_id = list(key), {c.config_id: c for c in configs}
    if len(by_id) < len(configs):
        raise ValueError("two configurations have one config_id")
    if any(c.engine != "gbm" for c in configs):
        raise ValueError("engine mllib fits all series together: see fit_pooled")
    columns = list(dict.fromkeys(x for c in configs for x in c.columns))
    if missing := [x for x in columns if x not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    splits: dict[Split, int] = {}
    fits = [(c, r, splits.setdefault(Split(c.training_end, c.training_start, c.excluded, c.training_fraction, r), len(splits))) for c in configs for r in range(c.ntrainings)]
    # fits and predictions read the prepared rows: a lost part is made again from its inputs
    rows = with_splits(df, key, list(splits), seed).persist(StorageLevel.MEMORY_AND_DISK)
    size = rows.select(F.struct(*key).alias("k")).agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(F.to_json("k")).alias("series")).first()
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-size["rows"] // BLOCK_ROWS), min(size["series"], tasks))
    lanes = min(len(fits), max(1, -(-tasks // max(1, min(blocks, size["series"])))))
    schema = _schema(df, key, "config_id int, replicate int, split int, n_trees_opt int, n_training int, status string, message string, link string, model binary, errors array<double>")

    def fit_block(names: tuple, table: pa.Table) -> pa.Table:
        keep_memory()
        lane = [f for k, f in enumerate(fits) if k % lanes == names[1].as_py()]
        series, first = _series(table)
        frame, dates = table.select([*dict.fromkeys(["value", *columns])]).to_pandas(), _dates_of(table)
        bits = _words(table, TRAINS)
        out: dict[str, list] = {f.name: [] for f in schema.fields[len(key) :]}
        of, todo = [], {}
        for n, own in enumerate(series):
            part = frame.iloc[own]
            order = np.argsort(dates[own], kind="stable")
            part, trains = part.iloc[order], bits[own[order]]
            for c, r, split in lane:
                of.append(n)
                here, message, ready = len(of) - 1, None, None
                try:
                    y = _response(part["value"].to_numpy(np.float64, na_value=np.nan), c.link)
                    learns = (trains[:, split // WORD] >> (split % WORD) & 1).astype(bool) & ~np.isnan(y)
                    x = _numbers(part[learns], c.columns)
                    message = "no training rows" if not learns.any() else "no predictor has a value in the training rows" if np.isnan(x).all() else None
                    ready = (x, y[learns])
                except Exception as e:  # a bad series is a row of the result, never the end of the job
                    message = f"{type(e).__name__}: {e}"[:500]
                for name, v in (("config_id", c.config_id), ("replicate", r), ("split", split), ("n_trees_opt", 0), ("n_training", 0 if ready is None else len(ready[1])), ("status", "failed"), ("message", message), ("link", c.link), ("model", None), ("errors", None)):
                    out[name].append(v)
                if message is None:
                    text = "~".join([*(str(v[first[n]].as_py()) for v in (table[k] for k in key)), str(c.config_id), str(r)])
                    todo.setdefault(c.config_id, []).append((here, *ready, (seed * 1_000_003 + hash_text(text)) % 2**32))
        for config_id, members in todo.items():
            c = by_id[config_id]
            for part in _portions(members, c.cv_folds):
                for here, found in _fitted(part, c, patience):
                    for name, v in found.items():
                        out[name][here] = v
        picked = pa.array(first[np.array(of, np.int64)]) if of else pa.array([], pa.int64())
        done = [table[k].take(picked) for k in key] + [pa.array(out[f.name], to_arrow_type(f.dataType)) for f in schema.fields[len(key) :]]
        return pa.table(done, names=schema.names)

    def fit_partition(batches):
        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ROWS:  # the last series may go on
                table = pa.Table.from_batches(waiting)
                more = pc.equal(table[SERIES_ID], table[SERIES_ID][n - 1])
                yield from fit_block((0, pa.scalar(0)), table.filter(pc.invert(more))).to_batches()
                waiting = table.filter(more).to_batches()
                n = sum(b.num_rows for b in waiting)
        if waiting:
            yield from fit_block((0, pa.scalar(0)), pa.Table.from_batches(waiting)).to_batches()

    if clustered:
        lanes = 1
        sent = rows.select(*dict.fromkeys([*key, "date", "value", *columns]), TRAINS, F.to_json(F.struct(*key)).alias(SERIES_ID)).sortWithinPartitions(SERIES_ID)
        return rows, sent.mapInArrow(fit_partition, schema).persist(StorageLevel.MEMORY_AND_DISK)
    block = F.pmod(F.xxhash64(F.to_json(F.struct(*key))), F.lit(blocks))
    sent = rows.select(*dict.fromkeys([*key, "date", "value", *columns]), TRAINS, F.to_json(F.struct(*key)).alias(SERIES_ID), block.alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("_lane"))
    models = sent.groupBy("_block", "_lane").applyInArrow(fit_block, schema)
    return rows, models.persist(StorageLevel.MEMORY_AND_DISK)


#: Rows of a block of series, about, and rows that are fitted side by side (those of each fold count).
BLOCK_ROWS, TOGETHER = 20_000, 60_000
SERIES_ID = "_series"


def _series(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """The rows of each series of a block, and the first of them; series come in the order of their names."""
    coded = table[SERIES_ID].combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.chunk(0)
    names = coded.dictionary.to_pylist()
    number = np.argsort(np.argsort(names, kind="stable"), kind="stable")[coded.indices.to_numpy()] if names else np.zeros(0, np.int64)
    order = np.argsort(number, kind="stable")
    parts = np.split(order, np.cumsum(np.bincount(number, minlength=len(names)))[:-1]) if names else []
    return parts, np.array([p[0] for p in parts], np.int64)


def _words(table: pa.Table, column: str) -> np.ndarray:
    """Bitmaps by (row, word)."""
    lists = table[column].combine_chunks()
    parts = lists.chunks if isinstance(lists, pa.ChunkedArray) else [lists]
    words = np.concatenate([p.flatten().to_numpy(zero_copy_only=False) for p in parts] or [np.zeros(0, np.int64)])
    return words.reshape(table.num_rows, -1) if len(words) else np.zeros((table.num_rows, 1), np.int64)


def _dates_of(table: pa.Table) -> np.ndarray:
    """The dates, for sorting; NULLs come last."""
    return table["date"].cast(pa.timestamp("us")).to_numpy()


def _response(value: np.ndarray, link_name: str) -> np.ndarray:
    """Finite responses under their link; others are NaN."""
    link_name in ("linear", "log") or _unknown_link(link_name)
    with np.errstate(divide="ignore", invalid="ignore"):
        y = np.log(np.where(value > 0, value, np.nan)) if link_name == "log" else value
    return np.where(np.isfinite(y), y, np.nan)


def _unknown_link(name: str) -> None:
    raise ValueError(f"unknown link {name!r}")


def _portions(members: list[tuple], folds: int):
    """Fits in their order, so many at once that their rows are about ``TOGETHER``."""
    part, rows = [], 0
    for m in members:
        part.append(m)
        rows += len(m[2]) * max(1, folds)
        if rows >= TOGETHER:
            yield part
            part, rows = [], 0
    if part:
        yield part


def _fitted(members: list[tuple], c: Config, patience: int | None):
    """(place, columns of the models' table) of each member; should fitting them together fail, each is tried alone."""
    try:
        models, errors = fit_all([m[1:] for m in members], c.columns, c.learning_rate, c.interaction_depth, c.trees, c.cv_folds, patience=patience)
    except Exception as e:
        if len(members) > 1:
            for m in members:
                yield from _fitted([m], c, patience)
        else:
            yield members[0][0], {"message": f"{type(e).__name__}: {e}"[:500]}
        return
    for (here, *_), m, curve in zip(members, models, errors, strict=True):
        yield here, {"n_trees_opt": m.trees, "status": "ok", "model": m.dumps(), "errors": curve.tolist()}


def hash_text(text: str) -> int:
    """A seed from a text: the same in every process."""
    import zlib

    return zlib.crc32(text.encode())


def predict(rows: DataFrame, models: DataFrame, key: Sequence[str], name: str = "predicted", lanes: int = 1) -> DataFrame:
    """Each row of a series once for each of its fits, with config_id, replicate, the row's set in that fit, and the
    prediction, its link undone (NULL where the fit failed). Rows and models meet in blocks of series; with
    ``lanes``, the fits of a series are dealt out to so many tasks."""
    key = list(key)
    own_columns = [c for c in rows.columns if c not in (TRAINS, AFTER)]
    schema = T.StructType([*(rows.schema[c] for c in own_columns), *T._parse_datatype_string(f"config_id int, replicate int, set string, {name} double").fields])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        numeric = _frame(left)
        (series, _), (models_of, _) = _series(left), _series(right)
        names = {left[SERIES_ID][int(s[0])].as_py(): s for s in series}
        trains, after = _words(left, TRAINS), _words(left, AFTER)
        has = {c: right[c].to_pylist() for c in ("config_id", "replicate", "split", "status", "link", "model")}
        places, of, sets, out = [], [], [], []
        for fits in models_of:
            at = names.get(right[SERIES_ID][int(fits[0])].as_py(), np.zeros(0, np.int64))
            own = numeric.iloc[at] if len(at) else numeric[:0]
            for k in fits.tolist():
                y = np.full(len(at), np.nan)
                if has["status"][k] == "ok":
                    b = Booster.loads(has["model"][k])
                    y = unlinked(b.predict(_numbers(own, b.names)), has["link"][k])
                word, bit = divmod(has["split"][k], WORD)
                places.append(at)
                of.append(np.full(len(at), k))
                sets.append(np.where(after[at, word] >> bit & 1, 0, np.where(trains[at, word] >> bit & 1, 1, 2)))
                out.append(y)
        if not places:
            return pa.table([pa.array([], to_arrow_type(f.dataType)) for f in schema.fields], names=schema.names)
        # the rows of all fits are taken at once
        of = pa.array(np.concatenate(of))
        which = pa.DictionaryArray.from_arrays(pa.array(np.concatenate(sets).astype(np.int32)), pa.array(["prediction", "training", "testing"])).cast(pa.string())
        found = [*left.select(own_columns).take(pa.array(np.concatenate(places))).columns, *(right[c].take(of) for c in ("config_id", "replicate")), which, pa.array(np.concatenate(out))]
        return pa.table(found, names=schema.names)

    found = met_by_series(rows, models.drop("errors"), key, run, schema, lanes)
    return found.withColumn(name, finite(F.col(name)))


def met_by_series(rows: DataFrame, models: DataFrame, key: Sequence[str], run, schema: T.StructType, lanes: int = 1) -> DataFrame:
    """``run(rows, models)`` on the Arrow tables of a block of series and of their models."""
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    named = F.to_json(F.struct(*key))
    placed = lambda df: df.withColumn(SERIES_ID, named).withColumn("_block", F.pmod(F.xxhash64(SERIES_ID), F.lit(blocks)))
    left = placed(rows).withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))) if lanes > 1 else placed(rows).withColumn("_lane", F.lit(0))
    right = placed(models).withColumn("_lane", F.pmod(F.xxhash64("config_id", "replicate"), F.lit(lanes)).cast("int"))
    return left.groupBy("_block", "_lane").cogroup(right.groupBy("_block", "_lane")).applyInArrow(run, schema)


def _frame(table: pa.Table) -> pd.DataFrame:
    """The columns that a model may use, as numbers."""
    kinds = (pa.types.is_integer, pa.types.is_floating, pa.types.is_decimal, pa.types.is_boolean)
    own = [f.name for f in table.schema if any(k(f.type) for k in kinds)]
    return pd.DataFrame({c: table[c].cast(pa.float64(), safe=False).to_numpy() for c in own})


def unlinked(y: np.ndarray, link_name: str) -> np.ndarray:
    """Predictions in the units of the response."""
    return np.exp(y) if link_name == "log" else y


def fit_pooled(df: DataFrame, key: Sequence[str], columns: Sequence[str], trees: int = 20, depth: int = 3, rate: float = 0.1) -> DataFrame:
    """Engine "mllib": one gradient-boosted model over all series, for a set too large for tasks of
    single series; NULLs are imputed by medians, the series is a variable."""
    from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    named = df.withColumn("_series", F.concat_ws("~", *(F.col(k).cast("string") for k in key)))
    cast = named.withColumns({c: F.col(c).cast("double") for c in columns})
    fed = [f"_i_{c}" for c in columns]
    train = cast.filter((F.col("set") == "training") & F.col("value").isNotNull())
    imputer = Imputer(strategy="median", inputCols=list(columns), outputCols=fed).fit(train)
    indexer = StringIndexer(inputCol="_series", outputCol="_s", handleInvalid="keep").fit(train)
    assembler = VectorAssembler(inputCols=[*fed, "_s"], outputCol="_x", handleInvalid="keep")
    ready = lambda d: assembler.transform(indexer.transform(imputer.transform(d)))
    model = GBTRegressor(featuresCol="_x", labelCol="value", predictionCol="predicted", maxIter=trees, maxDepth=depth, stepSize=rate, seed=1).fit(ready(train))
    return model.transform(ready(cast)).select(*df.columns, "predicted")
