"""What fitted models tell: anomalies, trends, counterfactuals, influence."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.columns import finite, from_decimal_year
from .aggregates import replicate_summary
from .boost import Booster
from .joins import key_join
from .model import SERIES_ID, _dates_of, _frame, _numbers, _schema, _series, fire_groups, met_by_series, predict, unlinked


def anomaly(predictions: DataFrame, key: Sequence[str], beside: Sequence[str] = ()) -> DataFrame:
    """date, observed, predicted (mean over replicates, with quantiles) and their difference; columns ``beside`` them, which
    all replicates share, stay and need no join."""
    out = replicate_summary(predictions.withColumnRenamed("value", "observed"), [*key, "date", "observed"], beside=beside)
    return out.withColumn("anomaly", F.col("observed") - F.col("predicted"))


def partial_dependence(models: DataFrame, key: Sequence[str], ranges: DataFrame, variable: str = "date_unix", points: str = "points") -> DataFrame:
    """(series, config_id, replicate, x, y) at ``points`` places from ``low`` to ``high`` of each series, y in the units
    of the response; ``ranges`` has (series, low, high, points). Computed from the trees alone, no rows are scored."""
    group = [*key, "config_id", "replicate"]
    joined = key_join(models.filter("status = 'ok'"), ranges, key).select(*group, "model", "link", "low", "high", F.col(points).alias("points"))
    schema = _schema(joined, group, "x double, y double")

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                b = Booster.loads(row.model)
                if variable in b.names:
                    x = np.linspace(row.low, row.high, max(1, int(row.points)))
                    yield pd.DataFrame({**{g: [getattr(row, g)] * len(x) for g in group}, "x": x, "y": unlinked(b.partial_dependence(variable, x), row.link)})

    return joined.mapInPandas(run, schema)


def trend(models: DataFrame, rows: DataFrame, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(series, date, trend, trend_p025, trend_p975): partial dependence on the decimal year, a point a day; for each
    of ``by`` (config_id) as well, or over all fits of a series."""
    ranges = rows.groupBy(*key).agg(F.min("date_unix").alias("low"), F.max("date_unix").alias("high"), (F.datediff(F.max("date"), F.min("date")) + 1).alias("points"))
    pdp = partial_dependence(models, key, ranges)
    dated = pdp.withColumn("date", from_decimal_year(F.col("x"))).withColumnRenamed("y", "trend")
    return replicate_summary(dated, [*key, *by, "date"], "trend")


def no_fire(rows: DataFrame, models: DataFrame, key: Sequence[str], columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(series, date, predicted_nofire and predicted_nofire_{region} ...): predictions with the fire
    variables of a region, or all of them, at 0; means over replicates."""
    groups = fire_groups(list(columns))
    every = [c for v in groups.values() for c in v]
    scenarios = {"predicted_nofire": every} | {f"predicted_nofire{s}": v for s, v in groups.items() if s}
    copies = rows.withColumn("scenario", F.explode(F.array(*map(F.lit, scenarios))))
    zeroed = {}
    for c in every:
        affected = [s for s, v in scenarios.items() if c in v]
        zeroed[c] = F.when(F.col("scenario").isin(affected), F.lit(0.0)).otherwise(F.col(c))
    found = predict(copies.withColumns(zeroed) if zeroed else copies, models, key)
    return counterfactual_mean(found, [*key, *by], list(scenarios))


def counterfactual_mean(found: DataFrame, key: Sequence[str], scenarios: Sequence[str]) -> DataFrame:
    """A column for each scenario: the mean of its predictions over replicates, those that are NULL left out."""
    return found.groupBy(*key, "date").pivot("scenario", list(scenarios)).agg(F.avg("predicted"))


def normalised_trend(rows: DataFrame, models: DataFrame, key: Sequence[str], columns: Sequence[str], n: int = 5000, seed: int = 1) -> DataFrame:
    """(series, date, normalised): for each date, the mean prediction (its link undone first) over a sample of ``n`` of the series'
    weather rows (all, if there are fewer) with the date's own decimal year; the mean over fits.

    The sample goes through each tree once (:meth:`Booster.mean_over_rows`), not once for each date.
    """
    key, names = list(key), list(columns)
    schema = T.StructType([*(rows.schema[k] for k in key), rows.schema["date"], T.StructField("normalised", T.DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        numeric, done = _frame(left), []
        (series, _), (models_of, _) = _series(left), _series(right)
        by_name = {left[SERIES_ID][int(s[0])].as_py(): s for s in series}
        dates = _dates_of(left)
        for fits in models_of:
            at = by_name.get(right[SERIES_ID][int(fits[0])].as_py(), np.zeros(0, np.int64))
            at = at[np.argsort(dates[at], kind="stable")]
            sample = np.random.default_rng(seed).permutation(len(at))[:n]
            for k in fits.tolist():
                b, out = Booster.loads(right["model"][k].as_py()), np.full(len(at), np.nan)
                if "date_unix" in b.names and len(at):
                    x = _numbers(numeric.iloc[at], b.names)
                    undo = np.exp if right["link"][k].as_py() == "log" else None
                    out = b.mean_over_rows("date_unix", x[:, b.names.index("date_unix")], x[sample], undo)
                done.append(pa.table([*left.select([*key, "date"]).take(pa.array(at)).columns, pa.array(out)], names=schema.names))
        return pa.concat_tables(done) if done else pa.table([pa.array([], to_arrow_type(f.dataType)) for f in schema.fields], names=schema.names)

    wanted = rows.select(*dict.fromkeys([*key, "date", *names]))
    found = met_by_series(wanted, models.filter("status = 'ok'").drop("errors"), key, run, schema)
    return found.groupBy(*key, "date").agg(F.avg(finite(F.col("normalised"))).alias("normalised"))


#: Calendar variables whose values are 1 to so many.
CALENDAR = {"yday": 366, "month": 12, "wday": 7, "season_number": 4}


def _dates_of_years(x: np.ndarray) -> np.ndarray:
    """:func:`from_decimal_year` of an array."""
    years = np.floor(x)
    start = (years.astype(np.int64) - 1970).astype("datetime64[Y]")
    first = start.astype("datetime64[D]")
    days = ((start + 1).astype("datetime64[D]") - first).astype(np.int64)
    return first + np.floor((x - years) * days + 1e-6).astype(np.int64)


def _mean_curve(curves: Sequence[np.ndarray], at: np.ndarray, size: int) -> np.ndarray:
    """By place, the mean of the curves' values at it, those that are NaN left out."""
    y, at = np.concatenate(curves), np.tile(at, len(curves))
    there = ~np.isnan(y)
    n = np.bincount(at[there], minlength=size)
    return np.where(n > 0, np.bincount(at[there], y[there], size) / np.maximum(1, n), np.nan)


def composite_time_effect(models: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """(series, date, effect): mean of the partial dependences on decimal year, day of year, month, weekday
    and season (``season_number``), as far as the model has them, at the dates.

    The dates and the models of a series meet once, in its block: no curve is shuffled or joined to the dates.
    """
    key, names = list(key), [*CALENDAR, "trend"]
    schema = T.StructType([*(rows.schema[k] for k in [*key, "date", "date_unix"]), *(T.StructField(f"effect_{n}", T.DoubleType()) for n in names)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.group_by([SERIES_ID, *key, "date", "date_unix"], use_threads=False).aggregate([])  # each date once
        (series, _), (models_of, _) = _series(left), _series(right)
        fits = {right[SERIES_ID][int(f[0])].as_py(): f.tolist() for f in models_of}
        date, unix = left["date"].cast(pa.date32()), left["date_unix"].cast(pa.float64()).to_numpy()
        days, month = date.to_numpy().astype("datetime64[D]"), pc.month(date)
        places = {"yday": pc.day_of_year(date), "month": month, "wday": pc.day_of_week(date, count_from_zero=False, week_start=1)}
        places = {n: pc.fill_null(c, 0).to_numpy() for n, c in places.items()}
        places["season_number"] = np.where(places["month"] > 0, places["month"] % 12 // 3 + 1, 0)
        effect = {n: np.full(len(days), np.nan) for n in names}
        for own in series:
            boosters = [(Booster.loads(right["model"][k].as_py()), right["link"][k].as_py()) for k in fits.get(left[SERIES_ID][int(own[0])].as_py(), ())]
            curves = lambda name, x: [unlinked(b.partial_dependence(name, x), link) for b, link in boosters if name in b.names]  # noqa: B023, E731
            for name, last in CALENDAR.items():
                if found := curves(name, np.linspace(1, last, last)):
                    mean = _mean_curve(found, np.arange(1, last + 1), last + 1)  # 0 is no date
                    effect[name][own] = mean[places[name][own]]
            dated = own[~np.isnat(days[own]) & ~np.isnan(unix[own])]
            if len(dated):
                first, end = days[dated].min(), days[dated].max()
                x = np.linspace(unix[dated].min(), unix[dated].max(), (end - first).astype(int) + 1)
                if found := curves("date_unix", x):
                    at, place = np.unique(_dates_of_years(x), return_inverse=True)
                    mean, there = _mean_curve(found, place, len(at)), np.minimum(np.searchsorted(at, days[dated]), len(at) - 1)
                    effect["trend"][dated] = np.where(at[there] == days[dated], mean[there], np.nan)
        found = [pa.array(effect[n], from_pandas=True) for n in names]
        return pa.table([*left.select([*key, "date", "date_unix"]).columns, *found], names=schema.names)

    found = met_by_series(rows.select(*key, "date", "date_unix"), models.filter("status = 'ok'").select(*key, "config_id", "replicate", "link", "model"), key, run, schema)
    values = F.filter(F.array(*(F.col(f"effect_{n}") for n in names)), lambda x: x.isNotNull())
    return found.withColumn("effect", F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values)))


def importance(models: DataFrame, key: Sequence[str]) -> DataFrame:
    """(series, config_id, replicate, n_trees_opt, variable, influence)."""
    group = [*key, "config_id", "replicate", "n_trees_opt"]
    rows = models.filter("status = 'ok'").select(*group, "model")
    schema = _schema(rows, group, "variable string, influence double")

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                gain = Booster.loads(row.model).influence()
                yield pd.DataFrame({**{g: [getattr(row, g)] * len(gain) for g in group}, "variable": list(gain), "influence": list(gain.values())})

    return rows.mapInPandas(run, schema)


def legacy_residuals(predictions: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Predicted minus observed; columns that hold "fire" or "pm25_emission" are set to 0."""
    zero = {c: F.lit(0.0) for c in columns if "fire" in c or "pm25_emission" in c}
    return predictions.withColumn("residual", F.col("predicted") - F.col("value")).withColumns(zero)


def long_result(wide: DataFrame, key: Sequence[str], wanted: Sequence[str] = ("observed", "predicted", "anomaly", "trend", "predicted_nofire")) -> DataFrame:
    """(series, date, variable, value) of the output columns that there are."""
    return wide.unpivot([*key, "date"], [c for c in wide.columns if c in wanted or c.startswith("predicted_nofire")], "variable", "value")
