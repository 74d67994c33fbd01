"""From measurements and weather to weather-corrected results: one plan, all series at once."""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import effects, model
from ..operators.aggregates import fit_metrics
from ..operators.joins import key_join, with_weather
from ..operators.yoy import yoy_attribution
from ..sources.store import Store, written
from .prep import prep_data

#: Fits of a series that one task predicts.
FITS_A_TASK = 16
SERIES = ["location_id", "poll", "unit", "source", "process_id", "country"]


def presets(args: Mapping[str, object], preset: Mapping[str, object] | None = None, override: Mapping[str, object] | None = None) -> dict[str, object]:
    """A process's preset replaces arguments; overrides replace both."""
    return {**args, **(preset or {}), **(override or {})}


def deweather_configs(meas: DataFrame, weather: DataFrame, configs: Sequence[model.Config], key: Sequence[str] = tuple(SERIES), since: str | None = "2020-01-01") -> dict[str, DataFrame]:
    """``result`` (series, config_id, date, variable, value), ``models`` (a row for each fit, with its status),
    ``performance``, ``importance`` and ``rows``, of all configurations in one plan. The rows are prepared
    once, with the largest lag, and persisted: ``rows.unpersist()`` when the results are written."""
    key, by = list(key), [*key, "config_id"]
    wanted = list(dict.fromkeys(v for c in configs for v in c.weather_vars))
    data = prep_data(with_weather(meas, weather), key, wanted, max(c.lag for c in configs), since)
    rows, models = model.fit_configs(data, key, configs)
    fits = sum(c.ntrainings for c in configs)
    predicted = model.predict(rows, models, key, lanes=max(1, -(-fits // FITS_A_TASK)))
    wide = effects.anomaly(predicted, by)
    if trends := [c.config_id for c in configs if c.output == "trend"]:
        of = F.col("config_id").isin(trends)
        wide = key_join(wide, effects.trend(models.filter(of), rows, key, ["config_id"]), [*by, "date"], "full")
    if columns := [x for g in model.fire_groups([x for c in configs for x in c.columns]).values() for x in g]:
        fires = F.col("config_id").isin([c.config_id for c in configs if c.add_fire])
        wide = key_join(wide, effects.no_fire(rows, models.filter(fires), key, list(dict.fromkeys(columns)), ["config_id"]), [*by, "date"], "left")
    return {"result": effects.long_result(wide, by), "models": models, "performance": fit_metrics(predicted, [*by, "replicate"]), "importance": effects.importance(models, key), "rows": rows}


def deweather(meas: DataFrame, weather: DataFrame, weather_vars: Sequence[str], output: str | Sequence[str] = "anomaly", key: Sequence[str] = tuple(SERIES), since: str | None = "2020-01-01", time_vars: Sequence[str] | None = None, preset: Mapping[str, object] | None = None, override: Mapping[str, object] | None = None, **options) -> dict[str, DataFrame]:
    """:func:`deweather_configs` of one output or several; ``options`` are those of :class:`model.Config`, a list of values
    gives a configuration for each, and training dates may be given for each output ({"trend": ...}). A process's
    ``preset`` replaces these arguments, ``override`` replaces both. Fire variables count if they are among
    ``weather_vars``."""
    args = presets({"weather_vars": weather_vars, "output": output, "time_vars": time_vars, **options}, preset, override)
    weather_vars, output, time_vars = (args.pop(k) for k in ("weather_vars", "output", "time_vars"))
    outputs = {o: {} for o in ([output] if isinstance(output, str) else output)}
    for name in ("training_start", "training_end", "excluded"):
        if name in args:
            value = args.pop(name)
            for o, own in outputs.items():
                if not isinstance(value, Mapping) or o in value:
                    own[name] = value[o] if isinstance(value, Mapping) else value
    if time_vars is not None:
        for own in outputs.values():
            own["time_vars"] = time_vars
    fire = any(v.startswith(model.FIRE_PREFIXES) for v in weather_vars)
    configs = model.config_grid(outputs, weather_vars, **{"add_fire": fire, **args})
    return deweather_configs(meas, weather, configs, key, since)


def deweather_yoy(meas: DataFrame, weather: DataFrame, weather_vars: Sequence[str], months: Sequence[str], key: Sequence[str] = tuple(SERIES), since: str | None = "2020-01-01", keep_originals: bool = False, sink: Store | None = None, constants: Mapping[str, str] | None = None, **options) -> DataFrame:
    """(series, date, variable, value) of each month's year-over-year parts; the days of the month and of
    the year before are kept out of the training. Months are configurations of one plan.

    With ``keep_originals`` the results that they are made from stay as well, in a column ``month`` for each month. With
    a ``sink``, the rows (with ``constants``, such as the process) are also upserted there.
    """
    fire = any(v.startswith(model.FIRE_PREFIXES) for v in weather_vars)
    configs = []
    for k, month in enumerate(months):
        (one,) = model.config_grid({"anomaly": {"excluded": compared_days(month)}}, weather_vars, **{"add_fire": fire, **options})
        configs.append(replace(one, config_id=k))
    whole = deweather_configs(meas, weather, configs, key, since)["result"]
    out = yoy_of_months(whole, key, months, keep_originals)
    if sink is not None:
        out = written(out, "yoy")
        sink.put_results(out, **(constants or {}))
    return out


def yoy_of_months(results: DataFrame, key: Sequence[str], months: Sequence[str], keep_originals: bool = False) -> DataFrame:
    """The year-over-year parts of each month from the results of its own configuration (config_id is the month's place)."""
    out = None
    for k, month in enumerate(months):
        own = results.filter(F.col("config_id") == k).drop("config_id")
        part = yoy_attribution(own, key, month)
        if keep_originals:
            part = own.unionByName(part).withColumn("month", F.lit(month).cast("date"))
        out = part if out is None else out.unionByName(part)
    return out


def compared_days(month: str) -> list[str]:
    """All days of the month of a date and of the same month a year earlier."""
    year, number = map(int, month.split("-")[:2])
    return [dt.date(y, number, d).isoformat() for y in (year, year - 1) for d in range(1, calendar.monthrange(y, number)[1] + 1)]
