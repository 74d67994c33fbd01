"""Joins of measurements, weather and lookups, and set operations on keys."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import season, weekday_number


def with_weather(meas: DataFrame, weather: DataFrame) -> DataFrame:
    """Series of locations that have weather, their days without any with NULLs."""
    known = meas.join(weather.select("location_id").distinct(), "location_id", "left_semi")
    return known.join(weather, ["location_id", "date"], "left")


def key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join in which NULL keys are equal, as they are where rows are grouped."""
    theirs = {k: f"_right_{k}" for k in keys}
    same = functools.reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(v)) for k, v in theirs.items()))
    joined = left.join(right.withColumnsRenamed(theirs), same, how)
    if how in ("full", "right"):  # where only one side has a row
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(v)) for k, v in theirs.items()})
    return joined.drop(*theirs.values())


def natural_left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left")


def coalesce_join(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """New values where the old table has none; columns that it lacks are added."""
    renamed = new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = old.join(renamed, list(keys), "left")
    out = {c: F.coalesce(F.col(c), F.col(f"_new_{c}")) if c in old.columns else F.col(f"_new_{c}") for c in columns}
    return joined.withColumns(out).drop(*(f"_new_{c}" for c in columns))


def trend_join(data: DataFrame, trend: DataFrame, keys: Sequence[str]) -> DataFrame:
    return data.join(trend, list(keys), "full")


def cross_grid(*tables: DataFrame) -> DataFrame:
    """All combinations of small tables (configurations, days of a year, pollutants), without repeats."""
    out = tables[0].distinct()
    for t in tables[1:]:
        out = out.join(t.distinct(), how="cross")
    return out


def not_processed(requested: DataFrame, processed: DataFrame, keys: Sequence[str], layers: str | None = None, least: int = 11, force: bool = False) -> DataFrame:
    """Requested keys that are not done yet, or (``layers`` counts them) not wholly; all if forced."""
    if force:
        return requested
    done = processed.filter(F.col(layers) >= least) if layers else processed
    return requested.join(done.select(*keys).distinct(), list(keys), "left_anti")


def years_to_read(stations: DataFrame, cached: DataFrame, stale_since: int) -> DataFrame:
    """(code, year) that stations cover and the cache lacks, or holds from a year that still changes."""
    years = stations.select("code", F.explode(F.sequence(F.year("begin"), F.year("end"))).alias("year"))
    return not_processed(years, cached.filter(F.col("year") < stale_since), ["code", "year"])


def in_dates(df: DataFrame, dates: DataFrame, keep: bool = True, date: str = "date") -> DataFrame:
    return df.join(dates.select(date).distinct(), date, "left_semi" if keep else "left_anti")


def completed(results: DataFrame, by: Sequence[str], polls: Sequence[str]) -> DataFrame:
    """Every place with every pollutant, NULLs where there is no result."""
    grid = results.select(*by).distinct().withColumn("poll", F.explode(F.array(*map(F.lit, polls))))
    return grid.join(results, [*by, "poll"], "left")


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A small table's columns by key (lookup lists of cities or countries)."""
    return df.join(table, list(keys), "left")


def time_effects(df: DataFrame, effects: Mapping[str, DataFrame], date: str = "date") -> DataFrame:
    """Joins the effect of each time variable (tables keyed by yday, month, wday or season, at most 366
    rows) and their mean over those that are not NULL."""
    d = F.col(date)
    keys = {"yday": F.dayofyear(d), "month": F.month(d), "wday": weekday_number(d), "season": season(d)}
    out = df
    for name, table in effects.items():
        t = table.select(F.col(name).alias(f"_k_{name}"), F.col("effect").alias(f"effect_{name}"))
        out = out.join(F.broadcast(t), keys[name] == F.col(f"_k_{name}"), "left").drop(f"_k_{name}")
    values = F.filter(F.array(*(F.col(f"effect_{n}") for n in effects)), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))
    return out.withColumn("effect", mean)


def union_distinct(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.dropDuplicates(list(keys))


def key_sets(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Keys in both tables, and keys in the left one only."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, list(keys), "left_semi"), a.join(b, list(keys), "left_anti")


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(columns), "variable", "value")


def to_wide(df: DataFrame, ids: Sequence[str], names: Sequence[str], variable: str = "variable") -> DataFrame:
    return df.groupBy(*ids).pivot(variable, list(names)).agg(F.first("value", ignorenulls=True))


def nest(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row a series with its rows as a sorted list, for callers that ask for it."""
    return df.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("data"))


def unnest(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.select(*key, F.inline("data"))
