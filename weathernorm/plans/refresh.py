"""Preparation of what a few changed days touch, with the result that preparing everything would have.

A changed day reaches further than itself: values up to ``MAX_GAP`` missing rows away are interpolated with it,
the days after it have it as a lag, and it may move what holds for its whole series: the bound on outliers,
which columns are empty, whether the series is recent. So the series that changed are judged first, by
sums over their rows before and after. Where such a property moves in a way that matters, the series is
prepared anew; else only the rows that the change reaches are, from the rows around them. Only the buckets
of the series that changed are read and written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import time_features
from ..operators.cleaning import complete_cases, fill_series, null_not_finite
from ..operators.joins import key_join
from ..sources.store import Store, written
from .prep import enrich, prep_data

#: Rows that are interpolated over at most, as in :func:`fill_series`, and deviations that make an outlier.
MAX_GAP, TIMES = 5, 10.0


def series_properties(rows: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(series, _median, _mad, _last, _has_{column}): what of a series decides on each of its rows."""
    valued = rows.filter(F.col("value").isNotNull())
    centre = valued.groupBy(*key).agg(F.median("value").alias("_median"))
    off = key_join(valued, centre, key).withColumn("_off", F.col("value") - F.col("_median"))
    spread = off.groupBy(*key).agg(F.first("_median").alias("_median"), (1.4826 * F.median(F.abs("_off"))).alias("_mad"))
    kept = key_join(valued, spread, key).filter(_kept("") & F.col("date").isNotNull())
    return kept.groupBy(*key).agg(F.first("_median").alias("_median"), F.first("_mad").alias("_mad"), F.max("date").alias("_last"), *((F.count(c) > 0).alias(f"_has_{c}") for c in columns))


def _kept(prefix: str):
    mad = F.col(f"{prefix}_mad")
    return F.coalesce((mad == 0) | (F.col("value") - F.col(f"{prefix}_median") < TIMES * mad), F.lit(False))


def refresh(raw: Store, prepared: Store, changes: DataFrame, key: Sequence[str], weather_vars: Sequence[str], lag: int = 0, since: str | None = "2020-01-01") -> DataFrame:
    """Upserts changed rows (series, date, value, weather) into ``raw`` and what they reach into ``prepared``, which holds
    :func:`prep_data` of ``raw``; both are keyed by series and date. Gives the series that changed, with ``whole``:
    whether all of each was prepared."""
    key = list(key)
    touched = written(changes.select(*key).distinct(), "changed-series")
    before = null_not_finite(written(raw.rows_of(touched), "series-before"))
    raw.put(changes)
    rows = null_not_finite(written(raw.rows_of(touched), "series-after"))
    old = series_properties(before, key, weather_vars) if before.columns and set(weather_vars) <= set(before.columns) else None
    new = series_properties(rows, key, weather_vars)
    properties = [c for c in new.columns if c not in key]
    both = new.withColumn("_there", F.lit(False)) if old is None else key_join(new, old.withColumnsRenamed({c: f"_old{c}" for c in properties}).withColumn("_there", F.lit(True)), key, "left")
    if old is None:
        both = both.withColumns({f"_old{c}": F.lit(None).cast(new.schema[c].dataType) for c in properties})
    judged = key_join(rows, both, key, "left")
    # an outlier before and not now, or the other way round
    flips = judged.groupBy(*key).agg(F.max(F.col("value").isNotNull() & (_kept("") != _kept("_old"))).alias("_flips"))
    moved = ~F.coalesce(F.col("_there"), F.lit(False)) | F.coalesce(F.col("_flips"), F.lit(True))
    for c in weather_vars:
        moved = moved | ~F.col(f"_has_{c}").eqNullSafe(F.col(f"_old_has_{c}"))
    if since is not None:
        recent = lambda c: F.coalesce(F.col(c) >= F.lit(since).cast("date"), F.lit(False))
        moved = moved | (recent("_last") != recent("_old_last"))
    told = written(key_join(key_join(touched, both, key, "left"), flips, key, "left").withColumn("whole", F.coalesce(moved, F.lit(True))), "changed-properties")

    whole = told.filter("whole").select(*key)
    anew = prep_data(key_join(rows, whole, key, "left_semi"), key, weather_vars, lag, since)
    reached = _reached(rows, told.filter("not whole"), changes, key, weather_vars, lag, since)
    gone = whole.withColumn("date", F.lit(None).cast("date"))
    partly = reached.select(*key, "date").unionByName(key_join(changes.select(*key, "date"), whole, key, "left_anti"))
    stale = prepared.rows_of(touched).select(*key, "date")
    gone = key_join(stale, whole, key, "left_semi").unionByName(partly).distinct()
    fresh = reached.filter("_fresh").drop("_fresh")
    prepared.exchange(written(gone, "rows-gone"), written(anew.unionByName(fresh.select(*anew.columns)), "rows-fresh"))
    return told.select(*key, "whole")


def _reached(rows: DataFrame, told: DataFrame, changes: DataFrame, key: list[str], weather_vars: Sequence[str], lag: int, since: str | None) -> DataFrame:
    """The rows that the changed days reach, prepared; ``_fresh`` is whether a row belongs to the result."""
    marked = changes.select(*key, "date").distinct().withColumn("_changed", F.lit(True))
    own = key_join(key_join(rows, told.drop("whole", "_there", "_flips", *(c for c in told.columns if c.startswith("_old"))), key), marked, [*key, "date"], "left")
    own = own.filter(F.col("date").isNotNull()).withColumn("_changed", F.coalesce("_changed", F.lit(False))).withColumn("_keep", _kept("") & F.col("value").isNotNull())
    line = own.filter(F.col("_keep") | F.col("_changed"))
    order = Window.partitionBy(*key).orderBy("date")
    near = MAX_GAP + 2
    # numbers among the rows that stay; a row that does not shares that of the one before it
    line = line.withColumn("_place", F.sum(F.col("_keep").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    line = line.withColumn("_bent", F.max("_changed").over(order.rowsBetween(-near, near)))
    days = Window.partitionBy(*key).orderBy(F.unix_date("date"))
    line = line.withColumn("_reached", F.max("_bent").over(days.rangeBetween(-lag, 0)))
    around = line.withColumn("_around", F.max("_reached").over(order.rowsBetween(-near, near + lag))).filter(F.col("_around") & F.col("_keep"))
    filled = fill_series(around, key, weather_vars, max_gap=MAX_GAP, place="_place", has="_has_")
    out = enrich(filled, key, weather_vars, lag).filter("_reached")  # rows of the calendar alone are none
    helpers = ["_median", "_mad", *(f"_has_{c}" for c in weather_vars), "_changed", "_keep", "_place", "_bent", "_around"]
    fresh = F.lit(True) if since is None else F.coalesce(F.col("_last") >= F.lit(since).cast("date"), F.lit(False))
    for c in weather_vars:
        fresh = fresh & F.col(c).isNotNull()
    return time_features(out.withColumn("_fresh", fresh).drop("_reached", "_last", *helpers))
