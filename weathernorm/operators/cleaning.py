"""Filters and cleaning of series tables; all keyed by ``key``, the columns that name a series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import finite


def numeric_columns(df: DataFrame, but: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType) and f.name not in but]


def null_not_finite(df: DataFrame, but: Sequence[str] = ()) -> DataFrame:
    """NaN and infinities of all floating-point columns become NULL."""
    return df.withColumns({c: finite(F.col(c)) for c in numeric_columns(df, but)})


def drop_outliers(df: DataFrame, key: Sequence[str], value: str = "value", times: float = 10.0) -> DataFrame:
    """Keeps rows with value - median < times * 1.4826 * median(|value - median|) of their series; NULL
    values go. A series whose deviation is 0 keeps all its values."""
    w = Window.partitionBy(*key)
    centred = df.filter(F.col(value).isNotNull()).withColumn("_off", F.col(value) - F.median(value).over(w))
    mad = 1.4826 * F.median(F.abs("_off")).over(w)
    return centred.withColumn("_mad", mad).filter((F.col("_mad") == 0) | (F.col("_off") < times * F.col("_mad"))).drop("_off", "_mad")


def clean(df: DataFrame, key: Sequence[str], value: str = "value", date: str = "date") -> DataFrame:
    """Not-finite numbers to NULL, outliers and rows without a date out."""
    return drop_outliers(null_not_finite(df), key, value).filter(F.col(date).isNotNull())


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns)) if columns else df


def recent_series(df: DataFrame, key: Sequence[str], since: str = "2020-01-01", date: str = "date") -> DataFrame:
    """Series whose last date is not before ``since``; on the partitioning that other steps by ``key`` have."""
    last = F.max(date).over(Window.partitionBy(*key))
    return df.withColumn("_last", last).filter(F.col("_last") >= F.lit(since).cast("date")).drop("_last")


def any_predictor(df: DataFrame, predictors: Sequence[str], response: str = "value") -> DataFrame:
    """Rows with a response and at least one predictor."""
    return df.na.drop(how="all", subset=list(predictors)).filter(F.col(response).isNotNull())


def fit_rows(df: DataFrame, response: str = "value") -> DataFrame:
    """Training rows with a finite response."""
    return df.filter((F.col("set") == "training") & finite(F.col(response)).isNotNull())


def skipped_series(all_rows: DataFrame, kept: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of the series of which nothing was kept."""
    return all_rows.select(*key).distinct().join(kept.select(*key).distinct(), list(key), "left_anti")


def date_range(df: DataFrame, start: str = "date_from", end: str = "date_to", date: str = "date") -> DataFrame:
    """Rows within their own range of dates; a range that is no date drops the row."""
    return df.filter(F.col(date).between(F.try_to_date(F.col(start)), F.try_to_date(F.col(end))))


def available(df: DataFrame, as_of: str, days: int = 3, missing: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Dates that a source has by ``as_of``: before it by more than ``days``, and not known to be missing."""
    out = df.filter(F.col(date) < F.date_sub(F.lit(as_of).cast("date"), days))
    return out.filter(~F.col(date).isin([F.lit(m).cast("date") for m in missing])) if missing else out


def bad_weather(df: DataFrame, column: str = "air_temp_min") -> DataFrame:
    """Rows whose weather is missing."""
    return df.filter(finite(F.col(column)).isNull())


def impact_filter(df: DataFrame, polls: Sequence[str], least: int | None = None) -> DataFrame:
    out = df.filter(F.col("poll").isin(list(polls)))
    return out if least is None else out.filter(F.col("country_count") >= least)


def fill_series(df: DataFrame, key: Sequence[str], columns: Sequence[str], date: str = "date", max_gap: int = 5, place: str | None = None, has: str | None = None) -> DataFrame:
    """Fills weather columns of each series, all on one sort of the series by date and one back:

    a column without any value becomes 0; ``precip*`` and ``fire_*`` get 0 for NULL; temperatures,
    pressures, dewpoints, ceilings, boundary layers and sunshine are interpolated in date over runs of
    at most ``max_gap`` missing rows between two values. Wind and humidity are never filled.

    For a part of a series, ``place`` has each row's number in the whole one, and ``{has}{column}`` says whether the
    whole one has a value.
    """
    whole = Window.partitionBy(*key)
    ordered = whole.orderBy(date)
    # a frame that ends at the series' end is computed anew for each row; the reverse order is not
    before = ordered.rowsBetween(Window.unboundedPreceding, 0)
    after = whole.orderBy(F.desc("_rn")).rowsBetween(Window.unboundedPreceding, 0)
    zero = [c for c in columns if c.startswith(("precip", "fire_"))]
    bent = [c for c in columns if c.startswith(("sunshine", "atmos_pres", "air_temp", "ceil_hgt", "pbl_", "dewpoint_temp"))]
    out = df.withColumn("_rn", F.col(place) if place else F.row_number().over(ordered)).withColumn("_t", F.unix_date(date).cast("double"))
    seen = {f"_n_{c}": F.col(f"{has}{c}").cast("int") if has else F.count(c).over(whole) for c in columns}
    ends = {}
    for c in bent:
        here = F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("_t").alias("t"), F.col("_rn").alias("r")))
        ends |= {f"_p_{c}": F.last(here, True).over(before), f"_q_{c}": F.last(here, True).over(after)}
    out = out.withColumns(seen | ends)
    filled = {}
    for c in columns:
        v = F.col(c)
        if c in bent:
            p, q = F.col(f"_p_{c}"), F.col(f"_q_{c}")
            between = p["v"] + (q["v"] - p["v"]) * (F.col("_t") - p["t"]) / (q["t"] - p["t"])
            v = F.coalesce(v, F.when(q["r"] - p["r"] - 1 <= max_gap, between))
        elif c in zero:
            v = F.coalesce(v, F.lit(0.0))
        filled[c] = F.when(F.col(f"_n_{c}") == 0, F.lit(0.0)).otherwise(v)
    return out.withColumns(filled).drop("_rn", "_t", *seen, *ends)


def calendar(df: DataFrame, key: Sequence[str], date: str = "date", unit: str = "DAY") -> DataFrame:
    """Every day (or other unit) of each series from its first to its last date, missing ones as NULLs. Each row
    brings the missing days up to the next one: no join, on the partitioning and order that the series have.
    Dates of another unit than days must be the first days of theirs."""
    step = F.expr(f"INTERVAL 1 {unit}")
    dated = df.filter(F.col(date).isNotNull()).withColumn("_next", F.lead(date).over(Window.partitionBy(*key).orderBy(date)))
    upto = F.coalesce(F.greatest(F.col(date), (F.col("_next") - step).cast("date")), F.col(date))
    days = dated.withColumn("_day", F.explode(F.sequence(F.col(date), upto, step)))
    here = F.col("_day") == F.col(date)
    return days.select(*key, F.col("_day").alias(date), *(F.when(here, F.col(c)).alias(c) for c in df.columns if c not in (*key, date)))


def add_lags(df: DataFrame, key: Sequence[str], columns: Sequence[str], lags: int, date: str = "date") -> DataFrame:
    """``{column}_lag1`` to ``_lag{lags}`` by calendar day: a missing day gives NULL. Like the calendar's
    rows, missing days are part of the result."""
    if lags < 1 or not columns:
        return df
    w = Window.partitionBy(*key).orderBy(date)
    full = calendar(df, key, date)
    return full.withColumns({f"{c}_lag{n}": F.lag(c, n).over(w) for c in columns for n in range(1, lags + 1)})


def previous_row(df: DataFrame, key: Sequence[str], column: str, order: str = "date") -> DataFrame:
    return df.withColumn(f"lag1{column}", F.lag(column, 1).over(Window.partitionBy(*key).orderBy(order)))


def floored(d: Column, unit: str) -> Column:
    """The first day of the unit ("day", "week", "month", "quarter" or "year") that a date is in; weeks start on Mondays."""
    return d.cast("date") if unit == "day" else F.date_trunc(unit, d).cast("date")


def rolling_mean(df: DataFrame, key: Sequence[str], column: str = "value", width: int = 7, max_nulls: int | None = None, min_values: int | None = None, date: str = "date", mean: Callable[[str], Column] | None = None, unit: str = "day") -> DataFrame:
    """Right-aligned mean over ``width`` units of the calendar of the means by unit; the first width - 1 units are
    NULL, and so are those with more than ``max_nulls`` missing or fewer than ``min_values`` values. Text has
    no mean: its most frequent value counts, of ties the smallest. ``mean`` is another aggregate: a built-in
    one, or a pandas aggregate function of the caller."""
    text = isinstance(df.schema[column].dataType, T.StringType)
    mean = mean or ((lambda c: F.mode(c, True)) if text else F.avg)
    each = df.withColumn(date, floored(F.col(date), unit)).groupBy(*key, date).agg(mean(column).alias(column))
    w = Window.partitionBy(*key).orderBy(date).rowsBetween(-(width - 1), 0)
    ok = F.count(F.lit(1)).over(w) == width
    if max_nulls is not None:
        ok = ok & (F.count(F.lit(1)).over(w) - F.count(column).over(w) <= max_nulls)
    if min_values is not None:
        ok = ok & (F.count(column).over(w) >= min_values)
    return calendar(each, key, date, unit.upper()).withColumn(column, F.when(ok, mean(column).over(w)))


def running_mode(df: DataFrame, key: Sequence[str], column: str, width: int, date: str = "date") -> DataFrame:
    """The most frequent value of the last ``width`` rows; of ties the smallest."""
    w = Window.partitionBy(*key).orderBy(date).rowsBetween(-(width - 1), 0)
    return df.withColumn(f"{column}_mode", F.mode(column, True).over(w))
