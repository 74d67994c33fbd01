"""Feature preparation: clean, fill, enrich, filter; one lazy plan over all series at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import time_features, wind_sector
from ..operators.cleaning import add_lags, clean, complete_cases, fill_series, recent_series


def enrich(df: DataFrame, key: Sequence[str], weather_vars: Sequence[str], lag: int) -> DataFrame:
    """Wind sector, then lags of all weather variables by calendar day."""
    if "wd" in df.columns:
        df = df.withColumn("wd_factor", wind_sector(F.col("wd")))
    return add_lags(df, key, list(weather_vars), lag)


def prep_data(df: DataFrame, key: Sequence[str], weather_vars: Sequence[str], lag: int = 0, since: str | None = "2020-01-01") -> DataFrame:
    """The rows that a model may see, with their features. A series that fails a step (no recent date, no
    complete case) has no rows; the others are not affected."""
    missing = [c for c in [*key, "date", "value", *weather_vars] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    out = fill_series(clean(df, key), key, weather_vars)
    out = enrich(out, key, weather_vars, lag)
    if since is not None:
        out = recent_series(out, key, since)
    return time_features(complete_cases(out, weather_vars))
