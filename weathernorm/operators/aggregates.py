"""Aggregations of measurements, grids, stations and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, wind_direction

ID_COLUMNS = ["location_id", "poll", "unit", "source", "timezone", "process_id", "country"]


def daily_mean(meas: DataFrame, ids: Sequence[str] = tuple(ID_COLUMNS)) -> DataFrame:
    """One mean value a calendar date and series."""
    return meas.groupBy(F.to_date("date").alias("date"), *ids).agg(F.avg("value").alias("value"))


def grid_daily(hourly: DataFrame, cell: Sequence[str] = ("cell_lat", "cell_lon"), hours: int = 24) -> DataFrame:
    """Daily means, extremes and sums of an hourly grid, and its wind, in one pass; days of fewer hours go."""
    names = set(hourly.columns)
    aggs: dict[str, Column] = {"_hours": F.countDistinct(F.hour("ts"))}
    for c in ("d2m", "t2m", "sp", "blh"):
        if c in names:
            aggs[c] = F.avg(c)
    for c in ("t2m", "blh"):
        if c in names:
            aggs |= {f"{c}_min": F.min(c), f"{c}_max": F.max(c)}
    if "tp" in names:
        aggs["tp"] = F.sum("tp")
    if {"u10", "v10"} <= names:
        aggs |= {"ws": F.avg(F.hypot("u10", "v10")), "_u": F.sum("u10"), "_v": F.sum("v10")}
    out = hourly.groupBy(*cell, F.to_date("ts").alias("date")).agg(*(a.alias(n) for n, a in aggs.items())).filter(F.col("_hours") >= hours)
    if "_u" in out.columns:
        out = out.withColumn("wd", wind_direction(F.col("_u"), F.col("_v")))
    return out.drop("_hours", "_u", "_v")


def station_daily(hourly: DataFrame, circular: bool = False) -> DataFrame:
    """Hourly station weather by day; wind direction is the speed-weighted mean, arithmetic or circular."""
    wd, ws = F.col("wd"), F.col("ws")
    aggs = [F.min("air_temp").alias("air_temp_min"), F.max("air_temp").alias("air_temp_max"), F.avg("air_temp").alias("air_temp")]
    aggs += [F.avg(c).alias(c) for c in ("atmos_pres", "ceil_hgt", "visibility", "precip")]
    aggs += [F.avg(F.col("RH") / 100).alias("RH"), F.min(F.col("RH") / 100).alias("RH_min"), F.max(F.col("RH") / 100).alias("RH_max"), F.max("ws").alias("ws_max"), F.avg("ws").alias("ws")]
    if circular:
        mean = F.pmod(F.degrees(F.atan2(F.sum(ws * F.sin(F.radians(wd))), F.sum(ws * F.cos(F.radians(wd))))) + 360, F.lit(360.0))
    else:
        mean = F.try_divide(F.sum(wd * ws), F.sum(F.when(wd.isNotNull(), ws)))
    out = hourly.groupBy("code", F.to_date("ts").alias("date")).agg(*aggs, mean.alias("wd"))
    return out.withColumns({c: finite(F.col(c)) for c in out.columns if c not in ("code", "date")})


def inverse_distance_mean(df: DataFrame, by: Sequence[str], columns: Sequence[str], distance: str = "distance_km") -> DataFrame:
    """Mean over stations with weights 1 / max(1, distance); each variable skips its own NULLs."""
    w = 1 / F.greatest(F.lit(1.0), F.col(distance))
    return df.groupBy(*by).agg(*(F.try_divide(F.sum(F.col(c) * w), F.sum(F.when(F.col(c).isNotNull(), w))).alias(c) for c in columns))


def local_day_extremes(hourly: DataFrame, zones: DataFrame, by: Sequence[str] = ("location_id",), column: str = "blh") -> DataFrame:
    """Least, greatest and mean boundary layer by local day; ``zones`` has the offset in hours by location."""
    local = hourly.join(zones, "location_id").withColumn("date", F.to_date(F.col("ts") + F.make_dt_interval(F.lit(0), F.floor("offset_hours").cast("int"))))
    return local.groupBy(*by, "date").agg(F.min(column).alias("pbl_min"), F.max(column).alias("pbl_max"), F.avg(column).alias("pbl"))


def region_daily(df: DataFrame, columns: Sequence[str] = ("Tair", "Qair", "Wind", "PSurf", "Rainf")) -> DataFrame:
    return df.groupBy("region", F.to_date("ts").alias("date")).agg(*(F.avg(c).alias(c) for c in columns))


def day_bits(date: Column) -> tuple[Column, Column]:
    """The bitmap that a day is in (one holds 32,768 days, 89 years), and its bit there."""
    day = F.unix_date(F.to_date(date)).cast("long")
    return F.bitmap_bucket_number(day), F.bitmap_bit_position(day)


def availability(long: DataFrame) -> DataFrame:
    """(location_id, weather_var, source, share): the share of all the table's dates with a value, of every location and
    every (variable, source) of the table.

    Days are bits: one shuffle by location counts the days of each variable and source, and merges a location's days
    to one bitmap; those of all locations merge to one row, which is broadcast. The grid of all pairs is made in
    each location's row, not joined.
    """
    bucket, bit = day_bits(F.col("date"))
    days = long.select("location_id", "weather_var", "source", bucket.alias("_bucket"), bit.alias("_bit"), F.when(F.col("value").isNotNull(), bit).alias("_has"))
    # a partitioning by location serves every grouping below
    by_bitmap = days.repartition("location_id").groupBy("location_id", "weather_var", "source", "_bucket")
    seen = by_bitmap.agg(F.bitmap_count(F.bitmap_construct_agg("_has")).alias("_n"), F.bitmap_construct_agg("_bit").alias("_days"))
    pair = F.struct("weather_var", "source")
    merged = seen.groupBy("location_id", "_bucket").agg(F.bitmap_or_agg("_days").alias("_days"), F.collect_list(F.struct(pair.alias("pair"), F.col("_n").alias("n"))).alias("_seen"))  # a row a variable and source
    rows = merged.groupBy("_bucket").agg(F.bitmap_count(F.bitmap_or_agg("_days")).alias("_d"), F.array_distinct(F.flatten(F.collect_set(F.transform("_seen", lambda p: p["pair"])))).alias("_pairs"))
    table = rows.agg(F.sum("_d").alias("_d"), F.array_distinct(F.flatten(F.collect_list("_pairs"))).alias("_pairs"))
    each = merged.join(F.broadcast(table), how="cross").select("location_id", "_d", "_seen", F.explode("_pairs").alias("_p"))  # one row on the right
    n = F.aggregate(F.filter("_seen", lambda p: p["pair"].eqNullSafe(F.col("_p"))), F.lit(0).cast("long"), lambda a, p: a + p["n"])
    counted = each.groupBy("location_id", F.col("_p.weather_var").alias("weather_var"), F.col("_p.source").alias("source")).agg(F.sum(n).alias("_n"), F.first("_d").alias("_d"))
    return counted.select("location_id", "weather_var", "source", (F.col("_n") / F.col("_d")).alias("share"))


def pick_source(shares: DataFrame, priority: Sequence[str], least: float = 0.5) -> DataFrame:
    """The first source, in order of priority, with enough values; variables with none disappear."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("source"))
    return shares.filter((F.col("share") >= least) & (rank > 0)).groupBy("location_id", "weather_var").agg(F.min_by("source", rank).alias("source"))


def fit_metrics(pred: DataFrame, by: Sequence[str]) -> DataFrame:
    """RMSE and R2 (squared correlation) of each set, side by side."""
    ok = pred.filter(F.col("value").isNotNull() & F.col("predicted").isNotNull())
    sets = ["training", "testing", "prediction"]
    aggs = []
    for s in sets:
        y, p = (F.when(F.col("set") == s, F.col(c)) for c in ("value", "predicted"))
        # corr() fails on a constant; this is NULL then
        y = F.when(p.isNotNull(), y)
        r2 = F.try_divide(F.pow(F.covar_pop(y, p), 2), F.var_pop(y) * F.var_pop(p))
        aggs += [F.sqrt(F.avg(F.pow(y - p, 2))).alias(f"rmse_{s}"), r2.alias(f"rsquared_{s}")]
    return ok.groupBy(*by).agg(*aggs)


def legacy_metrics(pred: DataFrame, by: Sequence[str]) -> DataFrame:
    """RMSE, MAE and 1 - SSE/SST on the fitted rows and on the predicted ones."""
    ok = pred.filter(F.col("value").isNotNull() & F.col("predicted").isNotNull())
    aggs = []
    for name, here in (("training", F.col("set") != "prediction"), ("prediction", F.col("set") == "prediction")):
        y, e = F.when(here, F.col("value")), F.when(here, F.col("value") - F.col("predicted"))
        aggs += [F.sqrt(F.avg(e * e)).alias(f"rmse_{name}"), F.avg(F.abs(e)).alias(f"mae_{name}"), (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias(f"r2_{name}")]
    return ok.groupBy(*by).agg(*aggs)


def replicate_summary(df: DataFrame, by: Sequence[str], column: str = "predicted", beside: Sequence[str] = ()) -> DataFrame:
    """Mean and 2.5 % and 97.5 % quantiles (linear between order statistics) over replicates; columns ``beside`` them, which all
    replicates share, stay (of several values one that is not NULL)."""
    q = F.percentile(column, F.array(F.lit(0.025), F.lit(0.975)))
    kept = [F.first(c, ignorenulls=True).alias(c) for c in beside]
    return df.groupBy(*by).agg(F.avg(column).alias(column), *kept, q.alias("_q")).withColumns({f"{column}_p025": F.col("_q")[0], f"{column}_p975": F.col("_q")[1]}).drop("_q")


def period_mean(df: DataFrame, by: Sequence[str], years: Sequence[int], days: Sequence[int]) -> DataFrame:
    """Mean over some days of the year in some years."""
    return df.filter(F.year("date").isin(list(years)) & F.dayofyear("date").isin(list(days))).groupBy(*by).agg(F.avg("value").alias("value"))


def period_means_until(df: DataFrame, by: Sequence[str], years: Sequence[int], first: int, last: int) -> DataFrame:
    return period_mean(df, by, years, range(first, last + 1))


def before_after(df: DataFrame, by: Sequence[str], event: str, years: Sequence[int], columns: Sequence[str] = ("observed", "normalised")) -> DataFrame:
    """Change after an event, relative to the same days of the year in ``years``."""
    e = F.lit(event).cast("date")
    last = df.agg(F.max("date").alias("_last"))
    d = df.join(F.broadcast(last), how="cross")
    after = F.col("date") >= e
    before = F.year("date").isin(list(years)) & F.dayofyear("date").between(F.dayofyear(e), F.dayofyear("_last")) & ~after
    aggs = [a for c in columns for a in (F.avg(F.when(after, F.col(c))).alias(f"{c}_after"), F.avg(F.when(before, F.col(c))).alias(f"{c}_before"))]
    out = d.groupBy(*by).agg(*aggs)
    return out.withColumns({f"{c}_change": F.try_divide(F.col(f"{c}_after") - F.col(f"{c}_before"), F.col(f"{c}_before")) for c in columns})


def coverage(df: DataFrame, by: Sequence[str], polls: Sequence[str]) -> DataFrame:
    """Rows of every place and pollutant; pairs without rows are there with 0."""
    grid = df.select(*by).distinct().withColumn("poll", F.explode(F.array(*map(F.lit, polls))))
    return grid.join(df.groupBy(*by, "poll").agg(F.count(F.lit(1)).alias("n")), [*by, "poll"], "left").na.fill(0, ["n"])


def importance_summary(importance: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Median and total influence of each variable over all fits, its lags counted with it."""
    fits = [c for c in importance.columns if c not in ("variable", "influence")]
    var = F.regexp_replace("variable", r"_lag\d+$", "")
    per = importance.groupBy(*fits, var.alias("variable")).agg(F.sum("influence").alias("influence"))
    return per.groupBy(*by, "variable").agg(F.median("influence").alias("median_influence"), F.sum("influence").alias("total_influence"))


def quality_distribution(df: DataFrame, by: Sequence[str], column: str, low: float, high: float, bins: int) -> DataFrame:
    """Quartiles of a measure, and its histogram over ``bins`` equal steps."""
    hist = [F.count(F.when(F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)) == k, 1)).alias(f"bin{k}") for k in range(1, bins + 1)]
    q = F.percentile(column, F.array(*(F.lit(x) for x in (0.25, 0.5, 0.75))))
    out = df.groupBy(*by).agg(q.alias("_q"), *hist)
    return out.withColumns({"q25": F.col("_q")[0], "q50": F.col("_q")[1], "q75": F.col("_q")[2]}).drop("_q")


def linear_trend(df: DataFrame, by: Sequence[str], column: str = "value") -> DataFrame:
    """Slope a day, intercept, and the change over the whole span."""
    t = F.unix_date("date").cast("double")
    out = df.groupBy(*by).agg(F.regr_slope(F.col(column), t).alias("slope"), F.regr_intercept(F.col(column), t).alias("intercept"), (F.max(t) - F.min(t)).alias("_span"))
    return out.withColumn("change", F.col("slope") * F.col("_span")).drop("_span")


def trend_segments(df: DataFrame, segments: DataFrame, by: Sequence[str]) -> DataFrame:
    """Lines a + b * days of a table of trend segments, with their bounds, at every date they hold for."""
    days = F.datediff("date", "start").cast("double")
    joined = df.select(*by, "date").distinct().join(segments, list(by)).filter(F.col("date").between(F.col("start"), F.col("end")))
    return joined.select(*by, "date", *((F.col(a) + F.col(b) * days).alias(n) for n, a, b in (("trend", "a", "b"), ("lower", "a_lower", "b_lower"), ("upper", "a_upper", "b_upper"))))


def collect_replicates(models: DataFrame, key: Sequence[str]) -> DataFrame:
    """A series' models as one list (a few replicates), for callers that want one row a series."""
    return models.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("config_id", "replicate", "n_trees_opt", "model"))).alias("models"))


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def hash_sample(df: DataFrame, by: Sequence[str], n: int, seed: int, identity: Sequence[str]) -> DataFrame:
    """``n`` rows of each group in the order of a seeded hash: the same rows on every run."""
    h = F.md5(F.concat_ws("~", *(F.col(c).cast("string") for c in identity), F.lit(str(seed))))
    return top_n(df, by, [h, *map(F.col, identity)], n)


def key_value(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row (name, value as text) for each column of a row."""
    return df.select(*ids, *(F.col(c).cast("string").alias(c) for c in columns)).unpivot(list(ids), list(columns), "name", "value")
