"""Weather of locations: stations, grid, radiation and fires, put together variable by variable."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import extraterrestrial_radiation
from ..operators.aggregates import day_bits, grid_daily, inverse_distance_mean, station_daily
from ..operators.cleaning import date_range
from ..operators.joins import coalesce_join, natural_left
from ..operators.space_time import BUFFERS, HOURS, fires_circular, fires_near, fires_oriented, grid_cell_value, grid_index, nearest_stations, needs_fire, trajectory_sums
from ..sources.store import Store, normal_key, written
from ..sources.tables import GRID_NAMES, STATION_NAMES, in_units, renamed, snapshot

STATION_VARS = ["air_temp_min", "air_temp_max", "atmos_pres", "wd", "ws", "ws_max", "ceil_hgt", "visibility", "precip", "RH", "RH_max"]


def station_weather(locations: DataFrame, stations: DataFrame, hourly: DataFrame, km: float = 100.0, n: int = 4, since: str = "2020-01-01") -> DataFrame:
    """(location_id, date, canonical variables): distance-weighted over each location's nearest stations."""
    near = nearest_stations(locations, stations, km, n, since).select(*locations.columns, "code", "distance_km")
    daily = station_daily(hourly)
    joined = near.join(daily, "code")
    if {"date_from", "date_to"} <= set(joined.columns):
        joined = date_range(joined)
    return renamed(inverse_distance_mean(joined, ["location_id", "date"], STATION_VARS), STATION_NAMES, True, ["location_id", "date"])


def grid_weather(locations: DataFrame, hourly: DataFrame, step: float = 0.25, hours: int = 24) -> DataFrame:
    """(location_id, date, canonical variables) of the grid cell that each location lies in."""
    at = grid_cell_value(locations.select("location_id", "lat", "lon"), grid_daily(hourly, hours=hours), step)
    return in_units(renamed(at, GRID_NAMES, True, ["location_id", "date"]))


def sunshine(locations: DataFrame, dates: DataFrame) -> DataFrame:
    """Radiation above the atmosphere, the same day after day in every year, leap days included."""
    days = dates.select("date").distinct().withColumn("_yday", F.dayofyear("date"))
    grid = locations.select("location_id", "lat").distinct().join(days, how="cross")
    return grid.select("location_id", "date", extraterrestrial_radiation(F.col("_yday"), F.col("lat")).alias("sunshine"))


def combine_weathers(weathers: Mapping[str, DataFrame], variables: Sequence[str], least: float = 0.5) -> DataFrame:
    """One wide table: for each location and variable the first source (in the mapping's order) that has a
    value on at least ``least`` of all the tables' dates. The sources stay wide: one shuffle by location
    serves the rows of a date, the shares and the choice. Several rows of a source and date are one, with
    the first values that are not NULL."""
    place, tagged, has = ["location_id", "date"], None, {}
    for source, df in weathers.items():
        has[source] = [v for v in variables if v in df.columns]
        part = df.select(*place, F.lit(True).alias(f"_{source}"), *(F.col(v).alias(f"_{source}_{v}") for v in has[source]))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    cells = [c for c in tagged.columns if c not in place]
    wide = tagged.repartition("location_id").groupBy(*place).agg(*(F.first(c, ignorenulls=True).alias(c) for c in cells))
    # days as bits, and the values of each source in all; of the same columns, so that the shuffle serves this as well
    bucket, bit = day_bits(F.col("date"))
    bitmaps = wide.groupBy(bucket.alias("_bucket")).agg(F.bitmap_count(F.bitmap_construct_agg(bit)).alias("_dates"), *(F.count(c).alias(f"_all{c}") for c in cells))
    dates = bitmaps.agg(F.sum("_dates").alias("_dates"), *(F.sum(f"_all{c}").alias(f"_all{c}") for c in cells))
    own = Window.partitionBy("location_id")
    seen = wide.withColumns({f"_n{c}": F.count(c).over(own) for c in cells if any(c == f"_{s}_{v}" for s in has for v in has[s])}).join(F.broadcast(dates), how="cross")
    values, here = {}, F.lit(False)
    for v in variables:
        value, used = F.lit(None), F.lit(False)
        for source in reversed([s for s in has if v in has[s]]):
            enough = (F.col(f"_n_{source}_{v}") / F.col("_dates") >= least) & (F.col(f"_all_{source}_{v}") > 0) & (F.col(f"_all_{source}") > 0)
            value = F.when(enough, F.col(f"_{source}_{v}")).otherwise(value)
            used = F.when(enough, F.col(f"_{source}").isNotNull()).otherwise(used)
        values[v], here = value, here | used
    return seen.filter(here).select(*place, *(x.alias(v) for v, x in values.items()))


def local_layers(locations: DataFrame, hourly: DataFrame, step: float = 0.25) -> DataFrame:
    """(location_id, date, pbl_min, pbl_max, pbl) by local day, of the grid cell that each location lies in. Hours are summed
    up by cell, then by cell, offset and day; only these days meet the locations."""
    cell, zone = ["_i", "_j"], ["_i", "_j", "offset_hours"]
    at = grid_index(locations.select("location_id", "lat", "lon"), "lat", "lon", step).select("location_id", *cell).distinct()
    at = at.join(locations.select("location_id", "offset_hours").distinct(), "location_id")
    hours = grid_index(hourly, "cell_lat", "cell_lon", step).groupBy(*cell, F.date_trunc("hour", "ts").alias("ts")).agg(F.min("blh").alias("pbl_min"), F.max("blh").alias("pbl_max"), F.sum("blh").alias("_sum"), F.count("blh").alias("_n"))

    def together(df: DataFrame, by) -> DataFrame:
        return df.groupBy(*by, "date").agg(F.min("pbl_min").alias("pbl_min"), F.max("pbl_max").alias("pbl_max"), F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))

    zones = at.select(*zone).distinct().join(hours, cell)
    local = F.to_date(F.col("ts") + F.make_dt_interval(F.lit(0), F.floor("offset_hours").cast("int")))
    days = together(zones.withColumn("date", local), zone)
    found = together(at.join(days, zone), ["location_id"])
    return found.withColumn("pbl", F.try_divide("_sum", "_n")).drop("_sum", "_n")


def boundary_layer(weather: DataFrame, locations: DataFrame, hourly: DataFrame, step: float = 0.25, wanted: Sequence[str] = ("pbl_min", "pbl_max")) -> DataFrame:
    """``weather`` with the extremes of the boundary layer by local day, of the grid cell that each location lies in.
    ``locations`` has lat, lon and offset_hours; ``hourly`` has cell_lat, cell_lon, ts and blh."""
    return natural_left(weather, local_layers(locations, hourly, step).select("location_id", "date", *wanted), ["location_id", "date"])


def with_cached_fire(weather: DataFrame, cached: DataFrame) -> DataFrame:
    """Fire columns from stored results, where there are any."""
    return coalesce_join(weather, cached, ["location_id", "date"], [c for c in cached.columns if c.startswith("fire_")])


@dataclass(frozen=True)
class FireOptions:
    """How fires are attached: the mode ("circular", "oriented" or "trajectory"), the hours that they count back, and
    for trajectories the hours before each point; the buffer (None: the mode's own); columns for regions or for
    ages in days; the height of trajectories (None: the middle of the boundary layer, or 10 m)."""

    mode: str = "circular"
    hours: int = HOURS
    delay_hours: int = 24
    buffer_km: float | None = None
    half_angle: float = 45.0
    regions: tuple[str, ...] = ()
    by_age: bool = False
    height: float | None = None
    source: str = "viirs"

    def __post_init__(self) -> None:
        if self.mode not in BUFFERS:
            raise ValueError(f"unknown fire mode {self.mode!r}")

    @property
    def buffer(self) -> float:
        return BUFFERS[self.mode] if self.buffer_km is None else self.buffer_km

    @property
    def columns(self) -> list[str]:
        names = ["", *(f"_{r}" for r in self.regions), *(f"_age{k}" for k in range(self.hours // 24 + 1) if self.by_age)]
        return [f"fire_{what}{name}" for name in names for what in ("frp", "count")]

    @property
    def key(self) -> dict[str, str | None]:
        """What a stored result is known by, besides its location and date."""
        values = {"mode": self.mode, "duration_hour": self.hours, "height": self.height, "buffer_km": self.buffer, "fire_source": self.source, "fire_split_regions": list(self.regions) or "none"}
        return {k: normal_key(v) for k, v in values.items()}


FIRE_KEY = ["location_id", "date", "mode", "duration_hour", "height", "buffer_km", "fire_source", "fire_split_regions"]


def stored_fires(cache: Store, options: FireOptions) -> DataFrame:
    """(location_id, date, fire columns) of what the store holds for these options."""
    found = cache.read()
    for name, value in options.key.items():
        found = found.filter(F.col(name).eqNullSafe(F.lit(value)))
    return found.select("location_id", "date", *(c for c in options.columns if c in found.columns))


def at_height(points: DataFrame, todo: DataFrame) -> DataFrame:
    """The points of the trajectory whose height is next to what each (location_id, date) asks for; all points, where
    they have no heights."""
    wanted = todo.select("location_id", "date", "trajs_height").groupBy("location_id", "date").agg(F.min("trajs_height").alias("trajs_height"))
    near = points.join(wanted, ["location_id", "date"])
    if "height" in points.columns:
        off = F.abs(F.col("height") - F.col("trajs_height"))
        w = Window.partitionBy("location_id", "date")
        near = near.withColumn("_least", F.min(F.struct(off.alias("off"), F.col("height").alias("height"))).over(w)).filter(F.col("height").eqNullSafe(F.col("_least.height"))).drop("_least")
    return near.select(*points.columns)


def fire_columns(todo: DataFrame, fires: DataFrame, options: FireOptions, points: DataFrame | None = None) -> DataFrame:
    """(location_id, date, the options' columns) of rows with lat, lon, at, and wd and ws or trajs_height as the mode needs."""
    ages = options.hours // 24 if options.by_age else None
    if options.mode == "circular" and not options.regions and not options.by_age:
        found = fires_circular(todo, fires, options.buffer, options.hours)
    elif options.mode == "circular":
        found = fires_near(todo, fires, options.buffer, options.hours, options.regions, ages)
    elif options.mode == "oriented":
        if missing := {"wd", "ws"} - set(todo.columns):
            raise ValueError(f"oriented fires need {', '.join(sorted(missing))}")
        found = fires_oriented(todo, fires, options.half_angle, options.hours, options.buffer, options.regions, ages)
    else:
        if points is None:
            raise ValueError("fires along trajectories need the points of the trajectories")
        found = trajectory_sums(at_height(points, todo), fires, options.buffer, options.delay_hours, options.regions, ages)
    return found.select("location_id", "date", *options.columns)


def add_fire(weather: DataFrame, locations: DataFrame, fires: DataFrame, mode: str | None = None, points: DataFrame | None = None, cached: DataFrame | None = None, cache: Store | None = None, save: bool = False, **options) -> DataFrame:
    """Fills fire columns: from what is stored first (a table ``cached`` in trajectory mode, or a store ``cache`` with the
    key ``FIRE_KEY`` in every mode), then from the fires themselves; with ``save``, what was computed goes to the
    store. The mode is "trajectory" if points are given, or else "circular"; ``options`` are those of
    :class:`FireOptions`."""
    options = FireOptions(mode=mode or ("circular" if points is None else "trajectory"), **options)
    if cached is not None and options.mode == "trajectory":
        weather = with_cached_fire(weather, cached)
    if cache is not None:
        weather = with_cached_fire(weather, stored_fires(cache, options))
    todo = needs_fire(weather, options.height).join(locations.select("location_id", "lat", "lon"), "location_id").withColumn("at", F.col("date").cast("timestamp"))
    found = fire_columns(todo, fires, options, points)
    if cache is not None and save:
        # written once, read by the store's write and by the result
        found = written(found, "fires")
        cache.put(found.select("location_id", "date", *(F.lit(v).cast("string").alias(k) for k, v in options.key.items()), *options.columns))
    return coalesce_join(weather, found, ["location_id", "date"], options.columns)


def collect_weather(locations: DataFrame, variables: Sequence[str], stations: DataFrame | None = None, station_hourly: DataFrame | None = None, grid_hourly: DataFrame | None = None, add_sunshine: bool = False, fires: DataFrame | None = None, fire_mode: str | None = None, priority: Sequence[str] = ("grid", "station", "sun"), step: float = 0.25, km: float = 100.0, points: DataFrame | None = None, layers_hourly: DataFrame | None = None, save_to: str | None = None, grid_hours: int = 24, least: float = 0.5, **fire) -> DataFrame:
    """All sources of weather for the locations, combined; the boundary layer by local day from ``layers_hourly`` (the
    locations then have offset_hours) and fires attached, if there are any; ``fire`` has further arguments of
    :func:`add_fire`. With ``save_to``, the table is stored there, and read from there the next time."""
    if save_to is not None:
        return snapshot(locations.sparkSession, save_to, lambda: collect_weather(locations, variables, stations, station_hourly, grid_hourly, add_sunshine, fires, fire_mode, priority, step, km, points, layers_hourly, None, grid_hours, least, **fire))
    found: dict[str, DataFrame] = {}
    if station_hourly is not None:
        found["station"] = station_weather(locations, stations, station_hourly, km)
    if grid_hourly is not None:
        found["grid"] = grid_weather(locations, grid_hourly, step, grid_hours)
    if add_sunshine:
        dates = None
        for df in found.values():
            part = df.select("date").distinct()
            dates = part if dates is None else dates.union(part)
        found["sun"] = sunshine(locations, dates.distinct())
    layers = [v for v in variables if v in ("pbl_min", "pbl_max", "pbl")] if layers_hourly is not None else []
    # what the fires' mode needs is kept until they are attached
    helpers = [] if fires is None else [v for v in ("wd", "ws", "pbl_min", "pbl_max") if v not in variables and any(v in df.columns for df in found.values())]
    out = combine_weathers({s: found[s] for s in priority if s in found}, [*(v for v in variables if v not in layers), *helpers], least)
    if layers:
        out = boundary_layer(out, locations, layers_hourly, step, layers)
    if fires is not None:
        out = add_fire(out, locations, fires, fire_mode, points, **fire)
    return out.drop(*helpers)
