"""Nearest stations, grid cells, cities by name or place, and fires near a place in time."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EARTH_KM, bearing_deg, cell, finite, fold_name, haversine_km, sphere_km
from ..sources.store import written
from .joins import key_join

_CELL = ["_cx", "_cy", "_cz"]


def _celled(df: DataFrame, lat: str, lon: str, km: float, around: bool = False) -> DataFrame:
    """Adds the cube of each point, or a row for each of the 27 cubes around it."""
    cubes = cell(F.col(lat), F.col(lon), km)
    if around:
        steps = F.array(*map(F.lit, (-1, 0, 1)))
        for name, c in zip(_CELL, cubes, strict=True):
            df = df.withColumn(f"{name}d", F.explode(steps)).withColumn(name, c + F.col(f"{name}d")).drop(f"{name}d")
        return df
    return df.withColumns(dict(zip(_CELL, cubes, strict=True)))


def within_km(left: DataFrame, right: DataFrame, km: float, condition: Column | None = None) -> DataFrame:
    """Pairs of points of both tables (``lat``/``lon`` and ``r_lat``/``r_lon``) within ``km`` of one another
    and their ``distance_km``: an equi-join on cubes, then the distance. The left side, the one that
    is repeated 27 times, should be the smaller."""
    a, b = _celled(left, "lat", "lon", km, around=True), _celled(right, "r_lat", "r_lon", km)
    far = haversine_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    joined = a.join(b, _CELL).drop(*_CELL).withColumn("distance_km", far).filter(F.col("distance_km") <= km)
    return joined if condition is None else joined.filter(condition)


def nearest_stations(locations: DataFrame, stations: DataFrame, km: float = 100.0, n: int = 4, since: str = "2020-01-01") -> DataFrame:
    """Of the stations that still report, within ``km``: the ``n`` latest, then nearest, of each location. Each place is
    searched once, however many locations share it, among the first ``n`` stations of each place and end."""
    s = stations.filter(F.col("end") >= F.lit(since).cast("date")).withColumnsRenamed({"lat": "r_lat", "lon": "r_lon"})
    alike = Window.partitionBy("r_lat", "r_lon", "end").orderBy("code")
    s = s.withColumn("_nth", F.row_number().over(alike)).filter(F.col("_nth") <= n).drop("_nth")
    near = within_km(locations.select("lat", "lon").distinct(), s, km).filter(F.col("distance_km") < km)
    order = [F.desc("end"), F.col("distance_km"), F.col("code")]
    best = near.withColumn("_nth", F.row_number().over(Window.partitionBy("lat", "lon").orderBy(*order))).filter(F.col("_nth") <= n).drop("_nth")
    w = Window.partitionBy("location_id").orderBy(*order)
    return locations.join(best, ["lat", "lon"]).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def nearest_city(points: DataFrame, cities: DataFrame, km: float = 20.0) -> DataFrame:
    """The closest city of the same country within ``km``; points without one go. Of cities of one country and place
    the first counts, and points of one country and place are one."""
    place = ["country", "lat", "lon"]
    c = cities.groupBy(F.col("country").alias("_country"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")).agg(F.min(F.struct(F.col("id").alias("city_id"), F.col("name").alias("city_name"))).alias("c"))
    near = within_km(points.select(*place).distinct(), c.select("c.*", "_country", "r_lat", "r_lon"), km, F.col("country") == F.col("_country"))
    best = lambda df, by: df.groupBy(*by).agg(F.min(F.struct("distance_km", "city_id", "city_name")).alias("b")).select(*by, "b.*")
    found = points.select("location_id", *place).join(best(near, place), place)
    return best(found, ["location_id"]).select("location_id", "city_id", "city_name", "distance_km")


def fuzzy_city(stations: DataFrame, cities: DataFrame) -> DataFrame:
    """Cities of nearly the same name (edit distance 1 after folding) and country, by the station's city and
    then by its region; of each station the first match, NULL without one.

    Names within one edit share a text that is either of them, or one of them less a letter, so the join
    is on these texts (a name has one more than letters) rather than on all pairs.
    """

    def shortened(name: Column) -> Column:
        less = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))))
        return F.array_distinct(F.concat(F.array(name), F.when(F.length(name) > 0, less).otherwise(F.array().cast("array<string>"))))

    target = cities.select(F.col("id").alias("city_id"), F.col("name").alias("city_name"), fold_name(F.col("name")).alias("_name"), F.lower("country").alias("_country"))
    target = target.withColumn("_key", F.explode(shortened(F.col("_name"))))
    found = []
    for order, column in enumerate(("city", "region")):
        s = stations.select("station_id", fold_name(F.col(column)).alias("_own"), F.lower("country").alias("_own_country"))
        s = s.withColumn("_key", F.explode(shortened(F.col("_own"))))
        near = (F.levenshtein("_own", "_name", 1) >= 0) & (F.levenshtein("_own_country", "_country", 1) >= 0)
        found.append(s.join(target, "_key").filter(near).select("station_id", "city_id", "city_name", F.lit(order).alias("_order")))
    best = found[0].unionByName(found[1]).groupBy("station_id").agg(F.min_by(F.struct("city_id", "city_name"), F.struct("_order", "city_id")).alias("b"))
    return stations.join(best, "station_id", "left").select(*stations.columns, "b.city_id", "b.city_name")


def grid_index(df: DataFrame, lat: str, lon: str, step: float) -> DataFrame:
    """Adds the cell (``_i``, ``_j``) of each point. Longitudes may go from -180 to 180 or from 0 to 360."""
    around = round(360 / step)
    snap = lambda c: F.round(c / step).cast("long")
    turn = lambda c: F.pmod(snap(c), F.lit(around)) if abs(around * step - 360) < 1e-6 else snap(c)
    return df.withColumn("_i", snap(F.col(lat))).withColumn("_j", turn(F.col(lon)))


def grid_cell_value(points: DataFrame, grid: DataFrame, step: float) -> DataFrame:
    """Each point with the values of the cell that it lies in; cells are named by their centre."""
    g = grid_index(grid, "cell_lat", "cell_lon", step).drop("cell_lat", "cell_lon")
    return grid_index(points, "lat", "lon", step).join(g, ["_i", "_j"]).drop("_i", "_j")


def _fires(days: DataFrame, fires: DataFrame, km: float, hours: int, condition: Column | None) -> DataFrame:
    """Pairs of (location_id, date, lat, lon, at) and the fires near it within the ``hours`` before ``at``."""
    d = days.withColumn("_day", F.explode(F.sequence(F.to_date(F.col("at") - F.make_dt_interval(F.lit(0), F.lit(hours))), F.to_date("at"))))
    f = fires.select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), F.col("ts").alias("fire_ts"), "frp", *(c for c in ("region", "fire_id") if c in fires.columns), F.to_date("ts").alias("_day"))
    a, b = _celled(d, "lat", "lon", km, around=True), _celled(f, "r_lat", "r_lon", km)
    far = haversine_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    recent = (F.col("fire_ts") <= F.col("at")) & (F.col("fire_ts") > F.col("at") - F.make_dt_interval(F.lit(0), F.lit(hours)))
    joined = a.join(b, [*_CELL, "_day"]).drop(*_CELL, "_day").withColumn("distance_km", far).filter((F.col("distance_km") <= km) & recent)
    return joined if condition is None else joined.filter(condition)


#: Hours that fires count back, and the buffers in km of each mode.
HOURS, BUFFERS = 120, {"circular": 200.0, "oriented": 200.0, "trajectory": 10.0}


def fire_sums(days: DataFrame, pairs: DataFrame, regions: Sequence[str] | None = None, ages: int | None = None, n: str | None = None, asks: Sequence[str] = ("location_id", "date")) -> DataFrame:
    """fire_frp and fire_count of every (location_id, date): 0 where there is no fire. With ``regions`` also columns for
    each of them (``fire_frp_{region}``, ``fire_count_{region}``), with ``ages`` for each age in days up to it
    (``fire_frp_age{k}``, ``fire_count_age{k}``). A pair may be several fires, ``n`` of them. Pairs are
    of what rows ``asks``, where that is not their location and date."""
    number = F.lit(1) if n is None else F.col(n)
    named = {"": F.lit(True)} | {f"_{r}": F.col("region") == r for r in regions or ()} | {f"_age{k}": F.datediff("at", "fire_ts") == k for k in range((ages if ages is not None else -1) + 1)}
    sums = [x for name, own in named.items() for x in (F.sum(F.when(own, F.col("frp"))).alias(f"fire_frp{name}"), F.coalesce(F.sum(F.when(own, number)), F.lit(0)).cast("long").alias(f"fire_count{name}"))]
    found = pairs.groupBy(*asks).agg(*sums)
    zero = {f"fire_{what}{name}": value for name in named for what, value in (("frp", 0.0), ("count", 0))}
    key = ["location_id", "date"]
    if list(asks) == key:
        return days.select(*key).distinct().join(found, key, "left").na.fill(zero)
    rows = days.select(*key, *asks).distinct().join(found, list(asks), "left")
    return rows.groupBy(*key).agg(*(F.sum(c).alias(c) for c in zero)).na.fill(zero)


def circular_pairs(days: DataFrame, fires: DataFrame, buffer_km: float, hours: int) -> DataFrame:
    """Fires within a circle in the hours before each location's date (``at``)."""
    return _fires(days, fires, buffer_km, hours, None)


def oriented_pairs(days: DataFrame, fires: DataFrame, half_angle: float, max_km: float, hours: int) -> DataFrame:
    """Fires upwind: within ``half_angle`` of where the wind comes from (``wd``), and no further than it
    travels in that time at ``ws`` m/s."""
    return _fires(days, fires, max_km, hours, _upwind(half_angle, hours))


def _upwind(half_angle: float, hours: int) -> Column:
    turn = F.abs(bearing_deg(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")) - F.col("wd"))
    return (F.least(turn, 360 - turn) <= half_angle) & (F.col("distance_km") <= F.col("ws") * 3.6 * hours)


def trajectory_pairs(points: DataFrame, fires: DataFrame, buffer_km: float, hours: int) -> DataFrame:
    """Fires near any point of a location's air-mass trajectory in the hours before the point's time; a fire counts once
    a location and date: by ``fire_id``, where fires have one, or else by its time, place and power."""
    p = points.withColumnRenamed("point_ts", "at")
    one = ["fire_id"] if "fire_id" in fires.columns else ["fire_ts", "r_lat", "r_lon", "frp"]
    near = _fires(p, fires, buffer_km, hours, None)
    # ages count from the date, not from the points on the way
    return near.groupBy("location_id", "date", *one).agg(*(F.first(c).alias(c) for c in ("fire_ts", "frp", "region") if c in near.columns and c not in one)).withColumn("at", F.col("date").cast("timestamp"))


_MICROS = 1_000_000


def trajectory_sums(points: DataFrame, fires: DataFrame, buffer_km: float, hours: int, regions: Sequence[str] | None = None, ages: int | None = None) -> DataFrame:
    """The sums of :func:`trajectory_pairs`, not from pairs of points and fires: a point meets each place that burns in a
    span of time once. Spans are a day, or the window if that is shorter, so that a window that ends within a span
    began before it: all windows of a location and date cover a place's span up to the latest end and from the
    earliest start, and what burnt until then is a running sum over the place's fires. Fires with a
    ``fire_id`` may have one id in several places; they are compared one by one."""
    if "fire_id" in fires.columns:
        return fire_sums(points, trajectory_pairs(points, fires, buffer_km, hours), regions, ages)
    width, length = min(24, hours) * 3600 * _MICROS, hours * 3600 * _MICROS
    once = fires.groupBy("ts", "lat", "lon", "frp").agg(F.count(F.lit(1)), *(F.first(c).alias(c) for c in ("region",) if regions))
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    # sums of numbers that are not finite have no differences: such fires are places of their own, which are counted
    odd = F.when(finite(F.col("frp")).isNull(), F.col("frp"))
    parts = ["_odd", *(["region"] if regions else []), *(["_fire_day"] if ages is not None else [])]
    placed = once.filter("ts IS NOT NULL").select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), t.alias("_t"), F.ceil(t / width).alias("_bin"), F.to_date("ts").alias("_fire_day"), finite(F.col("frp")).alias("frp"), odd.alias("_odd"), *(["region"] if regions else []))
    place = ["r_lat", "r_lon", "_bin", *parts]
    # written, so that the numbers stay what they are
    places = written(placed.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).drop("_n").withColumn("_place", F.monotonically_increasing_id()), "fire-places")
    burnt = key_join(placed, places, place).select("_place", "_t", "frp")

    end = F.unix_micros(F.col("point_ts").cast("timestamp"))
    bins = F.explode(F.sequence(F.floor((end - length) / width) + 1, F.ceil(end / width)))
    asked = points.filter("point_ts IS NOT NULL").select("location_id", "date", "lat", "lon", end.alias("_end"), bins.alias("_bin"))
    low, high = F.col("_end") - length, F.col("_end")
    asked = asked.select("location_id", "date", "lat", "lon", "_bin", F.when(low > (F.col("_bin") - 1) * width, low).alias("_low"), F.when(high < F.col("_bin") * width, high).alias("_high"))
    there = _celled(asked.select("lat", "lon", "_bin").distinct(), "lat", "lon", buffer_km, around=True)
    far = haversine_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    near = there.join(_celled(places, "r_lat", "r_lon", buffer_km), [*_CELL, "_bin"]).filter(far <= buffer_km).select("lat", "lon", "_bin", "_place", *parts)
    met = asked.join(near, ["lat", "lon", "_bin"]).groupBy("location_id", "date", "_place").agg(
        F.min("_low").alias("_low"),
        F.max("_high").alias("_high"),
        F.max(F.col("_low").isNull() & F.col("_high").isNull()).alias("_whole"),
        *(F.first(c).alias(c) for c in parts),
    )
    whole = F.col("_whole") | F.coalesce(F.col("_high") >= F.col("_low"), F.lit(False))
    # both ends without the middle between them are two questions
    kinds = F.when(whole, F.array(F.lit(0))).when(F.col("_low").isNull(), F.array(F.lit(1))).when(F.col("_high").isNull(), F.array(F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2)))
    looked = met.withColumn("_kind", F.explode(kinds)).select("location_id", "date", "_place", *parts, "_kind", F.when(F.col("_kind") == 1, F.col("_high")).when(F.col("_kind") == 2, F.col("_low")).otherwise(F.lit(0)).alias("_t"))
    line = looked.unionByName(burnt.withColumn("_kind", F.lit(-1)), allowMissingColumns=True)
    own = Window.partitionBy("_place")
    until = own.orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fire = F.when(F.col("_kind") == -1, F.lit(1)).otherwise(F.lit(0))
    line = line.withColumns({"_sum": F.sum("frp").over(until), "_count": F.sum(fire).over(until), "_all_sum": F.sum("frp").over(own), "_all_count": F.sum(fire).over(own)})

    def asked_of(part: str):
        so_far, all_ = F.coalesce(F.col(f"_{part}"), F.lit(0)), F.coalesce(F.col(f"_all_{part}"), F.lit(0))
        return F.when(F.col("_kind") == 0, all_).when(F.col("_kind") == 1, so_far).otherwise(all_ - so_far)

    n = asked_of("count")
    found = line.filter(F.col("_kind") >= 0).select("location_id", "date", *parts, n.alias("n"), asked_of("sum").alias("frp")).filter("n > 0")
    found = found.withColumn("frp", F.coalesce("_odd", "frp")).withColumn("at", F.col("date").cast("timestamp"))
    return fire_sums(points, found.withColumnRenamed("_fire_day", "fire_ts"), regions, ages, "n")


#: Fires of a cell and day that are compared one by one; how often a cell with more is halved.
FEW_FIRES, HALVINGS = 32, 4
_DAY_S = 86_400.0


def fire_leaves(fires: DataFrame, buffer_km: float, few: int = FEW_FIRES, halvings: int = HALVINGS, n: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A tree of cells over the fires of each day, as deep as they are many: (leaves, points).

    A day holds what burns after one midnight up to the next. A cube of the buffer's width is a leaf if it holds
    ``few`` fires or less; others are halved in each direction, up to ``halvings`` times. Leaves have their sums,
    points (fires of one time and place are one; a row may be ``n`` fires) their leaf. Counts are made from the sums of the finest
    cells, so that no task sees the fires of a hot cell together.
    """
    at = F.col("ts").cast("timestamp").cast("double")
    once = fires.groupBy("ts", "lat", "lon").agg(F.sum("frp").alias("frp"), (F.count(F.lit(1)) if n is None else F.sum(n)).alias("n"))
    fine = [c.alias(f"_f{k}") for k, c in enumerate(cell(F.col("lat"), F.col("lon"), buffer_km / 2**halvings))]
    placed = once.select("ts", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), "frp", "n", F.ceil(at / _DAY_S).alias("_day"), *fine)
    names = [f"_f{k}" for k in range(3)]
    finest = placed.groupBy(*names, "_day").agg(F.sum("n").alias("n"))
    up = lambda name, level: F.floor(F.col(name) / 2 ** (halvings - level))
    level = F.lit(halvings)
    for own in range(halvings - 1, -1, -1):  # the widest cell with few fires
        held = F.sum("n").over(Window.partitionBy("_day", *(up(c, own) for c in names)))
        level = F.when(held <= few, F.lit(own)).otherwise(level)
    mapped = finest.select(*names, "_day", level.alias("_level"))
    to_level = lambda name: F.floor(F.col(name) / F.pow(F.lit(2.0), F.lit(halvings) - F.col("_level"))).cast("long")
    mapped = mapped.select("*", *(to_level(c).alias(f"_l{k}") for k, c in enumerate(names)), *(up(c, 0).cast("long").alias(c0) for c, c0 in zip(names, _CELL, strict=True)))
    # made once, read by the leaves and by what is on a border
    points = written(placed.join(mapped, [*names, "_day"]).drop(*names), "fire-points")
    leaves = points.groupBy("_day", "_level", "_l0", "_l1", "_l2", *_CELL).agg(F.sum("frp").alias("frp"), F.sum("n").alias("n"))
    return leaves, points


def _spans(asked: DataFrame, hours: int) -> DataFrame:
    """A row for each day (``_day``, as in :func:`fire_leaves`) that the hours before ``at`` reach; ``_whole``: all of it."""
    end = F.col("at").cast("timestamp").cast("double")
    day = F.explode(F.sequence(F.floor((end - hours * 3600.0) / _DAY_S) + 1, F.ceil(end / _DAY_S)))
    whole = ((F.col("_day") - 1) * _DAY_S >= end - hours * 3600.0) & (F.col("_day") * _DAY_S <= end)
    return asked.filter("at IS NOT NULL").withColumn("_day", day).withColumn("_whole", whole)


def fires_near(days: DataFrame, fires: DataFrame, km: float, hours: int, regions: Sequence[str] | None = None, ages: int | None = None, wind: Sequence[str] = (), condition: Column | None = None) -> DataFrame:
    """The sums of fires within ``km`` in the hours before each location's date (``at``) that meet ``condition``, which may
    use ``distance_km`` and places (``lat``, ``lon``, ``r_lat``, ``r_lon``) and the columns ``wind``. Rows of one place, time and wind
    ask once; the fires of one place and day, which are as far and in the same direction, answer with their
    sums, and one by one only on days that the hours cover in part."""
    asks = ["lat", "lon", "at", *wind]
    parts = [*(["region"] if regions else []), *(["fire_ts"] if ages is not None else [])]
    spans = _spans(days.select(*asks).distinct(), hours)
    at = F.col("ts").cast("timestamp").cast("double")
    each = fires.select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), "ts", F.ceil(at / _DAY_S).alias("_day"), "frp", *(F.to_date("ts").alias(c) if c == "fire_ts" else F.col(c) for c in parts))
    place = ["r_lat", "r_lon", "_day", *parts]
    daily = each.groupBy(*place).agg(F.sum("frp").alias("frp"), F.count(F.lit(1)).alias("n"))
    far = haversine_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    recent = (F.col("ts") <= F.col("at")) & (F.col("ts") > F.col("at") - F.make_dt_interval(F.lit(0), F.lit(hours)))

    def met(asked: DataFrame, answers: DataFrame, when: Column) -> DataFrame:
        both = _celled(asked, "lat", "lon", km, around=True).join(_celled(answers, "r_lat", "r_lon", km), [*_CELL, "_day"])
        both = both.withColumn("distance_km", far).filter((F.col("distance_km") <= km) & when)
        return both if condition is None else both.filter(condition)

    # a whole day's sums are the same at whatever time they are asked for
    on = ["lat", "lon", *wind, "_day"]
    whole = spans.filter("_whole")
    sums = met(whole.select(*on).distinct(), daily, F.lit(True)).groupBy(*on, *parts).agg(F.sum("frp").alias("frp"), F.sum("n").alias("n"))
    partly = met(spans.filter("NOT _whole"), each.withColumn("n", F.lit(1).cast("long")), recent)
    pairs = whole.join(sums, on).select(*asks, *parts, "frp", "n").unionByName(partly.select(*asks, *parts, "frp", "n"))
    return fire_sums(days, pairs, regions, ages, "n", asks)


def fires_circular(days: DataFrame, fires: DataFrame, buffer_km: float = 200.0, hours: int = HOURS, few: int = FEW_FIRES, halvings: int = HALVINGS) -> DataFrame:
    """fire_frp and fire_count within a circle in the hours before each location's date (``at``), those of
    :func:`circular_pairs`, but not from all pairs: on whole days, leaves (:func:`fire_leaves`) that lie wholly within the circle
    answer from their sums, only those on the border send their fires, by place and day; on days that the hours
    cover in part fires are compared one by one. Rows of one place and time ask once."""
    asks = ["lat", "lon", "at"]
    spans = _spans(days.select(*asks).distinct(), hours)
    at = F.col("ts").cast("timestamp").cast("double")
    daily = fires.groupBy("lat", "lon", F.ceil(at / _DAY_S).alias("_day")).agg(F.sum("frp").alias("frp"), F.count(F.lit(1)).alias("n"))
    leaves, points = fire_leaves(daily.withColumn("ts", F.timestamp_seconds(F.col("_day") * 86_400)), buffer_km, few, halvings, "n")
    # a whole day's sums are the same at whatever time they are asked for
    on, whole = ["lat", "lon", "_day"], spans.filter("_whole")
    around = _celled(whole.select(*on).distinct(), "lat", "lon", buffer_km, around=True)
    met = around.join(leaves, [*_CELL, "_day"]).drop(*_CELL)
    # the leaf's cube against the location's place on the sphere, in km of straight lines
    width = F.lit(buffer_km) / F.pow(F.lit(2.0), F.col("_level"))
    near2 = far2 = F.lit(0.0)
    for k, x in enumerate(sphere_km(F.col("lat"), F.col("lon"))):
        low, high = F.col(f"_l{k}") * width, (F.col(f"_l{k}") + 1) * width
        below, above = low - x, x - high
        near2 = near2 + F.pow(F.greatest(below, above, F.lit(0.0)), 2)
        far2 = far2 + F.pow(F.greatest(F.abs(low - x), F.abs(high - x)), 2)
    chord = 2 * EARTH_KM * math.sin(min(buffer_km / (2 * EARTH_KM), math.pi / 2))
    slack = 1e-6 * EARTH_KM
    sided = met.withColumns({"_in": F.sqrt(far2) <= chord - slack, "_out": F.sqrt(near2) > chord + slack}).filter(~F.col("_out"))
    inside = sided.filter("_in").select(*on, "frp", "n")
    border = sided.filter(~F.col("_in")).select(*on, "_level", "_l0", "_l1", "_l2")
    close = border.join(points.select("r_lat", "r_lon", "frp", "n", "_day", "_level", "_l0", "_l1", "_l2"), ["_day", "_level", "_l0", "_l1", "_l2"])
    far = haversine_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    close = close.filter(far <= buffer_km).select(*on, "frp", "n")
    sums = inside.unionByName(close).groupBy(*on).agg(F.sum("frp").alias("frp"), F.sum("n").alias("n"))
    each = fires.select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), "ts", F.ceil(at / _DAY_S).alias("_day"), "frp", F.lit(1).cast("long").alias("n"))
    recent = (F.col("ts") <= F.col("at")) & (F.col("ts") > F.col("at") - F.make_dt_interval(F.lit(0), F.lit(hours)))
    partly = _celled(spans.filter("NOT _whole"), "lat", "lon", buffer_km, around=True).join(_celled(each, "r_lat", "r_lon", buffer_km), [*_CELL, "_day"])
    pairs = whole.join(sums, on).select(*asks, "frp", "n").unionByName(partly.filter(recent & (far <= buffer_km)).select(*asks, "frp", "n"))
    return fire_sums(days, pairs, n="n", asks=asks)


def fires_oriented(days: DataFrame, fires: DataFrame, half_angle: float = 45.0, hours: int = HOURS, max_km: float = 200.0, regions: Sequence[str] | None = None, ages: int | None = None) -> DataFrame:
    """The sums of :func:`oriented_pairs`."""
    return fires_near(days, fires, max_km, hours, regions, ages, ["wd", "ws"], _upwind(half_angle, hours))


def fires_trajectory(points: DataFrame, fires: DataFrame, buffer_km: float = 10.0, hours: int = 24) -> DataFrame:
    """The sums of :func:`trajectory_pairs`."""
    return trajectory_sums(points, fires, buffer_km, hours)


def fires_split(days: DataFrame, fires: DataFrame, regions: Sequence[str], buffer_km: float = 200.0, hours: int = HOURS) -> DataFrame:
    """As :func:`fires_circular`, in a column for each region (``fire_frp_{region}``)."""
    wide = fires_near(days, fires, buffer_km, hours, regions)
    return wide.select("location_id", "date", *(f"fire_frp_{r}" for r in regions))


def fires_by_age(days: DataFrame, fires: DataFrame, buffer_km: float = 200.0, hours: int = HOURS) -> DataFrame:
    """As :func:`fires_circular`, in a column for each age in days."""
    wide = fires_near(days, fires, buffer_km, hours, ages=hours // 24)
    return wide.select("location_id", "date", *(f"fire_frp_age{k}" for k in range(hours // 24 + 1)))


def needs_fire(weather: DataFrame, height: float | None = None) -> DataFrame:
    """Rows without fire data (all, where there is no such column), with the height of their trajectory:
    the one given, or the middle of the boundary layer, or 10 m."""
    rows = weather.filter(F.col("fire_frp").isNull()) if "fire_frp" in weather.columns else weather
    middle = (F.col("pbl_min") + F.col("pbl_max")) / 2 if {"pbl_min", "pbl_max"} <= set(weather.columns) else F.lit(None).cast("double")
    return rows.withColumn("trajs_height", F.coalesce(F.lit(height).cast("double"), middle, F.lit(10.0)))


def local_dates(hours: DataFrame, zones: DataFrame) -> DataFrame:
    """Each UTC hour with its local date, by the whole hours of the zone's offset."""
    shifted = F.col("ts") + F.make_dt_interval(F.lit(0), F.floor("offset_hours").cast("int"))
    return hours.join(zones, "zone").withColumn("local_date", F.to_date(shifted))
