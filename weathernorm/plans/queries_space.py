"""Queries over places: stations, grid cells, cities, fires, local days."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import space_time as st
from ..sources import tables
from .register import registrar

QUERIES, ORACLE = {}, {}
query = registrar(QUERIES, ORACLE)


def _km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"


_KNN = f"near AS (SELECT l.location_id, s.code, s.end_date, {_km('l.lat', 'l.lon', 's.r_lat', 's.r_lon')} AS distance_km FROM location l, station s WHERE s.end_date >= DATE '2020-01-01'), knn AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY end_date DESC, distance_km, code) AS rn FROM near WHERE distance_km < 1500)"


def _stations(station):
    return station.withColumnsRenamed({"r_lat": "lat", "r_lon": "lon", "end_date": "end"}).select("code", "lat", "lon", "end")


@query("knn_stations", f"WITH {_KNN} --FINAL-- SELECT location_id, code, distance_km, CAST(rn AS INT) AS rank FROM knn WHERE rn <= 4", "distance_km", "location", "station")
def knn_stations(location, station):
    near = st.nearest_stations(location.select("location_id", "lat", "lon"), _stations(station), 1500.0, 4)
    return near.select("location_id", "code", "distance_km", "rank")


@query("idw_station_weather", f"WITH {_KNN}, d AS (SELECT code, CAST(ts AS DATE) AS date, avg(air_temp) AS air_temp, avg(precip) AS precip, avg(ws) AS ws FROM station_hourly GROUP BY ALL), j AS (SELECT location_id, date, air_temp, precip, ws, 1 / greatest(1.0, distance_km) AS w FROM knn JOIN d USING (code) WHERE rn <= 4) --FINAL-- SELECT location_id, date, sum(air_temp * w) / sum(w) FILTER (air_temp IS NOT NULL) AS air_temp, sum(precip * w) / sum(w) FILTER (precip IS NOT NULL) AS precip, sum(ws * w) / sum(w) FILTER (ws IS NOT NULL) AS ws FROM j GROUP BY ALL", "air_temp precip ws", "location", "station", "station_hourly")
def idw_station_weather(location, station, hourly):
    near = st.nearest_stations(location.select("location_id", "lat", "lon"), _stations(station), 1500.0, 4).select("location_id", "code", "distance_km")
    daily = agg.station_daily(hourly).select("code", "date", "air_temp", "precip", "ws")
    return agg.inverse_distance_mean(near.join(daily, "code"), ["location_id", "date"], ["air_temp", "precip", "ws"])


@query("grid_cell_extract", "WITH g AS (SELECT cell_lat, cell_lon, CAST(ts AS DATE) AS date, avg(t2m) AS t2m, max(blh) AS blh_max FROM hourly GROUP BY ALL), p AS (SELECT location_id, lat, lon FROM location) --FINAL-- SELECT location_id, date, t2m - 273.15 AS air_temp_max, blh_max AS pbl_max FROM p JOIN g ON round(p.lat / 2) = round(g.cell_lat / 2) AND round(p.lon / 2) = round(g.cell_lon / 2)", "air_temp_max pbl_max", "location", "hourly")
def grid_cell_extract(location, hourly):
    grid = hourly.groupBy("cell_lat", "cell_lon", F.to_date("ts").alias("date")).agg(F.avg("t2m").alias("t2m_max"), F.max("blh").alias("blh_max"))
    points = location.select("location_id", "lat", "lon")
    found = st.grid_cell_value(points, grid, 2.0).drop("lat", "lon")
    return tables.in_units(tables.renamed(found, tables.GRID_NAMES, True, ["location_id", "date"]))


@query("nearest_city", f"WITH p AS (SELECT station_id AS location_id, lower(country) AS country, CAST((station_id * 37) % 170 - 85 AS DOUBLE) AS lat, CAST((station_id * 73) % 360 - 180 AS DOUBLE) AS lon FROM named_station), n AS (SELECT p.location_id, c.id AS city_id, c.name AS city_name, {_km('p.lat', 'p.lon', 'c.lat', 'c.lon')} AS distance_km FROM p JOIN city c USING (country)), r AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY distance_km, city_id) AS rn FROM n WHERE distance_km <= 500) --FINAL-- SELECT location_id, city_id, city_name, distance_km FROM r WHERE rn = 1", "distance_km", "named_station", "city")
def nearest_city(named, city):
    k = F.col("station_id")
    points = named.select(k.alias("location_id"), F.lower("country").alias("country"), ((k * 37) % 170 - 85).cast("double").alias("lat"), ((k * 73) % 360 - 180).cast("double").alias("lon"))
    return st.nearest_city(points, city, 500.0)


_FOLD = "strip_accents(lower(trim({0})))"


@query("fuzzy_city", f"""WITH s AS (SELECT station_id, 0 AS o, {_FOLD.format("city")} AS own, lower(country) AS oc FROM named_station UNION ALL SELECT station_id, 1, {_FOLD.format("region")}, lower(country) FROM named_station),
  m AS (SELECT s.station_id, s.o, c.id, c.name FROM s, city c WHERE abs(length(s.own) - length(c.name)) <= 1 AND levenshtein(s.own, {_FOLD.format("c.name")}) <= 1 AND levenshtein(s.oc, lower(c.country)) <= 1),
  b AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY o, id) AS rn FROM m) SELECT n.station_id, n.city, n.region, n.country, b.id AS city_id, b.name AS city_name FROM named_station n LEFT JOIN b ON b.station_id = n.station_id AND rn = 1""", "", "named_station", "city")
def fuzzy_city(named, city):
    return st.fuzzy_city(named, city)


_DAYS = "SELECT DISTINCT location_id, date FROM {0}"


def _fire_sql(pairs: str, days: str = "place_days") -> str:
    return f"WITH pairs AS ({pairs}), s AS (SELECT location_id, date, sum(frp) AS fire_frp, count(*) AS fire_count FROM pairs GROUP BY ALL) --FINAL-- SELECT d.location_id, d.date, coalesce(fire_frp, 0) AS fire_frp, coalesce(fire_count, 0) AS fire_count FROM ({_DAYS.format(days)}) d LEFT JOIN s USING (location_id, date)"


_RECENT = "f.ts <= p.at AND f.ts > p.at - INTERVAL {0} HOUR"
_CIRCLE = f"SELECT p.location_id, p.date, f.frp, f.region, date_diff('day', CAST(f.ts AS DATE), p.date) AS age FROM place_days p JOIN fires f ON {_RECENT.format(72)} WHERE {_km('p.lat', 'p.lon', 'f.lat', 'f.lon')} <= 500"


@query("fire_circular", _fire_sql(_CIRCLE), "fire_frp", "place_days", "fires")
def fire_circular(days, fires):
    return st.fires_circular(days, fires, 500.0, 72)


_BEAR = "(degrees(atan2(sin(radians(f.lon - p.lon)) * cos(radians(f.lat)), cos(radians(p.lat)) * sin(radians(f.lat)) - sin(radians(p.lat)) * cos(radians(f.lat)) * cos(radians(f.lon - p.lon)))) + 720)"


@query("fire_oriented", _fire_sql(f"SELECT location_id, date, frp FROM (SELECT p.location_id, p.date, p.ws, f.frp, {_km('p.lat', 'p.lon', 'f.lat', 'f.lon')} AS km, abs({_BEAR} - 360 * floor({_BEAR} / 360) - p.wd) AS turn FROM place_days p JOIN fires f ON {_RECENT.format(72)}) WHERE km <= 1000 AND least(turn, 360 - turn) <= 45.5 AND km <= ws * 3.6 * 72"), "fire_frp", "place_days", "fires")
def fire_oriented(days, fires):
    return st.fires_oriented(days, fires, 45.5, 72, 1000.0)


@query("fire_trajectory", _fire_sql(f"SELECT DISTINCT p.location_id, p.date, f.ts, f.lat, f.lon, f.frp FROM traj_points p JOIN fires f ON f.ts <= p.point_ts AND f.ts > p.point_ts - INTERVAL 24 HOUR WHERE {_km('p.lat', 'p.lon', 'f.lat', 'f.lon')} <= 300", "traj_points"), "fire_frp", "traj_points", "fires")
def fire_trajectory(points, fires):
    return st.fires_trajectory(points, fires, 300.0, 24)


_REGIONS = ["click", "view", "purchase", "signup", "error"]


@query("fire_by_region", f"WITH pairs AS ({_CIRCLE}) --FINAL-- SELECT d.location_id, d.date, " + ", ".join(f"coalesce(sum(frp) FILTER (region = '{r}'), 0) AS fire_frp_{r}" for r in _REGIONS) + f" FROM ({_DAYS.format('place_days')}) d LEFT JOIN pairs USING (location_id, date) GROUP BY ALL", " ".join(f"fire_frp_{r}" for r in _REGIONS), "place_days", "fires")
def fire_by_region(days, fires):
    return st.fires_split(days, fires, _REGIONS, 500.0, 72)


@query("fire_by_age", f"WITH pairs AS ({_CIRCLE}) --FINAL-- SELECT d.location_id, d.date, " + ", ".join(f"coalesce(sum(frp) FILTER (age = {k}), 0) AS fire_frp_age{k}" for k in range(4)) + f" FROM ({_DAYS.format('place_days')}) d LEFT JOIN pairs USING (location_id, date) GROUP BY ALL", " ".join(f"fire_frp_age{k}" for k in range(4)), "place_days", "fires")
def fire_by_age(days, fires):
    return st.fires_by_age(days, fires, 500.0, 72)


@query("needs_fire", "SELECT location_id, date, coalesce((pbl_min + pbl_max) / 2, 10) AS trajs_height FROM (SELECT *, pbl_min + air_temp_max AS pbl_max FROM daily) WHERE fire_frp IS NULL", "trajs_height", "daily")
def needs_fire(daily):
    w = daily.withColumn("pbl_max", F.col("pbl_min") + F.col("air_temp_max"))
    return st.needs_fire(w).select("location_id", "date", "trajs_height")


@query("local_day_minmax", "WITH z AS (SELECT DISTINCT location_id, location_id % 11 - 5 + 0.5 AS off FROM hourly) --FINAL-- SELECT location_id, CAST(ts + INTERVAL 1 HOUR * CAST(floor(off) AS INT) AS DATE) AS date, min(blh) AS pbl_min, max(blh) AS pbl_max, avg(blh) AS pbl FROM hourly JOIN z USING (location_id) GROUP BY ALL", "pbl_min pbl_max pbl", "hourly")
def local_day_minmax(hourly):
    zones = hourly.select("location_id", (F.col("location_id") % 11 - 5 + 0.5).alias("offset_hours")).distinct()
    return agg.local_day_extremes(hourly, zones)


@query("region_daily", "SELECT source AS region, CAST(ts AS DATE) AS date, avg(t2m) AS Tair, avg(d2m) AS Qair, avg(value) AS Wind, avg(sp) AS PSurf, avg(tp) AS Rainf FROM hourly GROUP BY ALL", "Tair Qair Wind PSurf Rainf", "hourly")
def region_daily(hourly):
    return agg.region_daily(hourly.select(F.col("source").alias("region"), "ts", F.col("t2m").alias("Tair"), F.col("d2m").alias("Qair"), F.col("value").alias("Wind"), F.col("sp").alias("PSurf"), F.col("tp").alias("Rainf")))
