"""Queries over whole plans (stations, grid, boundary layer, fires, stores) and over single steps of them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import aggregates as agg
from ..operators import cleaning, effects, joins, model
from ..sources import store, tables
from . import weather as plans
from .queries_space import _BEAR, _CIRCLE, _KNN, _RECENT, _REGIONS, _km, _stations
from .queries_tables import _STATION
from .register import registrar

QUERIES, ORACLE = {}, {}
query = registrar(QUERIES, ORACLE)


def _list(template: str, names) -> str:
    return ", ".join(template.format(n) for n in names)


# ---- weather plans ---------------------------------------------------------------------------
_STATION_COLUMNS = ["air_temp_min", "air_temp_max", "atmos_pres", "wd", "ws", "ws_max", "ceil_hgt", "visibility", "precip", "RH", "RH_max"]
_KEPT = {**{c: c for c in ("air_temp_min", "air_temp_max", "atmos_pres", "wd", "ws", "ceil_hgt", "visibility", "precip")}, "RH_max": "humidity"}
_MEANS = _list("sum({0} * w) / nullif(sum(w) FILTER ({0} IS NOT NULL), 0) AS {0}", _STATION_COLUMNS)


@query("station_weather", f"WITH {_KNN}, d AS ({_STATION}), j AS (SELECT location_id, d.*, 1 / greatest(1.0, distance_km) AS w FROM knn JOIN d USING (code) WHERE rn <= 4), m AS (SELECT location_id, date, {_MEANS} FROM j GROUP BY ALL) --FINAL-- SELECT location_id, date, " + ", ".join(f"{a} AS {b}" for a, b in _KEPT.items()) + " FROM m", " ".join(_KEPT.values()), "location", "station", "station_hourly")
def station_weather(location, station, hourly):
    return plans.station_weather(location.select("location_id", "lat", "lon"), _stations(station), hourly, 1500.0)


_CELL = "round(l.lat / 4) = round(h.cell_lat / 4) AND ((CAST(round(l.lon / 4) AS BIGINT) % 90) + 90) % 90 = ((CAST(round(h.cell_lon / 4) AS BIGINT) % 90) + 90) % 90"
_WIND = "360 - ((degrees(atan2(sum(v10), sum(u10))) + 90) - 360 * floor((degrees(atan2(sum(v10), sum(u10))) + 90) / 360))"


@query("grid_weather", f"WITH d AS (SELECT cell_lat, cell_lon, CAST(ts AS DATE) AS date, avg(d2m) AS dewpoint_temp, min(t2m) - 273.15 AS air_temp_min, max(t2m) - 273.15 AS air_temp_max, avg(sp) / 100 AS atmos_pres, sum(tp) * 1000 AS precip, min(blh) AS pbl_min, max(blh) AS pbl_max, avg(sqrt(u10 * u10 + v10 * v10)) AS ws, {_WIND} AS wd FROM hourly GROUP BY ALL HAVING count(DISTINCT hour(ts)) >= 3) --FINAL-- SELECT location_id, date, dewpoint_temp, air_temp_min, air_temp_max, atmos_pres, precip, pbl_min, pbl_max, ws, wd FROM location l JOIN d h ON {_CELL}", "dewpoint_temp air_temp_min air_temp_max atmos_pres precip pbl_min pbl_max ws wd", "location", "hourly")
def grid_weather(location, hourly):
    return plans.grid_weather(location, hourly.select("cell_lat", "cell_lon", "ts", "u10", "v10", "t2m", "d2m", "sp", "tp", "blh"), 4.0, hours=3)


@query("grid_days_of_24_hours", "SELECT cell_lon, CAST(ts AS DATE) AS date, avg(sp) AS sp, sum(tp) AS tp FROM hourly GROUP BY ALL HAVING count(DISTINCT hour(ts)) = 24", "sp tp", "hourly")
def grid_days_of_24_hours(hourly):
    return agg.grid_daily(hourly.select("cell_lon", "ts", "sp", "tp"), ["cell_lon"])


_LAYERS = f"l AS (SELECT l.location_id, CAST(ts + INTERVAL 1 HOUR * CAST(floor(off) AS INT) AS DATE) AS date, min(blh) AS pbl_min, max(blh) AS pbl_max FROM hourly h JOIN (SELECT location_id, lat, lon, location_id % 11 - 5 + 0.5 AS off FROM location) l ON {_CELL} GROUP BY ALL)"


@query("boundary_layer", f"WITH {_LAYERS}, w AS (SELECT location_id, date FROM l UNION SELECT location_id, DATE '2030-01-01' FROM location) --FINAL-- SELECT location_id, date, pbl_min, pbl_max FROM w LEFT JOIN l USING (location_id, date)", "pbl_min pbl_max", "location", "hourly")
def boundary_layer(location, hourly):
    at = location.select("location_id", "lat", "lon", (F.col("location_id") % 11 - 5 + 0.5).alias("offset_hours"))
    days = plans.local_layers(at, hourly, 4.0).select("location_id", "date")
    weather = days.union(at.select("location_id", F.lit("2030-01-01").cast("date")))
    return plans.boundary_layer(weather, at, hourly, 4.0)


@query("add_fire", f"WITH pairs AS ({_CIRCLE}), s AS (SELECT location_id, date, sum(frp) AS frp, count(*) AS n FROM pairs GROUP BY ALL), w AS (SELECT DISTINCT location_id, date, CASE WHEN location_id % 3 = 0 THEN CAST(location_id AS DOUBLE) END AS fire_frp FROM place_days) --FINAL-- SELECT location_id, date, coalesce(fire_frp, frp, 0) AS fire_frp, CASE WHEN fire_frp IS NULL THEN coalesce(n, 0) END AS fire_count FROM w LEFT JOIN s USING (location_id, date)", "fire_frp", "place_days", "fires")
def add_fire(days, fires):
    weather = days.select("location_id", "date", F.when(F.col("location_id") % 3 == 0, F.col("location_id").cast("double")).alias("fire_frp")).distinct()
    return plans.add_fire(weather, days.select("location_id", "lat", "lon").distinct(), fires, buffer_km=500.0, hours=72)


_FIRE_WEATHER = "SELECT DISTINCT location_id, date, wd, ws, CASE WHEN location_id % 3 = 0 THEN CAST(location_id AS DOUBLE) END AS fire_frp FROM place_days"


def _fire_weather(days, *columns):
    return days.select("location_id", "date", *columns, F.when(F.col("location_id") % 3 == 0, F.col("location_id").cast("double")).alias("fire_frp")).distinct()


_ORIENTED = f"SELECT location_id, date, frp, region, age FROM (SELECT p.location_id, p.date, p.ws, f.frp, f.region, date_diff('day', CAST(f.ts AS DATE), p.date) AS age, {_km('p.lat', 'p.lon', 'f.lat', 'f.lon')} AS km, abs({_BEAR} - 360 * floor({_BEAR} / 360) - p.wd) AS turn FROM place_days p JOIN fires f ON {_RECENT.format(120)}) WHERE km <= 1000 AND least(turn, 360 - turn) <= 45.5 AND km <= ws * 3.6 * 120"


@query("add_fire_oriented", f"WITH pairs AS ({_ORIENTED}), s AS (SELECT location_id, date, sum(frp) AS frp, count(*) AS n FROM pairs GROUP BY ALL), w AS ({_FIRE_WEATHER}) --FINAL-- SELECT location_id, date, wd, ws, coalesce(fire_frp, frp, 0) AS fire_frp, CASE WHEN fire_frp IS NULL THEN coalesce(n, 0) END AS fire_count FROM w LEFT JOIN s USING (location_id, date)", "wd ws fire_frp", "place_days", "fires")
def add_fire_oriented(days, fires):
    return plans.add_fire(_fire_weather(days, "wd", "ws"), days.select("location_id", "lat", "lon").distinct(), fires, "oriented", buffer_km=1000.0, half_angle=45.5)


_ALONG = f"SELECT location_id, date, frp, region, date_diff('day', CAST(ts AS DATE), date) AS age FROM (SELECT DISTINCT p.location_id, p.date, f.ts, f.lat, f.lon, f.frp, f.region FROM traj_points p JOIN fires f ON f.ts <= p.point_ts AND f.ts > p.point_ts - INTERVAL 24 HOUR WHERE {_km('p.lat', 'p.lon', 'f.lat', 'f.lon')} <= 300)"


@query("add_fire_trajectory", f"WITH pairs AS ({_ALONG}), s AS (SELECT location_id, date, sum(frp) AS fire_frp, count(*) AS fire_count FROM pairs GROUP BY ALL), w AS (SELECT DISTINCT location_id, date FROM traj_points) --FINAL-- SELECT location_id, date, coalesce(fire_frp, 0) AS fire_frp, coalesce(fire_count, 0) AS fire_count FROM w LEFT JOIN s USING (location_id, date)", "fire_frp", "traj_points", "fires")
def add_fire_trajectory(points, fires):
    weather = points.select("location_id", "date").distinct()
    locations = weather.select("location_id", F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon")).distinct()
    # trajectories of two heights: those of 10 m are next to the default
    both = points.withColumn("height", F.lit(10.0)).unionByName(points.withColumn("height", F.lit(500.0)).withColumn("lat", -F.col("lat")))
    return plans.add_fire(weather, locations, fires, points=both, buffer_km=300.0)


_SPLIT = [f"fire_{what}{name}" for name in ("", *(f"_{r}" for r in _REGIONS)) for what in ("frp", "count")]


@query("add_fire_by_region", f"WITH pairs AS ({_CIRCLE}) --FINAL-- SELECT d.location_id, d.date, coalesce(sum(frp), 0) AS fire_frp, count(frp) AS fire_count, " + ", ".join(f"coalesce(sum(frp) FILTER (region = '{r}'), 0) AS fire_frp_{r}, count(*) FILTER (region = '{r}') AS fire_count_{r}" for r in _REGIONS) + " FROM (SELECT DISTINCT location_id, date FROM place_days) d LEFT JOIN pairs USING (location_id, date) GROUP BY ALL", " ".join(c for c in _SPLIT if "frp" in c), "place_days", "fires")
def add_fire_by_region(days, fires):
    """What a first call computes goes to the store; the second takes all of it from there."""
    weather, at = days.select("location_id", "date").distinct(), days.select("location_id", "lat", "lon").distinct()
    cache = store.Store(days.sparkSession, f"{store.scratch(days.sparkSession)}/fires-{uuid.uuid4().hex}", plans.FIRE_KEY, buckets=4)
    options = {"mode": "circular", "buffer_km": 500.0, "hours": 72, "regions": tuple(_REGIONS), "cache": cache}
    plans.add_fire(weather, at, fires, save=True, **options)
    return plans.add_fire(weather, at, fires.limit(0), **options)


@query("add_fire_by_age", f"WITH pairs AS ({_ORIENTED}) --FINAL-- SELECT d.location_id, d.date, coalesce(sum(frp), 0) AS fire_frp, count(frp) AS fire_count, " + ", ".join(f"coalesce(sum(frp) FILTER (age = {k}), 0) AS fire_frp_age{k}, count(*) FILTER (age = {k}) AS fire_count_age{k}" for k in range(6)) + " FROM (SELECT DISTINCT location_id, date FROM place_days) d LEFT JOIN pairs USING (location_id, date) GROUP BY ALL", "fire_frp " + " ".join(f"fire_frp_age{k}" for k in range(6)), "place_days", "fires")
def add_fire_by_age(days, fires):
    weather = days.select("location_id", "date", "wd", "ws").distinct()
    return plans.add_fire(weather, days.select("location_id", "lat", "lon").distinct(), fires, "oriented", buffer_km=1000.0, half_angle=45.5, by_age=True).drop("wd", "ws")


@query("add_cached_fire", "WITH w AS (SELECT DISTINCT location_id, date FROM traj_points) --FINAL-- SELECT location_id, date, CASE WHEN location_id % 2 = 0 THEN 7.0 END AS fire_frp FROM w", "fire_frp", "traj_points")
def add_cached_fire(points):
    days = points.select("location_id", "date").distinct()
    cached = days.filter("location_id % 2 = 0").select("location_id", "date", F.lit(7.0).alias("fire_frp"), F.lit(1).alias("fire_count"))
    return plans.with_cached_fire(days, cached).drop("fire_count")


@query("sunshine", "WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS date, dayofyear(ts) AS j FROM fires), g AS (SELECT location_id, radians(lat) AS phi FROM location), x AS (SELECT location_id, date, phi, 1 + 0.033 * cos(2 * pi() / 365 * j) AS dr, 0.409 * sin(2 * pi() / 365 * j - 1.39) AS dec FROM d, g), s AS (SELECT *, acos(greatest(-1.0, least(1.0, -tan(phi) * tan(dec)))) AS ws FROM x) --FINAL-- SELECT location_id, date, 24 * 60 / pi() * 0.0820 * dr * (ws * sin(phi) * sin(dec) + cos(phi) * cos(dec) * sin(ws)) AS sunshine FROM s", "sunshine", "fires", "location")
def sunshine(fires, location):
    return plans.sunshine(location, fires.select(F.to_date("ts").alias("date")))


_SUN = "24 * 60 / pi() * 0.0820 * dr * (sunset * sin(phi) * sin(dec) + cos(phi) * cos(dec) * sin(sunset))"


@query("collect_weather", f"""WITH {_KNN}, d AS ({_STATION}), j AS (SELECT location_id, d.*, 1 / greatest(1.0, distance_km) AS w FROM knn JOIN d USING (code) WHERE rn <= 4), st AS (SELECT location_id, date, {_MEANS} FROM j GROUP BY ALL), dd AS (SELECT DISTINCT date FROM st),
  n AS (SELECT location_id, count(air_temp_min) / (SELECT count(*) FROM dd) AS s1, count(precip) / (SELECT count(*) FROM dd) AS s2 FROM st GROUP BY 1),
  g AS (SELECT location_id, date, radians(lat) AS phi, 1 + 0.033 * cos(2 * pi() / 365 * dayofyear(date)) AS dr, 0.409 * sin(2 * pi() / 365 * dayofyear(date) - 1.39) AS dec FROM location, dd), x AS (SELECT *, acos(greatest(-1.0, least(1.0, -tan(phi) * tan(dec)))) AS sunset FROM g)
  --FINAL-- SELECT location_id, date, CASE WHEN s1 >= 0.5 THEN air_temp_min END AS air_temp_min, CASE WHEN s2 >= 0.5 THEN precip END AS precip, {_SUN} AS sunshine FROM x LEFT JOIN st USING (location_id, date) LEFT JOIN n USING (location_id)""", "air_temp_min precip sunshine", "location", "station", "station_hourly")
def collect_weather(location, station, hourly):
    return plans.collect_weather(location.select("location_id", "lat", "lon"), ["air_temp_min", "precip", "sunshine"], _stations(station), hourly, add_sunshine=True, km=1500.0)


_WHOLE = ["air_temp_min", "air_temp_max", "precip", "ws", "pbl_min", "pbl_max"]
_GRID_DAY = "g AS (SELECT location_id, date, t0 AS air_temp_min, t1 AS air_temp_max, tp AS precip, ws FROM location l JOIN (SELECT round(cell_lat / 4) * 4 AS cell_lat, round(cell_lon / 4) * 4 AS cell_lon, CAST(ts AS DATE) AS date, min(t2m) - 273.15 AS t0, max(t2m) - 273.15 AS t1, sum(tp) * 1000 AS tp, avg(sqrt(u10 * u10 + v10 * v10)) AS ws FROM hourly GROUP BY ALL HAVING count(DISTINCT hour(ts)) >= 2) h ON {0})"


@query("collect_weather_of_all_sources", f"""WITH {_KNN}, d AS ({_STATION}), j AS (SELECT location_id, d.*, 1 / greatest(1.0, distance_km) AS w FROM knn JOIN d USING (code) WHERE rn <= 4), st AS (SELECT location_id, date, {_MEANS} FROM j GROUP BY ALL), {_GRID_DAY.format(_CELL)}, {_LAYERS},
  dd AS (SELECT DISTINCT date FROM (SELECT date FROM st UNION ALL SELECT date FROM g)), total AS (SELECT count(*) AS n FROM dd),
  u AS (SELECT location_id, date, {_list("g.{0} AS g_{0}, st.{0} AS s_{0}", _WHOLE[:4])}, g.location_id IS NOT NULL AS in_g, st.location_id IS NOT NULL AS in_s FROM g FULL JOIN st USING (location_id, date)),
  n AS (SELECT location_id, {_list("count(g_{0}) / (SELECT n FROM total) >= 0.25 AS gok_{0}, count(s_{0}) / (SELECT n FROM total) >= 0.25 AS sok_{0}", _WHOLE[:4])} FROM u GROUP BY 1),
  c AS (SELECT location_id, date, {_list("CASE WHEN gok_{0} THEN g_{0} WHEN sok_{0} THEN s_{0} END AS {0}", _WHOLE[:4])} FROM u JOIN n USING (location_id) WHERE {" OR ".join(f"(CASE WHEN gok_{v} THEN in_g WHEN sok_{v} THEN in_s ELSE false END)" for v in _WHOLE[:4])})
  --FINAL-- SELECT location_id, date, {", ".join(_WHOLE)} FROM c LEFT JOIN l USING (location_id, date)""", " ".join(_WHOLE), "location", "station", "station_hourly", "hourly")
def collect_weather_of_all_sources(location, station, station_hourly, hourly):
    at = location.select("location_id", "lat", "lon", (F.col("location_id") % 11 - 5 + 0.5).alias("offset_hours"))
    grid = hourly.select((F.round(F.col("cell_lat") / 4) * 4).alias("cell_lat"), (F.round(F.col("cell_lon") / 4) * 4).alias("cell_lon"), "ts", "u10", "v10", "t2m", "d2m", "sp", "tp")
    layers = hourly.select("cell_lat", "cell_lon", "ts", "blh")
    path = f"{store.scratch(location.sparkSession)}/weather-{uuid.uuid4().hex}"
    arguments = {"stations": _stations(station), "station_hourly": station_hourly, "grid_hourly": grid, "step": 4.0, "km": 1500.0, "layers_hourly": layers, "save_to": path, "grid_hours": 2, "least": 0.25}
    plans.collect_weather(at, _WHOLE, **arguments)
    return plans.collect_weather(at, _WHOLE, **arguments)  # from the snapshot


_TURN = "degrees(atan2(sum(ws * sin(radians(wd))), sum(ws * cos(radians(wd))))) + 360"


@query("station_wind_round_the_circle", f"SELECT code, CAST(ts AS DATE) AS date, CAST(round(({_TURN}) - 360 * floor(({_TURN}) / 360), 4) AS DOUBLE) AS wd FROM station_hourly GROUP BY ALL", "wd", "station_hourly")
def station_wind_round_the_circle(hourly):
    return agg.station_daily(hourly, circular=True).select("code", "date", F.round("wd", 4).alias("wd"))


# ---- sources ---------------------------------------------------------------------------------
@query("hours_between", "SELECT event_id, location_id FROM hourly WHERE ts >= TIMESTAMP '2024-01-09 10:00:00' AND ts <= TIMESTAMP '2024-01-13 11:00:00'", "", "hourly")
def hours_between(hourly):
    return tables.hours_between(hourly, "2024-01-10", "2024-01-12").select("event_id", "location_id")


@query("location_scan", "SELECT DISTINCT location_id, CAST(nationkey AS VARCHAR) AS country, lat, lon, DATE '2020-01-01' AS date_from, DATE '2020-12-31' AS date_to FROM location", "lat lon", "location")
def location_scan(location):
    named = location.withColumn("country", F.col("nationkey").cast("string"))
    return tables.required(tables.locations(named.union(named), "2020-01-01", "2020-12-31"), "locations")


@query("station_catalogue", "SELECT CAST(code AS VARCHAR) || '-' || name AS code, CAST(unnest(range(2018, year(end_date) + 1)) AS INT) AS year FROM station", "", "station")
def station_catalogue(station):
    dated = station.select(F.col("code").cast("string").alias("usaf"), F.col("name").alias("wban"), F.lit("2018-05-01").cast("date").alias("begin"), F.col("end_date").alias("end"))
    return tables.station_catalogue(dated).select("code", "year")


@query("years_to_read", "WITH y AS (SELECT code, CAST(unnest(range(2018, year(end_date) + 1)) AS INT) AS year FROM station) SELECT code, year FROM y WHERE year >= 2023 OR code % 4 > 0", "", "station")
def years_to_read(station):
    dated = station.select("code", F.lit("2018-05-01").cast("date").alias("begin"), F.col("end_date").alias("end"))
    cached = joins.years_to_read(dated, dated.select("code", F.lit(0).alias("year")).limit(0), 9999).filter("code % 4 = 0")
    return joins.years_to_read(dated, cached, stale_since=2023)


@query("date_in_name", "SELECT DISTINCT date AS found, 'w/era_' || CAST(date AS VARCHAR) || '.nc' AS path FROM meas UNION ALL SELECT NULL, 'w/era_today.nc'", "", "meas")
def date_in_name(meas):
    paths = meas.select(F.concat(F.lit("w/era_"), F.col("date").cast("string"), F.lit(".nc")).alias("path")).distinct()
    paths = paths.union(paths.limit(1).select(F.lit("w/era_today.nc")))
    return paths.select("path", fn.date_in_name(F.col("path")).alias("found"))


@query("daily_store", "SELECT location_id, date, CASE WHEN month(date) = 7 THEN value + 1 ELSE value END AS value FROM (SELECT location_id, date, avg(value) AS value FROM meas GROUP BY ALL) WHERE year(date) = 1997 AND month(date) IN (6, 7)", "value", "meas")
def daily_store(meas):
    daily = meas.groupBy("location_id", "date").agg(F.avg("value").alias("value")).withColumn("month", F.trunc("date", "MM"))
    path = f"{store.scratch(meas.sparkSession)}/daily-{uuid.uuid4().hex}"
    tables.write_daily(daily, path, "month")
    tables.write_daily(daily.filter("month(date) = 7").withColumn("value", F.col("value") + 1), path, "month")
    return tables.read_daily(meas.sparkSession, path, ["1997-06-01", "1997-07-01", "1890-01-01"], "month").drop("month")


_STORED = "old AS (SELECT location_id, poll, date, avg(value) AS value FROM meas GROUP BY ALL), new AS (SELECT location_id, poll, date, value + 1 AS value FROM old WHERE location_id % 7 = 0 AND month(date) = 3), kept AS (SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.location_id = old.location_id AND new.poll = old.poll AND new.date = old.date) UNION ALL SELECT * FROM new)"


def _filled(meas):
    s = store.Store(meas.sparkSession, f"{store.scratch(meas.sparkSession)}/store-{uuid.uuid4().hex}", ["location_id", "poll", "date"], buckets=8)
    old = meas.groupBy("location_id", "poll", "date").agg(F.avg("value").alias("value"))
    s.put(old)
    s.put(old.filter("location_id % 7 = 0 AND month(date) = 3").withColumn("value", F.col("value") + 1))
    return s


@query("store_put_and_find", f"WITH {_STORED} --FINAL-- SELECT * FROM kept WHERE poll = 'no2'", "value", "meas")
def store_put_and_find(meas):
    return _filled(meas).find(poll="no2", location_id=None)


@query("store_remove", f"WITH {_STORED} --FINAL-- SELECT * FROM kept WHERE poll <> 'pm25'", "value", "meas")
def store_remove(meas):
    s = _filled(meas)
    s.remove(poll="pm25")
    return s.read()


@query("store_apply", f"WITH {_STORED} --FINAL-- SELECT location_id, poll, date, CASE WHEN poll = 'o3' THEN value - first_value(value) OVER (PARTITION BY location_id, poll ORDER BY date) ELSE value END AS value FROM kept", "value", "meas")
def store_apply(meas):
    s = _filled(meas)

    def from_first(pdf):
        pdf = pdf.sort_values("date")
        return pdf.assign(value=pdf["value"] - pdf["value"].iloc[0])

    s.apply(from_first, poll="o3")
    return s.read()


@query("store_keys", f"WITH {_STORED} SELECT DISTINCT location_id, poll, date FROM kept", "", "meas")
def store_keys(meas):
    return _filled(meas).keys()


@query("store_purge", f"WITH {_STORED} --FINAL-- SELECT location_id, poll, date, CASE WHEN value > 50 THEN value END AS value FROM kept WHERE value > 50", "value", "meas")
def store_purge(meas):
    s = _filled(meas)
    s.put(s.read().withColumn("value", F.when(F.col("value") > 50, F.col("value"))))
    s.purge(["value"])
    return s.read()


# ---- steps -----------------------------------------------------------------------------------
@query("date_inclusion", "SELECT location_id, date, observed FROM obs_pred WHERE date IN (SELECT date FROM obs_pred WHERE observed > 100000)", "observed", "obs_pred")
def date_inclusion(df):
    return joins.in_dates(df.select("location_id", "date", "observed"), df.filter("observed > 100000"))


@query("lookup_names", "SELECT location_id, nationkey, n.region FROM location LEFT JOIN (SELECT DISTINCT nationkey, 'r' || (nationkey % 3) AS region FROM location WHERE nationkey < 20) n USING (nationkey)", "", "location")
def lookup_names(location):
    names = location.filter("nationkey < 20").select("nationkey", F.concat(F.lit("r"), F.col("nationkey") % 3).alias("region")).distinct()
    return joins.lookup(location.select("location_id", "nationkey"), names, ["nationkey"])


@query("union_distinct", "SELECT location_id FROM location WHERE location_id % 3 = 0 UNION SELECT location_id FROM place_days", "", "location", "place_days")
def union_distinct(location, days):
    return joins.union_distinct([location.filter("location_id % 3 = 0").select("location_id"), days.select("location_id")], ["location_id"])


@query("fit_rows", "SELECT location_id, date, air_temp_min FROM daily WHERE year(date) < 1997 AND air_temp_min IS NOT NULL", "air_temp_min", "daily")
def fit_rows(daily):
    named = daily.withColumn("set", F.when(F.year("date") < 1997, "training").otherwise("testing"))
    spoilt = named.withColumn("air_temp_min", F.coalesce("air_temp_min", F.lit(float("nan"))))
    return cleaning.fit_rows(spoilt, "air_temp_min").select("location_id", "date", "air_temp_min")


_MONTHLY = "WITH m AS (SELECT location_id, CAST(date_trunc('month', date) AS DATE) AS date, avg(value) AS value FROM daily GROUP BY ALL), e AS (SELECT location_id, min(date) AS a, max(date) AS b FROM m GROUP BY 1), spine AS (SELECT location_id, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS date FROM e), f AS (SELECT * FROM spine LEFT JOIN m USING (location_id, date)), c AS (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS mean FROM f WINDOW w AS (PARTITION BY location_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"


@query("rolling_months", _MONTHLY + " --FINAL-- SELECT location_id, date, CASE WHEN n = 3 THEN mean END AS value FROM c", "value", "daily")
def rolling_months(daily):
    return cleaning.rolling_mean(daily.select("location_id", "date", "value"), ["location_id"], width=3, unit="month")


@query("rolling_text", "WITH t AS (SELECT location_id, CAST(date_trunc('week', date) AS DATE) AS date, CASE WHEN wd < 180 THEN 'east' ELSE 'west' END AS side FROM daily WHERE wd IS NOT NULL), n AS (SELECT location_id, date, CASE WHEN count(*) FILTER (side = 'east') >= count(*) FILTER (side = 'west') THEN 'east' ELSE 'west' END AS side FROM t GROUP BY ALL), e AS (SELECT location_id, min(date) AS a, max(date) AS b FROM n GROUP BY 1), f AS (SELECT s.location_id, s.date, side FROM (SELECT location_id, CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS date FROM e) s LEFT JOIN n USING (location_id, date)), c AS (SELECT *, count(*) OVER w AS k, count(*) FILTER (side = 'east') OVER w AS east, count(*) FILTER (side = 'west') OVER w AS west FROM f WINDOW w AS (PARTITION BY location_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) SELECT location_id, date, CASE WHEN k < 4 OR east + west = 0 THEN NULL WHEN east >= west THEN 'east' ELSE 'west' END AS side FROM c", "", "daily")
def rolling_text(daily):
    sides = daily.filter("wd IS NOT NULL").select("location_id", "date", F.when(F.col("wd") < 180, "east").otherwise("west").alias("side"))
    return cleaning.rolling_mean(sides, ["location_id"], "side", width=4, unit="week")


@query("utc_hours_of_local_day", "WITH d AS (SELECT DISTINCT CAST('2024-03-29' AS DATE) + CAST(location_id % 5 AS INT) AS date FROM location), b AS (SELECT date, (CAST(date AS TIMESTAMP) AT TIME ZONE 'Europe/Paris') AT TIME ZONE 'UTC' AS a, (CAST(date + 1 AS TIMESTAMP) AT TIME ZONE 'Europe/Paris') AT TIME ZONE 'UTC' AS z FROM d) SELECT date, strftime(unnest(range(a, z, INTERVAL 1 HOUR)), '%Y-%m-%d %H') AS hour FROM b", "", "location")
def utc_hours_of_local_day(location):
    days = location.select(F.date_add(F.lit("2024-03-29").cast("date"), (F.col("location_id") % 5).cast("int")).alias("date")).distinct()
    hours = fn.utc_hours_of_local_day(F.col("date"), F.lit("Europe/Paris"))
    return days.select("date", F.explode(F.transform(hours, lambda h: F.date_format(h, "yyyy-MM-dd HH"))).alias("hour"))


@query("hour_features", "SELECT event_id, CAST(hour(ts) AS INT) AS hour, CAST(hour((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Kolkata') AS INT) AS hour_local FROM hourly", "", "hourly")
def hour_features(hourly):
    return fn.hour_features(hourly, "ts", "Asia/Kolkata").select("event_id", "hour", "hour_local")


@query("comma_keys", "SELECT location_id, coalesce(array_to_string(list_sort(list(DISTINCT poll)), ','), 'none') AS polls FROM meas GROUP BY 1", "", "meas")
def comma_keys(meas):
    return meas.groupBy("location_id").agg(F.collect_list("poll").alias("p")).select("location_id", fn.comma_key(F.col("p")).alias("polls"))


@query("config_signatures", """SELECT DISTINCT poll, '{"engine":"gbm","lag":1,"output":"' || poll || '","time_vars":["date_unix","yday"],"weather_vars":["' || source || '","precip"]}' AS signature FROM meas""", "", "meas")
def config_signatures(meas):
    c = meas.select("poll", "source").distinct()
    return c.select("poll", fn.config_signature(F.col("poll"), F.lit("gbm"), F.lit(1), F.array(F.lit("precip"), F.col("source")), F.array(F.lit("yday"), F.lit("date_unix"))).alias("signature"))


_GAINS = "g AS (SELECT location_id, 0 AS config_id, CAST(month(date) % 2 AS INT) AS replicate, unnest(['ws', 'ws_lag1', 'precip', 'precip_lag12']) AS variable, unnest([avg(observed), avg(predicted), avg(trend), min(observed)]) AS influence FROM obs_pred GROUP BY 1, 3)"


@query("importance_of_variables", f"WITH {_GAINS}, p AS (SELECT location_id, replicate, regexp_replace(variable, '_lag[0-9]+$', '') AS variable, sum(influence) AS influence FROM g GROUP BY ALL) --FINAL-- SELECT variable, median(influence) AS median_influence, sum(influence) AS total_influence FROM p GROUP BY 1", "median_influence total_influence", "obs_pred")
def importance_of_variables(df):
    means = df.groupBy("location_id", F.lit(0).alias("config_id"), (F.month("date") % 2).alias("replicate")).agg(F.avg("observed").alias("ws"), F.avg("predicted").alias("ws_lag1"), F.avg("trend").alias("precip"), F.min("observed").alias("precip_lag12"))
    long = means.unpivot(["location_id", "config_id", "replicate"], ["ws", "ws_lag1", "precip", "precip_lag12"], "variable", "influence")
    return agg.importance_summary(long)


@query("counterfactual_mean", "SELECT location_id, date, avg(observed) FILTER (r = 0) AS predicted_nofire, avg(trend) AS \"predicted_nofire_X\" FROM (SELECT *, unnest([0, 1]) AS r FROM obs_pred) GROUP BY ALL", "predicted_nofire predicted_nofire_X", "obs_pred")
def counterfactual_mean(df):
    copies = df.withColumn("replicate", F.explode(F.array(F.lit(0), F.lit(1))))
    one = copies.select("location_id", "date", F.lit("predicted_nofire").alias("scenario"), F.when(F.col("replicate") == 0, F.col("observed")).alias("predicted"))
    two = copies.select("location_id", "date", F.lit("predicted_nofire_X").alias("scenario"), F.col("trend").alias("predicted"))
    return effects.counterfactual_mean(one.union(two), ["location_id"], ["predicted_nofire", "predicted_nofire_X"])


@query("anomaly_of_replicates", "WITH r AS (SELECT location_id, date, observed, predicted + unnest([-3.0, 0.0, 9.0]) AS predicted FROM obs_pred) --FINAL-- SELECT location_id, date, observed, avg(predicted) AS predicted, quantile_cont(predicted, 0.025) AS predicted_p025, quantile_cont(predicted, 0.975) AS predicted_p975, observed - avg(predicted) AS anomaly FROM r GROUP BY location_id, date, observed", "observed predicted predicted_p025 predicted_p975 anomaly", "obs_pred", dealt=True)
def anomaly_of_replicates(df):
    replicates = df.select("location_id", "date", F.col("observed").alias("value"), "predicted", F.explode(F.array(F.lit(-3.0), F.lit(0.0), F.lit(9.0))).alias("d"))
    return effects.anomaly(replicates.withColumn("predicted", F.col("predicted") + F.col("d")).drop("d"), ["location_id"])


@query("model_lists", "SELECT location_id, count(DISTINCT year(date)) AS n, CAST(min(year(date)) AS INT) AS first FROM obs_pred GROUP BY 1", "", "obs_pred")
def model_lists(df):
    models = df.select("location_id", F.lit(0).alias("config_id"), F.year("date").alias("replicate"), F.lit(1).alias("n_trees_opt"), F.lit("{}").alias("model")).distinct()
    return agg.collect_replicates(models, ["location_id"]).select("location_id", F.size("models").cast("long").alias("n"), F.col("models")[0]["replicate"].alias("first"))


@query("untrainable", "SELECT location_id FROM daily GROUP BY 1 HAVING count(*) FILTER (year(date) < 1993) = 0", "", "daily")
def untrainable(daily):
    return model.untrainable(daily.withColumn("set", F.when(F.year("date") < 1993, "training").otherwise("testing")), ["location_id"])


@query("top_rows", "SELECT location_id, date, observed FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY observed DESC, date) AS rn FROM obs_pred) WHERE rn <= 3", "observed", "obs_pred")
def top_rows(df):
    return agg.top_n(df.select("location_id", "date", "observed"), ["location_id"], [F.desc("observed"), F.col("date")], 3)
