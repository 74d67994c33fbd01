"""Views over the driver's tables, in SQL that both Spark and DuckDB read: series, weather, places, fires."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    # daily pollutant values; several rows a day, gaps, a third of the rows of one pollutant
    "meas": """SELECT l_suppkey AS location_id, CASE l_returnflag WHEN 'A' THEN 'pm25' WHEN 'N' THEN 'no2' ELSE 'o3' END AS poll, 'ug/m3' AS unit,
        CASE WHEN l_linestatus = 'O' THEN 'net1' ELSE 'net2' END AS source, 'UTC' AS timezone, 'daily' AS process_id, 'XX' AS country,
        CAST(l_shipdate AS DATE) AS date, l_extendedprice / 1000 AS value FROM lineitem""",
    # a prepared-series input: daily weather with missing values
    "daily": """SELECT l_suppkey AS location_id, CAST(l_shipdate AS DATE) AS date, AVG(l_extendedprice) / 1000 AS value,
        CAST((SUM(l_partkey) * 7) % 361 AS DOUBLE) AS wd, AVG(l_quantity) / 5 AS ws,
        CASE WHEN SUM(l_orderkey) % 7 = 0 THEN NULL ELSE AVG(l_tax) * 100 END AS precip,
        CASE WHEN SUM(l_partkey) % 5 = 0 THEN NULL ELSE 1000 + AVG(l_discount) * 100 END AS atmos_pres,
        CASE WHEN SUM(l_orderkey) % 4 = 0 THEN NULL ELSE AVG(l_quantity) - 10 END AS air_temp_min,
        CASE WHEN SUM(l_orderkey) % 4 = 1 THEN NULL ELSE AVG(l_quantity) END AS air_temp_max,
        CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE AVG(l_discount) * 1000 END AS pbl_min,
        CASE WHEN SUM(l_partkey) % 3 = 0 THEN NULL ELSE AVG(l_tax) * 50 END AS fire_frp
        FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    # hourly values of many cells or stations
    "hourly": """SELECT CAST(user_id % 20 AS INT) AS location_id, CAST(user_id % 20 AS DOUBLE) AS cell_lat, CAST(user_id % 7 AS DOUBLE) AS cell_lon, event_id, ts, event_type AS source,
        value, value * COS(event_id) AS u10, value * SIN(event_id) AS v10, 280 + value / 10 AS t2m, 275 + value / 20 AS d2m, 100000 + value AS sp, value / 1e5 AS tp, value * 3 AS blh FROM events""",
    "station_hourly": """SELECT CAST(user_id % 40 AS INT) AS code, ts, value / 10 AS air_temp, 1000 + value / 50 AS atmos_pres, CAST(event_id % 360 AS DOUBLE) AS wd,
        CASE WHEN event_id % 11 = 0 THEN NULL ELSE value / 20 END AS ws, value * 10 AS ceil_hgt, value * 20 AS visibility,
        CASE WHEN event_id % 9 = 0 THEN NULL ELSE value / 100 END AS precip, CAST(event_id % 100 AS DOUBLE) AS RH FROM events""",
    "station": """SELECT CAST(s_suppkey AS INT) AS code, s_name AS name, CAST((s_suppkey * 37) % 170 - 85 AS DOUBLE) AS r_lat, CAST((s_suppkey * 73) % 360 - 180 AS DOUBLE) AS r_lon,
        CASE WHEN s_suppkey % 5 = 0 THEN DATE '2019-06-30' WHEN s_suppkey % 5 = 1 THEN DATE '2021-03-31' ELSE DATE '2023-12-31' END AS end_date, s_nationkey AS nationkey FROM supplier""",
    "location": """SELECT c_custkey AS location_id, c_name AS name, CAST((c_custkey * 53) % 170 - 85 AS DOUBLE) AS lat, CAST((c_custkey * 97) % 360 - 180 AS DOUBLE) AS lon,
        c_nationkey AS nationkey FROM customer""",
    "fires": """SELECT ts, CAST((event_id * 37) % 170 - 85 AS DOUBLE) AS lat, CAST((event_id * 73) % 360 - 180 AS DOUBLE) AS lon, value AS frp, event_type AS region FROM events""",
    # days on which a place asks for the fires around it
    "place_days": """SELECT s_suppkey AS location_id, CAST((s_suppkey * 37) % 170 - 85 AS DOUBLE) AS lat, CAST((s_suppkey * 73) % 360 - 180 AS DOUBLE) AS lon, d.date, CAST(d.date AS TIMESTAMP) AS at,
        CAST((s_suppkey * 31) % 360 AS DOUBLE) AS wd, CAST(s_suppkey % 9 AS DOUBLE) AS ws FROM supplier CROSS JOIN (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events) d""",
    "traj_points": """SELECT CAST(user_id AS BIGINT) AS location_id, CAST(ts AS DATE) AS date, ts AS point_ts, CAST((event_id * 41) % 170 - 85 AS DOUBLE) AS lat, CAST((event_id * 61) % 360 - 180 AS DOUBLE) AS lon FROM events""",
    # observed and predicted values by day
    "obs_pred": """SELECT l_suppkey AS location_id, CAST(l_shipdate AS DATE) AS date, AVG(l_extendedprice) AS observed, AVG(l_quantity * 1000) AS predicted, AVG(l_quantity * 900 + l_tax * 100) AS trend
        FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    # station and city names with accents and one edit
    "city": """SELECT c_custkey AS id, LOWER(c_name) AS name, CASE WHEN c_custkey % 3 = 0 THEN 'france' ELSE 'germany' END AS country, CAST((c_custkey * 53) % 170 - 85 AS DOUBLE) AS lat, CAST((c_custkey * 97) % 360 - 180 AS DOUBLE) AS lon FROM customer""",
    "named_station": """SELECT s_suppkey AS station_id, CASE WHEN s_suppkey % 2 = 0 THEN CONCAT('Cùstomer#', SUBSTR(s_name, 10)) ELSE s_name END AS city, CONCAT('customer#', SUBSTR(s_name, 11)) AS region,
        CASE WHEN s_suppkey % 3 = 0 THEN 'France' ELSE 'Germany' END AS country FROM supplier""",
}


#: Views that sum up a large table: the table, and what its rows are grouped by (by series only, where steps by series follow).
GROUPED = {"obs_pred": ("lineitem", ("l_suppkey", "CAST(l_shipdate AS DATE)")), "daily": ("lineitem", ("l_suppkey",))}


def view(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> DataFrame:
    """A view over the tables of one folder. Where ``dealt``, a table that it sums up (``GROUPED``) is shuffled by the groups
    first, into parts that follow the table's bytes: the view and groupings of its rows then need no other shuffle."""
    large, by = GROUPED.get(name, (None, ())) if dealt else (None, ())
    for t in TABLES:
        if t in VIEWS[name]:
            rows = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            (spread(rows, *map(F.expr, by)) if t == large else rows).createOrReplaceTempView(t)
    return spark.sql(VIEWS[name])


def sql(body: str, *names: str) -> str:
    """DuckDB SQL with the views that it uses in front."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = body.strip()
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
