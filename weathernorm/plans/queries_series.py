"""Queries over series: cleaning, filling, lags, rolling means, weather joins, sources, splits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.columns import season, weekday_number
from ..operators import aggregates as agg
from ..operators import cleaning, joins, model
from ..sources import store, tables
from . import weather as weather_plans
from .prep import prep_data
from .refresh import refresh
from .register import registrar

QUERIES, ORACLE = {}, {}
query = registrar(QUERIES, ORACLE)


KEY = ["location_id"]
VARS = ["wd", "ws", "precip", "atmos_pres", "air_temp_min", "air_temp_max", "pbl_min", "fire_frp"]
_BENT, _ZERO = ["atmos_pres", "air_temp_min", "air_temp_max", "pbl_min"], ["precip", "fire_frp"]

# outliers: one-sided, on 1.4826 x the median deviation; a deviation of 0 keeps all
_MAD = """med AS (SELECT location_id, median(value) AS m FROM daily WHERE value IS NOT NULL GROUP BY 1),
  dev AS (SELECT d.*, value - m AS off FROM daily d JOIN med USING (location_id) WHERE value IS NOT NULL),
  lim AS (SELECT location_id, 1.4826 * median(abs(off)) AS mad FROM dev GROUP BY 1),
  cleaned AS (SELECT dev.* EXCLUDE (off) FROM dev JOIN lim USING (location_id) WHERE (mad = 0 OR off < {times} * mad) AND date IS NOT NULL)"""


@query("mad_filter", "WITH " + _MAD.format(times=2) + " --FINAL-- SELECT location_id, date, value FROM cleaned", "value", "daily")
def mad_filter(daily):
    return cleaning.drop_outliers(daily, KEY, times=2.0).select("location_id", "date", "value")


def _filled_sql(source: str) -> str:
    """Fill rules as SQL: interpolation between neighbours over at most five rows, zeros, empty columns."""
    ends = ", ".join(f"last_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS pr_{c}, last_value({c} IGNORE NULLS) OVER b AS pv_{c}, last_value(CASE WHEN {c} IS NOT NULL THEN t END IGNORE NULLS) OVER b AS pt_{c}, first_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER a AS qr_{c}, first_value({c} IGNORE NULLS) OVER a AS qv_{c}, first_value(CASE WHEN {c} IS NOT NULL THEN t END IGNORE NULLS) OVER a AS qt_{c}" for c in _BENT)
    seen = ", ".join(f"count({c}) OVER (PARTITION BY location_id) AS n_{c}" for c in VARS)
    out = []
    for c in VARS:
        v = c
        if c in _BENT:
            v = f"coalesce({c}, CASE WHEN qr_{c} - pr_{c} - 1 <= 5 THEN pv_{c} + (qv_{c} - pv_{c}) * (t - pt_{c}) / (qt_{c} - pt_{c}) END)"
        elif c in _ZERO:
            v = f"coalesce({c}, 0)"
        out.append(f"CASE WHEN n_{c} = 0 THEN 0 ELSE {v} END AS {c}")
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY date) AS rn, CAST(date - DATE '1970-01-01' AS DOUBLE) AS t FROM {source}),
  ends AS (SELECT *, {ends}, {seen} FROM numbered WINDOW b AS (PARTITION BY location_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY location_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  filled AS (SELECT location_id, date, value, {", ".join(out)} FROM ends)"""


@query("fill_and_interpolate", "WITH " + _filled_sql("daily") + " --FINAL-- SELECT * FROM filled", "value " + " ".join(VARS), "daily")
def fill_and_interpolate(daily):
    return cleaning.fill_series(daily, KEY, VARS)


_SPINE = "ends_{0} AS (SELECT location_id, min(date) AS a, max(date) AS b FROM {0} GROUP BY 1), spine AS (SELECT location_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM ends_{0})"


@query("calendar_lag", "WITH " + _SPINE.format("daily") + ", f AS (SELECT location_id, date, ws FROM spine LEFT JOIN daily USING (location_id, date)) --FINAL-- SELECT *, lag(ws, 1) OVER w AS ws_lag1, lag(ws, 2) OVER w AS ws_lag2 FROM f WINDOW w AS (PARTITION BY location_id ORDER BY date)", "ws ws_lag1 ws_lag2", "daily")
def calendar_lag(daily):
    return cleaning.add_lags(daily.select("location_id", "date", "ws"), KEY, ["ws"], 2)


@query("previous_row", "SELECT location_id, date, ws, lag(ws) OVER (PARTITION BY location_id ORDER BY date) AS lag1ws FROM daily", "ws lag1ws", "daily")
def previous_row(daily):
    return cleaning.previous_row(daily.select("location_id", "date", "ws"), KEY, "ws")


_ROLL = "WITH " + _SPINE.format("daily") + ", f AS (SELECT location_id, date, value FROM spine LEFT JOIN daily USING (location_id, date)), c AS (SELECT location_id, date, count(*) OVER w AS n, count(value) OVER w AS k, avg(value) OVER w AS m FROM f WINDOW w AS (PARTITION BY location_id ORDER BY date ROWS BETWEEN {0} PRECEDING AND CURRENT ROW))"


@query("rolling_mean", _ROLL.format(13) + " --FINAL-- SELECT location_id, date, CASE WHEN n = 14 AND n - k <= 12 THEN m END AS value FROM c", "value", "daily")
def rolling_mean(daily):
    return cleaning.rolling_mean(daily.select("location_id", "date", "value"), KEY, width=14, max_nulls=12)


@query("rolling_mean_min_values", _ROLL.format(29) + " --FINAL-- SELECT location_id, date, CASE WHEN n = 30 AND k >= 5 THEN m END AS value FROM c", "value", "daily")
def rolling_mean_min_values(daily):
    return cleaning.rolling_mean(daily.select("location_id", "date", "value"), KEY, width=30, min_values=5)


@query("running_mode", "WITH s AS (SELECT location_id, date, CAST(floor(wd / 45) AS INT) AS sector, row_number() OVER (PARTITION BY location_id ORDER BY date) AS rn FROM daily), p AS (SELECT a.location_id, a.date, a.sector, b.sector AS v, count(*) AS n FROM s a JOIN s b ON a.location_id = b.location_id AND b.rn BETWEEN a.rn - 4 AND a.rn GROUP BY ALL) SELECT location_id, date, sector, min_by(v, -n * 100 + v) AS sector_mode FROM p GROUP BY ALL", "", "daily")
def running_mode(daily):
    return cleaning.running_mode(daily.select("location_id", "date", F.floor(F.col("wd") / 45).cast("int").alias("sector")), KEY, "sector", 5)


_PREP = "WITH " + _MAD.format(times=10) + ", " + _filled_sql("cleaned") + ", " + _SPINE.format("filled") + ", wide AS (SELECT location_id, date, filled.* EXCLUDE (location_id, date), CAST(floor(wd / 45) AS INT) % 8 AS wd_factor FROM spine LEFT JOIN filled USING (location_id, date)), lagged AS (SELECT *, " + ", ".join(f"lag({c}) OVER w AS {c}_lag1" for c in VARS) + " FROM wide WINDOW w AS (PARTITION BY location_id ORDER BY date)), recent AS (SELECT location_id FROM lagged GROUP BY 1 HAVING max(date) >= DATE '2000-01-01')"


PREPARED_SQL = _PREP + " --FINAL-- SELECT location_id, date, value, wd_factor, " + ", ".join(VARS + [f"{c}_lag1" for c in VARS]) + ", year(date) + (dayofyear(date) - 1) / CAST(dayofyear(make_date(year(date), 12, 31)) AS DOUBLE) AS date_unix, CAST(isodow(date) AS INT) AS wday FROM lagged SEMI JOIN recent USING (location_id) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in VARS)


@query("prep_features", PREPARED_SQL, "value date_unix " + " ".join(VARS + [f"{c}_lag1" for c in VARS]), "daily", dealt=True)
def prep_features(daily):
    out = prep_data(daily, KEY, VARS, lag=1, since="2000-01-01")
    return out.select("location_id", "date", "value", "wd_factor", *VARS, *(f"{c}_lag1" for c in VARS), "date_unix", "wday")


@query("refresh_prepared", PREPARED_SQL, "value date_unix " + " ".join(VARS + [f"{c}_lag1" for c in VARS]), "daily", dealt=True)
def refresh_prepared(daily):
    """A fiftieth of the places' days come in later: what they reach is prepared again, the rest stays as it is."""
    spark, late = daily.sparkSession, (F.col("location_id") % 7 == 0) & (F.dayofyear("date") % 40 == 3)
    raw, prepared = (store.Store(spark, f"{store.scratch(spark)}/{name}-{uuid.uuid4().hex}", [*KEY, "date"], buckets=8) for name in ("raw", "prepared"))
    # days lie by series: some parts of them are written by one task, so that files are few
    raw.put(daily.filter(~late).coalesce(max(spark.sparkContext.defaultParallelism, tables.parts(daily) // 8)), lies=True)
    stored = raw.read()
    ready = prep_data(prepared.placed(stored, tables.parts(stored)), [store.PLACE, *KEY], VARS, lag=1, since="2000-01-01")
    prepared.put(ready.drop(store.PLACE), lies=True)
    refresh(raw, prepared, store.written(daily.filter(late), "late-days"), KEY, VARS, 1, "2000-01-01")
    return prepared.read().select("location_id", "date", "value", "wd_factor", *VARS, *(f"{c}_lag1" for c in VARS), "date_unix", "wday")


@query("not_finite_to_null", "SELECT location_id, date, CASE WHEN CAST(wd AS INT) % 4 < 3 THEN ws END AS ws FROM daily", "ws", "daily")
def not_finite_to_null(daily):
    k = F.col("wd").cast("int") % 10
    spoilt = F.when(F.col("wd").cast("int") % 4 == 3, F.when(k < 4, float("inf")).when(k < 7, float("-inf")).otherwise(float("nan"))).otherwise(F.col("ws"))
    return cleaning.null_not_finite(daily.select("location_id", "date", spoilt.alias("ws")))


@query("row_filters", "SELECT location_id, date, value, precip, pbl_min FROM daily WHERE (precip IS NOT NULL OR pbl_min IS NOT NULL) AND value IS NOT NULL AND date < DATE '2000-12-28' AND date NOT IN (DATE '1998-03-03', DATE '1999-04-04')", "value precip pbl_min", "daily")
def row_filters(daily):
    rows = cleaning.any_predictor(daily.select("location_id", "date", "value", "precip", "pbl_min"), ["precip", "pbl_min"])
    return cleaning.available(rows, "2000-12-31", 3, ["1998-03-03", "1999-04-04"])


@query("bad_weather", "SELECT location_id, count(*) AS n FROM daily WHERE air_temp_min IS NULL GROUP BY 1", "", "daily")
def bad_weather(daily):
    return cleaning.bad_weather(daily).groupBy("location_id").agg(F.count(F.lit(1)).alias("n"))


@query("date_range", "WITH r AS (SELECT location_id, CASE WHEN location_id % 4 = 0 THEN NULL ELSE DATE '1996-02-01' END AS a, DATE '1998-01-31' AS b FROM (SELECT DISTINCT location_id FROM daily)) --FINAL-- SELECT location_id, date, value FROM daily JOIN r USING (location_id) WHERE date BETWEEN a AND b", "value", "daily")
def date_range(daily):
    start = F.when(F.col("location_id") % 4 == 0, "1996-02-31").otherwise("1996-02-01")
    return cleaning.date_range(daily.select("location_id", "date", "value").withColumn("date_from", start).withColumn("date_to", F.lit("1998-01-31"))).select("location_id", "date", "value")


@query("impact_filter", "WITH c AS (SELECT poll, location_id, count(*) AS country_count FROM meas GROUP BY ALL) SELECT * FROM c WHERE poll IN ('pm25', 'no2') AND country_count >= 130", "", "meas")
def impact_filter(meas):
    return cleaning.impact_filter(meas.groupBy("poll", "location_id").agg(F.count(F.lit(1)).alias("country_count")), ["pm25", "no2"], 130)


@query("meas_join_weather", "WITH m AS (SELECT location_id, poll, date, avg(value) AS value FROM meas GROUP BY ALL), w AS (SELECT location_id, date, ws, wd FROM daily WHERE location_id % 3 <> 0 AND CAST(wd AS INT) % 2 = 0) --FINAL-- SELECT m.*, ws, wd FROM m LEFT JOIN w USING (location_id, date) WHERE m.location_id IN (SELECT location_id FROM w)", "value ws wd", "meas", "daily")
def meas_join_weather(meas, daily):
    m = meas.groupBy("location_id", "poll", "date").agg(F.avg("value").alias("value"))
    w = daily.filter((F.col("location_id") % 3 != 0) & (F.col("wd").cast("int") % 2 == 0)).select("location_id", "date", "ws", "wd")
    return joins.with_weather(m, w)


@query("coalesce_join", "WITH n AS (SELECT location_id, date, ws AS precip, wd AS extra FROM daily WHERE location_id % 2 = 0) --FINAL-- SELECT d.location_id, d.date, coalesce(d.precip, n.precip) AS precip, n.extra FROM daily d LEFT JOIN n USING (location_id, date)", "precip extra", "daily")
def coalesce_join(daily):
    new = daily.filter("location_id % 2 = 0").select("location_id", "date", F.col("ws").alias("precip"), F.col("wd").alias("extra"))
    return joins.coalesce_join(daily.select("location_id", "date", "precip"), new, ["location_id", "date"], ["precip", "extra"])


@query("trend_full_join", "WITH a AS (SELECT location_id, date, observed FROM obs_pred WHERE year(date) <= 1998), b AS (SELECT location_id, date, trend FROM obs_pred WHERE year(date) >= 1998) --FINAL-- SELECT location_id, date, observed, trend FROM a FULL JOIN b USING (location_id, date)", "observed trend", "obs_pred")
def trend_full_join(df):
    return joins.trend_join(df.filter(F.year("date") <= 1998).select("location_id", "date", "observed"), df.filter(F.year("date") >= 1998).select("location_id", "date", "trend"), ["location_id", "date"])


@query("date_exclusion", "SELECT location_id, date, observed FROM obs_pred WHERE date NOT IN (SELECT date FROM obs_pred WHERE observed > 100000)", "observed", "obs_pred")
def date_exclusion(df):
    return joins.in_dates(df.select("location_id", "date", "observed"), df.filter("observed > 100000"), keep=False)


@query("completed_results", "WITH r AS (SELECT location_id, poll, avg(value) AS value FROM meas WHERE value > 95 GROUP BY ALL), g AS (SELECT location_id, unnest(['pm25', 'no2', 'o3']) AS poll FROM (SELECT DISTINCT location_id FROM r)) --FINAL-- SELECT g.location_id, g.poll, value FROM g LEFT JOIN r USING (location_id, poll)", "value", "meas")
def completed_results(meas):
    return joins.completed(meas.filter("value > 95").groupBy("location_id", "poll").agg(F.avg("value").alias("value")), ["location_id"], ["pm25", "no2", "o3"])


@query("time_effects", """WITH m AS (SELECT month(date) AS k, avg(observed) AS em FROM obs_pred GROUP BY 1), w AS (SELECT isodow(date) AS k, avg(trend) AS ew FROM obs_pred GROUP BY 1), y AS (SELECT dayofyear(date) AS k, avg(predicted) AS ey FROM obs_pred WHERE dayofyear(date) < 300 GROUP BY 1),
  s AS (SELECT month(date) % 12 // 3 AS k, max(observed) AS es FROM obs_pred GROUP BY 1)
  --FINAL-- SELECT location_id, date, em AS effect_month, ew AS effect_wday, ey AS effect_yday, es AS effect_season, (em + ew + coalesce(ey, 0) + es) / CASE WHEN ey IS NULL THEN 3 ELSE 4 END AS effect FROM obs_pred JOIN m ON month(date) = m.k JOIN w ON isodow(date) = w.k JOIN s ON month(date) % 12 // 3 = s.k LEFT JOIN y ON dayofyear(date) = y.k""", "effect_month effect_wday effect_yday effect_season effect", "obs_pred")
def time_effects(df):
    by = lambda name, k, value: df.groupBy(k.alias(name)).agg(value.alias("effect"))
    effects = {
        "month": by("month", F.month("date"), F.avg("observed")),
        "wday": by("wday", weekday_number(F.col("date")), F.avg("trend")),
        "yday": by("yday", F.dayofyear("date"), F.avg("predicted")).filter("yday < 300"),
        "season": by("season", season(F.col("date")), F.max("observed")),
    }
    return joins.time_effects(df.select("location_id", "date"), effects)


_LONG = """w1 AS (SELECT location_id, date, 'precip' AS weather_var, precip AS value FROM daily UNION ALL SELECT location_id, date, 'air_temp_min', air_temp_min FROM daily UNION ALL SELECT location_id, date, 'pbl_min', pbl_min FROM daily),
  long AS (SELECT *, 'a' AS source FROM w1 WHERE (location_id + day(date)) % 3 > 0 UNION ALL SELECT location_id, date, weather_var, value + 1, 'b' FROM w1),
  shares AS (SELECT location_id, weather_var, source, count(DISTINCT CASE WHEN value IS NOT NULL THEN date END) / CAST((SELECT count(DISTINCT date) FROM long) AS DOUBLE) AS share FROM long GROUP BY ALL)"""


def _sources(daily):
    variables = ["precip", "air_temp_min", "pbl_min"]
    b = daily.select("location_id", "date", *((F.col(v) + 1).alias(v) for v in variables))
    a = daily.filter((F.col("location_id") + F.day("date")) % 3 > 0).select("location_id", "date", *variables)
    return {"a": a, "b": b}, variables


@query("source_availability", "WITH " + _LONG + " --FINAL-- SELECT * FROM shares", "share", "daily")
def source_availability(daily):
    parts, variables = _sources(daily)
    long = [joins.to_long(d, ["location_id", "date"], variables).withColumn("source", F.lit(s)).withColumnRenamed("variable", "weather_var") for s, d in parts.items()]
    return agg.availability(long[0].unionByName(long[1]))


@query("pick_weather_source", "WITH " + _LONG + """, pick AS (SELECT location_id, weather_var, min(source) AS source FROM shares WHERE share >= 0.1 GROUP BY ALL)
  --FINAL-- SELECT location_id, date, max(value) FILTER (weather_var = 'precip') AS precip, max(value) FILTER (weather_var = 'air_temp_min') AS air_temp_min, max(value) FILTER (weather_var = 'pbl_min') AS pbl_min FROM long JOIN pick USING (location_id, weather_var, source) GROUP BY ALL""", "precip air_temp_min pbl_min", "daily")
def pick_weather_source(daily):
    parts, variables = _sources(daily)
    return weather_plans.combine_weathers(parts, variables, least=0.1)


@query("split_sets", """WITH b AS (SELECT location_id, date, date <= DATE '2000-06-30' AS pre, date <= DATE '2000-06-30' AND month(date) <> 7 AND date >= DATE '1995-03-01' AS ok0, md5(CAST(location_id AS VARCHAR) || '~' || CAST(date AS VARCHAR) || '~42~0') AS h FROM daily),
  e AS (SELECT *, ok0 OR (pre AND month(date) = 7 AND date NOT IN (SELECT CAST(unnest(generate_series(DATE '1997-07-01', DATE '1997-07-31', INTERVAL 1 DAY)) AS DATE)) AND date >= DATE '1995-03-01') AS ok FROM b),
  r AS (SELECT *, greatest(1, floor(0.8 * sum(CAST(pre AS INT)) OVER (PARTITION BY location_id))) AS n, row_number() OVER (PARTITION BY location_id ORDER BY CAST(NOT ok AS INT), h, date) AS rn FROM e)
  SELECT location_id, date, CASE WHEN NOT pre THEN 'prediction' WHEN ok AND rn <= n THEN 'training' ELSE 'testing' END AS "set" FROM r""", "", "daily")
def split_sets(daily):
    july = [f"1997-07-{d:02d}" for d in range(1, 32)]
    return model.split_sets(daily.select("location_id", "date"), KEY, 0.8, "2000-06-30", "1995-03-01", july)


@query("series_predictors", "SELECT location_id, list_sort(list_filter([CASE WHEN count(precip) FILTER (year(date) < 1993) > 0 THEN 'precip' END, CASE WHEN count(pbl_min) FILTER (year(date) < 1993) > 0 THEN 'pbl_min' END, CASE WHEN count(ws) FILTER (year(date) < 1993) > 0 THEN 'ws' END], lambda x: x IS NOT NULL)) AS predictors FROM daily GROUP BY 1", "", "daily")
def series_predictors(daily):
    named = daily.withColumn("set", F.when(F.year("date") < 1993, "training").otherwise("testing"))
    out = model.predictors(named, KEY, ["precip", "pbl_min", "ws"])
    return out.withColumn("predictors", F.array_sort("predictors"))
