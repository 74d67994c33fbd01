"""Queries over measurements and results: aggregates, year-over-year parts, reports, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import aggregates as agg
from ..operators import cleaning, joins, yoy
from ..sources import store, tables
from .register import registrar

QUERIES, ORACLE = {}, {}
query = registrar(QUERIES, ORACLE)


IDS = "location_id, poll, unit, source, timezone, process_id, country"


@query("daily_dedupe", f"SELECT date, {IDS}, avg(value) AS value FROM meas GROUP BY ALL", "value", "meas")
def daily_dedupe(meas):
    return agg.daily_mean(meas)


@query("measurement_scan", f"SELECT date, {IDS}, avg(value) AS value FROM meas WHERE poll IN ('pm25', 'o3') AND source = 'net2' AND date BETWEEN '1996-01-01' AND '1999-06-30' GROUP BY ALL", "value", "meas")
def measurement_scan(meas):
    return tables.measurements(meas, "1996-01-01", "1999-06-30", poll=["pm25", "o3"], source="net2", country=None)


@query("daily_grid_agg", "SELECT location_id, CAST(ts AS DATE) AS date, avg(d2m) AS d2m, avg(t2m) AS t2m, avg(sp) AS sp, avg(blh) AS blh, min(t2m) AS t2m_min, max(t2m) AS t2m_max, min(blh) AS blh_min, max(blh) AS blh_max, sum(tp) AS tp FROM hourly GROUP BY ALL HAVING count(DISTINCT hour(ts)) >= 12", "d2m t2m sp blh t2m_min t2m_max blh_min blh_max tp", "hourly")
def daily_grid_agg(hourly):
    return agg.grid_daily(hourly.drop("u10", "v10"), ["location_id"], 12)


@query("daily_wind", "WITH s AS (SELECT location_id, CAST(ts AS DATE) AS date, avg(sqrt(u10 * u10 + v10 * v10)) AS ws, sum(u10) AS u, sum(v10) AS v FROM hourly GROUP BY ALL), m AS (SELECT *, CASE WHEN degrees(atan2(v, u)) <= 0 THEN degrees(atan2(v, u)) + 360 ELSE degrees(atan2(v, u)) END AS m FROM s) --FINAL-- SELECT location_id, date, ws, CASE WHEN m < 270 THEN 270 - m ELSE 630 - m END AS wd FROM m", "ws wd", "hourly")
def daily_wind(hourly):
    return agg.grid_daily(hourly.select("location_id", "ts", "u10", "v10"), ["location_id"], 1)


_STATION = "SELECT code, CAST(ts AS DATE) AS date, min(air_temp) AS air_temp_min, max(air_temp) AS air_temp_max, avg(air_temp) AS air_temp, avg(atmos_pres) AS atmos_pres, avg(ceil_hgt) AS ceil_hgt, avg(visibility) AS visibility, avg(precip) AS precip, avg(RH / 100) AS RH, min(RH / 100) AS RH_min, max(RH / 100) AS RH_max, max(ws) AS ws_max, avg(ws) AS ws, CASE WHEN sum(CASE WHEN wd IS NOT NULL THEN ws END) = 0 THEN NULL ELSE sum(wd * ws) / sum(CASE WHEN wd IS NOT NULL THEN ws END) END AS wd FROM station_hourly GROUP BY ALL"


@query("station_daily", _STATION, "air_temp_min air_temp_max air_temp atmos_pres ceil_hgt visibility precip RH RH_min RH_max ws_max ws wd", "station_hourly")
def station_daily(hourly):
    return agg.station_daily(hourly)


@query("yoy_attribution", """WITH m AS (SELECT location_id, avg(CASE WHEN date_trunc('month', date) = DATE '1997-07-01' THEN observed END) AS o1, avg(CASE WHEN date_trunc('month', date) = DATE '1996-07-01' THEN observed END) AS o0,
  avg(CASE WHEN date_trunc('month', date) = DATE '1997-07-01' THEN predicted END) AS p1, avg(CASE WHEN date_trunc('month', date) = DATE '1996-07-01' THEN predicted END) AS p0 FROM obs_pred GROUP BY 1),
  k AS (SELECT * FROM m WHERE o1 IS NOT NULL AND o0 IS NOT NULL AND p1 IS NOT NULL AND p0 IS NOT NULL)
  --FINAL-- SELECT location_id, DATE '1997-07-01' AS date, unnest(['total', 'weather', 'emission', 'total_rel', 'weather_rel', 'emission_rel']) AS variable,
  unnest([o1 - o0, p1 - p0, (o1 - o0) - (p1 - p0), (o1 - o0) / o0, (p1 - p0) / o0, ((o1 - o0) - (p1 - p0)) / o0]) AS value FROM k""", "value", "obs_pred")
def yoy_attribution(df):
    long = joins.to_long(df, ["location_id", "date"], ["observed", "predicted"])
    return yoy.yoy_attribution(long, ["location_id"], "1997-07-15")


@query("yoy_from_trend", """WITH m AS (SELECT location_id, CAST(date_trunc('month', date) AS DATE) AS date, avg(observed) AS o, avg(trend) AS t, avg(observed - predicted) AS a FROM obs_pred GROUP BY 1, 2),
  d AS (SELECT location_id, date, o - lag(o) OVER w AS total, t - lag(t) OVER w AS emission, a - lag(a) OVER w AS residual, lag(o) OVER w AS o0 FROM m WINDOW w AS (PARTITION BY location_id, month(date) ORDER BY date))
  --FINAL-- SELECT location_id, date, total, emission, total - emission AS weather, residual, total / o0 AS total_rel, emission / o0 AS emission_rel, (total - emission) / o0 AS weather_rel, residual / o0 AS residual_rel FROM d WHERE o0 IS NOT NULL""", "total emission weather residual total_rel emission_rel weather_rel residual_rel", "obs_pred")
def yoy_from_trend(df):
    long = joins.to_long(df.withColumn("anomaly", F.col("observed") - F.col("predicted")), ["location_id", "date"], ["observed", "trend", "anomaly"])
    return yoy.yoy_from_trend(long, ["location_id"])


@query("monthly_trend_yoy", """WITH m AS (SELECT location_id, year(date) AS year, month(date) AS month, avg(trend) AS trend FROM obs_pred GROUP BY ALL)
  --FINAL-- SELECT location_id, CAST(year AS INT) AS year, CAST(month AS INT) AS month, trend, (trend - lag(trend) OVER w) / lag(trend) OVER w AS yoy FROM m WINDOW w AS (PARTITION BY location_id, month ORDER BY year)""", "trend yoy", "obs_pred")
def monthly_trend_yoy(df):
    return yoy.monthly_trend_yoy(df, ["location_id"])


@query("lag_over_years", """WITH m AS (SELECT location_id, CAST(year(date) AS INT) AS year, avg(observed) AS value FROM obs_pred GROUP BY ALL)
  --FINAL-- SELECT location_id, 'observed' AS variable, year, value, value - lag(value) OVER (PARTITION BY location_id ORDER BY year) AS change FROM m""", "value change", "obs_pred")
def lag_over_years(df):
    yearly = df.groupBy("location_id", F.lit("observed").alias("variable"), F.year("date").alias("year")).agg(F.avg("observed").alias("value"))
    return yoy.lag_over_years(yearly, ["location_id"])


@query("compare_models", """WITH y AS (SELECT location_id, CASE WHEN month(date) < 7 THEN 'a' ELSE 'b' END AS model, observed, predicted FROM obs_pred)
  --FINAL-- SELECT location_id, 'lineitem' AS source, model, avg(observed) AS total, avg(predicted) AS weather, avg(observed - predicted) AS emission, count(*) * 3 AS n FROM y GROUP BY ALL""", "total weather emission", "obs_pred")
def compare_models(df):
    wide = df.select("location_id", F.lit("lineitem").alias("source"), F.when(F.month("date") < 7, "a").otherwise("b").alias("model"), "date", F.col("observed").alias("total"), F.col("predicted").alias("weather"), (F.col("observed") - F.col("predicted")).alias("emission"))
    return yoy.compare_models(joins.to_long(wide, ["location_id", "source", "model", "date"], ["total", "weather", "emission"]))


@query("before_after", """WITH l AS (SELECT max(date) AS last FROM obs_pred), a AS (SELECT location_id, avg(CASE WHEN date >= DATE '2001-03-01' THEN observed END) AS observed_after, avg(CASE WHEN date < DATE '2001-03-01' AND year(date) IN (1998, 1999) AND dayofyear(date) BETWEEN 60 AND dayofyear(last) THEN observed END) AS observed_before,
  avg(CASE WHEN date >= DATE '2001-03-01' THEN trend END) AS normalised_after, avg(CASE WHEN date < DATE '2001-03-01' AND year(date) IN (1998, 1999) AND dayofyear(date) BETWEEN 60 AND dayofyear(last) THEN trend END) AS normalised_before FROM obs_pred, l GROUP BY 1)
  --FINAL-- SELECT *, (observed_after - observed_before) / observed_before AS observed_change, (normalised_after - normalised_before) / normalised_before AS normalised_change FROM a""", "observed_after observed_before normalised_after normalised_before observed_change normalised_change", "obs_pred")
def before_after(df):
    return agg.before_after(df.withColumnRenamed("trend", "normalised"), ["location_id"], "2001-03-01", [1998, 1999])


@query("period_mean", "SELECT location_id, avg(observed) AS value FROM obs_pred WHERE year(date) IN (1996, 1997) AND dayofyear(date) BETWEEN 32 AND 151 GROUP BY 1", "value", "obs_pred")
def period_mean(df):
    return agg.period_means_until(df.withColumnRenamed("observed", "value"), ["location_id"], [1996, 1997], 32, 151)


@query("linear_trend", """WITH t AS (SELECT location_id, observed, CAST(date - DATE '1970-01-01' AS DOUBLE) AS t FROM obs_pred)
  --FINAL-- SELECT location_id, regr_slope(observed, t) AS slope, regr_intercept(observed, t) AS intercept, regr_slope(observed, t) * (max(t) - min(t)) AS change FROM t GROUP BY 1""", "slope intercept change", "obs_pred")
def linear_trend(df):
    return agg.linear_trend(df, ["location_id"], "observed")


@query("quality_quantiles", """WITH b AS (SELECT location_id % 5 AS grp, observed FROM obs_pred) --FINAL-- SELECT grp, quantile_cont(observed, 0.25) AS q25, quantile_cont(observed, 0.5) AS q50, quantile_cont(observed, 0.75) AS q75,
  count(*) FILTER (observed >= 0 AND observed < 20000) AS bin1, count(*) FILTER (observed >= 20000 AND observed < 40000) AS bin2, count(*) FILTER (observed >= 40000 AND observed < 60000) AS bin3, count(*) FILTER (observed >= 60000 AND observed < 80000) AS bin4 FROM b GROUP BY 1""", "q25 q50 q75", "obs_pred")
def quality_quantiles(df):
    return agg.quality_distribution(df.withColumn("grp", F.col("location_id") % 5), ["grp"], "observed", 0.0, 80000.0, 4)


@query("coverage", """WITH g AS (SELECT location_id, unnest(['pm25', 'no2', 'o3', 'so2']) AS poll FROM (SELECT DISTINCT location_id FROM meas)), c AS (SELECT location_id, poll, count(*) AS n FROM meas GROUP BY ALL)
  SELECT g.location_id, g.poll, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (location_id, poll)""", "", "meas")
def coverage(meas):
    return agg.coverage(meas, ["location_id"], ["pm25", "no2", "o3", "so2"])


_SETS = "WITH s AS (SELECT location_id, CASE year(date) WHEN 1995 THEN 'testing' WHEN 1996 THEN 'prediction' ELSE 'training' END AS st, observed AS y, predicted AS p FROM obs_pred)"


@query("metrics", _SETS + " --FINAL-- SELECT location_id, " + ", ".join(f"sqrt(avg(pow(y - p, 2)) FILTER (st = '{s}')) AS rmse_{s}, pow(corr(CASE WHEN st = '{s}' THEN y END, CASE WHEN st = '{s}' THEN p END), 2) AS rsquared_{s}" for s in ("training", "testing", "prediction")) + " FROM s GROUP BY 1", "rmse_training rsquared_training rmse_testing rsquared_testing rmse_prediction rsquared_prediction", "obs_pred")
def metrics(df):
    return agg.fit_metrics(_with_sets(df), ["location_id"])


def _with_sets(df):
    named = F.when(F.year("date") == 1995, "testing").when(F.year("date") == 1996, "prediction").otherwise("training")
    return df.withColumn("set", named).withColumnRenamed("observed", "value")


@query("legacy_metrics", _SETS + " --FINAL-- SELECT location_id, " + ", ".join(f"sqrt(avg(pow(y - p, 2)) FILTER ({w})) AS rmse_{n}, avg(abs(y - p)) FILTER ({w}) AS mae_{n}, 1 - avg(pow(y - p, 2)) FILTER ({w}) / var_pop(y) FILTER ({w}) AS r2_{n}" for n, w in (("training", "st <> 'prediction'"), ("prediction", "st = 'prediction'"))) + " FROM s GROUP BY 1", "rmse_training mae_training r2_training rmse_prediction mae_prediction r2_prediction", "obs_pred")
def legacy_metrics(df):
    return agg.legacy_metrics(_with_sets(df), ["location_id"])


@query("replicate_summary", "SELECT location_id, avg(predicted) AS predicted, quantile_cont(predicted, 0.025) AS predicted_p025, quantile_cont(predicted, 0.975) AS predicted_p975 FROM obs_pred GROUP BY 1", "predicted predicted_p025 predicted_p975", "obs_pred")
def replicate_summary(df):
    return agg.replicate_summary(df, ["location_id"])


@query("trend_segments", """WITH s AS (SELECT location_id, min(date) AS d0, max(date) AS d1, avg(observed) AS a FROM obs_pred GROUP BY 1)
  --FINAL-- SELECT o.location_id, o.date, a + 0.5 * (o.date - d0) AS trend, a - 1 + 0.4 * (o.date - d0) AS lower, a + 1 + 0.6 * (o.date - d0) AS upper FROM obs_pred o JOIN s USING (location_id)""", "trend lower upper", "obs_pred")
def trend_segments(df):
    seg = df.groupBy("location_id").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.avg("observed").alias("a"))
    seg = seg.withColumns({"b": F.lit(0.5), "a_lower": F.col("a") - 1, "b_lower": F.lit(0.4), "a_upper": F.col("a") + 1, "b_upper": F.lit(0.6)})
    return agg.trend_segments(df, seg, ["location_id"])


@query("info_table", """WITH m AS (SELECT location_id, count(*) AS n, CAST(min(date) AS VARCHAR) AS first, CAST(max(date) AS VARCHAR) AS last FROM obs_pred GROUP BY 1)
  SELECT location_id, unnest(['n', 'first', 'last']) AS name, unnest([CAST(n AS VARCHAR), first, last]) AS value FROM m""", "", "obs_pred")
def info_table(df):
    one = df.groupBy("location_id").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))
    return agg.key_value(one, ["location_id"], ["n", "first", "last"])


@query("time_features", """WITH d AS (SELECT DISTINCT date FROM meas) --FINAL-- SELECT date, year(date) + (dayofyear(date) - 1) / CAST(dayofyear(make_date(year(date), 12, 31)) AS DOUBLE) AS date_unix, CAST(dayofyear(date) AS INT) AS yday, CAST(isodow(date) AS INT) AS wday, CAST(month(date) AS INT) AS month,
  CAST(strftime(date, '%W') AS INT) AS week, dayname(date) AS weekday_name, strftime(date, '%b') AS month_abb, CASE WHEN month(date) BETWEEN 3 AND 5 THEN 'MAM' WHEN month(date) BETWEEN 6 AND 8 THEN 'JJA' WHEN month(date) BETWEEN 9 AND 11 THEN 'SON' ELSE 'DJF' END AS season, CAST(month(date) % 12 // 3 AS INT) + 1 AS season_number FROM d""", "date_unix", "meas")
def time_features(meas):
    return fn.time_features(meas.select("date").distinct())


@query("solar_radiation", """WITH d AS (SELECT DISTINCT dayofyear(date) AS j FROM meas), g AS (SELECT DISTINCT lat, radians(lat) AS phi FROM location), x AS (SELECT lat, j, phi, 1 + 0.033 * cos(2 * pi() / 365 * j) AS dr, 0.409 * sin(2 * pi() / 365 * j - 1.39) AS dec FROM d, g),
  s AS (SELECT *, acos(greatest(-1.0, least(1.0, -tan(phi) * tan(dec)))) AS ws FROM x)
  --FINAL-- SELECT CAST(j AS INT) AS yday, lat, 24 * 60 / pi() * 0.0820 * dr * (ws * sin(phi) * sin(dec) + cos(phi) * cos(dec) * sin(ws)) AS sunshine FROM s""", "sunshine", "meas", "location")
def solar_radiation(meas, location):
    days = meas.select(F.dayofyear("date").alias("yday")).distinct()
    grid = joins.cross_grid(location.select("lat"), days)
    return grid.withColumn("sunshine", fn.extraterrestrial_radiation(F.col("yday"), F.col("lat")))


@query("wind_sector", "SELECT CAST(floor(wd / 45) AS INT) % 8 AS sector, CAST(floor(wd / 45) AS INT) AS sector_open, count(*) AS n FROM daily GROUP BY ALL", "", "daily")
def wind_sector(daily):
    return daily.groupBy(fn.wind_sector(F.col("wd")).alias("sector"), fn.wind_sector(F.col("wd"), wrap=False).alias("sector_open")).agg(F.count(F.lit(1)).alias("n"))


@query("link_round_trip", "SELECT location_id, date, CASE WHEN air_temp_min > 0 THEN ln(air_temp_min) END AS linked, CASE WHEN air_temp_min > 0 THEN air_temp_min END AS back FROM daily", "linked back", "daily")
def link_round_trip(daily):
    y = fn.link(F.col("air_temp_min"), "log")
    return daily.select("location_id", "date", y.alias("linked"), fn.inverse_link(y, "log").alias("back"))


@query("yoy_date_set", """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS month FROM meas)
  SELECT month, CAST(unnest(generate_series(month, month + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM m UNION ALL
  SELECT month, CAST(unnest(generate_series(month - INTERVAL 1 YEAR, month - INTERVAL 1 YEAR + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) FROM m""", "", "meas")
def yoy_date_set(meas):
    return meas.select(F.trunc("date", "MM").alias("month")).distinct().select("month", F.explode(fn.yoy_dates(F.col("month"))).alias("date"))


@query("upsert_results", """WITH old AS (SELECT location_id, date, poll, max(value) AS value FROM meas GROUP BY ALL), new AS (SELECT location_id, date, 'pm25' AS poll, observed / 1000 AS value FROM obs_pred)
  --FINAL-- SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.location_id = old.location_id AND new.date = old.date AND new.poll = old.poll) UNION ALL SELECT * FROM new""", "value", "meas", "obs_pred")
def upsert_results(meas, obs):
    old = meas.groupBy("location_id", "date", "poll").agg(F.max("value").alias("value"))
    new = obs.select("location_id", "date", F.lit("pm25").alias("poll"), (F.col("observed") / 1000).alias("value"))
    return store.upserted(old, new, ["location_id", "date", "poll"])


@query("missing_dates", "SELECT DISTINCT location_id, date FROM place_days p WHERE NOT EXISTS (SELECT 1 FROM (SELECT location_id, CAST(ts AS DATE) AS date, count(DISTINCT hour(ts)) AS layers FROM hourly GROUP BY ALL HAVING layers >= 15) h WHERE h.location_id = p.location_id AND h.date = p.date)", "", "place_days", "hourly")
def missing_dates(days, hourly):
    done = hourly.groupBy("location_id", F.to_date("ts").alias("date")).agg(F.countDistinct(F.hour("ts")).alias("layers"))
    return joins.not_processed(days.select("location_id", "date").distinct(), done, ["location_id", "date"], "layers", 15)


@query("series_skipped", "SELECT DISTINCT location_id, poll FROM meas EXCEPT SELECT DISTINCT location_id, poll FROM meas WHERE date >= DATE '2001-09-15'", "", "meas")
def series_skipped(meas):
    key = ["location_id", "poll"]
    return cleaning.skipped_series(meas, cleaning.recent_series(meas, key, "2001-09-15"), key)


@query("key_sets", "SELECT s.date, (h.date IS NOT NULL) AS both FROM (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS date FROM meas) s LEFT JOIN (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS date FROM obs_pred WHERE observed > 90000) h USING (date)", "", "meas", "obs_pred")
def key_sets(meas, obs):
    months = meas.select(F.trunc("date", "MM").alias("date"))
    both, left = joins.key_sets(months, obs.filter("observed > 90000").select(F.trunc("date", "MM").alias("date")), ["date"])
    return both.withColumn("both", F.lit(True)).unionByName(left.withColumn("both", F.lit(False)))


@query("long_and_wide", "SELECT location_id, date, observed, predicted, trend FROM obs_pred", "observed predicted trend", "obs_pred")
def long_and_wide(df):
    names = ["observed", "predicted", "trend"]
    return joins.to_wide(joins.to_long(df, ["location_id", "date"], names), ["location_id", "date"], names)


@query("nested_series", "SELECT location_id, date, observed FROM obs_pred", "observed", "obs_pred")
def nested_series(df):
    return joins.unnest(joins.nest(df, ["location_id"], ["date", "observed"]), ["location_id"])


@query("hash_sample", "WITH h AS (SELECT location_id, date, observed, row_number() OVER (PARTITION BY location_id ORDER BY md5(CAST(location_id AS VARCHAR) || '~' || CAST(date AS VARCHAR) || '~42'), location_id, date) AS rn FROM obs_pred) --FINAL-- SELECT location_id, date, observed FROM h WHERE rn <= 50", "observed", "obs_pred")
def hash_sample(df):
    return agg.hash_sample(df.select("location_id", "date", "observed"), ["location_id"], 50, 42, ["location_id", "date"])


@query("config_names", """WITH c AS (SELECT DISTINCT poll, source FROM meas) SELECT poll, source, concat_ws('_', poll, 'gbm', CASE WHEN l > 0 THEN 'lag' || l END, CASE WHEN source = 'net1' THEN 'filter' END, CASE WHEN l = 0 THEN 'nopbl' END, CASE WHEN source = 'net2' THEN 'fire' END) AS name, CAST(l AS INT) AS lag FROM c, (SELECT unnest([0, 1, 2]) AS l)""", "", "meas")
def config_names(meas):
    c = meas.select("poll", "source").distinct().withColumn("lag", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return c.withColumn("name", fn.config_name(F.col("poll"), F.lit("gbm"), F.col("lag"), F.col("source") == "net1", F.col("lag") > 0, F.col("source") == "net2"))
