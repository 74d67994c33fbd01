"""Whole plans: weather collection, deweather, year-over-year, the pooled engine, legacy variants."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from weathernorm.operators import aggregates as agg
from weathernorm.operators import effects, joins, model
from weathernorm.operators import space_time as st
from weathernorm.operators.joins import with_weather
from weathernorm.plans import deweather as plan
from weathernorm.plans import registry, views, weather
from weathernorm.plans.prep import prep_data
from weathernorm.sources import tables
from weathernorm.sources.store import Store

KEY = ["location_id", "poll"]


def world(spark, n=420):
    """Two places, daily: values follow temperature, and fall by 6 in the last months of the second."""
    meas, met = [], []
    for loc in (1, 2):
        for k in range(n):
            d = dt.date(2023, 1, 1) + dt.timedelta(k)
            temp, ws = 10 + 10 * math.sin(k / 20), 3 + math.cos(k / 5)
            met.append((loc, d, temp, ws))
            value = 20 + temp - 2 * ws + (k * 7 % 5) / 5 - (6 if loc == 2 and k > 364 else 0)
            meas.append((loc, "pm25", "ug", "s", "p", "XX", d, value))
    m = spark.createDataFrame(meas, "location_id int, poll string, unit string, source string, process_id string, country string, date date, value double")
    return m, spark.createDataFrame(met, "location_id int, date date, air_temp_min double, ws double")


def test_deweather_and_yoy(spark):
    meas, met = world(spark)
    out = plan.deweather(meas, met, ["air_temp_min", "ws"], key=KEY, lag=1, trees=80, learning_rate=0.1, cv_folds=2, training_end="2023-12-31")
    r = out["result"].groupBy("location_id", "variable").agg(F.avg(F.when(F.col("date") > "2024-01-01", F.col("value"))).alias("v")).collect()
    late = {(x["location_id"], x["variable"]): x["v"] for x in r}
    assert late[1, "anomaly"] == pytest.approx(0, abs=1.5) and late[2, "anomaly"] == pytest.approx(-6, abs=2)
    assert late[2, "observed"] - late[2, "predicted"] == pytest.approx(late[2, "anomaly"])
    assert {x["location_id"] for x in out["performance"].collect()} == {1, 2}
    assert agg.importance_summary(out["importance"]).count() == 2
    yoy = plan.deweather_yoy(meas, met, ["air_temp_min", "ws"], ["2024-01-01", "2024-02-01"], KEY, lag=0, trees=80, learning_rate=0.1, cv_folds=2)
    found = {(x["date"].month, x["location_id"], x["variable"]): x["value"] for x in yoy.collect()}
    assert len(found) == 24
    part = {k[1:]: v for k, v in found.items() if k[0] == 1}
    assert len(plan.compared_days("2024-07-01")) == 62 and len(plan.compared_days("2024-02-15")) == 57
    for loc in (1, 2):
        assert part[loc, "total"] == pytest.approx(part[loc, "weather"] + part[loc, "emission"])
    assert part[2, "emission"] < part[1, "emission"]
    assert plan.presets({"trees": 1, "lag": 0}, {"trees": 2}, {"lag": 3}) == {"trees": 2, "lag": 3}


def test_trend_output(spark):
    meas, met = world(spark, 200)
    out = plan.deweather(meas, met, ["air_temp_min"], output="trend", key=KEY, lag=0, trees=30, learning_rate=0.1, cv_folds=0)
    names = {r["variable"] for r in out["result"].select("variable").distinct().collect()}
    assert names == {"observed", "predicted", "anomaly", "trend"}


def test_pooled_engine(spark):
    meas, met = world(spark, 120)
    df = model.split_sets(joins.with_weather(meas, met), KEY, 0.8).withColumn("air_temp_min", F.when(F.col("ws") > 2.2, F.col("air_temp_min")))
    out = model.fit_pooled(df, KEY, ["air_temp_min", "ws"], trees=3, depth=2)
    assert out.count() == 240 and out.filter("predicted IS NULL").count() == 0


def test_collect_weather_prefers_by_priority_and_share(spark):
    loc = spark.createDataFrame([(1, 10.0, 20.0)], "location_id int, lat double, lon double")
    hours = [(10.0, 20.0, dt.datetime(2024, 1, d, h), 1.0, 0.0, 280.0 + h, 275.0, 101000.0, 0.0001, 500.0) for d in range(1, 5) for h in range(24)]
    grid = spark.createDataFrame(hours, "cell_lat double, cell_lon double, ts timestamp, u10 double, v10 double, t2m double, d2m double, sp double, tp double, blh double")
    grid = grid.filter("NOT (day(ts) = 4 AND hour(ts) = 7)")  # a day of 23 hours goes
    out = weather.collect_weather(loc, ["air_temp_min", "air_temp_max", "atmos_pres", "precip", "ws", "wd", "sunshine"], grid_hourly=grid, add_sunshine=True)
    rows = out.orderBy("date").collect()
    assert len(rows) == 3
    r = rows[0]
    assert (r["air_temp_min"], r["air_temp_max"], r["atmos_pres"], r["precip"], r["ws"], r["wd"]) == pytest.approx((6.85, 29.85, 1010.0, 2.4, 1.0, 270.0))
    assert 25 < r["sunshine"] < 40


def test_combine_needs_half_of_the_dates(spark):
    dates = [dt.date(2024, 1, d) for d in range(1, 11)]
    a = spark.createDataFrame([(1, d, 1.0 if k < 4 else None) for k, d in enumerate(dates)], "location_id int, date date, ws double")
    b = spark.createDataFrame([(1, d, 2.0) for d in dates], "location_id int, date date, ws double")
    assert {r["ws"] for r in weather.combine_weathers({"a": a, "b": b}, ["ws"]).collect()} == {2.0}
    assert {r["ws"] for r in weather.combine_weathers({"a": a, "b": b}, ["ws"], 0.4).collect()} == {1.0, None}
    assert weather.combine_weathers({"a": a}, ["ws"]).count() == 0


def test_add_fire_fills_only_what_is_missing(spark):
    loc = spark.createDataFrame([(1, 10.0, 20.0)], "location_id int, lat double, lon double")
    met = spark.createDataFrame([(1, dt.date(2024, 1, 2), 5.0), (1, dt.date(2024, 1, 3), None)], "location_id int, date date, fire_frp double")
    fires = spark.createDataFrame([(dt.datetime(2024, 1, 2, 12), 10.0, 20.1, 3.0, "A")], "ts timestamp, lat double, lon double, frp double, region string")
    out = [(r["fire_frp"], r["fire_count"]) for r in weather.add_fire(met, loc, fires).orderBy("date").collect()]
    assert out == [(5.0, None), (3.0, 1)]
    with pytest.raises(ValueError, match="fire mode"):
        weather.add_fire(met, loc, fires, "other")


def test_legacy_residuals_and_long_result(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1), 5.0, 7.0, 3.0)], "location_id int, date date, value double, predicted double, fire_frp_lag1 double")
    r = effects.legacy_residuals(df, ["fire_frp_lag1"]).first()
    assert (r["residual"], r["fire_frp_lag1"]) == (2.0, 0.0)
    wide = df.withColumnRenamed("value", "observed")
    assert {x["variable"] for x in effects.long_result(wide, ["location_id"]).collect()} == {"observed", "predicted"}


def test_small_sources(spark):
    s = spark.createDataFrame([("1", "2", dt.date(2019, 5, 1), dt.date(2021, 2, 1))], "usaf string, wban string, begin date, end date")
    cat = tables.station_catalogue(s)
    assert sorted(r["year"] for r in cat.collect()) == [2019, 2020, 2021]
    cached = spark.createDataFrame([("1-2", 2019), ("1-2", 2021)], "code string, year int")
    todo = joins.years_to_read(s.withColumn("code", F.lit("1-2")), cached, stale_since=2021)
    assert sorted(r["year"] for r in todo.collect()) == [2020, 2021]
    hours = spark.createDataFrame([(dt.datetime(2024, 1, 1, 9),), (dt.datetime(2024, 1, 1, 10),), (dt.datetime(2024, 1, 3, 11),), (dt.datetime(2024, 1, 3, 12),)], "ts timestamp")
    assert tables.hours_between(hours, "2024-01-02", "2024-01-02").count() == 2
    zones = spark.createDataFrame([("z", 5.5)], "zone string, offset_hours double")
    local = st.local_dates(spark.createDataFrame([("z", dt.datetime(2024, 1, 1, 20))], "zone string, ts timestamp"), zones).first()
    assert local["local_date"] == dt.date(2024, 1, 2)
    with pytest.raises(ValueError, match="no measurements"):
        tables.required(hours.limit(0), "measurements")


def test_several_outputs_with_presets_and_overrides(spark):
    meas, met = world(spark, 200)
    options = {"key": KEY, "lag": 0, "trees": 500, "learning_rate": 0.1, "cv_folds": 0, "training_end": {"anomaly": "2023-06-01"}}
    out = plan.deweather(meas, met, ["air_temp_min"], output=["anomaly", "trend"], preset={"trees": 25}, override={"ntrainings": 2}, **options)
    models = out["models"].collect()
    assert {(r["config_id"], r["replicate"]) for r in models} == {(0, 0), (0, 1), (1, 0), (1, 1)} and all(r["n_trees_opt"] <= 25 for r in models)
    names = {(r["config_id"], r["variable"]) for r in out["result"].filter("value is not null").select("config_id", "variable").distinct().collect()}
    assert (1, "trend") in names and (0, "trend") not in names
    n = {r["config_id"]: r["n_training"] for r in models}
    assert n[0] < n[1]  # only the anomaly has an end


def test_null_keys_keep_their_trend_and_fires(spark):
    meas, met = world(spark, 200)
    both = meas.filter("location_id = 1").withColumn("process_id", F.explode(F.array(F.lit("a"), F.lit(None).cast("string"))))
    weather_rows = met.withColumn("fire_frp", F.when(F.dayofyear("date") % 9 == 0, 5.0).otherwise(0.0))
    out = plan.deweather(both, weather_rows, ["air_temp_min", "fire_frp"], output="trend", key=[*KEY, "process_id"], lag=0, trees=20, learning_rate=0.1, cv_folds=2)
    n = {(r["process_id"], r["variable"]): r["n"] for r in out["result"].filter("value is not null").groupBy("process_id", "variable").agg(F.count("value").alias("n")).collect()}
    for name in ("trend", "predicted", "predicted_nofire", "observed"):
        assert n["a", name] == n[None, name] >= 200


def test_yoy_keeps_originals_and_goes_to_the_sink(spark, tmp_path):
    meas, met = world(spark)
    sink = Store(spark, f"file://{tmp_path}/yoy", [*KEY, "month", "date", "variable", "process"])
    options = {"key": KEY, "lag": 0, "trees": 20, "learning_rate": 0.1, "cv_folds": 0}
    months = ["2024-01-01", "2024-02-01"]
    out = plan.deweather_yoy(meas, met, ["air_temp_min", "ws"], months, keep_originals=True, sink=sink, constants={"process": "yoy"}, **options)
    names = {r[0] for r in out.select("variable").distinct().collect()}
    assert {"observed", "predicted", "anomaly", "total", "weather", "emission"} <= names
    assert {r["month"].month for r in out.select("month").distinct().collect()} == {1, 2}
    assert sink.read().count() == out.count() and sink.read().filter("process <> 'yoy'").count() == 0
    # the parts alone are those of the plain call
    plain = plan.deweather_yoy(meas, met, ["air_temp_min", "ws"], months, **options)
    parts = out.filter(F.col("variable").isin("total", "weather", "emission", "total_rel", "weather_rel", "emission_rel")).drop("month")
    assert plain.count() == parts.count() == 24


def test_bucketed_tables_reach_the_fit_without_a_shuffle(spark):
    meas, met = world(spark, 120)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        m, w = (tables.write_bucketed(df, name, buckets=4) for df, name in ((meas, "meas_by_place"), (met, "weather_by_place")))
        data = prep_data(with_weather(m, w), KEY, ["air_temp_min", "ws"], 1)
        grid = model.config_grid({"anomaly": {}}, ["air_temp_min", "ws"], trees=20, learning_rate=0.1, lag=1, cv_folds=2)
        rows, models = model.fit_configs(data, KEY, grid, clustered=True)
        plan_text = rows.unpersist()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan_text and plan_text.count("Bucketed: true") >= 2
        assert {r["status"] for r in models.collect()} == {"ok"} and models.count() == 2
        _, dealt = model.fit_configs(prep_data(with_weather(meas, met), KEY, ["air_temp_min", "ws"], 1), KEY, grid)
        assert {r["model"] for r in dealt.collect()} == {r["model"] for r in models.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        spark.conf.unset(tables.CO_PARTITION)
        spark.sql("DROP TABLE IF EXISTS meas_by_place")
        spark.sql("DROP TABLE IF EXISTS weather_by_place")


def test_results_of_predictions_are_dealt_by_bytes(spark, monkeypatch):
    """parts follow the bytes of the table whatever the other shuffles have, one shuffle serves the view, the means and the trend."""
    at, least = "/root/testdata/sf0.001", int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(tables, "TASK_BYTES", 5_000)
    kept = views.view(spark, at, "obs_pred").selectExpr("location_id", "date", "observed", "predicted + 2 AS predicted", "observed - predicted - 2 AS anomaly", "trend")
    want = {(r["location_id"], r["date"], v): r[v] for r in kept.collect() for v in ("observed", "predicted", "anomaly", "trend")}
    out = registry.queries()["results_of_predictions"](spark, at)
    steps = out._jdf.queryExecution().executedPlan().toString()  # not run yet
    assert steps.count("Exchange ") == steps.count("FileScan ") == 1
    assert out.rdd.getNumPartitions() > 2 * least
    got = [((r["location_id"], r["date"], r["variable"]), r["value"]) for r in out.collect()]
    assert len(got) == len(want) and dict(got) == pytest.approx(want, rel=1e-6, abs=1e-6)
    assert registry.queries()["anomaly_of_replicates"](spark, at).rdd.getNumPartitions() > 2 * least


def test_daily_series_are_dealt_once(spark, monkeypatch):
    """rows are shuffled by series before they are summed up by day, into parts by bytes; the preparation needs no other shuffle."""
    at, least = "/root/testdata/sf0.001", int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(tables, "TASK_BYTES", 5_000)
    out = registry.queries()["prep_features"](spark, at)
    steps = out._jdf.queryExecution().executedPlan().toString()  # not run yet
    assert steps.count("Exchange ") == steps.count("FileScan ") == 1
    assert out.rdd.getNumPartitions() > 2 * least
    plain = views.view(spark, at, "daily")
    assert plain.count() == views.view(spark, at, "daily", dealt=True).count()


def test_anomalies_keep_what_stands_beside(spark):
    """Keys that are NULL stay, and of a column beside the replicates the value that is not NULL."""
    rows = [(None, "2024-01-01", 3.0, 1.0, None), (None, "2024-01-01", 3.0, 2.0, 7.0), (1, None, None, 4.0, None)]
    df = spark.createDataFrame(rows, "location_id int, date string, value double, predicted double, trend double")
    out = {r["location_id"]: (r["predicted"], r["anomaly"], r["trend"]) for r in effects.anomaly(df, ["location_id"], ["trend"]).collect()}
    assert out == {None: (1.5, 1.5, 7.0), 1: (4.0, None, None)}
