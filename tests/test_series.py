"""Cleaning, filling, lags, rolling means, preparation: the assertions of the series operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from weathernorm.functions import columns as fn
from weathernorm.operators import cleaning, joins, yoy
from weathernorm.plans.prep import prep_data
from weathernorm.sources import tables

VARS = ["wd", "ws", "precip", "atmos_pres", "air_temp_min", "air_temp_max", "dewpoint_temp", "pbl_min", "pbl_max"]


def days(n, start="2021-01-01"):
    return [dt.date.fromisoformat(start) + dt.timedelta(k) for k in range(n)]


def series(spark, n=10, location=1, start="2021-01-01", **own):
    rows = []
    for k, d in enumerate(days(n, start)):
        row = {"location_id": location, "date": d, "value": 10.0 * (k + 1), "wd": 45.0 * k % 360, "ws": k + 1.0, "precip": 0.1, "atmos_pres": 1010.0 + k, "air_temp_min": float(k), "air_temp_max": 5.0 + k, "dewpoint_temp": k / 2, "pbl_min": 100.0 + 10 * k, "pbl_max": 200.0 + 10 * k, "fire_frp": 1.0}
        row |= {c: f[k] if isinstance(f, list) else f for c, f in own.items()}
        rows.append(row)
    kinds = {"location_id": "int", "date": "date"}
    schema = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in rows[0])
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema)


def values(df, column, order="date"):
    return [r[column] for r in df.orderBy(order).collect()]


def test_not_finite_becomes_null(spark):
    ws = [1.0, float("inf"), float("-inf"), float("nan"), None]
    assert values(cleaning.null_not_finite(series(spark, 5, ws=ws)), "ws") == [1.0, None, None, None, None]


def test_outlier_goes_on_one_side_only(spark):
    v = [10.0, 20.0, 30.0, 40.0, 10000.0, 50.0, 60.0, 70.0, 80.0, -10000.0]
    assert values(cleaning.drop_outliers(series(spark, value=v), ["location_id"]), "value") == [x for x in v if x < 9000]


def test_constant_series_keeps_its_values(spark):
    assert len(values(cleaning.drop_outliers(series(spark, value=5.0), ["location_id"]), "value")) == 10


def test_null_values_and_dates_go(spark):
    df = series(spark, value=[None] + [1.0] * 9).withColumn("date", F.when(F.col("ws") != 3, F.col("date")))
    assert cleaning.clean(df, ["location_id"]).count() == 8


def test_fills(spark):
    pressure = [1010.0, 1011.0, None, 1013.0] + [1014.0] * 6
    fire = [None, 1.0, 2.0, None, 3.0, None, 4.0, 5.0, None, 6.0]
    out = cleaning.fill_series(series(spark, atmos_pres=pressure, fire_frp=fire, pbl_min=None, precip=[None] + [0.1] * 9, ws=[None] + [1.0] * 9), ["location_id"], [*VARS, "fire_frp"])
    assert values(out, "atmos_pres")[2] == 1012.0
    assert values(out, "fire_frp") == [0.0 if x is None else x for x in fire]
    assert values(out, "pbl_min") == [0.0] * 10
    assert values(out, "precip")[0] == 0.0
    assert values(out, "ws")[0] is None  # wind is never filled


def test_long_gaps_and_ends_stay(spark):
    t = [None, 1.0, None, None, None, None, None, None, 8.0, None]
    assert values(cleaning.fill_series(series(spark, air_temp_min=t), ["location_id"], ["air_temp_min"]), "air_temp_min") == t
    t[2] = 2.0  # five missing rows are filled
    assert values(cleaning.fill_series(series(spark, air_temp_min=t), ["location_id"], ["air_temp_min"]), "air_temp_min")[1:9] == pytest.approx([1, 2, 3, 4, 5, 6, 7, 8])


def test_lag_is_by_calendar_day(spark):
    df = series(spark, 5).filter(F.col("ws") != 3)
    out = cleaning.add_lags(df, ["location_id"], ["ws"], 1)
    assert values(out, "ws_lag1") == [None, 1.0, 2.0, None, 4.0]
    assert cleaning.add_lags(df, ["location_id"], ["ws"], 0) is df


def test_wind_sectors(spark):
    wd = [0.0, 44.9, 45.0, 90.0, 180.0, 315.0, 359.9, 360.0]
    df = series(spark, 8, wd=wd)
    assert values(df.withColumn("s", fn.wind_sector(F.col("wd"))), "s") == [0, 0, 1, 2, 4, 7, 7, 0]
    assert values(df.withColumn("s", fn.wind_sector(F.col("wd"), wrap=False)), "s")[-1] == 8


def test_rolling_mean_needs_its_width(spark):
    out = cleaning.rolling_mean(series(spark, 6).filter(F.col("ws") != 4), ["location_id"], width=3, max_nulls=1)
    assert values(out, "value") == [None, None, 20.0, 25.0, 40.0, 55.0]
    assert values(cleaning.rolling_mean(series(spark, 6).filter(F.col("ws") != 4), ["location_id"], width=3, max_nulls=0), "value")[3] is None


def test_prep_skips_a_bad_series_only(spark):
    both = series(spark, 10).unionByName(series(spark, 15, 2, ws=None)).unionByName(series(spark, 10, 3, "2018-01-01"))
    out = prep_data(both, ["location_id"], [v for v in VARS if v != "ws"] + ["ws"], lag=1)
    # an all-NULL column becomes 0, so location 2 stays; location 3 is too old
    assert {r["location_id"] for r in out.select("location_id").distinct().collect()} == {1, 2}
    assert out.filter("location_id = 1").count() == 10
    assert {"wd_factor", "ws_lag1", "date_unix", "yday", "season"} <= set(out.columns)
    with pytest.raises(ValueError, match="missing columns"):
        prep_data(both.drop("wd"), ["location_id"], VARS)


def test_decimal_year_round_trip(spark):
    df = spark.sql("SELECT explode(sequence(DATE '2019-12-20', DATE '2021-01-10')) AS date")
    back = df.withColumn("back", fn.from_decimal_year(fn.decimal_year(F.col("date"))))
    assert back.filter("date <> back").count() == 0
    x = spark.sql("SELECT DATE '2024-07-01' AS date").select(fn.decimal_year(F.col("date"))).first()[0]
    assert x == pytest.approx(2024.49727, abs=1e-5)


def test_link(spark):
    df = spark.createDataFrame([(0.0,), (math.e,)], "v double")
    assert [r[0] for r in df.select(fn.link(F.col("v"), "log")).collect()] == [None, 1.0]
    with pytest.raises(ValueError):
        fn.link(F.col("v"), "sqrt")


def test_yoy_dates(spark):
    count = lambda m: len(spark.range(1).select(fn.yoy_dates(F.lit(m).cast("date"))).first()[0])
    assert count("2024-07-15") == 62
    assert count("2024-02-01") == 57


def long_result(spark, location, observed, predicted):
    rows = []
    for year, o, p in ((2023, observed[0], predicted[0]), (2024, observed[1], predicted[1])):
        for d in range(1, 6):
            rows += [(location, dt.date(year, 7, d), "observed", o), (location, dt.date(year, 7, d), "predicted", p)]
    return spark.createDataFrame(rows, "location_id string, date date, variable string, value double")


def test_yoy_attribution_golden(spark):
    df = long_result(spark, "a", (50.0, 55.0), (45.0, 48.0)).union(long_result(spark, "b", (60.0, 50.0), (55.0, 45.0)))
    out = {(r["location_id"], r["variable"]): r["value"] for r in yoy.yoy_attribution(df, ["location_id"], "2024-07-01").collect()}
    assert len(out) == 12
    assert [out["a", v] for v in ("total", "weather", "emission")] == [5.0, 3.0, 2.0]
    assert [out["a", f"{v}_rel"] for v in ("total", "weather", "emission")] == pytest.approx([0.10, 0.06, 0.04])
    assert out["b", "emission"] == 0.0


def test_yoy_attribution_needs_both_variables(spark):
    df = long_result(spark, "a", (50.0, 55.0), (45.0, 48.0)).filter("variable = 'observed'")
    assert yoy.yoy_attribution(df, ["location_id"], "2024-07-01").count() == 0


def test_coalesce_join_adds_columns(spark):
    old = spark.createDataFrame([(1, 2.0), (2, None)], "k int, a double")
    new = spark.createDataFrame([(1, 9.0, 5.0), (2, 9.0, 6.0)], "k int, a double, b double")
    assert [tuple(r) for r in joins.coalesce_join(old, new, ["k"], ["a", "b"]).orderBy("k").collect()] == [(1, 2.0, 5.0), (2, 9.0, 6.0)]


def test_names_fold_all_of_latin(spark):
    said = {"Łódź": "lodz", " İzmir ": "izmir", "Đà Nẵng": "da nang", "Ćuprija": "cuprija", "Großœuvre": "grossoeuvre", "Ærø": "aero", "Šiauliai": "siauliai", "Timișoara": "timisoara", "München": "munchen", "ğüş ı": "gus i"}
    df = spark.createDataFrame([(k,) for k in said], "name string")
    assert {r[0]: r[1] for r in df.select("name", fn.fold_name(F.col("name"))).collect()} == said


def test_days_of_23_and_25_hours(spark):
    df = spark.createDataFrame([("2024-03-31",), ("2024-10-27",), ("2024-06-01",)], "d string").select(F.col("d").cast("date").alias("d"))
    hours = {str(r[0]): r[1] for r in df.select("d", fn.utc_hours_of_local_day(F.col("d"), F.lit("Europe/Berlin"))).collect()}
    assert [len(hours[d]) for d in ("2024-03-31", "2024-10-27", "2024-06-01")] == [23, 25, 24]
    assert hours["2024-06-01"][0] == dt.datetime(2024, 5, 31, 22)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert df.select("d", fn.utc_hours_of_local_day(F.col("d"), F.lit("Europe/Berlin"))).collect()[2][1] == hours["2024-06-01"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_dates_in_file_names(spark):
    paths = {"/x/era5_2024-01-05.tiff": dt.date(2024, 1, 5), "gdas_2023-12-31.nc": dt.date(2023, 12, 31), "/a_2024-01-01/b.tif": None, "era5_latest.nc": None}
    df = spark.createDataFrame([(k,) for k in paths], "p string")
    assert {r[0]: r[1] for r in df.select("p", fn.date_in_name(F.col("p"))).collect()} == paths


def test_calendar_of_repeated_and_missing_dates(spark):
    rows = [(1, dt.date(2024, 1, 1), 1.0), (1, dt.date(2024, 1, 4), 2.0), (1, dt.date(2024, 1, 4), 3.0), (2, dt.date(2024, 5, 1), 4.0), (2, None, 5.0), (3, dt.date(2024, 2, 28), 6.0), (3, dt.date(2024, 3, 1), None)]
    df = spark.createDataFrame(rows, "k int, date date, v double")
    got = [(r["k"], r["date"].isoformat()[5:], r["v"]) for r in cleaning.calendar(df, ["k"]).orderBy("k", "date", "v").collect()]
    assert got == [(1, "01-01", 1.0), (1, "01-02", None), (1, "01-03", None), (1, "01-04", 2.0), (1, "01-04", 3.0), (2, "05-01", 4.0), (3, "02-28", 6.0), (3, "02-29", None), (3, "03-01", None)]
    months = spark.createDataFrame([(1, dt.date(2024, 1, 1), 1.0), (1, dt.date(2024, 4, 1), 2.0)], "k int, date date, v double")
    assert [r["date"].month for r in cleaning.calendar(months, ["k"], unit="MONTH").orderBy("date").collect()] == [1, 2, 3, 4]


def test_rolling_mean_takes_other_aggregates_and_text(spark):
    df = series(spark, 6, value=[1.0, 5.0, None, 3.0, 2.0, 9.0])
    assert values(cleaning.rolling_mean(df.select("location_id", "date", "value"), ["location_id"], width=3, mean=F.max), "value") == [None, None, 5.0, 5.0, 3.0, 9.0]
    text = df.select("location_id", "date", F.when(F.col("value") > 2.5, "b").otherwise("a").alias("t"))
    assert values(cleaning.rolling_mean(text, ["location_id"], "t", width=2), "t") == [None, "a", "a", "a", "a", "a"]


def test_parts_follow_the_bytes_of_the_files(spark, tmp_path, monkeypatch):
    """a shuffle before the preparation has more parts when the tables are larger, and the windows take it as it is."""
    rows = spark.range(20_000).select((F.col("id") % 50).alias("location_id"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 50).cast("int")).alias("date"), F.rand(1).alias("value"), F.rand(2).alias("ws"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/t")
    stored, least = spark.read.parquet(f"{tmp_path}/t"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tables.spread(stored, "location_id").rdd.getNumPartitions() == least
    monkeypatch.setattr(tables, "TASK_BYTES", 10_000)
    wide = tables.spread(stored, "location_id")
    assert wide.rdd.getNumPartitions() > 2 * least
    out = prep_data(wide, ["location_id"], ["ws"], since=None)
    assert out.rdd.getNumPartitions() == wide.rdd.getNumPartitions()
    assert out.count() == 20_000 and prep_data(stored, ["location_id"], ["ws"], since=None).exceptAll(out).isEmpty()
