"""Joins in space and time against brute force; the keyed store; entry points."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weathernorm.operators import space_time as st
from weathernorm.plans import weather as plans
from weathernorm.sources import store, tables


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


def test_within_km_at_poles_and_date_line(spark):
    rng = random.Random(2)
    left = [(k, rng.choice([89.5, -89.9, 0.1, 45.0]) + rng.uniform(-0.4, 0.4), rng.choice([179.9, -179.9, 0.0]) + rng.uniform(-0.09, 0.09)) for k in range(60)]
    right = [(k, rng.choice([89.5, -89.9, 0.1, 45.0]) + rng.uniform(-0.4, 0.4), rng.choice([179.9, -179.9, 0.0]) + rng.uniform(-0.09, 0.09)) for k in range(60)]
    a = spark.createDataFrame(left, "i int, lat double, lon double")
    b = spark.createDataFrame(right, "j int, r_lat double, r_lon double")
    found = {(r["i"], r["j"]) for r in st.within_km(a, b, 60.0).collect()}
    assert found == {(i, j) for i, *p in left for j, *q in right if km(p, q) <= 60.0}
    assert found


def test_fuzzy_names_against_brute_force(spark):
    names = ["paris", "pariss", "parys", "aris", "lyon", "lyons", "marseille", "x", "xy", ""]
    cities = spark.createDataFrame([(k, n, "france") for k, n in enumerate(names) if n], "id int, name string, country string")
    stations = spark.createDataFrame([(k, n, "none", "Francé") for k, n in enumerate(["Pàris", "paris", "lyn", "marseile", "zz", "y"])], "station_id int, city string, region string, country string")
    out = {r["station_id"]: r["city_name"] for r in st.fuzzy_city(stations, cities).collect()}
    assert out == {0: "paris", 1: "paris", 2: "lyon", 3: "marseille", 4: None, 5: "x"}


def test_fire_needs_space_and_time(spark):
    day = dt.datetime(2024, 1, 5)
    days = spark.createDataFrame([(1, dt.date(2024, 1, 5), 10.0, 10.0, day, 90.0, 5.0)], "location_id int, date date, lat double, lon double, at timestamp, wd double, ws double")
    fires = spark.createDataFrame([(dt.datetime(2024, 1, 4), 10.0, 10.5, 3.0, "A"), (dt.datetime(2024, 1, 4), 10.0, 9.5, 5.0, "B"), (dt.datetime(2024, 1, 1), 10.0, 10.0, 7.0, "A"), (dt.datetime(2024, 1, 4), 40.0, 10.0, 9.0, "A")], "ts timestamp, lat double, lon double, frp double, region string")
    one = lambda df: df.first().asDict()
    assert one(st.fires_circular(days, fires, hours=72))["fire_frp"] == 8.0
    assert one(st.fires_oriented(days, fires))["fire_frp"] == 3.0  # the wind comes from the east
    assert one(st.fires_split(days, fires, ["A", "B"], hours=72)) == {"location_id": 1, "date": dt.date(2024, 1, 5), "fire_frp_A": 3.0, "fire_frp_B": 5.0}


def test_station_weather_plan(spark):
    loc = spark.createDataFrame([(1, 0.0, 0.0)], "location_id int, lat double, lon double")
    stations = spark.createDataFrame([(7, 0.0, 0.5, dt.date(2021, 1, 1)), (8, 0.0, 0.1, dt.date(2019, 1, 1))], "code int, lat double, lon double, end date")
    hours = [(7, dt.datetime(2024, 1, 1, h), 10.0 + h, 1000.0, 90.0, 2.0, 100.0, 5.0, 0.0, 50.0) for h in range(24)]
    hourly = spark.createDataFrame(hours, "code int, ts timestamp, air_temp double, atmos_pres double, wd double, ws double, ceil_hgt double, visibility double, precip double, RH double")
    out = plans.station_weather(loc, stations, hourly).first()
    assert (out["air_temp_min"], out["air_temp_max"], out["humidity"]) == pytest.approx((10.0, 33.0, 0.5))


def test_store_round_trip(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s", ["location_id", "variable"])
    assert s.read().count() == 0 and s.keys().count() == 0 and s.remove(location_id=1) == 0
    a = spark.createDataFrame([("1", "x", 1.0), ("1", "y", 2.0), ("2", "x", 3.0)], "location_id string, variable string, value double")
    s.put(a)
    s.put(spark.createDataFrame([("1", "x", 9.0)], a.schema))
    assert sorted(r["value"] for r in s.read().collect()) == [2.0, 3.0, 9.0]
    assert s.find(location_id="1", variable=None).count() == 2
    assert s.remove(location_id="1", variable="y") == 1
    assert s.keys().count() == 2


def test_daily_store_replaces_only_its_dates(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    tables.write_daily(spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 1, 2))], "v int, date date"), path)
    tables.write_daily(spark.createDataFrame([(3, dt.date(2024, 1, 2))], "v int, date date"), path)
    assert sorted(r["v"] for r in tables.read_daily(spark, path).collect()) == [1, 3]
    assert tables.read_daily(spark, path, ["2024-01-03"]).count() == 0


def test_region_csv_skips_and_counts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,region,Tair,Qair,Wind,PSurf,Rainf,SWdown\nA20240101_0300,X,1,2,3,4,5,6\nbad,X,1,2,3,4,5,6\nA20240101_0600,X,one,2,3\n\n")
    (tmp_path / "b.csv").write_text('"extra","region","id","SWdown","Rainf","PSurf","Wind","Qair","Tair"\n9,"Y","A20240102_0000",6,5,4,3,2,1\n')
    (tmp_path / "c.csv").write_text("id,region,Tair\nA20240101_0300,X,1\n")
    (tmp_path / "d.csv").write_text("nothing of use\nhere\n")
    rows, skipped = tables.region_csv(spark, f"file://{tmp_path}/*.csv")
    found = sorted((str(r["ts"]), r["region"], r["Tair"], r["SWdown"]) for r in rows.collect())
    assert found == [("2024-01-01 03:00:00", "X", 1.0, 6.0), ("2024-01-01 06:00:00", "X", None, None), ("2024-01-02 00:00:00", "Y", 1.0, 6.0)]
    said = {r["file"]: (r["lines"], r["reason"]) for r in skipped.collect()}
    assert said["a.csv"][0] == 1 and set(said) == {"a.csv", "c.csv", "d.csv"} and said["c.csv"][1].startswith("lacks Qair")


def test_station_years_with_fresh_ones(spark, tmp_path):
    stored = spark.createDataFrame([("a", 2020, 1.0), ("a", 2021, 2.0), ("b", 2021, 3.0)], "code string, year int, wd double")
    stored.write.partitionBy("code", "year").parquet(f"file://{tmp_path}/s")
    fresh = spark.createDataFrame([("a", 2021, 9.0, 1.0), ("a", 2022, 8.0, 1.0)], "code string, year int, wd double, ws double")
    got = tables.station_years(spark, f"file://{tmp_path}/s", ["a"], [2020, 2021, 2022], fresh)
    assert sorted(r["wd"] for r in got.collect()) == [1.0, 8.0, 9.0]
    assert tables.station_years(spark, f"file://{tmp_path}/s", years=[2021]).count() == 2


def test_keys_of_a_store_stay_what_they_are(spark, tmp_path):
    schema = "location_id string, variable string, value double"
    s = store.Store(spark, f"file://{tmp_path}/k", ["location_id", "variable"], schema=schema)
    assert s.read().schema.simpleString() == "struct<location_id:string,variable:string,value:double>" and s.find(location_id="1").count() == 0
    rows = [("007", "x", 1.0), ("7", "x", 2.0), ("", "x", 3.0), (None, "x", 4.0), ("a=b/c %", "x", 5.0)]
    s.put(spark.createDataFrame(rows, schema))
    s.put(spark.createDataFrame([("007", "x", 10.0), (None, "x", 40.0)], schema))
    got = sorted(((r["location_id"], r["value"]) for r in s.read().collect()), key=str)
    assert got == sorted([("007", 10.0), ("7", 2.0), ("", 3.0), (None, 40.0), ("a=b/c %", 5.0)], key=str)
    assert s.find(location_id="007").first()["value"] == 10.0 and s.find(location_id="").first()["value"] == 3.0
    with pytest.raises(TypeError, match="location_id: int"):
        s.put(spark.createDataFrame([(7, "x", 1.0)], "location_id int, variable string, value double"))
    s.put(spark.createDataFrame([("8", "x", 1.0, "new")], schema + ", note string"))
    assert s.find(location_id="7").first()["note"] is None and s.read().count() == 6


def test_a_write_touches_its_buckets_only_and_breaks_off_without_harm(spark, tmp_path, monkeypatch):
    s = store.Store(spark, f"file://{tmp_path}/w", ["location_id"])
    s.put(spark.createDataFrame([(str(k), float(k)) for k in range(50)], "location_id string, value double"))
    before = s._current()[1]["buckets"]
    s.put(spark.createDataFrame([("3", 33.0)], "location_id string, value double"))
    after = s._current()[1]["buckets"]
    assert sum(before[b] != after[b] for b in after) == 1 and s.read().count() == 50
    # broken off between the rows and the snapshot, and in the middle of the snapshot
    with monkeypatch.context() as m:
        m.setattr(store.Store, "_commit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            s.put(spark.createDataFrame([("3", 99.0)], "location_id string, value double"))
    assert s.find(location_id="3").first()["value"] == 33.0
    (tmp_path / "w" / "snapshots" / f"{s._current()[0] + 1:012d}").write_text('{"schema": ')
    assert s.find(location_id="3").first()["value"] == 33.0
    s.put(spark.createDataFrame([("3", 34.0)], "location_id string, value double"))
    assert s.find(location_id="3").first()["value"] == 34.0
    # of two writers one fails
    number, snapshot = s._current()
    s.put(spark.createDataFrame([("4", 44.0)], "location_id string, value double"))
    with pytest.raises(store.ConcurrentWrite):
        s._replace(number, snapshot, s.find(location_id="5"), [5])
    assert s.vacuum(keep=1) > 0 and s.read().count() == 50 and s.find(location_id="4").first()["value"] == 44.0


def test_entry_and_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_snapshot_is_computed_once(spark, tmp_path):
    path, calls = f"file://{tmp_path}/snap", []

    def compute():
        calls.append(1)
        return spark.createDataFrame([(1, 2.0)], "location_id int, value double")

    assert tables.snapshot(spark, path, compute).columns == ["location_id"]
    assert tables.snapshot(spark, path, compute).count() == 1 and calls == [1]


def test_fire_archive_replaces_days(spark, tmp_path):
    head = "latitude,longitude,acq_date,acq_time,frp\n"
    for k, rows in enumerate(["1,2,2024-01-01,0100,5\n1,2,2024-01-02,0100,6\n", "1,2,2024-01-02,0200,7\n"]):
        (tmp_path / f"{k}.csv").write_text(head + rows)
        tables.split_fires(spark, f"file://{tmp_path}/{k}.csv", f"file://{tmp_path}/fires")
    assert sorted(r["frp"] for r in spark.read.parquet(f"file://{tmp_path}/fires").collect()) == [5.0, 7.0]


def test_result_and_fire_sinks(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/r", store.RESULT_KEY)
    row = spark.createDataFrame([("1", "2024-01-01", "trend", 3.0)], "location_id string, date string, variable string, value double")
    for _ in range(2):
        s.put_results(row, poll="pm25", unit="ug", source="s", process_id="p")
    assert s.read().count() == 1
    fires = store.Store(spark, f"file://{tmp_path}/f", store.ARTEFACT_KEY)
    key = {"duration_hour": 72, "hours": [12, 0], "height": None, "met_type": "gdas1", "buffer_km": 10, "fire_source": "viirs", "fire_split_regions": None}
    fires.put_fires(spark.createDataFrame([("1", 2.0), ("2", None)], "location_id string, fire_frp double"), key)
    assert fires.find(hours=[0, 12], fire_split_regions="none").count() == 2
    assert fires.find(duration_hour=24).count() == 0
    assert fires.purge(["fire_frp"]) == 1 and fires.purge(["fire_frp"]) == 0
    assert fires.keys().count() == 1
    fires.put_fires(spark.createDataFrame([("2", 7.0)], "location_id string, fire_frp double"), key)
    assert fires.apply(lambda pdf: pdf.assign(fire_frp=pdf["fire_frp"] * 2), location_id="1") == 1
    assert {r["location_id"]: r["fire_frp"] for r in fires.read().collect()} == {"1": 4.0, "2": 7.0}


def test_grid_cells_go_round_the_earth(spark):
    points = spark.createDataFrame([(1, 10.0, -179.9), (2, 10.0, -90.0), (3, 10.0, 359.9)], "location_id int, lat double, lon double")
    for centres in ((180.0, 270.0, 0.0), (-180.0, -90.0, 360.0)):
        grid = spark.createDataFrame([(10.0, lon, k) for k, lon in enumerate(centres)], "cell_lat double, cell_lon double, v int")
        assert {(r["location_id"], r["v"]) for r in st.grid_cell_value(points, grid, 0.25).collect()} == {(1, 0), (2, 1), (3, 2)}


def _clustered_fires(spark):
    """A burning region (most fires in a few km), some around it, and places in and beside it."""
    rng = np.random.default_rng(4)
    start, rows = dt.datetime(2024, 1, 1), []
    for k in range(1500):
        hot = k % 3
        lat, lon = (float(c + rng.normal(0, 0.05 if hot else 2)) for c in (10, 20))
        rows.append((k, start + dt.timedelta(hours=int(rng.integers(0, 200)), minutes=int(rng.choice([0, 0, 17]))), lat, lon, float(rng.integers(1, 9)), "AB"[k % 2]))
    rows += [(9000 + k, start + dt.timedelta(days=2), 10.0, 20.0, 1.0, "A") for k in range(40)]  # at one time and place
    fires = spark.createDataFrame(rows, "fire_id int, ts timestamp, lat double, lon double, frp double, region string")
    places = [(k, dt.date(2024, 1, 1) + dt.timedelta(d), 10.0 + dy, 20.0 + dx, start + dt.timedelta(days=d, hours=h)) for k, (dy, dx, h) in enumerate([(0, 0, 0), (0.5, 0.3, 0), (1.7, 0, 0), (-1.8, 0.1, 5), (0, 40, 0)]) for d in (0, 3, 5, 8)]
    return fires, spark.createDataFrame(places, "location_id int, date date, lat double, lon double, at timestamp")


@pytest.mark.parametrize(("few", "halvings", "hours"), [(32, 4, 72), (1, 3, 120), (5, 5, 31), (10_000, 4, 72)])
def test_fires_by_leaves_are_those_of_all_pairs(spark, few, halvings, hours):
    fires, days = _clustered_fires(spark)
    got = {(r["location_id"], r["date"]): (r["fire_frp"], r["fire_count"]) for r in st.fires_circular(days, fires, 200.0, hours, few, halvings).collect()}
    want = {(r["location_id"], r["date"]): (r["fire_frp"], r["fire_count"]) for r in st.fire_sums(days, st.circular_pairs(days, fires, 200.0, hours)).collect()}
    assert got == want and max(n for _, n in want.values()) > 100


def test_only_the_border_sends_its_fires(spark):
    fires, days = _clustered_fires(spark)
    leaves, points = st.fire_leaves(fires, 200.0)
    assert points.agg(F.sum("n")).first()[0] == fires.count() == leaves.agg(F.sum("n")).first()[0]
    assert points.filter("ts = timestamp '2024-01-03' and n > 1").count() >= 1  # one time and place is one row
    crowded = leaves.filter(F.col("n") > st.FEW_FIRES)
    assert crowded.filter(F.col("_level") < st.HALVINGS).count() == 0


def test_trajectory_fires_count_once_by_id_and_follow_the_height(spark):
    day, ts = dt.date(2024, 1, 2), dt.datetime(2024, 1, 1, 20)
    fires = spark.createDataFrame([(1, ts, 10.0, 20.0, 3.0, "A"), (2, ts, 10.0, 20.0, 3.0, "A"), (3, ts, -10.0, 20.0, 9.0, "A")], "fire_id int, ts timestamp, lat double, lon double, frp double, region string")
    steps = [(1, day, dt.datetime(2024, 1, 1, h), lat, 20.0, height) for h in (21, 23) for lat, height in ((10.0, 100.0), (-10.0, 900.0))]
    points = spark.createDataFrame(steps, "location_id int, date date, point_ts timestamp, lat double, lon double, height double")
    sums = lambda **o: plans.add_fire(spark.createDataFrame([(1, day, 150.0, 250.0)], "location_id int, date date, pbl_min double, pbl_max double"), spark.createDataFrame([(1, 0.0, 0.0)], "location_id int, lat double, lon double"), o.pop("fires", fires), points=points, **o).first().asDict()
    assert {k: v for k, v in sums().items() if "fire" in k} == {"fire_frp": 6.0, "fire_count": 2}  # the two detections, by id; 200 m is next to 100
    assert sums(height=800.0)["fire_frp"] == 9.0
    assert sums(fires=fires.drop("fire_id"))["fire_count"] == 1
    assert {k: v for k, v in sums(regions=("A", "B"), by_age=True, hours=24).items() if "frp" in k} == {"fire_frp": 6.0, "fire_frp_A": 6.0, "fire_frp_B": 0.0, "fire_frp_age0": 0.0, "fire_frp_age1": 6.0}
    with pytest.raises(ValueError, match="points"):
        plans.add_fire(spark.createDataFrame([(1, day)], "location_id int, date date"), points.select("location_id", "lat", "lon"), fires, "trajectory")


def test_collected_weather_keeps_what_the_fires_need_and_no_more(spark, tmp_path):
    loc = spark.createDataFrame([(1, 0.0, 0.0)], "location_id int, lat double, lon double")
    stations = spark.createDataFrame([(7, 0.0, 0.5, dt.date(2021, 1, 1))], "code int, lat double, lon double, end date")
    hours = [(7, dt.datetime(2024, 1, 2, h), 10.0 + h, 1000.0, 90.0, 2.0, 100.0, 5.0, 0.0, 50.0) for h in range(24)]
    hourly = spark.createDataFrame(hours, "code int, ts timestamp, air_temp double, atmos_pres double, wd double, ws double, ceil_hgt double, visibility double, precip double, RH double")
    fires = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), 0.0, 1.0, 2.0, "A"), (dt.datetime(2024, 1, 1, 5), 0.0, -1.0, 4.0, "A")], "ts timestamp, lat double, lon double, frp double, region string")
    points = spark.createDataFrame([(1, dt.date(2024, 1, 2), dt.datetime(2024, 1, 1, 6), 0.0, -1.0)], "location_id int, date date, point_ts timestamp, lat double, lon double")
    path = f"file://{tmp_path}/weather"
    for mode, frp in (("circular", 6.0), ("oriented", 2.0), ("trajectory", 4.0), (None, 4.0)):
        out = plans.collect_weather(loc, ["air_temp_min"], stations, hourly, fires=fires, fire_mode=mode, points=points, save_to=path if mode is None else None)
        assert out.columns == ["location_id", "date", "air_temp_min", "fire_frp", "fire_count"] and out.first()["fire_frp"] == frp
    assert plans.collect_weather(loc, ["precip"], save_to=path).columns == out.columns  # the snapshot is what was saved


def test_stored_fires_are_not_computed_again(spark, tmp_path):
    loc = spark.createDataFrame([(1, 0.0, 0.0)], "location_id int, lat double, lon double")
    met = spark.createDataFrame([(1, dt.date(2024, 1, 2))], "location_id int, date date")
    fires = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), 0.0, 1.0, 2.0, "A")], "ts timestamp, lat double, lon double, frp double, region string")
    cache = store.Store(spark, f"file://{tmp_path}/fires", plans.FIRE_KEY, buckets=2)
    assert plans.add_fire(met, loc, fires, cache=cache, save=True).first()["fire_frp"] == 2.0
    assert plans.add_fire(met, loc, fires.limit(0), cache=cache).first()["fire_frp"] == 2.0
    assert plans.add_fire(met, loc, fires.limit(0), cache=cache, hours=48).first()["fire_frp"] == 0.0  # of other options nothing is stored


def _read_rows(df):
    """Rows that the scans of a query put out."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan"):
            found += node.metrics().get("numOutputRows").get().value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return found


def test_a_search_reads_the_row_groups_that_may_hold_it(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "ROW_GROUP", 64 << 10)
    s = store.Store(spark, f"file://{tmp_path}/s", ["location_id", "poll", "date"], buckets=2, sort_by=["poll", "date"])
    rows = spark.range(120_000).selectExpr("cast(id % 50 as int) location_id", "concat('p', id % 40) poll", "date_add(date '2020-01-01', cast(id / 2000 as int)) date", "rand(3) value")
    s.put(rows)
    found = s.find(poll="p7")
    assert found.count() == 3000 and _read_rows(found) < 0.35 * 120_000
    assert s.find(location_id=7, poll="p7").count() == rows.filter("location_id = 7 and poll = 'p7'").count()
    assert s.find(location_id="no number").count() == 0 and s.find(date="2020-01-05").count() == 2000


def test_a_unique_store_refuses_a_repeated_key(spark, tmp_path):
    twice = spark.createDataFrame([("1", "x", 1.0), ("1", "x", 2.0)], "location_id string, variable string, value double")
    s = store.Store(spark, f"file://{tmp_path}/s", ["location_id", "variable"], unique=True)
    with pytest.raises(ValueError, match="repeated"):
        s.put(twice)
    assert s.read().count() == 0
    s.put(twice.limit(1))
    many = store.Store(spark, f"file://{tmp_path}/t", ["location_id", "variable"])
    many.put(twice)  # a key's rows are replaced together
    many.put(twice.limit(1))
    assert many.read().count() == 1


def test_a_large_bucket_is_several_tasks(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s", ["location_id", "date"], buckets=4)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        s.put(spark.range(60_000).selectExpr("case when id % 10 < 9 then 1 else cast(id as int) end location_id", "id date", "rand(1) value"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert s.read().count() == 60_000
    files = [p for p in tmp_path.rglob("*.parquet")]
    assert len(files) > 6


@pytest.mark.parametrize("hours", [24, 7, 60])
def test_trajectory_sums_are_those_of_all_pairs(spark, hours):
    fires, _ = _clustered_fires(spark)
    fires = fires.drop("fire_id").withColumn("lat", F.round("lat", 1)).withColumn("lon", F.round("lon", 1))
    # the region goes with the place: which of a repeated fire's regions counts is open
    fires = fires.withColumns({"frp": F.when(F.col("lat") > 14, float("inf")).otherwise(F.col("frp")), "region": F.when(F.round(F.col("lat") * 10) % 2 == 0, "A").otherwise("B")})
    rng = np.random.default_rng(9)
    steps = []
    for k in range(12):
        for d in (2, 4, 6):
            steps += [(k, dt.date(2024, 1, 1 + d), dt.datetime(2024, 1, 1) + dt.timedelta(days=d, minutes=int(m)), float(np.round(10 + rng.normal(0, 2), 1)), float(np.round(20 + rng.normal(0, 2), 1))) for m in rng.choice([0, 17, 300, 1440, 2000, -900], 4)]
    points = spark.createDataFrame(steps, "location_id int, date date, point_ts timestamp, lat double, lon double")
    regions = ["A", "B"]
    got = st.trajectory_sums(points, fires, 150.0, hours, regions, 3).collect()
    want = st.fire_sums(points, st.trajectory_pairs(points, fires, 150.0, hours), regions, 3).collect()
    assert {tuple(sorted(r.asDict().items())) for r in got} == {tuple(sorted(r.asDict().items())) for r in want}
    assert max(r["fire_count"] for r in got) > 20


@pytest.mark.parametrize("hours", [72, 31])
def test_sums_by_place_and_day_are_those_of_all_pairs(spark, hours):
    fires, days = _clustered_fires(spark)
    fires = fires.withColumn("lat", F.round("lat", 1)).withColumn("lon", F.round("lon", 1))
    days = days.withColumns({"wd": F.lit(80.0), "ws": F.lit(3.0)})
    days = days.unionByName(days.withColumn("location_id", F.col("location_id") + 100))  # of one place
    rows = lambda df: {tuple(sorted(r.asDict().items())) for r in df.collect()}
    for ages, regions in ((hours // 24, ["A", "B"]), (None, None)):
        got, want = st.fires_near(days, fires, 200.0, hours, regions, ages), st.fire_sums(days, st.circular_pairs(days, fires, 200.0, hours), regions, ages)
        assert rows(got) == rows(want) and want.filter("fire_count > 10").count()
        got, want = st.fires_oriented(days, fires, 60.0, hours, 200.0, regions, ages), st.fire_sums(days, st.oriented_pairs(days, fires, 60.0, 200.0, hours), regions, ages)
        assert rows(got) == rows(want) and want.filter("fire_count > 10").count()


def test_fires_of_a_place_and_day_are_one_row_of_the_tree(spark):
    day = dt.datetime(2024, 1, 2)
    fires = spark.range(2000).select((F.lit(day) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id"))).alias("ts"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit(1.0).alias("frp"))
    once = fires.groupBy("lat", "lon", F.lit(day + dt.timedelta(days=1)).alias("ts")).agg(F.sum("frp").alias("frp"), F.count(F.lit(1)).alias("n"))
    leaves, points = st.fire_leaves(once, 200.0, n="n")
    assert points.count() == 1 and leaves.first()["n"] == 2000


def test_places_are_searched_once(spark, monkeypatch):
    rng = random.Random(5)
    spots = [(float(rng.randint(-3, 3)), float(rng.randint(-3, 3))) for _ in range(12)]
    locations = [(k, *spots[k % 12]) for k in range(120)]
    stations = [(k, *spots[k * 7 % 12], dt.date(2021 + k % 2, 1, 1)) for k in range(240)]
    asked, within = [], st.within_km
    monkeypatch.setattr(st, "within_km", lambda left, right, *more: asked.append((left.count(), right.count())) or within(left, right, *more))
    near = st.nearest_stations(spark.createDataFrame(locations, "location_id int, lat double, lon double"), spark.createDataFrame(stations, "code int, lat double, lon double, end date"), 300.0, 3)
    got = {(r["location_id"], r["rank"]): r["code"] for r in near.collect()}
    want = {}
    for k, *at in locations:
        order = sorted((-end.toordinal(), km(at, p), code) for code, *p, end in stations if km(at, p) < 300.0)
        want |= {(k, n + 1): code for n, (_, _, code) in enumerate(order[:3])}
    assert got == want
    cities = [(k, f"c{k}", "ab"[k % 2], *spots[k * 5 % 12]) for k in range(240)]
    points = spark.createDataFrame([(k, "ab"[k // 60], *p) for k, *p in locations], "location_id int, country string, lat double, lon double")
    found = {r["location_id"]: r["city_id"] for r in st.nearest_city(points, spark.createDataFrame(cities, "id int, name string, country string, lat double, lon double"), 300.0).collect()}
    best = {k: min(((km(p, q), i) for i, _, c, *q in cities if c == "ab"[k // 60] and km(p, q) <= 300.0), default=(0, None))[1] for k, *p in locations}
    assert found == {k: i for k, i in best.items() if i is not None}
    assert all(left <= 24 and right <= 12 * 2 * 3 for left, right in asked) and len(asked) == 2


def test_layers_by_cell_and_offset_are_those_by_location(spark, monkeypatch):
    from weathernorm.operators import aggregates as agg

    at = spark.range(40).selectExpr("cast(id as int) location_id", "0.1 * id lat", "359.0 + 0.07 * id lon", "id % 5 - 2 + 0.5 offset_hours")
    hourly = spark.range(600).selectExpr("cast(id % 4 as double) cell_lat", "cast(id % 3 as double) cell_lon", "timestamp '2024-01-01' + make_dt_interval(0, 0, id * 7) ts", "cast(id * 37 % 101 as double) blh")
    want = agg.local_day_extremes(st.grid_cell_value(at.drop("offset_hours"), hourly, 2.0), at.select("location_id", "offset_hours"))
    rows = lambda df: sorted(tuple(r) for r in df.select("location_id", "date", "pbl_min", "pbl_max", F.round("pbl", 6)).collect())
    assert rows(plans.local_layers(at, hourly, 2.0)) == rows(want) != []
