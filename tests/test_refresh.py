"""Preparing what changed days touch gives what preparing everything gives."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from weathernorm.plans.prep import prep_data
from weathernorm.plans.refresh import refresh
from weathernorm.sources import store
from weathernorm.sources.store import Store

KEY, VARS = ["location_id", "poll"], ["air_temp_min", "precip", "ws", "pbl_min"]
SCHEMA = "location_id int, poll string, date date, value double, air_temp_min double, precip double, ws double, pbl_min double"


def _series(n=150, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for place in range(12):
        for poll in ("no2", None):
            for d in range(n):
                if rng.random() < 0.08:  # a missing day
                    continue
                hole = lambda p=0.3: None if rng.random() < p else float(rng.normal(10, 3))
                rows.append((place, poll, dt.date(2023, 1, 1) + dt.timedelta(d), float(rng.normal(30, 5)) if rng.random() > 0.02 else 900.0, hole(), hole(), float(rng.random()), None if place == 3 else hole()))
    return rows


def _stores(spark, tmp_path, rows, lag, since="2020-01-01"):
    raw, prepared = (Store(spark, f"file://{tmp_path}/{n}", [*KEY, "date"], partition=["location_id"], buckets=16) for n in ("raw", "prepared"))
    df = spark.createDataFrame(rows, SCHEMA)
    raw.put(df)
    prepared.put(prep_data(df, KEY, VARS, lag, since))
    return raw, prepared


def _same(a, b):
    a, b = (x.select(*sorted(x.columns)).withColumns({c: F.round(c, 9) for c, t in x.dtypes if t == "double"}) for x in (a, b))
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("lag", [0, 2])
def test_a_refresh_is_the_whole_preparation(spark, tmp_path, lag):
    rows = _series()
    raw, prepared = _stores(spark, tmp_path, rows, lag)
    old_files = {p.name for p in tmp_path.rglob("*.parquet")}
    day = lambda d: dt.date(2023, 1, 1) + dt.timedelta(d)
    changes = [
        (0, "no2", day(40), 31.0, 5.0, 1.0, 0.5, 7.0),  # a value where one may have been missing
        (0, "no2", day(43), 31.0, None, None, 0.5, None),
        (0, None, day(80), 31.0, 6.0, 1.0, 0.5, 7.0),  # a series with a NULL in its key
        (1, "no2", day(20), 5_000.0, 5.0, 1.0, 0.5, 7.0),  # becomes an outlier
        (2, "no2", day(149), 30.0, 5.0, 1.0, None, 7.0),  # its row goes: wind is never filled
        (3, "no2", day(60), 30.0, 5.0, 1.0, 0.4, 7.0),  # first value of an empty column: the whole series
        (4, "no2", day(170), 30.0, None, 1.0, 0.4, 7.0),  # after the end, with a gap
    ]
    told = {(r["location_id"], r["poll"]): r["whole"] for r in refresh(raw, prepared, spark.createDataFrame(changes, SCHEMA), KEY, VARS, lag).collect()}
    assert len(told) == 6 and told[3, "no2"] and sum(told.values()) <= 3  # most are not prepared as a whole
    assert _same(prepared.read(), prep_data(raw.read(), KEY, VARS, lag))
    # buckets of other places are the files that they were
    current = prepared._current()[1]["buckets"]
    assert len(set(current.values())) == 2 and old_files


def test_new_series_and_recency(spark, tmp_path):
    rows = _series(60)
    raw, prepared = _stores(spark, tmp_path, rows, 1, "2023-03-10")
    assert prepared.read().count() == 0  # none is recent
    changes = [(5, "no2", dt.date(2023, 3, 12), 30.0, 1.0, 1.0, 0.4, 7.0), (99, "o3", dt.date(2023, 4, 1), 30.0, 1.0, 1.0, 0.4, 7.0)]
    refresh(raw, prepared, spark.createDataFrame(changes, SCHEMA), KEY, VARS, 1, "2023-03-10")
    assert _same(prepared.read(), prep_data(raw.read(), KEY, VARS, 1, "2023-03-10"))
    assert {r[0] for r in prepared.read().select("location_id").distinct().collect()} == {5, 99}


def test_writes_shuffle_what_changed(spark, tmp_path, monkeypatch):
    """first rows are computed once, placed rows are written where they lie, and rows of other partitions are written again
    without a join or shuffle of theirs; with too many partitions the write is the plain one."""
    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            made.add(len(f))
            yield f

    rows = _series(60)
    df = spark.createDataFrame(rows, SCHEMA)
    raw, prepared = (Store(spark, f"file://{tmp_path}/{n}", [*KEY, "date"], partition=["location_id"], buckets=4) for n in ("raw", "prepared"))
    raw.put(df.mapInPandas(counted, df.schema))
    assert made.value == len(rows) and _same(raw.read(), df)

    ready = prep_data(prepared.placed(raw.read(), 10), [store.PLACE, *KEY], VARS, 1).drop(store.PLACE)
    assert ready._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1  # not run yet
    assert ready.rdd.getNumPartitions() == 12
    prepared.put(ready, lies=True)
    assert _same(prepared.read(), prep_data(df, KEY, VARS, 1))
    folders = {p.parent for p in tmp_path.joinpath("prepared").rglob("*.parquet")}
    assert 0 < len([*tmp_path.joinpath("prepared").rglob("*.parquet")]) <= 12 and len(folders) <= 4  # a task has one bucket

    changes = spark.createDataFrame([(4, "no2", dt.date(2023, 1, 20), 30.0, 1.0, 1.0, 0.4, 7.0), (None, "no2", dt.date(2023, 1, 20), 30.0, 1.0, 1.0, 0.4, 7.0)], SCHEMA)
    own, others = raw._apart(raw.read(), changes)
    assert {r[0] for r in own.select("location_id").distinct().collect()} == {4} and own.count() + others.count() == len(rows)
    plan = others._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("BroadcastExchange") > 0

    want = raw.read().filter("NOT (location_id = 4 AND poll <=> 'no2' AND date = '2023-01-20')").unionByName(changes)
    want = spark.createDataFrame(want.collect(), SCHEMA)
    raw.put(changes)
    assert _same(raw.read(), want)
    raw.put(changes)  # a NULL partition is found again
    assert _same(raw.read(), want)
    monkeypatch.setattr(store, "FEW", 1)
    assert raw._apart(raw.read(), changes)[1] is None
    raw.put(changes.withColumn("value", F.lit(31.0)))
    assert raw.read().count() == want.count() and raw.read().filter("value = 31.0").count() == 2

    empty = Store(spark, f"file://{tmp_path}/empty", [*KEY, "date"], partition=["location_id"])
    empty.put(df.limit(0))
    assert empty._current() == (0, None) and empty.read().count() == 0
