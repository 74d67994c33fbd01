"""Fits recover what was put into a series: level, trend, anomaly, fire effect."""

import datetime as dt
import io
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weathernorm.operators import aggregates as agg
from weathernorm.operators import boost, effects, model
from weathernorm.operators.boost import Booster, fit_all

KEY = ["location_id"]
WEATHER = ["air_temp_min", "ws", "precip", "pbl_min", "fire_frp"]


def synthetic(spark, n=365, pre=335, trend=0.0, spike=0.0, fire=0.0, location=1, seed=5):
    rng = np.random.default_rng(seed + location)
    rows = []
    for d in range(1, n + 1):
        temp, ws = 12 + 8 * math.sin(2 * math.pi * d / 30), 2 + math.sin(2 * math.pi * d / 7)
        rain, pbl = (5.0 if d % 10 == 0 else 0.0), 180 + 25 * math.sin(2 * math.pi * d / 20)
        frp = float(rng.normal(5, 0.5)) if fire and rng.random() < 0.35 else 0.0
        value = 30 + 0.4 * temp + 0.8 * ws - 0.03 * rain + 0.01 * pbl + trend * d / n + rng.normal(0, 0.5) + fire * frp
        value += spike if pre < d <= pre + 7 else 0.0
        date = dt.date(2022, 1, 1) + dt.timedelta(d - 1)
        rows.append((location, date, value, temp - 2, ws, rain, pbl, frp, 2022 + (d - 1) / 365))
    return spark.createDataFrame(rows, "location_id int, date date, value double, air_temp_min double, ws double, precip double, pbl_min double, fire_frp double, date_unix double")


END = "2022-12-01"


def fitted(df, columns, **options):
    return model.fit(df, KEY, columns, **{"trees": 150, "rate": 0.1, "cv_folds": 2, "fraction": 0.8, "training_end": END} | options)


def test_sets(spark):
    df = synthetic(spark)
    july = [f"2022-07-{d:02d}" for d in range(1, 32)]
    out = model.split_sets(df, KEY, 0.7, END, excluded=july)
    n = {r["set"]: r["count"] for r in out.groupBy("set").count().collect()}
    assert n["prediction"] == 30
    assert abs(n["training"] / 335 - 0.7) < 0.05
    assert out.filter("month(date) = 7 AND set <> 'testing'").count() == 0
    assert model.split_sets(df, KEY, 0.7).filter("set = 'prediction'").count() == 0
    # all rows before the cut
    assert {(r["set"], r["date"].isoformat() <= END) for r in model.split_sets(df, KEY, 1.0, END).collect()} == {("training", True), ("prediction", False)}
    again = model.split_sets(df.repartition(7), KEY, 0.7, END, excluded=july)
    assert out.select("date", "set").exceptAll(again.select("date", "set")).count() == 0
    other = model.split_sets(df, KEY, 0.7, END, excluded=july, replicate=1)
    assert out.select("date", "set").exceptAll(other.select("date", "set")).count() > 0


def test_anomaly_is_recovered(spark):
    df = synthetic(spark, spike=12.0)
    rows, models = fitted(df, WEATHER[:4])
    assert models.first()["status"] == "ok" and 1 <= models.first()["n_trees_opt"] <= 150
    out = effects.anomaly(model.predict(rows, models, KEY), KEY).filter(F.col("date") > END).orderBy("date").collect()
    assert len(out) == 30
    assert np.mean([r["anomaly"] for r in out[:7]]) > 6
    assert abs(np.mean([r["anomaly"] for r in out[7:]])) < 2.4
    assert all(r["anomaly"] == pytest.approx(r["observed"] - r["predicted"]) for r in out)


def test_trend_is_recovered(spark):
    columns = ["date_unix", *WEATHER[:4]]
    rows, models = fitted(synthetic(spark, trend=-5.0), columns)
    t = [r["trend"] for r in effects.trend(models, rows, KEY).orderBy("date").collect()]
    assert 0.4 * 5 <= t[0] - t[-1] <= 1.5 * 5
    n = [r["normalised"] for r in effects.normalised_trend(rows, models, KEY, columns, n=50).orderBy("date").collect()]
    assert 0.4 * 5 <= n[0] - n[-1] <= 1.5 * 5
    assert effects.composite_time_effect(models, rows, KEY).filter("effect IS NULL").count() == 0


def test_fire_counterfactual(spark):
    rows, models = fitted(synthetic(spark, fire=2.0), WEATHER)
    p = model.predict(rows, models, KEY).select("date", "fire_frp", "predicted")
    out = p.join(effects.no_fire(rows, models, KEY, WEATHER).select("date", "predicted_nofire"), "date")
    quiet = out.filter("fire_frp = 0").select(F.max(F.abs(F.col("predicted") - F.col("predicted_nofire")))).first()[0]
    assert quiet < 1e-6
    uplift = out.filter("fire_frp > 0").select(F.avg(F.col("predicted") - F.col("predicted_nofire"))).first()[0]
    assert abs(uplift - 10) <= 5


def test_several_series_and_a_bad_one(spark):
    bad = synthetic(spark, location=3).withColumns({c: F.lit(None).cast("double") for c in WEATHER})
    df = synthetic(spark, location=1).union(synthetic(spark, location=2)).union(bad)
    rows, models = fitted(df, WEATHER, trees=20, replicates=2)
    status = {(r["location_id"], r["replicate"]): r["status"] for r in models.collect()}
    assert len(status) == 6 and status[1, 0] == status[2, 1] == "ok" and status[3, 0] != "ok"
    perf = agg.fit_metrics(model.predict(rows, models, KEY), [*KEY, "replicate"]).collect()
    assert {r["location_id"] for r in perf} == {1, 2}
    assert all(0 <= r["rsquared_training"] <= 1 for r in perf)
    gain = effects.importance(models, KEY).groupBy("location_id", "replicate").agg(F.sum("influence").alias("s")).collect()
    assert all(r["s"] == pytest.approx(100) for r in gain)


def test_log_link_round_trip(spark):
    rows, models = fitted(synthetic(spark), WEATHER, link_name="log")
    p = model.predict(rows, models, KEY).filter("set = 'prediction'")
    assert abs(p.select(F.avg(F.col("predicted") - F.col("value"))).first()[0]) < 2


def test_partial_dependence_is_the_brute_force_mean():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    x[:20, 1] = np.nan
    y = x[:, 0] ** 2 + np.nan_to_num(x[:, 1]) + rng.normal(0, 0.1, 400)
    b = Booster(["a", "b"], rate=0.2, splits=2, bag=1.0)
    b.fit(x, y, 30)
    grid = np.linspace(-1, 1, 5)
    additive = b.partial_dependence("a", grid)
    brute = []
    for v in grid:
        z = x.copy()
        z[:, 0] = v
        brute.append(b.predict(z).mean())
    assert np.corrcoef(additive, brute)[0, 1] > 0.98
    again = Booster.loads(b.dumps())
    assert np.allclose(again.predict(x), b.predict(x))


@pytest.mark.parametrize(
    ("names", "groups"),
    [
        (["fire_frp", "fire_frp_lag1"], {"": ["fire_frp", "fire_frp_lag1"]}),
        (["fire_frp_MYS_lag1", "fire_frp_MYS"], {"_MYS": ["fire_frp_MYS", "fire_frp_MYS_lag1"]}),
        (["fire_frp_IDN", "pm25_emission_IDN", "fire_count_THA"], {"_IDN": ["fire_frp_IDN", "pm25_emission_IDN"], "_THA": ["fire_count_THA"]}),
        (["fire_frp", "fire_frp_IDN"], {"": ["fire_frp"], "_IDN": ["fire_frp_IDN"]}),
        (["ws", "precip"], {}),
    ],
)
def test_fire_groups(names, groups):
    assert model.fire_groups(names) == groups


def test_config_grid(spark):
    grid = model.config_grid({"anomaly": {"training_end": END}, "trend": {}}, WEATHER, trees=[10, 20], add_fire=True)
    rows = model.config_table(spark, grid).collect()
    assert len(rows) == 4 and {r["output"] for r in rows} == {"anomaly", "trend"} and [r["config_id"] for r in rows] == [0, 1, 2, 3]
    assert rows[-1]["time_vars"] == ["date_unix", "yday", "wday"] and rows[0]["training_end"] == END
    assert "fire_frp_lag1" in grid[0].columns and not any("fire" in c for c in model.config_grid({"anomaly": {}}, WEATHER)[0].columns)
    for wrong in ({"engine": "other"}, {"tree": 1}):
        with pytest.raises((ValueError, TypeError)):
            model.config_grid({"anomaly": {}}, **wrong)


def test_a_grid_is_one_plan_and_a_bad_series_leaves_the_others(spark, monkeypatch):
    late = synthetic(spark, location=4).withColumn("date", F.date_add("date", 4000))
    nulls = synthetic(spark, location=3).withColumn("value", F.lit(None).cast("double"))
    wild = synthetic(spark, location=5).withColumn("ws", F.lit(12345.0))
    df = synthetic(spark, location=1).union(nulls).union(late).union(wild)
    monkeypatch.setattr(model, "_numbers", _refusing(model._numbers))
    grid = model.config_grid({"anomaly": {"training_end": END}}, WEATHER[:3], trees=15, lag=0, learning_rate=[0.1, 0.3], link=["linear", "log"], cv_folds=2, ntrainings=2)
    rows, models = model.fit_configs(df, KEY, grid)
    found = {(r["location_id"], r["config_id"], r["replicate"]): r for r in models.collect()}
    assert len(found) == 4 * 4 * 2
    assert all(r["status"] == ("ok" if k[0] == 1 else "failed") and (r["model"] is None) == (k[0] != 1) for k, r in found.items())
    assert {r["message"] for k, r in found.items() if k[0] in (3, 4)} == {"no training rows"}
    assert {r["message"] for k, r in found.items() if k[0] == 5} == {"ValueError: not these"}
    assert found[1, 0, 0]["model"] != found[1, 0, 1]["model"] != found[1, 1, 1]["model"]
    p = model.predict(rows, models, KEY).filter("location_id = 1 AND set = 'prediction'").groupBy("config_id").agg(F.avg(F.col("predicted") - F.col("value")).alias("off")).collect()
    assert len(p) == 4 and all(abs(r["off"]) < 3 for r in p)
    rows.unpersist()
    # a configuration alone gives what it gives in the grid
    _, alone = model.fit_configs(synthetic(spark, location=1), KEY, [grid[3]])
    assert {r["model"] for r in alone.collect()} == {r["model"] for k, r in found.items() if k[:2] == (1, 3)}


def _refusing(numbers):
    def run(pdf, columns):
        if (pdf["ws"] == 12345.0).any():
            raise ValueError("not these")
        return numbers(pdf, columns)

    return run


def test_trend_of_a_log_link_is_in_the_response_s_units(spark):
    columns = ["date_unix", *WEATHER[:4]]
    rows, models = fitted(synthetic(spark, trend=20.0), columns, link_name="log", trees=60)
    for out, name in ((effects.trend(models, rows, KEY), "trend"), (effects.composite_time_effect(models, rows, KEY), "effect"), (effects.normalised_trend(rows, models, KEY, columns), "normalised")):
        assert 30 < out.agg(F.avg(name)).first()[0] < 60


def test_seasons_have_an_effect_of_their_own(spark):
    df = synthetic(spark).withColumn("season_number", F.floor(F.month("date") % 12 / 3).cast("double") + 1)
    df = df.withColumn("value", F.col("value") + 5 * F.col("season_number"))
    rows, models = fitted(df, ["season_number", *WEATHER[:3]], trees=60)
    out = effects.composite_time_effect(models, rows, KEY).groupBy(F.quarter("date")).agg(F.min("effect").alias("e")).collect()
    assert len({round(r["e"], 3) for r in out}) > 2


def test_normalised_trend_takes_every_weather_row(spark):
    df, columns = synthetic(spark, trend=20.0), ["date_unix", *WEATHER[:4]]
    rows, models = fitted(df, columns, trees=30)
    got = [r["normalised"] for r in effects.normalised_trend(rows, models, KEY, columns).orderBy("date").collect()]
    b = Booster.loads(models.first()["model"])
    x = rows.orderBy("date").select(*b.names).toPandas().to_numpy(dtype=float)
    want, j = [], b.names.index("date_unix")
    for year in x[:, j]:
        grid = x.copy()
        grid[:, j] = year
        want.append(b.predict(grid).mean())
    assert np.allclose(got, want)


NULL_KEY = ["location_id", "process_id"]


def test_series_with_a_null_key_keep_everything(spark):
    one = synthetic(spark, trend=-5.0, fire=2.0)
    df = one.withColumn("process_id", F.lit("a")).unionByName(one.withColumn("process_id", F.lit(None).cast("string")))
    columns = ["date_unix", *WEATHER]
    # the two have seeds of their own: without a draw of rows they are alike
    rows, models = model.fit(df, NULL_KEY, columns, trees=60, rate=0.1, cv_folds=2, fraction=1.0, training_end=END)
    found = {r["process_id"]: r for r in models.collect()}
    assert set(found) == {"a", None} and all(len(r["errors"]) > 1 and r["status"] == "ok" for r in found.values())
    count = lambda out, c: {r["process_id"]: r["n"] for r in out.groupBy("process_id").agg(F.count(c).alias("n")).collect()}
    for out, c in ((effects.trend(models, rows, NULL_KEY), "trend"), (effects.composite_time_effect(models, rows, NULL_KEY), "effect"), (effects.composite_time_effect(models, rows, NULL_KEY), "effect_trend"), (effects.no_fire(rows, models, NULL_KEY, columns), "predicted_nofire"), (effects.normalised_trend(rows, models, NULL_KEY, columns), "normalised"), (model.predict(rows, models, NULL_KEY), "predicted")):
        n = count(out, c)
        assert n["a"] == n[None] > 300, c


def test_rows_do_not_grow_with_the_grid(spark):
    df = synthetic(spark).unionByName(synthetic(spark, location=2))
    options = {"trees": 3, "lag": 0, "cv_folds": 1, "ntrainings": 3}
    grid = model.config_grid({"anomaly": {"training_end": END}}, WEATHER[:2], learning_rate=[0.1, 0.2, 0.3], training_fraction=[0.5, 0.9], **options)
    rows, models = model.fit_configs(df, KEY, grid)
    assert rows.count() == df.count() and models.count() == 2 * 18
    splits = {(r["config_id"], r["replicate"]): r["split"] for r in models.collect()}
    assert len(set(splits.values())) == 6  # rates share them
    for c in grid:
        for r in range(3):
            opened = model.with_set(rows, splits[c.config_id, r]).select("location_id", "date", "set")
            plain = model.split_sets(df, KEY, c.training_fraction, END, replicate=r).select("location_id", "date", "set")
            assert opened.exceptAll(plain).count() == 0


@pytest.mark.parametrize("splits", [1, 2, 4])
def test_mean_over_rows_is_the_brute_force_mean(splits):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 3))
    x[:30, 0] = np.nan
    x[20:50, 1] = np.nan
    y = np.nan_to_num(x[:, 0]) ** 2 + np.nan_to_num(x[:, 1]) * np.nan_to_num(x[:, 0]) + rng.normal(0, 0.1, 300)
    b = Booster(["a", "b", "c"], rate=0.1, splits=splits)
    b.fit(x, y, 300)
    values = np.array([-3.0, -0.5, 0, 0.2, np.nan, 9])
    put = lambda v: np.column_stack([np.full(300, v), x[:, 1:]])
    assert np.allclose(b.mean_over_rows("a", values, x), [b.predict(put(v)).mean() for v in values], atol=1e-9)
    assert np.allclose(b.mean_over_rows("a", values, x, np.exp), [np.exp(b.predict(put(v))).mean() for v in values], atol=1e-9)


def test_fits_side_by_side_are_the_fits_alone():
    rng = np.random.default_rng(3)
    members = []
    for k, n in enumerate((200, 3, 90, 1, 350)):
        x = rng.normal(size=(n, 2))
        members.append((x, 3 * x[:, 0] + rng.normal(0, 0.1, n), k + 5))
    for folds in (1, 3):
        together, errors = fit_all(members, ["a", "b"], 0.1, 2, 120, folds)
        for m, b, e in zip(members, together, errors, strict=True):
            (alone,), (own,) = fit_all([m], ["a", "b"], 0.1, 2, 120, folds)
            assert np.array_equal(alone.predict(m[0]), b.predict(m[0])) and np.allclose(own, e) and alone.trees == b.trees


def test_a_curve_that_has_turned_stops_the_search():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(120, 3)), rng.normal(size=120)  # noise: the best number of trees is small
    (short,), (curve,) = fit_all([(x, y, 1)], ["a", "b", "c"], 0.1, 2, 2_000, 3, patience=100)
    (whole,), (longer,) = fit_all([(x, y, 1)], ["a", "b", "c"], 0.1, 2, 2_000, 3, patience=None)
    assert len(curve) < 500 and len(longer) == 2_000
    assert np.array_equal(curve, longer[: len(curve)]) and short.trees == whole.trees == int(np.argmin(longer)) + 1


def test_nothing_to_fit(spark):
    rows, models = model.fit(synthetic(spark).limit(0), KEY, WEATHER, trees=5)
    assert models.count() == 0 and model.predict(rows, models, KEY).count() == 0


def test_children_of_few_rows_are_not_searched(monkeypatch):
    """a node that can't be split any more takes no part in the search, and the search is the plain one."""
    rng, searched, plain = np.random.default_rng(3), [], boost.best_splits

    def best_splits(n, s, least):
        found = plain(n, s, least)
        for g in range(len(n)):
            gains = np.full((n.shape[1], boost.BINS - 1), -np.inf)
            for j in range(n.shape[1]):
                for k in range(boost.BINS - 1):
                    nl, nr, sl, sr = n[g, j, : k + 1].sum(), n[g, j, k + 1 : boost.BINS].sum(), s[g, j, : k + 1].sum(), s[g, j, k + 1 : boost.BINS].sum()
                    if min(nl, nr) >= least:
                        gains[j, k] = sl**2 / max(1, nl) + sr**2 / max(1, nr) + s[g, j, boost.BINS] ** 2 / max(1, n[g, j, boost.BINS]) - s[g, 0].sum() ** 2 / max(1, n[g, 0].sum())
            assert np.isclose(found[0][g], gains.max()) and (np.isneginf(gains.max()) or np.isclose(gains[found[1][g], found[2][g]], gains.max()))
        searched.append(n[:, 0].sum(1))
        return found

    monkeypatch.setattr(boost, "best_splits", best_splits)
    x = rng.normal(size=(120, 2))
    x[rng.random(120) < 0.1, 1] = np.nan
    boost.fit_all([(x, x[:, 0] + np.nan_to_num(x[:, 1]) + rng.normal(0, 0.1, 120), 5)], ["a", "b"], 0.1, 3, 3, 2)
    assert len(searched) > 6 and all(n.min(initial=20) >= 20 for n in searched)


def test_models_of_the_former_archive_are_read():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2))
    b = Booster(["a", "b"], rate=0.2, splits=2)
    b.fit(x, x[:, 0], 20)
    about = json.dumps({"names": b.names, "rate": b.rate, "start": b.start, "splits": b.splits, "edges": [len(e) for e in b.edges]})
    old = io.BytesIO()
    np.savez_compressed(old, about=np.frombuffer(about.encode(), np.uint8), edges=np.concatenate(b.edges), **{k: getattr(b, k).astype(v) for k, v in Booster.STORED.items()})
    now = b.dumps()
    assert np.array_equal(Booster.loads(old.getvalue()).predict(x), Booster.loads(now).predict(x))
    assert len(now) < len(old.getvalue()) and not now.startswith(b"PK")


def test_steps_read_bytes_and_route_every_row():
    """a step reads a row's bins as bytes, eight trees' draws are made at once, and each row goes where the splits say."""
    rng, fits, n = np.random.default_rng(6), 3, 90
    bins = rng.integers(0, boost.BINS, (fits * n, 2))
    bins[rng.random(bins.shape) < 0.1] = boost.BINS  # NULLs
    y, learns = bins[:, 0] / 10 + rng.normal(0, 0.1, fits * n), rng.random(fits * n) < 0.8
    run = boost.Lockstep(bins, y, np.repeat(np.arange(fits), n), learns, np.arange(fits), 0.5, 3)
    run.keep(np.array([True, False, True]))
    assert run.bins.dtype == np.uint8 and run.drawn.shape == (8, 2 * n)
    of, kept, draws = np.repeat([0, 1], n), np.r_[0:n, 2 * n : 3 * n], set()
    for _ in range(10):
        before = run.f.copy()
        tree, drawn = run.grow()
        draws.add(drawn.tobytes())
        assert not drawn[~learns[kept]].any()
        at = np.zeros(2 * n, int)
        for _ in range(3):
            for i in range(2 * n):
                j, c, v = tree["feature"][of[i], at[i]], tree["child"][of[i], at[i]], bins[kept[i]]
                if j >= 0:
                    at[i] = c + (2 if v[j] == boost.BINS else int(v[j] > tree["cut"][of[i], at[i]]))
        assert np.array_equal(run.f, before + 0.5 * tree["value"][of, at])
        for k in range(2):
            for leaf in set(at[of == k]):
                own = (of == k) & (at == leaf) & drawn
                assert own.sum() == tree["rows"][k, leaf] and (not own.any() or np.isclose(tree["value"][k, leaf], (y[kept] - before)[own].mean()))
    assert len(draws) == 10


def test_the_composite_effect_meets_its_models_once(spark):
    """dates and models are shuffled once each, and the effects are those of curves joined to the dates."""
    one = synthetic(spark, trend=-5.0)
    df = one.withColumn("process_id", F.lit("a")).unionByName(one.withColumn("process_id", F.lit(None).cast("string")))
    df = df.withColumns({"yday": F.dayofyear("date"), "month": F.month("date"), "wday": F.weekday("date") + 1, "season_number": F.floor(F.month("date") % 12 / 3) + 1})
    failed = one.withColumns({"process_id": F.lit("b"), "yday": F.lit(1), "month": F.lit(1), "wday": F.lit(1), "season_number": F.lit(1).cast("long")}).withColumns({c: F.lit(None).cast("double") for c in ("value", "ws")})
    df = df.unionByName(failed).unionByName(df.filter("month = 3")).filter("day(date) <> 9")  # repeated days, and missing ones
    columns = ["date_unix", "yday", "month", "wday", "season_number", "ws"]
    rows, models = model.fit(df, NULL_KEY, columns, trees=40, rate=0.1, cv_folds=2, replicates=2, link_name="log", training_end=END)
    out = effects.composite_time_effect(models, rows, NULL_KEY)
    got = {(r["process_id"], r["date"]): r for r in out.collect()}
    assert len(got) == out.count() == rows.select(*NULL_KEY, "date").distinct().count()
    plan = out._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert plan.count("Exchange ") <= 2 and "Join" not in plan.replace("CoGroup", "")
    pdp = effects.partial_dependence
    for name, last in effects.CALENDAR.items():
        ranges = rows.select(*NULL_KEY).distinct().withColumns({"low": F.lit(1.0), "high": F.lit(float(last)), "points": F.lit(last)})
        want = {(r["process_id"], r["at"]): r["y"] for r in pdp(models, NULL_KEY, ranges, name).groupBy("process_id", F.round("x").cast("int").alias("at")).agg(F.avg("y").alias("y")).collect()}
        place = {"yday": lambda d: d.timetuple().tm_yday, "month": lambda d: d.month, "wday": lambda d: d.isoweekday(), "season_number": lambda d: d.month % 12 // 3 + 1}[name]
        for (process, date), r in got.items():
            assert r[f"effect_{name}"] == (None if process == "b" else pytest.approx(want[process, place(date)], rel=1e-12))
    trend = {(r["process_id"], r["date"]): r["trend"] for r in effects.trend(models, rows, NULL_KEY).collect()}
    for (process, date), r in got.items():
        known = trend.get((process, date))
        assert r["effect_trend"] == (None if known is None else pytest.approx(known, rel=1e-12))
        parts = [r[f"effect_{n}"] for n in (*effects.CALENDAR, "trend") if r[f"effect_{n}"] is not None]
        assert r["effect"] == (pytest.approx(sum(parts) / len(parts)) if parts else None)
    assert {p for p, _ in got} == {"a", "b", None} and sum(r["effect_trend"] is not None for r in got.values()) > 600


def test_decimal_years_of_arrays_are_those_of_columns(spark):
    x = np.concatenate([np.linspace(1999.0, 2004.9999, 3_000), 2000 + np.arange(366) / 366, [1995.0, 2001.0 - 1e-12]])
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(effects.from_decimal_year(F.col("x"))).collect()]
    assert effects._dates_of_years(x).tolist() == want
