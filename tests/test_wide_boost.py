"""Trees grown by sums in SQL are the trees grown in one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weathernorm.operators import wide_boost
from weathernorm.operators.boost import Booster

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 3))
    x[rng.random((700, 3)) < 0.1] = np.nan
    x[:, 2] = np.nan  # a column without a value
    y = np.nan_to_num(x[:, 0]) ** 2 + 2 * np.nan_to_num(x[:, 1]) + np.isnan(x[:, 0]) + rng.normal(0, 0.1, 700)
    rows = [(*(None if np.isnan(v) else float(v) for v in r), float(v)) for r, v in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, c double, value double").repartition(5)
    return x, y, df


@pytest.mark.parametrize("splits", [1, 2, 3])
def test_trees_are_those_of_one_task(data, monkeypatch, splits):
    monkeypatch.setattr(wide_boost, "KEEP", 2)
    x, y, df = data
    one = Booster(COLUMNS, rate=0.3, splits=splits, bag=1.0)
    one.fit(x, y, 5)
    wide = wide_boost.fit_wide(df, COLUMNS, trees=5, rate=0.3, splits=splits, exact=True)
    for name in ("cut", "child", "rows"):
        assert np.array_equal(getattr(one, name), getattr(wide, name)), name
    names = lambda m: np.array([*m.names, ""])[m.feature]
    assert (names(one) == names(wide)).all() and np.allclose(one.value, wide.value) and np.allclose(one.gain, wide.gain)
    assert np.allclose(one.predict(x[:, :2]), wide.predict(x))
    again = Booster.loads(wide.dumps())
    assert np.allclose(again.predict(x), wide.predict(x))


def test_a_pooled_model_predicts_every_row(spark, data):
    x, y, df = data
    named = df.withColumn("set", F.when(F.rand(3) < 0.8, "training").otherwise("testing")).withColumn("value", F.when(F.col("b") < 1.9, F.exp("value")))
    model = wide_boost.fit_wide(named, COLUMNS, trees=12, rate=0.3, link_name="log")
    out = wide_boost.predict_wide(named, model, "log").collect()
    assert len(out) == 700 and all(r.predicted > 0 for r in out)
    pairs = np.array([(np.log(r.predicted), np.log(r.value)) for r in out if r.value is not None])
    assert np.corrcoef(pairs.T)[0, 1] > 0.8


def test_nothing_to_learn_from(data):
    with pytest.raises(ValueError, match="no training rows"):
        wide_boost.fit_wide(data[2].filter("value is null"), COLUMNS, trees=2)
