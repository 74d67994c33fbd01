"""Queries that fit a model to every series; results can't be said in SQL, tests recover known signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import effects, model
from .prep import prep_data
from .rounding import rounded
from .views import view

QUERIES: dict = {}
ORACLE: dict = {}
KEY = ["location_id"]
VARS = ["wd", "ws", "precip", "air_temp_min", "fire_frp"]
COLUMNS = ["date_unix", *VARS]
END = "2000-12-31"


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(*_fitted(spark, sf_dir)))
    return f


def _fitted(spark, sf_dir):
    data = prep_data(view(spark, sf_dir, "daily", dealt=True), KEY, VARS, since=None)
    return model.fit(data, KEY, COLUMNS, trees=40, rate=0.1, splits=2, cv_folds=2, fraction=0.8, training_end=END)


def best_numbers_of_trees(spark, sf_dir):
    """Fits at full settings: 10,000 trees at most, rate 0.01, three folds."""
    data = prep_data(view(spark, sf_dir, "daily", dealt=True), KEY, VARS, since=None)
    _, models = model.fit(data, KEY, COLUMNS, trees=10_000, rate=0.01, splits=2, cv_folds=3, fraction=0.9, training_end=END)
    return rounded(models.select(*KEY, "n_training", "n_trees_opt", F.array_min("errors").alias("least_error"), F.size("errors").alias("n_trees_tried")))


QUERIES["best_numbers_of_trees"] = best_numbers_of_trees


@query
def fit_predict(rows, models):
    return model.predict(rows, models, KEY).select("location_id", "date", "set", "value", "predicted")


@query
def fit_performance(rows, models):
    return agg.fit_metrics(model.predict(rows, models, KEY), KEY)


@query
def anomaly(rows, models):
    return effects.anomaly(model.predict(rows, models, KEY), KEY)


@query
def trend_pdp(rows, models):
    return effects.trend(models, rows, KEY)


@query
def nofire(rows, models):
    return effects.no_fire(rows, models, KEY, COLUMNS)


@query
def normalised_trend(rows, models):
    return effects.normalised_trend(rows, models, KEY, COLUMNS)


@query
def composite_effect(rows, models):
    return effects.composite_time_effect(models, rows, KEY)


@query
def importance(rows, models):
    return agg.importance_summary(effects.importance(models, KEY))
