"""Year-over-year changes, split into weather and emission parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _long(df: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    return df.unpivot(list(by), list(names), "variable", "value")


def yoy_attribution(long: DataFrame, by: Sequence[str], month: str) -> DataFrame:
    """From (date, variable, value): total = change of observed, weather = change of predicted, emission =
    total - weather, and each over last year's observed; six rows dated the month's first day. A group
    without both years of both variables has none."""
    start = F.trunc(F.lit(month).cast("date"), "MM")
    this, last = F.trunc("date", "MM") == start, F.trunc("date", "MM") == F.add_months(start, -12)
    mean = lambda v, when: F.avg(F.when((F.col("variable") == v) & when, F.col("value")))
    m = long.filter(this | last).groupBy(*by).agg(mean("observed", this).alias("o1"), mean("observed", last).alias("o0"), mean("predicted", this).alias("p1"), mean("predicted", last).alias("p0")).na.drop(subset=["o1", "o0", "p1", "p0"])
    total, weather = F.col("o1") - F.col("o0"), F.col("p1") - F.col("p0")
    parts = {"total": total, "weather": weather, "emission": total - weather}
    out = m.select(*by, start.alias("date"), *(c.alias(n) for n, c in parts.items()), *(F.try_divide(c, F.col("o0")).alias(f"{n}_rel") for n, c in parts.items()))
    return _long(out, [*by, "date"], [*parts, *(f"{n}_rel" for n in parts)])


def yoy_from_trend(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """From (date, variable, value) with observed, trend and anomaly: monthly changes to the row of the
    same month before; emission is the trend's, weather the rest, and the anomaly's is the residual."""
    names = ["observed", "trend", "anomaly"]
    monthly = long.groupBy(*by, F.trunc("date", "MM").alias("date")).agg(*(F.avg(F.when(F.col("variable") == n, F.col("value"))).alias(n) for n in names))
    w = Window.partitionBy(*by, F.month("date")).orderBy("date")
    d = {n: F.col(n) - F.lag(n).over(w) for n in names}
    before = F.lag("observed").over(w)
    out = monthly.select(*by, "date", d["observed"].alias("total"), d["trend"].alias("emission"), (d["observed"] - d["trend"]).alias("weather"), d["anomaly"].alias("residual"), before.alias("_o")).filter("_o is not null")
    return out.withColumns({f"{n}_rel": F.try_divide(F.col(n), F.col("_o")) for n in ("total", "emission", "weather", "residual")}).drop("_o")


def monthly_trend_yoy(df: DataFrame, by: Sequence[str], column: str = "trend") -> DataFrame:
    """Relative change of the monthly mean to the same month of the row before."""
    monthly = df.groupBy(*by, F.year("date").alias("year"), F.month("date").alias("month")).agg(F.avg(column).alias(column))
    before = F.lag(column).over(Window.partitionBy(*by, "month").orderBy("year"))
    return monthly.withColumn("yoy", F.try_divide(F.col(column) - before, before))


def lag_over_years(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Value minus the value of the row a year before, by variable."""
    w = Window.partitionBy(*by, "variable").orderBy("year")
    return df.withColumn("change", F.col("value") - F.lag("value").over(w))


def compare_models(yoy: DataFrame, by: Sequence[str] = ("location_id", "source", "model")) -> DataFrame:
    """Means of the parts, and how many there are, by location, source and model."""
    parts = ("total", "weather", "emission")
    return yoy.groupBy(*by).agg(*(F.avg(F.when(F.col("variable") == p, F.col("value"))).alias(p) for p in parts), F.count(F.lit(1)).alias("n"))
