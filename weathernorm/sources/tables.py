"""Sources: measurements, grids, stations, regions, fires; all are Parquet or CSV tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import daily_mean

# Canonical names of weather variables by source.
GRID_NAMES = {"d2m": "dewpoint_temp", "t2m_min": "air_temp_min", "t2m_max": "air_temp_max", "sp": "atmos_pres", "tp": "precip", "blh_min": "pbl_min", "blh_max": "pbl_max", "ws": "ws", "wd": "wd"}
STATION_NAMES = {"air_temp_min": "air_temp_min", "air_temp_max": "air_temp_max", "atmos_pres": "atmos_pres", "wd": "wd", "ws": "ws", "ceil_hgt": "ceil_hgt", "visibility": "visibility", "precip": "precip", "RH_max": "humidity"}


def measurements(meas: DataFrame, date_from: str | None = None, date_to: str | None = None, **filters: str | Sequence[str] | None) -> DataFrame:
    """Daily means of the rows that pass all filters given (a value or several; None is no filter)."""
    for name, wanted in filters.items():
        if wanted is not None:
            meas = meas.filter(F.col(name).isin([wanted] if isinstance(wanted, str | int) else list(wanted)))
    if date_from is not None:
        meas = meas.filter(F.col("date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        meas = meas.filter(F.col("date") <= F.lit(date_to).cast("date"))
    return daily_mean(meas)


def required(df: DataFrame, what: str) -> DataFrame:
    """The table, or an error if it has no rows."""
    if df.isEmpty():
        raise ValueError(f"no {what} found")
    return df


def locations(meas_locations: DataFrame, date_from: str, date_to: str) -> DataFrame:
    out = meas_locations.select("location_id", "country", "lat", "lon").distinct()
    return out.withColumn("date_from", F.lit(date_from).cast("date")).withColumn("date_to", F.lit(date_to).cast("date"))


def hours_between(hourly: DataFrame, date_from: str, date_to: str, before: int = 14, after: int = 35) -> DataFrame:
    """Hours from ``before`` hours ahead of the first date to ``after`` hours past the start of the last."""
    a, b = (F.lit(d).cast("timestamp") for d in (date_from, date_to))
    return hourly.filter((F.col("ts") >= a - F.make_dt_interval(F.lit(0), F.lit(before))) & (F.col("ts") <= b + F.make_dt_interval(F.lit(0), F.lit(after))))


def write_daily(df: DataFrame, path: str, date: str = "date") -> None:
    """Replaces the dates that the table has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def read_daily(spark: SparkSession, path: str, dates: Sequence[str] | None = None, date: str = "date") -> DataFrame:
    """The dates asked for; those that were never written have no rows."""
    df = spark.read.parquet(path)
    return df if dates is None else df.filter(F.col(date).isin([F.lit(d).cast("date") for d in dates]))


def station_years(spark: SparkSession, path: str, codes: Sequence[str] | None = None, years: Sequence[int] | None = None, fresh: DataFrame | None = None) -> DataFrame:
    """Hourly station weather, stored by code and year, and fresh rows, which stand for all of their stored years."""
    df = spark.read.parquet(path)
    if fresh is not None:
        df = df.join(fresh.select("code", "year").distinct(), ["code", "year"], "left_anti").unionByName(fresh, allowMissingColumns=True)
    if codes is not None:
        df = df.filter(F.col("code").isin(list(codes)))
    return df if years is None else df.filter(F.col("year").isin(list(years)))


def station_catalogue(stations: DataFrame) -> DataFrame:
    """A row for each year of each station."""
    return stations.withColumn("code", F.concat_ws("-", "usaf", "wban")).withColumn("year", F.explode(F.sequence(F.year("begin"), F.year("end"))))


REGION_COLUMNS = ("id", "region", "Tair", "Qair", "Wind", "PSurf", "Rainf", "SWdown")


def region_csv(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """3-hourly weather of regions from CSV files with the columns ``REGION_COLUMNS`` in any order and place (others are
    left out), the time in the id; and (file, lines, reason) of what was skipped: whole files that lack a
    column, and the lines of others that can't be read."""
    needed = F.array(*map(F.lit, REGION_COLUMNS))
    cells = F.transform(F.split(F.regexp_replace("value", '"', ""), ","), lambda c: F.trim(c))
    lines = spark.read.text(glob).select(F.col("_metadata.file_name").alias("file"), cells.alias("cells"))
    is_head = F.array_contains("cells", "id")
    heads = lines.groupBy("file").agg(F.min(F.when(is_head, F.col("cells"))).alias("head"))
    judged = heads.withColumn("lacks", F.array_except(needed, F.coalesce("head", F.array().cast("array<string>"))))
    good, bad = judged.filter(F.size("lacks") == 0).select("file", "head"), judged.filter(F.size("lacks") > 0)
    at = lambda c: F.try_element_at("cells", F.array_position("head", c).cast("int"))
    read = lines.filter(~is_head & (F.array_join("cells", "") != "")).join(good, "file")
    read = read.select("file", at("id").alias("id"), at("region").alias("region"), *(at(c).try_cast("double").alias(c) for c in REGION_COLUMNS[2:]))
    read = read.withColumn("ts", F.try_to_timestamp("id", F.lit("'A'yyyyMMdd_HHmm")))
    fine = F.col("ts").isNotNull() & F.col("region").isNotNull()
    skipped = read.filter(~fine).groupBy("file").agg(F.count(F.lit(1)).alias("lines")).withColumn("reason", F.lit("lines without a time or region"))
    whole = bad.select("file", F.lit(None).cast("long").alias("lines"), F.concat(F.lit("lacks "), F.array_join("lacks", ", ")).alias("reason"))
    return read.filter(fine).drop("file"), skipped.unionByName(whole)


def split_fires(spark: SparkSession, csv: str, path: str) -> None:
    """A fire archive (latitude, longitude, acq_date, acq_time, frp), one partition a day; days in the
    archive replace what was there."""
    schema = "latitude double, longitude double, acq_date date, acq_time string, frp double"
    write_daily(spark.read.schema(schema).option("header", True).csv(csv), path, "acq_date")


#: With this setting a join by (location_id, date) takes a partitioning by location_id as it is.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def write_bucketed(df: DataFrame, name: str, by: Sequence[str] = ("location_id",), sort: Sequence[str] = ("location_id", "date"), buckets: int = 200) -> DataFrame:
    """Stores ``df`` as a table of the warehouse in buckets of some columns, each file sorted. Tables with the same
    buckets are joined, completed, lagged and grouped by these columns (and others) without a shuffle; give
    measurements and weather the same number. A bucket is one file: one shuffle deals the rows here, none later."""
    dealt = df.repartition(buckets, *by)
    dealt.write.bucketBy(buckets, by[0], *by[1:]).sortBy(sort[0], *sort[1:]).mode("overwrite").saveAsTable(name)
    return bucketed(df.sparkSession, name)


def bucketed(spark: SparkSession, name: str) -> DataFrame:
    """A table of :func:`write_bucketed`, in a session that takes its buckets as they are."""
    spark.conf.set(CO_PARTITION, "false")
    return spark.table(name)


def snapshot(spark: SparkSession, path: str, compute, drop: Sequence[str] = ("value",)) -> DataFrame:
    """The table at ``path``, computed and stored first if there is none; some columns are left out."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        compute().write.parquet(path)
    return spark.read.parquet(path).drop(*drop)


def renamed(df: DataFrame, names: Mapping[str, str], only_known: bool = False, ids: Sequence[str] = ()) -> DataFrame:
    """Columns by their canonical names; other columns stay, or go."""
    if only_known:
        df = df.select(*ids, *(c for c in df.columns if c in names and c not in ids))
    return df.withColumnsRenamed(dict(names))


def in_units(df: DataFrame) -> DataFrame:
    """Kelvin to Celsius (air temperatures only), Pa to hPa, m to mm."""
    convert = {"air_temp_min": F.col("air_temp_min") - 273.15, "air_temp_max": F.col("air_temp_max") - 273.15, "atmos_pres": F.col("atmos_pres") / 100, "precip": F.col("precip") * 1000}
    return df.withColumns({c: x for c, x in convert.items() if c in df.columns})


#: Bytes of files behind a task, about.
TASK_BYTES = 4 << 20


def parts(df: DataFrame) -> int:
    """So many parts that each has some ``TASK_BYTES`` of the input files of ``df`` behind it, and as many as shuffles have at least."""
    spark, files = df.sparkSession, df.inputFiles()
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] if files else 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // TASK_BYTES))


def spread(df: DataFrame, *by: str | Column) -> DataFrame:
    """``df`` shuffled by some columns into so many parts that each has some ``TASK_BYTES`` of its input files behind it, and
    into as many as other shuffles have at least: steps by these columns then need no shuffle of their own, and the
    memory of a task doesn't grow with the tables."""
    return df.repartition(parts(df), *by)
