"""Scalar functions as Column expressions: dates, wind, links, radiation, distances, names, cleaning."""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0
# Letters that no decomposition makes plain, and what they fold to.
ACCENTED = "øłđðħıŧŋĸ"
PLAIN = "olddhitnk"
LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ĳ": "ij", "ŉ": "'n"}


def _latin() -> tuple[str, str]:
    """Lower-case Latin letters whose decomposition is a plain letter with marks, and these plain letters."""
    found, plain = [], []
    for c in map(chr, (*range(0xE0, 0x250), *range(0x1E00, 0x1F00))):
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1 and base[0].isascii() and c == c.lower():
            found.append(c)
            plain.append(base[0])
    return "".join(found) + ACCENTED, "".join(plain) + PLAIN


# ---- dates -----------------------------------------------------------------------------------
def days_in_year(d: Column) -> Column:
    return F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31)))


def decimal_year(d: Column) -> Column:
    return F.year(d) + (F.dayofyear(d) - 1) / days_in_year(d)


def from_decimal_year(x: Column) -> Column:
    start = F.make_date(F.floor(x).cast("int"), F.lit(1), F.lit(1))
    return F.date_add(start, F.floor((x - F.floor(x)) * days_in_year(start) + F.lit(1e-6)).cast("int"))


def weekday_number(d: Column) -> Column:
    """Monday is 1, Sunday 7."""
    return F.weekday(d) + 1


def week_of_year(d: Column) -> Column:
    """Weeks that start on Mondays; days before the first Monday are week 0."""
    return F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7).cast("int")


def season(d: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("DJF", "MAM", "JJA", "SON"))), season_number(d))


def season_number(d: Column) -> Column:
    """1 is December to February, 4 is September to November."""
    return F.floor(F.month(d) % 12 / 3).cast("int") + 1


def yoy_dates(month: Column) -> Column:
    """All days of the month of a date and of the same month a year earlier, as an array."""
    start = F.trunc(month, "MM")
    before = F.add_months(start, -12)
    return F.concat(F.sequence(start, F.last_day(start)), F.sequence(before, F.last_day(before)))


def utc_hours_of_local_day(d: Column, zone: Column) -> Column:
    """The UTC hours (without a zone, whatever the session's is) of a local day: 23 or 25 where clocks change."""
    start, end = (F.convert_timezone(zone, F.lit("UTC"), x.cast("timestamp_ntz")) for x in (d, F.date_add(d, 1)))
    return F.sequence(start, end - F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 1 HOUR"))


def hour_features(df: DataFrame, ts: str = "date", zone: str = "UTC") -> DataFrame:
    """Adds ``hour`` and ``hour_local`` of a time without a zone that is in UTC."""
    t = F.col(ts).cast("timestamp_ntz")
    return df.withColumns({"hour": F.hour(t), "hour_local": F.hour(F.convert_timezone(F.lit("UTC"), F.lit(zone), t))})


def time_features(df: DataFrame, date: str = "date") -> DataFrame:
    """Adds the calendar variables that a model may use; for times of a day see :func:`hour_features`."""
    d = F.col(date)
    return df.withColumns({"date_unix": decimal_year(d), "yday": F.dayofyear(d), "wday": weekday_number(d), "month": F.month(d), "week": week_of_year(d), "weekday_name": F.date_format(d, "EEEE"), "month_abb": F.date_format(d, "MMM"), "season": season(d), "season_number": season_number(d)})


# ---- weather ---------------------------------------------------------------------------------
def wind_sector(wd: Column, wrap: bool = True) -> Column:
    """Eight sectors of 45 degrees with edges at 0, 45, ...; 360 is sector 0 again, or 8 unwrapped."""
    s = F.floor(wd / 45).cast("int")
    return s % 8 if wrap else s


def wind_direction(u: Column, v: Column) -> Column:
    """Where the wind comes from, in (0, 360], from its eastward and northward parts."""
    return 360 - F.pmod(F.degrees(F.atan2(v, u)) + 90, F.lit(360.0))


def extraterrestrial_radiation(yday: Column, lat: Column) -> Column:
    """Daily radiation above the atmosphere in MJ/m2, for any day of the year and latitude in degrees."""
    phi, j = F.radians(lat), 2 * math.pi / 365 * yday
    distance, decl = 1 + 0.033 * F.cos(j), 0.409 * F.sin(j - 1.39)
    sunset = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.tan(phi) * F.tan(decl))))
    return 24 * 60 / math.pi * 0.0820 * distance * (sunset * F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.sin(sunset))


def link(value: Column, name: str) -> Column:
    """Identity ("linear" or NULL) or logarithm; NULL where that is undefined."""
    if name in (None, "linear"):
        return value
    if name == "log":
        return F.when(value > 0, F.log(value))
    raise ValueError(f"unknown link {name!r}")


def inverse_link(value: Column, name: str) -> Column:
    if name in (None, "linear"):
        return value
    if name == "log":
        return F.exp(value)
    raise ValueError(f"unknown link {name!r}")


# ---- space -----------------------------------------------------------------------------------
def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from the first point to the second, in [0, 360)."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    deg = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(deg + 360, F.lit(360.0))


def sphere_km(lat: Column, lon: Column) -> list[Column]:
    """A point's place on the sphere, in km from its centre."""
    x = EARTH_KM * F.cos(F.radians(lat)) * F.cos(F.radians(lon))
    y = EARTH_KM * F.cos(F.radians(lat)) * F.sin(F.radians(lon))
    return [x, y, EARTH_KM * F.sin(F.radians(lat))]


def cell(lat: Column, lon: Column, km: float) -> list[Column]:
    """Cube of ``km`` edge of a point on the sphere: points within ``km`` are in the same or in touching
    cubes, at the poles and at the date line too."""
    return [F.floor(c / km) for c in sphere_km(lat, lon)]


# ---- cleaning and names ----------------------------------------------------------------------
def finite(c: Column) -> Column:
    """NULL for NaN and both infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def fold_name(c: Column) -> Column:
    """Lower case without accents, for all of Latin; marks that stand apart go, ligatures are spelt out."""
    low = F.regexp_replace(F.lower(F.trim(c)), r"\p{M}", "")
    for letter, spelt in LIGATURES.items():
        low = F.replace(low, F.lit(letter), F.lit(spelt))
    return F.translate(low, *_latin())


def date_in_name(path: Column) -> Column:
    """The date (yyyy-MM-dd) between a file name's first underscore and what follows; NULL if there is none."""
    return F.try_to_date(F.regexp_extract(path, r"[^/_]*_(\d{4}-\d{2}-\d{2})[^/]*$", 1))


def comma_key(values: Column) -> Column:
    """A vector as a text key; NULL is "none"."""
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(values)), ","), F.lit("none"))


def config_name(output: Column, engine: Column, lag: Column, filtered: Column, pbl: Column, fire: Column) -> Column:
    """Display name of a configuration."""
    return F.concat_ws("_", output, engine, F.when(lag > 0, F.concat(F.lit("lag"), lag.cast("string"))), F.when(filtered, "filter"), F.when(~pbl, "nopbl"), F.when(fire, "fire"))


def config_signature(output: Column, engine: Column, lag: Column, weather_vars: Column, time_vars: Column) -> Column:
    """JSON of a configuration, its variable lists sorted."""
    return F.to_json(F.struct(engine.alias("engine"), lag.alias("lag"), output.alias("output"), F.array_sort(time_vars).alias("time_vars"), F.array_sort(weather_vars).alias("weather_vars")))
