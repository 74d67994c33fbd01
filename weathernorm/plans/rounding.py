"""Results that two engines can be held against, whatever the order of their sums.

Means of a few decimal numbers end in a 5 so often that rounding to digits tips either way; single
precision has no such ties. Nine digits come first, so that a sum that cancels is 0 in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 9


def rounded(df: DataFrame) -> DataFrame:
    """All double columns in single precision; a negative zero becomes zero."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, DIGITS).cast("float").cast("double") + F.lit(0.0) for c in doubles}) if doubles else df


def rounded_sql(body: str, columns: str) -> str:
    """The same for SQL: ``columns`` are the ones to round, by blanks."""
    replaced = ", ".join(f"CAST(CAST(round({c}, {DIGITS}) AS REAL) AS DOUBLE) + 0.0 AS {c}" for c in columns.split())
    head, _, tail = body.rpartition("--FINAL--")
    return f"{head} SELECT * REPLACE ({replaced}) FROM ({tail.strip()})"
