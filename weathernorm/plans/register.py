"""How a query and its SQL are registered."""

from __future__ import annotations

from .rounding import rounded, rounded_sql
from .views import sql, view


def registrar(queries: dict, oracle: dict):
    """A decorator: name, SQL (or None), the SQL's columns to round, and the views that both use.

    In the SQL, ``--FINAL--`` stands before the last SELECT where common table expressions come first. With ``dealt``,
    parts of the views follow the bytes of the table that is summed up.
    """

    def query(name: str, text: str | None, round_: str, *views: str, dealt: bool = False):
        def register(f):
            queries[name] = lambda spark, sf_dir: rounded(f(*(view(spark, sf_dir, v, dealt) for v in views)))
            if text:
                marked = text if "--FINAL--" in text else "--FINAL--" + text
                oracle[name] = sql(rounded_sql(marked, round_) if round_ else marked.replace("--FINAL--", ""), *views)
            return f

        return register

    return query
