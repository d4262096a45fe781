"""Every query of the library and its SQL, by name."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import SQL, Views

_queries: dict[str, Callable[[Views], DataFrame]] = {}
_sql: dict[str, str] = {}
MODULES = ("basic", "joins_windows", "statistics", "more", "streams", "files", "estimates", "models", "features")


def query(name: str, sql: str | None = None):
    """Registers a function of Views, with SQL for the same rows; the SQL may name the views."""
    def add(f):
        _queries[name] = f
        if sql:
            _sql[name] = with_views(sql.strip())
        return f

    return add


def with_views(sql: str) -> str:
    used = [f"{v} AS ({body})" for v, body in SQL.items() if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    head = re.match(r"WITH (RECURSIVE )?", sql)
    return f"WITH {head[1] or ''}" + ", ".join(used) + ", " + sql[head.end() :] if head else "WITH " + ", ".join(used) + " " + sql


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def on_tables(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(Views(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return run

    return {name: on_tables(f) for name, f in _queries.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
