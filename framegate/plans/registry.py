"""Table access and the query catalogue behind ``__spark_entry__``."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from framegate.plans.views import DUCK_VIEWS, SPARK_VIEWS
from framegate.runtime import unsized

# Pixels that one task of the pixel view makes, on average.
TASK_PIXELS = 200_000


class Tables:
    """Lazy access to the base tables and the views derived from them: ``t.orders``, ``t.fx_eval``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._pixel_tasks = 0

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name == "fx_pixels":
            return unsized(self.spark.sql(SPARK_VIEWS[name], part=self._spread_parts()))
        if name in SPARK_VIEWS:
            return self.sql(SPARK_VIEWS[name])
        return self.spark.read.parquet(self.path(name))

    def _spread_parts(self) -> DataFrame:
        """The columns of ``part`` that pixels are made of, dealt by key to as many tasks as the pixels need: a small file is
        one task, whatever its rows are exploded to."""
        rows = self.part.select("p_partkey", "p_size")
        if not self._pixel_tasks:
            pixels = rows.agg(F.sum(F.greatest(F.col("p_size"), F.lit(0)).cast("bigint"))).first()[0] or 0  # one row
            self._pixel_tasks = max(1, 2 * pixels // TASK_PIXELS)
        return rows.repartition(self._pixel_tasks, "p_partkey")

    def sql(self, text: str) -> DataFrame:
        """Run SQL whose ``{table}`` fields name base tables or views."""
        names = set(re.findall(r"\{(\w+)\}", text))
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})


_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its inventory id, with the SQL that must return the same rows."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = with_views(sql)
        return fn

    return wrap


def with_views(body: str) -> str:
    """Put the views a statement mentions in front of it as CTEs."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in DUCK_VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(DUCK_VIEWS[name])
                needed.append(name)

    need(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS ({DUCK_VIEWS[n]})" for n in needed)
    return f"WITH {ctes}\nSELECT * FROM ({body}) AS result"


def load_all() -> None:
    from framegate.plans import catalog  # noqa: F401  (registers on import)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()

    def bind(fn):
        return lambda spark, sf_dir: fn(Tables(spark, sf_dir))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def oracles() -> dict[str, str]:
    load_all()
    return dict(_ORACLES)
