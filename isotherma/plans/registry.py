"""Registered queries, each next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import Views, with_views
from ..session import tune

DIGITS = 6
OFF_TIE = 1.1e-8  # added before rounding, so that decimal data does not sit on a rounding tie


@dataclass(frozen=True)
class Query:
    build: Callable[[Views], DataFrame]
    numbers: tuple[str, ...]
    sql: str | None
    digits: int = DIGITS

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The result with its floating columns rounded, so that summation order does not show."""
        df = self.build(Views(tune(spark), sf_dir))
        rounded = {c: F.round(F.col(c).cast("double") + OFF_TIE, self.digits) + 0.0 for c in self.numbers}
        return df.select(*[rounded[c].alias(c) if c in rounded else F.col(c) for c in df.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        text = self.sql.strip()
        if self.numbers:
            replaced = ", ".join(f"round(CAST({c} AS DOUBLE) + {OFF_TIE}, {self.digits}) + 0.0 AS {c}" for c in self.numbers)
            text = f"SELECT * REPLACE ({replaced}) FROM (\n{with_views(text)}\n) AS q"
            return text
        return with_views(text)


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None, numbers: str = "", digits: int = DIGITS):
    def register(fn: Callable[[Views], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Query(fn, tuple(numbers.split()), sql, digits)
        return fn
    return register


def hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """SQL text of the great-circle distance, rounded as the spatial joins round it."""
    return (f"round(2*6371.0*asin(sqrt(greatest(0.0, least(1.0, pow(sin(radians({lat2}-{lat1})/2), 2)"
            f" + cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-{lon1})/2), 2))))), 6)")


def ridge_sql(x: str, y: str, w: str, n: int) -> str:
    """Slope and intercept, in SQL, of a ridge on two features with penalty 1."""
    sxx, szz, sxz, sxy, szy = (f"covar_pop({a}, {b})*count(*)" for a, b in ((x, x), (w, w), (x, w), (x, y), (w, y)))
    det = f"(({sxx} + 1)*({szz} + 1) - {sxz}*{sxz})"
    return f"(({szz} + 1)*{sxy} - {sxz}*{szy})/{det} AS bx{n}, (({sxx} + 1)*{szy} - {sxz}*{sxy})/{det} AS bz{n}, avg({x}) AS mx{n}, avg({w}) AS mz{n}, avg({y}) AS my{n}"
