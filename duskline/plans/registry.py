"""Query registry.

A query is a function of `Tables`, an output schema, and (where SQL can say
it) a SQL twin. The schema drives the final projection on both sides, so
names, types and rounding are the same by construction.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskline.session import SAFE_UNION, ship_package
from duskline.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    cols: list[tuple[str, str]]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set(*SAFE_UNION)
        return project(self.build(Tables(spark, sf_dir)), self.cols)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        out = ", ".join(_sql_out(c, t) for c, t in self.cols)
        return f"SELECT {out} FROM ({self.sql.strip()}) AS q"


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, cols: str, sql: str | None = None):
    """Register a query. cols: 'name:type ...' with i, s, d, t, b or f<digits>."""

    def wrap(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        spec = [tuple(c.split(":")) if ":" in c else (c, "f") for c in cols.split()]
        REGISTRY[name] = Query(name, ids, spec, fn, sql)
        return fn

    return wrap


def _digits(t: str) -> int:
    return int(t[1:]) if len(t) > 1 else 6


# A small offset moves decimal ties off the rounding boundary, so that last-bit
# differences from summation order cannot round two ways.
def _nudge(t: str) -> str:
    return f"3.1e-{_digits(t) + 2}"


def project(df: DataFrame, cols) -> DataFrame:
    out = []
    for name, t in cols:
        c = F.col(name)
        if t[0] == "f":
            v = c.cast("double")
            v = F.when(~F.isnan(v), v)
            c = F.round(v + F.lit(float(_nudge(t))), _digits(t)) + F.lit(0.0)
        elif t in ("i", "b"):
            c = c.cast("long") if t == "i" else c.cast("int").cast("long")
        elif t in ("s", "d", "t"):
            c = c.cast("string")
        else:
            raise ValueError(f"unknown column type {t}")
        out.append(c.alias(name))
    return df.select(*out)


def _sql_out(name: str, t: str) -> str:
    if t[0] == "f":
        v = f"CAST({name} AS DOUBLE)"
        return f"round(CASE WHEN isnan({v}) THEN NULL ELSE {v} END + {_nudge(t)}, {_digits(t)}) + 0.0 AS {name}"
    if t == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    if t == "b":
        return f"CAST(CAST({name} AS BOOLEAN) AS BIGINT) AS {name}"
    if t == "d":
        return f"CAST(CAST({name} AS DATE) AS VARCHAR) AS {name}"
    return f"CAST({name} AS VARCHAR) AS {name}"
