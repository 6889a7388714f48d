"""Registration of queries with one column specification that shapes both sides alike."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def _columns(spec: str) -> list[tuple[str, str, int]]:
    out = []
    for item in spec.split():
        name, kind = item.rsplit(":", 1)
        out.append((name, kind[0], int(kind[1:] or 6)))
    return out


def _nudge(digits: int) -> float:
    """Far below the last digit kept; puts exact rounding ties on the same side in both engines."""
    return 10.0 ** -(digits + 2)


def shape(df: DataFrame, spec: str) -> DataFrame:
    """Select the columns of ``spec``: ``name:i`` long, ``:f`` double rounded (``:f4`` to 4 digits), ``:s``, ``:d``."""
    out = []
    for name, kind, digits in _columns(spec):
        column = F.col(name)
        if kind == "i":
            column = column.cast("bigint")
        elif kind == "f":
            column = F.round(column.cast("double") + F.lit(_nudge(digits)), digits) + F.lit(0.0)
        elif kind == "d":
            column = column.cast("date")
        else:
            column = column.cast("string")
        out.append(column.alias(name))
    return df.select(*out)


def shape_sql(sql: str, spec: str) -> str:
    out = []
    for name, kind, digits in _columns(spec):
        if kind == "i":
            text = f'CAST("{name}" AS BIGINT)'
        elif kind == "f":
            text = f'round(CAST("{name}" AS DOUBLE) + {_nudge(digits)!r}, {digits}) + 0.0'
        elif kind == "d":
            text = f'CAST("{name}" AS DATE)'
        else:
            text = f'CAST("{name}" AS VARCHAR)'
        out.append(f'{text} AS "{name}"')
    return f"SELECT {', '.join(out)} FROM ({sql}) AS answer"


def query(name: str, spec: str, sql: str | None = None):
    """Register the decorated ``(spark, folder) -> DataFrame`` under ``name``."""

    def register(build):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(
            lambda spark, folder: shape(build(spark, folder), spec),
            None if sql is None else shape_sql(sql, spec),
        )
        return build

    return register
