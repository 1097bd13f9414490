"""Registry of runnable queries, each with the survey ids it covers and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .views import Views


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    build: Callable[[Views], DataFrame]
    oracle: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, ids: str, oracle: str | None = None):
    """Register `fn(views) -> DataFrame` under a name."""

    def register(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, ids, fn, oracle)
        return fn

    return register


def plain(df: DataFrame) -> DataFrame:
    """Columns in engine-neutral form: times as text, lists joined by `|`, decimals and doubles at 6 digits."""
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            # The small shift keeps exact halves from rounding differently in two engines.
            c = F.round(c.cast("double") + F.lit(1e-9), 6)
        elif isinstance(t, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|") if isinstance(t.elementType, (T.StringType, T.LongType, T.IntegerType)) else F.to_json(c)
        elif isinstance(t, (T.StructType, T.MapType)):
            c = F.to_json(c)
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain(q.build(Views(spark, folder)))

    run.__name__ = q.name
    return run


def load_all() -> dict[str, Query]:
    from . import decisions, governance, metrics, streams, texts, traffic  # noqa: F401

    return QUERIES


# SQL text helpers shared by the oracles.
def d(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def t(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def r(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE) + 1e-9, 6)"


def lst(x: str) -> str:
    return f"array_to_string({x}, '|')"
