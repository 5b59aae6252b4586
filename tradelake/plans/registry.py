"""Named queries over the test tables and their oracle SQL.

Each query takes ``(spark, sf_dir)``, derives the archive state from the given tables (so its
work grows with them) and returns a DataFrame whose column names match the oracle's.  Outputs
carry natural keys (ticker, issuer name, file key) rather than hash ids, and decimals are cast
to double at the edge so both engines hand over the same value types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .warehouse import Warehouse

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

# Parameters of the test scenario (fixed values).
DATE_FROM, DATE_TO = "1998-01-01", "1999-12-31"
CARD_TICKER = "Supplier#000000001"
COMPARE_TICKERS = [f"Supplier#00000000{i}" for i in range(1, 6)]


def register(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def out(df: DataFrame, *cols: str) -> DataFrame:
    """Select ``cols`` (all if none) and cast decimal columns to double."""
    names = list(cols) or df.columns
    types = dict(df.dtypes)
    return df.select(
        *[F.col(c).cast("double").alias(c) if types[c].startswith("decimal") else F.col(c) for c in names]
    )


_WH_CACHE: dict[tuple, Warehouse] = {}


def wh(spark: SparkSession, sf_dir: str, file_by: str = "ship", keep: bool = True) -> Warehouse:
    """The warehouse derived from the test tables, as lazy plans.  Every table of it derives from
    one compact aggregate of the raw rows, kept (memory, then disk) until ``reset``, so a query reads
    the raw tables once however many of the tables it uses.  With ``keep=False`` nothing is kept: for
    queries that need a table or a few columns, a pass over these is far less than the whole aggregate."""
    key = (spark.sparkContext.applicationId, spark.sparkContext.startTime, id(spark), sf_dir, file_by, keep)
    if key not in _WH_CACHE:
        _WH_CACHE[key] = Warehouse.from_testdata(spark, sf_dir, file_by, persist=keep)
    return _WH_CACHE[key]


def reset() -> None:
    for w in _WH_CACHE.values():
        w.release()
    _WH_CACHE.clear()


def date_lit(s: str):
    return F.lit(s).cast(T.DateType())
