"""The register of queries: a function of (session, folder) and, where SQL can say it, the SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _comparable(df: DataFrame) -> DataFrame:
    """Whole numbers as long, fractions rounded to six decimals, so that engines agree to the last digit shown."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, d: str = "", n: str = "") -> Callable:
    """Registers a query. d, n: the SQL's columns to round as doubles and to cast to BIGINT."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf: _comparable(f(spark, sf))
        if sql:
            swaps = [f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in d.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in n.split()]
            body = sql.strip().rstrip(";")
            SQL[name] = f"SELECT * REPLACE ({', '.join(swaps)}) FROM ({body}) AS q" if swaps else body
        return f

    return add
