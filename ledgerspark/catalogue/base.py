"""Registry of named queries: a Spark callable, and where SQL can say the same, a DuckDB query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, DateType, FractionalType, IntegralType, TimestampNTZType, TimestampType

from ledgerspark.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def canonical(df: DataFrame, digits: int = 6) -> DataFrame:
    """Integers as BIGINT, doubles rounded, dates as text: types both engines render alike."""
    columns = []
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (IntegralType, BooleanType)):
            column = column.cast("bigint")
        elif isinstance(kind, FractionalType):
            column = F.round(column.cast("double"), digits)
        elif isinstance(kind, (TimestampType, TimestampNTZType)):
            column = F.left(column.cast("string"), F.lit(19))
        elif isinstance(kind, DateType):
            column = column.cast("string")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return canonical(fn(tune(spark), sf_dir))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
