"""Registration of queries with their checking SQL.

A query declares its result columns as ``"name type, ..."``. Both sides are cast to them, and the type
``double6`` rounds to six digits (for sums of doubles, whose order differs between engines).
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
_SQL_TYPES = {"string": "varchar", "double6": "double"}


def query(columns: str, sql: str | None = None, name: str | None = None):
    """Register the decorated ``(spark, folder) -> DataFrame`` under its own name."""
    declared = [tuple(c.split()) for c in columns.split(",")]

    def register(build: Query) -> Query:
        key = name or build.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            result = build(spark, folder)
            return result.select(*[_spark_column(c, kind) for c, kind in declared])

        QUERIES[key] = run
        if sql is not None:
            wanted = ", ".join(_sql_column(c, kind) for c, kind in declared)
            CHECKS[key] = f"select {wanted} from ({sql}) answer"
        return build

    return register


def _spark_column(name: str, kind: str):
    column = F.col(f"`{name}`")
    if kind == "double6":
        return F.round(column.cast("double"), 6).alias(name)
    return column.cast(kind).alias(name)


def _sql_column(name: str, kind: str) -> str:
    value = f'cast("{name}" as {_SQL_TYPES.get(kind, kind)})'
    return f'round({value}, 6) as "{name}"' if kind == "double6" else f'{value} as "{name}"'
