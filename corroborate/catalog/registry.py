"""Registered queries: Spark plan, oracle SQL and the survey rows they cover."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from corroborate.catalog.views import Views
from corroborate.functions.timefn import iso


@dataclass(frozen=True)
class Query:
    name: str
    survey: tuple[str, ...]
    build: Callable[[Views], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return plain(self.build(Views(spark, folder)))


QUERIES: dict[str, Query] = {}


def query(name: str, survey: str, sql: str | None = None):
    def register(build: Callable[[Views], DataFrame]):
        QUERIES[name] = Query(name, tuple(survey.split()), build, sql)
        return build

    return register


def plain(df: DataFrame) -> DataFrame:
    """Instants as ISO text, arrays as comma lists: comparable across engines."""
    columns = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, Ty.TimestampType):
            c = iso(c)
        elif isinstance(field.dataType, Ty.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        elif isinstance(field.dataType, (Ty.IntegerType, Ty.ShortType)):
            c = c.cast("bigint")
        columns.append(c.alias(field.name))
    return df.select(*columns)
