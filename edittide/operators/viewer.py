"""Operations of the interactive viewer over a finished table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edittide.functions import columns as C


def json_keys(df: DataFrame, column: str) -> DataFrame:
    """Distinct keys of a column's JSON objects; cells that are none are passed over."""
    return df.select(F.explode(F.json_object_keys(F.col(column))).alias("key")).distinct()


def with_json_key(df: DataFrame, column: str, key: str) -> DataFrame:
    return df.withColumn(f"{column}_{key}", C.json_value(F.col(column), key))


def between(df: DataFrame, column: str, low, high) -> DataFrame:
    """Closed range over numbers or times."""
    kind = df.schema[column].dataType
    return df.filter(F.col(column).between(F.lit(low).cast(kind), F.lit(high).cast(kind)))


def equals(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose cell reads like the given text; a text that is no such value finds none."""
    return df.filter(F.col(column) == F.lit(value).try_cast(df.schema[column].dataType))


def extent(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("low"), F.max(column).alias("high"))


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The chosen columns in the order asked for; an unknown one raises."""
    return df.select(*columns)


def sort(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    return df.orderBy(F.asc(column) if ascending else F.desc(column))
