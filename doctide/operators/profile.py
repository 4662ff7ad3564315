"""Frequency tables and averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frequency(df: DataFrame, field: str | Column, name: str = "value") -> DataFrame:
    return df.groupBy((F.col(field) if isinstance(field, str) else field).alias(name)).agg(F.count("*").alias("probability"))


def frequency_exploded(df: DataFrame, array: str | Column, name: str = "value") -> DataFrame:
    """How often each element of an array occurs."""
    return frequency(df.select(F.explode(array).alias(name)), name, name)


def frequency_composite(df: DataFrame, field: str, array: str, size_name: str) -> DataFrame:
    """By a field and an array's length; a missing array counts 0."""
    length = F.when(F.col(array).isNull(), 0).otherwise(F.size(array)).cast("long")
    return df.groupBy(field, length.alias(size_name)).agg(F.count("*").alias("probability"))


def average(df: DataFrame, where: Column, field: str, name: str = "average") -> DataFrame:
    """The mean over matching rows; no row if none match."""
    return df.filter(where).groupBy(F.lit(1).alias("__all")).agg(F.avg(field).alias(name)).drop("__all")
