"""Ordering helpers: rank by value, sort by text or by length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_within(df: DataFrame, group: list[str], value: Column, tie: list[str], name: str = "rank") -> DataFrame:
    """Number the rows of each group from the highest value down; equal values go by ``tie``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(value.desc(), *tie)))


def by_text(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(F.col(column))


def by_byte_length(df: DataFrame, column: str) -> DataFrame:
    """Shortest first; rows of equal length in text order, so that the result is fixed."""
    return df.orderBy(F.octet_length(column), F.col(column))
