"""Unions and reshaping of metric tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def union_methods(tables: dict[str, DataFrame], column: str = "method") -> DataFrame:
    """Stack tables by column name with their label; absent columns become NULL."""
    parts = [df.withColumn(column, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def metric_pivot(
    rows: DataFrame, keys: Sequence[str], names: Sequence[str], metric: str = "metric", value: str = "value"
) -> DataFrame:
    """Metric names to columns; the list of names saves a pass over the data."""
    return rows.groupBy(*keys).pivot(metric, list(names)).agg(F.first(value, ignorenulls=True))


def metric_unpivot(
    wide: DataFrame, keys: Sequence[str], names: Sequence[str], metric: str = "metric", value: str = "value"
) -> DataFrame:
    return wide.unpivot(list(keys), list(names), metric, value)


def ranked(rows: DataFrame, column: str, levels: Sequence[str], out: str = "level") -> DataFrame:
    """Position of a value in a fixed list of levels (an ordered factor)."""
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(column))
    return rows.withColumn(out, F.when(pos > 0, pos.cast("int")))


def relabel(rows: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    mapped = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return rows.withColumn(column, F.coalesce(mapped[F.col(column)], F.col(column)))


def average_metrics(rows: DataFrame, metric: str = "metric", prefix: str = "Average") -> DataFrame:
    """Rows whose metric name starts with ``prefix``."""
    return rows.where(F.col(metric).startswith(prefix))
