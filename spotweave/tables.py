"""Helpers for the long sparse tables shared by all operators.

* expr: sample, spot, gene, value (zeros absent)
* protein: sample, spot, protein, value
* spots: sample, spot, spot_x, spot_y (every spot)
* cell index: sample, cell, cell_type, spot
* prop: method, sample, spot, cell_type, p
* layers: method, sample, cell_type, spot, gene, value
* metrics: method, sample, cell_type, metric, value

Keys (``sample``, ``spot``, ``gene``, ...) may have any hashable type: text
ids from files or integer ids from a warehouse. Integer ids make shuffles
smaller, so adapters keep them where they exist.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F, types as T

MARKER = "cell_type string, tier string, pos int, protein string"


def nan_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """NULL for NaN: Spark averages skip NULL but propagate NaN."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    chosen = floats if columns is None else list(columns)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in chosen})


def few_values(df: DataFrame, column: str, bound: int = 2000) -> list | None:
    """Distinct values in order, without NULL, or ``None`` when there are more than ``bound``.

    At most ``bound + 1`` values reach the driver.
    """
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(bound + 1).collect()
    return None if len(rows) > bound else sorted(r[0] for r in rows)
