"""Row tables from many CSV files, with fields taken from names and paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spotweave.sources.matrix import path_field
from spotweave.tables import nan_to_null


def scan_rows(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: str,
    fields: dict[str, str] | None = None,
    header: bool = True,
) -> DataFrame:
    """One scan over all files with a fixed schema; NaN text becomes NULL.

    ``fields`` maps new columns to patterns on the file path, e.g.
    ``{"replicate": r"_map_(\\d+)\\.csv"}``. A file whose header doesn't name the
    schema's columns in their order is refused.
    """
    raw = (
        spark.read.schema(schema)
        .option("header", header)
        .option("nanValue", "NaN")
        .option("nullValue", "NA")
        .option("enforceSchema", not header)
        .csv(path)
    )
    extra = [path_field(p).alias(n) for n, p in (fields or {}).items()]
    return nan_to_null(raw.select("*", *extra))


def sweep_params(rows: DataFrame, source: Column, names: dict[str, str]) -> DataFrame:
    """Parameters from run directory names; rows that do not parse are dropped.

    ``names`` maps a column to the label before the number, e.g.
    ``{"lam": "lambda_", "alpha": "alpha_"}``.
    """
    number = r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
    out = rows.withColumns(
        {n: F.regexp_extract(source, f"(?:^|[/_]){label}{number}", 1).try_cast("double") for n, label in names.items()}
    )
    return out.dropna(subset=list(names))


def proportions_long(wide: DataFrame, keys: Sequence[str], types: Sequence[str] | None = None) -> DataFrame:
    """Long proportions of a wide table; coordinates are dropped by name."""
    wide = wide.drop("spot_x", "spot_y")
    names = [c for c in wide.columns if c not in keys] if types is None else list(types)
    return wide.unpivot(list(keys), names, "cell_type", "p")
