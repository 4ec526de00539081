"""Metric tables with dictionaries as text, run logs and marker profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spotweave.sources.matrix import path_field
from spotweave.tables import MARKER


def dict_text(text: Column) -> Column:
    """``{'a': 0.1, 'b': 0.2}`` to a map from name to double."""
    bare = F.regexp_replace(text, "[{}'\"]", "")
    return F.transform_values(F.str_to_map(bare, F.lit(", "), F.lit(": ")), lambda _, v: v.try_cast("double"))


def dict_metrics(rows: DataFrame, keys: Sequence[str], columns: Sequence[str] = ("RMSE", "MAE")) -> DataFrame:
    """One row per cell type with a column per dictionary, matched by name.

    A name missing from one dictionary gives NULL there.
    """
    maps = rows.select(*keys, *[dict_text(F.col(c)).alias(c) for c in columns])
    names = F.map_keys(columns[0])
    for c in columns[1:]:
        names = F.array_union(names, F.map_keys(c))
    return maps.select("*", F.explode(names).alias("cell_type")).select(
        *keys, "cell_type", *[F.col(c)[F.col("cell_type")].alias(c.lower()) for c in columns]
    )


def to_dict_text(entries: Column) -> Column:
    """Map to dictionary text, the form the metric files use."""
    parts = F.transform(
        F.map_entries(entries), lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), e["value"].cast("string"))
    )
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def parse_run_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """Adds ``replicate`` and ``seconds``; lines without them give NULL."""
    return lines.withColumns(
        {
            "replicate": F.nullif(F.regexp_extract(line, r"(?<=Replicate )(\d+)", 1), F.lit("")).cast("int"),
            "seconds": F.nullif(F.regexp_extract(line, r"(?<=took )(\d+\.?\d*)", 1), F.lit("")).cast("double"),
        }
    )


def scan_run_logs(spark: SparkSession, path: str | Sequence[str], method_pattern: str) -> DataFrame:
    """Runtime rows of all logs; the method comes from the file path."""
    lines = spark.read.text(path).select("value", path_field(method_pattern).alias("method"))
    return parse_run_log(lines).select("method", "replicate", "seconds")


def marker_rows(profiles: DataFrame, column: str = "profile", n: int | None = None) -> DataFrame:
    """Marker table of a map from cell type to ``struct(Major array<string>)``.

    ``n`` keeps the first markers of each type; ``pos`` counts from 0.
    """
    per_type = profiles.select(F.explode(column).alias("cell_type", "_tiers"))
    major = F.col("_tiers.Major") if n is None else F.slice(F.col("_tiers.Major"), 1, n)
    return per_type.select("cell_type", F.lit("Major").alias("tier"), F.posexplode(major).alias("pos", "protein"))


def marker_table(spark: SparkSession, profile: dict[str, dict[str, list[str]]], n: int | None = None) -> DataFrame:
    """Marker table of a profile dictionary given by the caller."""
    rows = [
        (cell_type, tier, pos, protein)
        for cell_type, tiers in profile.items()
        for tier, proteins in tiers.items()
        for pos, protein in enumerate(proteins[:n])
    ]
    return spark.createDataFrame(rows, MARKER)
