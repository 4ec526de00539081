"""Truth tables built from single cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from spotweave.functions.scalar import counts_from_log


def spot_prop(cell_index: DataFrame, by: Sequence[str] = ("sample", "spot"), weight: str | None = None) -> DataFrame:
    """Share of each cell type among the cells of a spot (or of their weight)."""
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = cell_index.groupBy(*by, "cell_type").agg(amount.cast("double").alias("_n"))
    return counted.select(
        *by, "cell_type", (F.col("_n") / F.sum("_n").over(W.partitionBy(*by))).alias("p")
    )


def gt_layers(cell_index: DataFrame, cell_expr: DataFrame, logged: bool = True) -> DataFrame:
    """True expression per (sample, type, spot, gene): summed rounded counts of cells."""
    value = counts_from_log(F.col("value")) if logged else F.col("value")
    keys = [c for c in ("sample", "cell") if c in cell_expr.columns and c in cell_index.columns]
    return (
        cell_expr.withColumn("value", value)
        .join(cell_index, keys)
        .groupBy("sample", "cell_type", "spot", "gene")
        .agg(F.sum("value").alias("value"))
        .where(F.col("value") != 0)
    )
