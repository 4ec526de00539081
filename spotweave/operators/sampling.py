"""Seeded samples of exact size, and parameter sweeps."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, Window as W, functions as F

from spotweave.operators.order_stats import first_by_hash


def quotas(cells: DataFrame, total: int, by: str = "cell_type") -> DataFrame:
    """Cells to draw per type: rounded share of ``total``, corrected to sum up.

    Missing cells are added to the largest quota, surplus ones are taken from
    the smallest, one at a time. Adding keeps the largest the largest, and
    taking keeps the smallest the smallest, so the whole correction goes to
    that type, unless the smallest falls to 0: then the next one follows.
    There is one row per type, so the windows are small.
    """
    counts = cells.groupBy(by).agg(F.count(F.lit(1)).alias("available"))
    share = F.col("available") / F.sum("available").over(W.partitionBy(F.lit(0)))
    drawn = counts.withColumn("_q", F.rint(share * total).cast("bigint"))
    every = W.partitionBy(F.lit(0))
    largest = F.row_number().over(every.orderBy(F.col("_q").desc(), F.col("available").desc(), F.col(by)))
    up = every.orderBy(F.col("_q"), F.col("available").desc(), F.col(by))
    below = F.coalesce(F.sum("_q").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    gap = F.lit(total) - F.sum("_q").over(every)
    taken = F.greatest(F.least(-F.col("_gap") - F.col("_below"), F.col("_q")), F.lit(0))
    return (
        drawn.withColumns({"_gap": gap, "_top": largest, "_below": below})
        .withColumn(
            "quota",
            F.when(F.col("_gap") >= 0, F.col("_q") + F.when(F.col("_top") == 1, F.col("_gap")).otherwise(0)).otherwise(
                F.col("_q") - taken
            ),
        )
        .select(by, "available", "quota")
    )


def stratified_sample(
    cells: DataFrame, total: int = 12000, by: str = "cell_type", cell: Sequence[str] = ("cell",), seed: int = 412
) -> DataFrame:
    """Sample without replacement with the type shares of the whole table; asking for more cells than there are is an error."""
    return first_by_hash(cells, [by], cell, quotas(cells, total, by).select(by, "quota"), seed)


def uniform_sample(rows: DataFrame, n: int, cell: Sequence[str] = ("cell",), seed: int = 412) -> DataFrame:
    """``n`` rows without replacement; asking for more rows than there are is an error."""
    return first_by_hash(rows, [], cell, n, seed)


def sweep_points(**values: Sequence[float]) -> list[dict]:
    """All parameter combinations with a ``run_id``; the last name varies fastest."""
    names = list(values)
    return [{"run_id": i, **dict(zip(names, point))} for i, point in enumerate(product(*values.values()))]


def sweep_grid(runs: DataFrame, **values: Sequence[float]) -> DataFrame:
    """Each run with each parameter combination, decoded from ``run_id`` by div and mod."""
    size = 1
    for v in values.values():
        size *= len(v)
    out = runs.withColumn("run_id", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    step = size
    for name, options in values.items():
        step //= len(options)
        pos = F.floor(F.col("run_id") / step) % len(options)
        levels = F.array(*[F.lit(float(o)) for o in options])
        out = out.withColumn(name, F.element_at(levels, (pos + 1).cast("int")))
    return out
