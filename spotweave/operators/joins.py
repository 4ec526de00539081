"""Alignment, key checks, pairing, completion and marking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from spotweave.functions.scalar import canonical_type
from spotweave.tables import few_values


def align_shared(left: DataFrame, right: DataFrame, key: str, within: Sequence[str] = ()) -> DataFrame:
    """Distinct keys found on both sides, per ``within`` group.

    Pass dense key tables (headers): a gene that is zero everywhere still
    belongs to the grid.
    """
    cols = [*within, key]
    return left.select(*cols).distinct().join(right.select(*cols).distinct(), cols, "left_semi")


def restrict(facts: DataFrame, *key_sets: DataFrame) -> DataFrame:
    """Facts whose keys occur in every given key table."""
    for keys in key_sets:
        facts = facts.join(keys, keys.columns, "left_semi")
    return facts


def key_mismatch(left: DataFrame, right: DataFrame, key: str, within: Sequence[str] = ()) -> DataFrame:
    """Keys found on one side only, with the side that has them."""
    cols = [*within, key]
    sides = left.select(*cols, F.lit(1).alias("_side")).unionByName(right.select(*cols, F.lit(2).alias("_side")))
    return (
        sides.groupBy(*cols)
        .agg(F.min("_side").alias("_a"), F.max("_side").alias("_b"))
        .where(F.col("_a") == F.col("_b"))
        .select(*cols, F.when(F.col("_a") == 1, "left").otherwise("right").alias("only_in"))
    )


def require_same_keys(left: DataFrame, right: DataFrame, key: str, within: Sequence[str] = ()) -> None:
    """Raise unless both sides have the same keys."""
    odd = key_mismatch(left, right, key, within).limit(5).collect()
    if odd:
        raise ValueError(f"{key} keys do not match, e.g. {[r.asDict() for r in odd]}")


def pair_replicates(truth_runs: DataFrame, pred_runs: DataFrame, on: Sequence[str]) -> DataFrame:
    """Runs of predictions with their truth; ``paired`` is false without one."""
    on = list(on)
    known = truth_runs.select(*on).distinct().withColumn("_t", F.lit(True))
    return pred_runs.distinct().join(known, on, "left").withColumn("paired", F.col("_t").isNotNull()).drop("_t")


def attach_coords(facts: DataFrame, spots: DataFrame, on: Sequence[str] = ("sample", "spot")) -> DataFrame:
    """Coordinates by key, never by position; unknown spots keep NULL."""
    return facts.join(spots.select(*on, "spot_x", "spot_y"), list(on), "left")


def mark_subset(facts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Membership filter (chosen cells or marker genes)."""
    return facts.join(chosen, chosen.columns, "left_semi")


def match_types(facts: DataFrame, names: DataFrame, column: str = "cell_type") -> DataFrame:
    """Join on the canonical spelling, so spaces and underscores are equal."""
    return facts.withColumn("_canon", canonical_type(F.col(column))).join(
        names.select(F.col(column).alias("_name"), canonical_type(F.col(column)).alias("_canon")), "_canon", "left"
    ).withColumn(column, F.coalesce("_name", column)).drop("_canon", "_name")


def grid(rows: DataFrame, cols: DataFrame, column: str, spread: int = 64) -> DataFrame:
    """Every row with every value of ``column``.

    A short column list becomes an array literal and no join is needed. A
    long one, with the same rows, is spread over ``spread`` copies and met by an equality join, so
    the work is split evenly.
    """
    values = few_values(cols, column)
    if values is not None:
        kind = cols.schema[column].dataType
        return rows.withColumn(column, F.explode(F.array(*[F.lit(v).cast(kind) for v in values])))
    copies = cols.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    slot = F.pmod(F.xxhash64(*rows.columns), F.lit(spread)).cast("int")
    return rows.withColumn("_copy", slot).join(copies, "_copy").drop("_copy")


def complete(
    facts: DataFrame, rows: DataFrame, cols: DataFrame, column: str, value: str, fill: float = 0.0
) -> DataFrame:
    """Dense grid of ``rows`` and ``column`` with ``fill`` where facts lack a row."""
    keys = [*rows.columns, column]
    return grid(rows, cols, column).join(facts.select(*keys, value), keys, "left").fillna(fill, [value])
