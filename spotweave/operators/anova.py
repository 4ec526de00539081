"""Analysis of variance and pairwise comparison of methods.

Spark reduces the data to one row per method (or method and block). Blocks may be
many: they are eliminated by grouped sums, and only a system of methods by
methods is solved in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from spotweave.functions.scalar import safe_ratio, significance
from spotweave.functions.tails import f_tail, range_tail
from spotweave.session import stored
from spotweave.tables import nan_to_null


def group_moments(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean and centred sum of squares per group, missing values skipped."""
    return (
        nan_to_null(rows, [value])
        .where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(value).alias("mean"),
            (F.var_pop(value) * F.count(F.lit(1))).alias("css"),
        )
    )


def anova_oneway(
    rows: DataFrame, method: str = "method", value: str = "value", keys: Sequence[str] = (), p_value: bool = True
) -> DataFrame:
    """F test of equal method means, one row per ``keys``."""
    m = group_moments(rows, [*keys, method], value)
    # one row per method here, so this window is small
    every = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    grand = F.sum(F.col("n") * F.col("mean")).over(every) / F.sum("n").over(every)
    gap = F.col("mean") - F.col("_grand")
    table = m.withColumn("_grand", grand).groupBy(*keys).agg(
        (F.count(F.lit(1)) - 1).alias("df_method"),
        (F.sum("n") - F.count(F.lit(1))).alias("df_error"),
        F.sum(F.col("n") * gap * gap).alias("ss_method"),
        F.sum("css").alias("ss_error"),
    )
    f = safe_ratio(F.col("ss_method") / F.col("df_method"), F.col("ss_error") / F.col("df_error"))
    out = table.withColumn("f", f)
    return out.withColumn("p", f_tail(F.col("f"), F.col("df_method"), F.col("df_error"))) if p_value else out


def anova_block(
    rows: DataFrame,
    method: str = "method",
    block: str = "sample",
    value: str = "value",
    keys: Sequence[str] = (),
    min_methods: int = 3,
    p_value: bool = True,
) -> DataFrame:
    """Two-way additive analysis, method first, replicate as block.

    Sequential sums of squares, right for unbalanced and disconnected designs as
    well. The blocks are eliminated by sums: with ``n`` and ``t`` the count and
    (centred) total of a method in a block, methods a and b meet in
    ``sum over blocks n_a n_b / n`` and the right-hand side of a is
    ``t_a - sum over blocks n_a t / n``. So no design matrix is built, and the system that a
    task solves for each of ``keys`` has as many rows as methods. Fewer than
    ``min_methods`` methods give NULL.
    """
    # a constant key, so that joins have a key also without ``keys``
    given, keys = list(keys), [*keys, "_all"]
    rows = rows.withColumn("_all", F.lit(0))
    cells = stored(group_moments(rows, [*keys, method, block], value), "cells")
    grand = cells.groupBy(*keys).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_grand"))
    n, y = F.col("n").cast("double"), F.col("mean") - F.col("_grand")
    centred = cells.join(grand, keys).select(*keys, F.col(method).alias("_a"), F.col(block).alias("_b"), n.alias("n"), (n * y).alias("t"), (n * y * y).alias("yy"), "css")
    blocks = centred.groupBy(*keys, "_b").agg(F.sum("n").alias("block_n"), F.sum("t").alias("block_t"))
    share = stored(centred.join(blocks, [*keys, "_b"]), "cells_by_block")
    methods = share.groupBy(*keys, "_a").agg(
        F.sum("n").alias("n"),
        F.sum("t").alias("t"),
        F.sum(F.col("t") - F.col("n") * F.col("block_t") / F.col("block_n")).alias("right"),
        F.sum("yy").alias("yy"),
        F.sum("css").alias("css"),
    )
    per_block = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.col("block_t") * F.col("block_t") / F.col("block_n")).alias("block_ss"))
    other = share.select(*keys, "_b", F.col("_a").alias("_c"), F.col("n").alias("n_c"))
    met = share.join(other, [*keys, "_b"]).groupBy(*keys, "_a", "_c").agg(F.sum(F.col("n") * F.col("n_c") / F.col("block_n")).alias("met"))
    system = met.join(methods, [*keys, "_a"]).join(per_block, keys)
    fields = ", ".join([f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys])
    schema = f"{fields}, df_method bigint, df_block bigint, df_error bigint, ss_method double, ss_block double, ss_error double"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.drop_duplicates("_a")
        place = pd.Series(range(len(one)), index=one["_a"])
        matrix = np.diag(one["n"].to_numpy(float))
        np.subtract.at(matrix, (place[pdf["_a"]].to_numpy(), place[pdf["_c"]].to_numpy()), pdf["met"].to_numpy(float))
        values, vectors = np.linalg.eigh(matrix)
        held = values > 1e-9 * one["n"].max()  # one zero for each connected part of the design
        turned = vectors[:, held].T @ one["right"].to_numpy(float)
        by_method = float((one["t"] ** 2 / one["n"]).sum())
        both = float(pdf["block_ss"].iloc[0]) + float((turned**2 / values[held]).sum())
        rank = int(pdf["blocks"].iloc[0]) + int(held.sum())
        row = {k: [pdf[k].iloc[0]] for k in keys} | {
            "df_method": [len(one) - 1],
            "df_block": [rank - len(one)],
            "df_error": [round(one["n"].sum()) - rank],
            "ss_method": [by_method],
            "ss_block": [both - by_method],
            "ss_error": [max(0.0, float(one["yy"].sum()) - both) + float(one["css"].sum())],
        }
        return pd.DataFrame(row)

    table = system.groupBy(*keys).applyInPandas(solve, schema).drop("_all")
    f = safe_ratio(F.col("ss_method") / F.col("df_method"), F.col("ss_error") / F.col("df_error"))
    out = table.withColumn("f", F.when(F.col("df_method") >= min_methods - 1, f)).select(*given, *table.columns[len(given):], "f")
    return out.withColumn("p", f_tail(F.col("f"), F.col("df_method"), F.col("df_error"))) if p_value else out


def tukey_pairs(
    rows: DataFrame,
    method: str = "method",
    value: str = "value",
    keys: Sequence[str] = (),
    focal: str | None = None,
    errors: DataFrame | None = None,
    p_value: bool = True,
    right: bool = True,
    include_lowest: bool = True,
) -> DataFrame:
    """Honest significant differences between method means.

    ``focal`` keeps the comparisons with one method. ``errors`` may hold
    ``ss_error`` and ``df_error`` per ``keys`` from another model (the block
    design); by default they come from the one-way table.
    """
    # a constant key, so that joins have a key also without ``keys``
    given, keys = list(keys), [*keys, "_all"]
    m = stored(group_moments(rows.withColumn("_all", F.lit(0)), [*keys, method], value), "method_means")
    table = anova_oneway(rows, method, value, given, p_value=False) if errors is None else errors
    error = table.select(*given, F.lit(0).alias("_all"), "ss_error", "df_error")
    ranked = m.select(*keys, F.col(method).alias("group1"), F.col("mean").alias("mean1"), F.col("n").alias("n1"))
    other = m.select(*keys, F.col(method).alias("group2"), F.col("mean").alias("mean2"), F.col("n").alias("n2"))
    if focal is not None:
        # each other method meets the focal one only
        ranked, other = ranked.where(F.col("group1") == focal), other.where(F.col("group2") != focal)
        meets = F.lit(True)
    else:
        meets = F.col("group1") < F.col("group2")
    k = m.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    pairs = ranked.join(other, keys).where(meets).join(error, keys).join(k, keys)
    mse = F.col("ss_error") / F.col("df_error")
    diff = F.col("mean2") - F.col("mean1")
    se = F.sqrt(mse / 2 * (1 / F.col("n1") + 1 / F.col("n2")))
    out = pairs.select(
        *given, "group1", "group2", diff.alias("diff"), safe_ratio(F.abs(diff), se).alias("q"), "k", "df_error"
    )
    if not p_value:
        return out
    out = out.withColumn("p_adj", range_tail(F.col("q"), F.col("k"), F.col("df_error")))
    return out.withColumn("signif", significance(F.col("p_adj"), right, include_lowest))
