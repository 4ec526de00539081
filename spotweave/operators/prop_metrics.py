"""Scores of predicted proportions against the truth, for all groups at once.

Everything works on sparse rows: a missing (spot, type) row is a zero, and
zeros enter sums and counts by the grid size ``spots * types`` of the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from spotweave.functions.scalar import entropy_term, safe_ratio
from spotweave.operators.order_stats import exact_quantiles
from spotweave.session import stored

ID = ("method", "sample")


def pair_rows(truth: DataFrame, pred: DataFrame, group: Sequence[str] = ID) -> DataFrame:
    """Rows ``group, spot, cell_type, t, q`` with zeros for missing partners.

    ``truth`` lacks some of the group columns (usually ``method``); it is
    repeated for each group that has predictions. One shuffle by
    (group, spot) serves every later step per spot.
    """
    group = list(group)
    shared = [c for c in group if c in truth.columns]
    runs = pred.select(*group).distinct()
    t = truth.join(runs, shared).select(
        *group, "spot", "cell_type", F.col("p").alias("t"), F.lit(0.0).alias("q")
    )
    q = pred.join(truth.select(*shared).distinct(), shared, "left_semi").select(
        *group, "spot", "cell_type", F.lit(0.0).alias("t"), F.col("p").alias("q")
    )
    return (
        t.unionByName(q)
        .repartition(*group, "spot")
        .groupBy(*group, "spot", "cell_type")
        .agg(F.sum("t").alias("t"), F.sum("q").alias("q"))
    )


def jsd_spot(pairs: DataFrame, group: Sequence[str] = ID, zero_rule_on: str = "truth") -> DataFrame:
    """Jensen-Shannon distance (base 2, square root) per spot.

    Both rows are scaled to sum 1. If the row named by ``zero_rule_on``
    ("truth" or "pred") sums to 0 the distance is 1; if only the other one
    does it is NaN.
    """
    spot = [*group, "spot"]
    w = W.partitionBy(*spot)
    sums = pairs.withColumn("_T", F.sum("t").over(w)).withColumn("_Q", F.sum("q").over(w))
    a, b = F.col("t") / F.col("_T"), F.col("q") / F.col("_Q")
    m = (a + b) / 2
    term = F.when((F.col("_T") > 0) & (F.col("_Q") > 0), (entropy_term(a, m) + entropy_term(b, m)) / 2)
    ruled, other = ("_T", "_Q") if zero_rule_on == "truth" else ("_Q", "_T")
    return (
        sums.withColumn("_term", term)
        .groupBy(*spot)
        .agg(F.sum("_term").alias("_d"), F.max(ruled).alias("_r"), F.max(other).alias("_o"))
        .select(
            *spot,
            F.when(~(F.col("_r") > 0), F.lit(1.0))
            .when(~(F.col("_o") > 0), F.lit(float("nan")))
            .otherwise(F.sqrt(F.greatest(F.col("_d"), F.lit(0.0))))
            .alias("jsd"),
        )
    )


def jsd_quantiles(jsd: DataFrame, group: Sequence[str] = ID) -> DataFrame:
    """Quartiles of the distances; NaN in a group makes its quartiles NaN."""
    return exact_quantiles(
        jsd, group, "jsd", [0.25, 0.5, 0.75], ["jsd_q1", "jsd_median", "jsd_q3"], nan_result=True
    )


def _sums(pairs: DataFrame, group: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Sums per (group, type), and the number of spots per group."""
    d = F.col("t") - F.col("q")
    types = pairs.groupBy(*group, "cell_type").agg(
        F.sum(d * d).alias("_dd"),
        F.sum(F.abs(d)).alias("_d"),
        F.sum("t").alias("_t"),
        F.sum("q").alias("_q"),
        F.sum(F.col("t") * F.col("t")).alias("_tt"),
        F.sum(F.col("q") * F.col("q")).alias("_qq"),
        F.sum(F.col("t") * F.col("q")).alias("_tq"),
    )
    spots = (
        pairs.groupBy(*group, "spot").agg(F.lit(1).alias("_one")).groupBy(*group).agg(F.sum("_one").alias("n_spots"))
    )
    return types, spots


def prop_by_type(pairs: DataFrame, group: Sequence[str] = ID) -> DataFrame:
    """RMSE and MAE of each cell type over all spots of a group."""
    types, spots = _sums(pairs, group)
    return types.join(spots, list(group)).select(
        *group,
        "cell_type",
        F.sqrt(F.col("_dd") / F.col("n_spots")).alias("rmse"),
        (F.col("_d") / F.col("n_spots")).alias("mae"),
    )


def prop_global(pairs: DataFrame, group: Sequence[str] = ID) -> DataFrame:
    """Global RMSE, MAE and Pearson correlation of the flattened grids."""
    types, spots = _sums(pairs, group)
    names = ("_dd", "_d", "_t", "_q", "_tt", "_qq", "_tq")
    total = types.groupBy(*group).agg(F.count(F.lit(1)).alias("n_types"), *[F.sum(c).alias(c) for c in names])
    g = total.join(spots, list(group)).withColumn("_n", (F.col("n_spots") * F.col("n_types")).cast("double"))
    cov = F.col("_tq") - F.col("_t") * F.col("_q") / F.col("_n")
    var_t = F.col("_tt") - F.col("_t") * F.col("_t") / F.col("_n")
    var_q = F.col("_qq") - F.col("_q") * F.col("_q") / F.col("_n")
    return g.select(
        *group,
        "n_spots",
        "n_types",
        F.sqrt(F.col("_dd") / F.col("_n")).alias("sum_rmse"),
        (F.col("_d") / F.col("_n")).alias("sum_mae"),
        safe_ratio(cov, F.sqrt(var_t * var_q)).alias("corr"),
    )


def prop_metrics(
    truth: DataFrame, pred: DataFrame, group: Sequence[str] = ID, zero_rule_on: str = "truth"
) -> DataFrame:
    """The whole proportion benchmark, one row per group."""
    pairs = stored(pair_rows(truth, pred, group), "pairs")
    median = jsd_quantiles(jsd_spot(pairs, group, zero_rule_on), group).select(
        *group, F.col("jsd_median").alias("jsd")
    )
    return prop_global(pairs, group).join(median, list(group))


def metric_maps(by_type: DataFrame, summary: DataFrame, group: Sequence[str] = ID) -> DataFrame:
    """One row per group with RMSE and MAE as maps from cell type to value."""
    maps = by_type.groupBy(*group).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("cell_type", "rmse")))).alias("rmse"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("cell_type", "mae")))).alias("mae"),
    )
    return summary.join(maps, list(group))
