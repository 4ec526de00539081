"""Gene, cell and spot filters on sparse expression.

The keys to keep are stored before they meet the expression again: their file
size tells Spark whether to broadcast them, so the expression is shuffled for
the filter only when the keys are too many for that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spotweave.session import stored


def _keep(expr: DataFrame, keep: DataFrame, keys: list[str]) -> DataFrame:
    return expr.join(stored(keep.select(*keys), "keys"), keys, "left_semi")


def split_prefix(expr: DataFrame, prefix: str = "MT-", gene: str = "gene") -> tuple[DataFrame, DataFrame]:
    """(other genes, genes with the prefix); both sides are kept."""
    hit = F.col(gene).startswith(prefix)
    return expr.where(~hit), expr.where(hit)


def prefix_totals(
    expr: DataFrame, prefix: str = "MT-", by: Sequence[str] = ("sample", "spot"), gene: str = "gene"
) -> DataFrame:
    """Per spot: total of prefix genes, total of the rest, and the prefix share."""
    hit = F.col(gene).startswith(prefix)
    return (
        expr.groupBy(*by)
        .agg(
            F.sum(F.when(hit, F.col("value")).otherwise(0.0)).alias("mt_total"),
            F.sum(F.when(hit, 0.0).otherwise(F.col("value"))).alias("rest_total"),
        )
        .withColumn("mt_share", F.col("mt_total") / (F.col("mt_total") + F.col("rest_total")))
    )


def _nonzero() -> Column:
    """Expressed: neither zero nor missing nor NaN."""
    return (F.col("value") != 0) & ~F.isnan(F.col("value").cast("double"))


def gene_stats(expr: DataFrame, within: Sequence[str] = ("sample",), cells: DataFrame | None = None) -> DataFrame:
    """Per gene: cells with a nonzero value, mean over them, and all cells.

    ``cells`` is the dense cell or spot table; without it, cells that have
    any expression are counted.
    """
    within = list(within)
    nonzero = _nonzero()
    rows = (expr if cells is None else cells).groupBy(*within, "spot").agg(F.lit(1).alias("_one"))
    total = rows.groupBy(*within).agg(F.sum("_one").alias("n_cells"))
    stats = expr.groupBy(*within, "gene").agg(
        F.count_if(nonzero).alias("n_nonzero"), F.avg(F.when(nonzero, F.col("value"))).alias("nonzero_mean")
    )
    if within:
        return stats.join(total, within)
    return stats.withColumn("n_cells", total.scalar())


def filter_gex(
    expr: DataFrame,
    nonzero_percentage: float = 0.01,
    mean_expression_threshold: float = 1.1,
    within: Sequence[str] = ("sample",),
    cells: DataFrame | None = None,
) -> DataFrame:
    """Keep genes nonzero in a share of spots and with a high mean over these."""
    keep = gene_stats(expr, within, cells).where(
        (F.col("n_nonzero") / F.col("n_cells") >= nonzero_percentage)
        & (F.col("nonzero_mean") >= mean_expression_threshold)
    )
    return _keep(expr, keep, [*within, "gene"])


def filter_genes3(
    expr: DataFrame,
    cell_count_cutoff: float = 5,
    cell_percentage_cutoff2: float = 0.03,
    nonz_mean_cutoff: float = 1.12,
    within: Sequence[str] = ("sample",),
    cells: DataFrame | None = None,
) -> DataFrame:
    """Keep widespread genes, and rarer ones whose nonzero mean is high."""
    keep = gene_stats(expr, within, cells).where(
        (F.col("n_nonzero") > F.col("n_cells") * cell_percentage_cutoff2)
        | ((F.col("n_nonzero") > cell_count_cutoff) & (F.col("nonzero_mean") > nonz_mean_cutoff))
    )
    return _keep(expr, keep, [*within, "gene"])


def filter_min(
    expr: DataFrame, min_genes: int = 100, min_cells: int = 3, within: Sequence[str] = ("sample",)
) -> DataFrame:
    """Cells with enough genes, then genes in enough of the cells left."""
    within = list(within)
    cells = expr.where(_nonzero()).groupBy(*within, "spot").count().where(F.col("count") >= min_genes)
    left = _keep(expr, cells, [*within, "spot"])
    genes = left.where(_nonzero()).groupBy(*within, "gene").count().where(F.col("count") >= min_cells)
    return _keep(left, genes, [*within, "gene"])


def filter_min_counts(expr: DataFrame, min_counts: float = 100, by: Sequence[str] = ("sample", "spot")) -> DataFrame:
    """Spots whose total count reaches the minimum."""
    keep = expr.groupBy(*by).agg(F.sum("value").alias("_s")).where(F.col("_s") >= min_counts)
    return _keep(expr, keep, list(by))


def data_checks(facts: DataFrame, by: Sequence[str] = ("sample",), value: str = "value") -> DataFrame:
    """Counts of rows, negative, NaN and missing values per group in one pass."""
    v = F.col(value)
    return facts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(v < 0).alias("n_negative"),
        F.count_if(F.isnan(v)).alias("n_nan"),
        F.count_if(v.isNull()).alias("n_null"),
        F.count_if(v == 0).alias("n_zero"),
    )


def incomplete_metrics(by_type: DataFrame, metrics: Sequence[str] = ("rmse", "nrmse", "mae")) -> DataFrame:
    """Cell types with a missing or NaN metric."""
    bad = F.lit(False)
    for m in metrics:
        bad = bad | F.col(m).isNull() | F.isnan(m)
    return by_type.where(bad)
