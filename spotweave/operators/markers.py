"""Marker ranking, variable genes and per-gene scaling from sparse moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spotweave.functions.scalar import safe_ratio
from spotweave.operators.joins import grid
from spotweave.session import stored


def _with_zeros(n_cells: Column) -> tuple[Column, Column]:
    """(mean, squares about it) over ``n_cells`` cells, from n, m and m2 of the nonzero ones: the two groups merged."""
    n, m = F.col("n"), F.col("m")
    return n * m / n_cells, F.col("m2") + n * (n_cells - n) / n_cells * m * m


def _nonzero_moments() -> list[Column]:
    """n, m, m2: number, mean and squares about the mean of the values; Spark merges them without cancellation."""
    v = F.col("value")
    return [F.count(v).alias("n"), F.avg(v).alias("m"), (F.var_pop(v) * F.count(v)).alias("m2")]


def rank_markers(expr: DataFrame, labels: DataFrame, top: int = 100, cell: Sequence[str] = ("spot",)) -> DataFrame:
    """Welch t of each type against all other cells, best ``top`` genes per type.

    ``labels`` gives one ``cell_type`` per cell. Implicit zeros enter by the
    cell counts. Moments stay at one row per (type, gene). A gene without spread
    in either group has no t and comes last.
    """
    sizes = labels.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n1"))
    own = (
        expr.join(labels.select(*cell, "cell_type"), list(cell))
        .groupBy("cell_type", "gene")
        .agg(*_nonzero_moments())
    )
    every = grid(own.select("gene").distinct(), sizes, "cell_type").join(own, ["cell_type", "gene"], "left")
    every = every.fillna(0, ["n"]).fillna(0.0, ["m", "m2"]).join(sizes, "cell_type")
    mean, squares = _with_zeros(F.col("n1"))
    # one entry for each cell type
    types = F.collect_list(F.struct("cell_type", "n1", "mean", "squares")).over(W.partitionBy("gene"))
    rows = every.select("cell_type", "gene", "n1", mean.alias("mean"), squares.alias("squares")).withColumn("_all", types)
    rows = rows.withColumn("_rest", F.filter("_all", lambda o: o["cell_type"] != F.col("cell_type"))).drop("_all")

    def over_rest(term) -> Column:
        return F.aggregate("_rest", F.lit(0.0), lambda acc, o: acc + term(o))

    rows = rows.withColumn("n2", over_rest(lambda o: o["n1"])).withColumn(
        "mean2", F.try_divide(over_rest(lambda o: o["n1"] * o["mean"]), F.col("n2"))
    )
    apart = over_rest(lambda o: o["squares"] + o["n1"] * (o["mean"] - F.col("mean2")) * (o["mean"] - F.col("mean2")))
    m1, m2 = F.col("mean"), F.col("mean2")
    var1 = F.try_divide("squares", F.col("n1") - 1)
    var2 = F.try_divide(apart, F.col("n2") - 1)
    t = safe_ratio(m1 - m2, F.sqrt(var1 / F.col("n1") + var2 / F.col("n2")))
    t = F.when(~F.isnan(t) & (F.abs(t) != float("inf")), t)
    best = W.partitionBy("cell_type").orderBy(F.col("t").desc_nulls_last(), F.col("gene"))
    return (
        rows.select("cell_type", "gene", m1.alias("mean_in"), m2.alias("mean_out"), t.alias("t"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
    )


def marker_union(ranked: DataFrame) -> DataFrame:
    """Distinct genes over all types."""
    return ranked.select("gene").distinct()


def gene_moments(expr: DataFrame, n_cells: DataFrame, within: Sequence[str] = ("sample",)) -> DataFrame:
    """Mean and sample variance of each gene over all cells, zeros included."""
    m = expr.groupBy(*within, "gene").agg(*_nonzero_moments()).join(n_cells, list(within))
    mean, squares = _with_zeros(F.col("n_cells"))
    var = F.try_divide(squares, F.col("n_cells") - 1)
    return m.select(*within, "gene", mean.alias("mean"), var.alias("variance"))


def variable_features(
    expr: DataFrame, n_cells: DataFrame, top: int = 2000, within: Sequence[str] = ("sample",)
) -> DataFrame:
    """Genes with the largest variance-to-mean ratio."""
    m = gene_moments(expr, n_cells, within).withColumn("dispersion", safe_ratio(F.col("variance"), F.col("mean")))
    best = W.partitionBy(*within).orderBy(F.col("dispersion").desc_nulls_last(), F.col("gene"))
    return m.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def scale_genes(
    expr: DataFrame, n_cells: DataFrame, within: Sequence[str] = ("sample",), cap: float | None = 10.0
) -> DataFrame:
    """Mean 0 and deviation 1 per gene, capped above; sparse.

    Nonzero cells carry ``value``; ``zero_value`` is what every other cell of
    that gene would hold.
    """
    sd = F.sqrt("variance")
    z = F.coalesce(safe_ratio(F.col("value") - F.col("mean"), sd), F.lit(0.0))
    z0 = F.coalesce(safe_ratio(-F.col("mean"), sd), F.lit(0.0))
    if cap is not None:
        z, z0 = F.least(z, F.lit(float(cap))), F.least(z0, F.lit(float(cap)))
    moments = stored(gene_moments(expr, n_cells, within), "moments")
    return expr.join(moments, [*within, "gene"]).select(
        *within, "spot", "gene", z.alias("value"), z0.alias("zero_value")
    )
