"""Row, library-size and antibody normalisation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spotweave.functions.scalar import safe_ratio
from spotweave.operators.joins import complete
from spotweave.operators.order_stats import exact_quantiles
from spotweave.session import stored


def normalize_rows(
    rows: DataFrame, by: Sequence[str] = ("sample", "spot"), value: str = "p", zero_row: str = "zero"
) -> DataFrame:
    """Divide by the row sum. A zero row becomes 0 ("zero") or NaN ("nan")."""
    fill = 0.0 if zero_row == "zero" else float("nan")
    total = F.sum(value).over(W.partitionBy(*by))
    return rows.withColumn(value, safe_ratio(F.col(value), total, fill))


def normalize_total(
    expr: DataFrame,
    target_sum: float | None = 10000.0,
    within: Sequence[str] = ("sample",),
    log: bool = True,
) -> DataFrame:
    """Scale each spot to ``target_sum``, or to the median total of its sample."""
    within = list(within)
    totals = stored(expr.groupBy(*within, "spot").agg(F.sum("value").alias("_total")), "totals")
    if target_sum is None:
        seen = totals.where(F.col("_total") > 0)
        median = exact_quantiles(seen, within, "_total", [0.5], ["_target"])
        if within:
            totals = totals.join(median, within)
        else:
            totals = totals.withColumn("_target", median.scalar())
    else:
        totals = totals.withColumn("_target", F.lit(float(target_sum)))
    scaled = expr.join(totals, [*within, "spot"]).withColumn(
        "value", safe_ratio(F.col("value") * F.col("_target"), F.col("_total"), 0.0)
    )
    return (scaled.withColumn("value", F.log1p("value")) if log else scaled).drop("_total", "_target")


def winsor_bounds(
    protein: DataFrame,
    spots: DataFrame,
    proteins: DataFrame,
    lower: float,
    upper: float,
    within: Sequence[str] = ("sample",),
) -> DataFrame:
    """Quantile bounds per protein over all spots; implicit zeros count by number."""
    within = list(within)
    n_spots = spots.groupBy(*within).agg(F.count(F.lit(1)).alias("_spots"))
    seen = protein.groupBy(*within, "protein").agg(F.count(F.lit(1)).alias("_seen"))
    every = complete(seen, n_spots.select(*within), proteins, "protein", "_seen", 0)
    zeros = every.join(n_spots, within).select(
        *within, "protein", F.lit(0.0).alias("value"), (F.col("_spots") - F.col("_seen")).alias("_n")
    )
    weighted = protein.select(*within, "protein", "value", F.lit(1).cast("bigint").alias("_n")).unionByName(zeros)
    return exact_quantiles(weighted, [*within, "protein"], "value", [lower, upper], ["low", "high"], weight="_n")


@dataclass(frozen=True)
class ClrParts:
    """What the centred log ratio of a sparse antibody table is made of.

    ``facts``: logged value ``a`` of each nonzero row and ``b``, that of a zero
    of the same protein. ``base``: ``b`` of every protein. ``centre``: mean
    logged value of every spot over all proteins.
    """

    facts: DataFrame
    base: DataFrame
    centre: DataFrame


def clr_parts(
    protein: DataFrame,
    spots: DataFrame,
    proteins: DataFrame,
    lower: float = 0.05,
    upper: float = 0.95,
    within: Sequence[str] = ("sample",),
) -> ClrParts:
    """Winsorised and logged values without making the table dense.

    A zero turns into a constant of its protein, so the mean over all proteins
    is that of the constants plus what the nonzero rows add to them.
    """
    within = list(within)
    bounds = winsor_bounds(protein, spots, proteins, lower, upper, within)
    zero = F.log1p(F.greatest(F.col("low"), F.least(F.col("high"), F.lit(0.0))))
    base = stored(bounds.withColumn("b", zero), "antibody_bounds")
    facts = protein.join(base, [*within, "protein"]).select(
        *within,
        "spot",
        "protein",
        F.log1p(F.greatest(F.col("low"), F.least(F.col("high"), F.col("value")))).alias("a"),
        "b",
    )
    added = facts.groupBy(*within, "spot").agg(F.sum(F.col("a") - F.col("b")).alias("_add"))
    panel = base.groupBy(*within).agg(F.sum("b").alias("_sum"), F.count(F.lit(1)).alias("_size"))
    mean = (F.coalesce(F.col("_add"), F.lit(0.0)) + F.col("_sum")) / F.col("_size")
    centre = (
        spots.select(*within, "spot")
        .join(added, [*within, "spot"], "left")
        .join(panel, within)
        .select(*within, "spot", mean.alias("centre"))
    )
    return ClrParts(facts, base.select(*within, "protein", "b"), centre)


def antibody_clr(
    protein: DataFrame,
    spots: DataFrame,
    proteins: DataFrame,
    lower: float = 0.05,
    upper: float = 0.95,
    within: Sequence[str] = ("sample",),
) -> DataFrame:
    """Winsorise each protein, then centred log ratio within each spot.

    The result is dense over ``spots`` x ``proteins`` as the transformed zero
    is not zero. Spots are spread over the proteins only at the end.
    """
    within = list(within)
    spot = [*within, "spot"]
    parts = clr_parts(protein, spots, proteins, lower, upper, within)
    # proteins are numbered once in their sample; one list of places per spot, no longer than the antibody panel
    listed = parts.base.groupBy(*within).agg(F.array_sort(F.collect_list(F.struct("protein", "b"))).alias("_panel"))
    panel = stored(listed, "panels")
    number = panel.select(*within, F.posexplode("_panel").alias("_pos", "_entry")).select(*within, "_pos", F.col("_entry.protein").alias("protein"))
    placed = parts.facts.join(number, [*within, "protein"]).groupBy(*spot).agg(F.array_sort(F.collect_list(F.struct("_pos", "a"))).alias("_seen"))
    rows = parts.centre.join(placed, spot, "left").join(panel, within)
    rows = rows.withColumns({"_seen": F.coalesce("_seen", F.array().cast("array<struct<_pos:int,a:double>>")), "_zero": F.col("_panel.b"), "_names": F.col("_panel.protein")})

    def piece(entry: Column, i: Column) -> Column:
        """Constants of the zeros since the entry before, then the entry."""
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get("_seen", i - 1)["_pos"] + 1)
        return F.concat(F.slice("_zero", begin + 1, entry["_pos"] - begin), F.array(entry["a"]))

    last = F.coalesce(F.get("_seen", F.size("_seen") - 1)["_pos"] + 1, F.lit(0))
    values = F.concat(F.flatten(F.transform("_seen", piece)), F.slice("_zero", last + 1, F.size("_zero") - last))
    return (
        rows.select(*spot, "centre", F.inline(F.arrays_zip(F.col("_names").alias("protein"), values.alias("a"))))
        .select(*spot, "protein", (F.col("a") - F.col("centre")).alias("value"))
    )
