"""Scores of expression layers, from nonzero rows only.

The dense grid ``genes * spots`` of a cell type enters the formulas as a
count: every cell missing on both sides is an exact match of zeros.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spotweave.functions.scalar import safe_ratio
from spotweave.sources.matrix import cell_value
from spotweave.tables import nan_to_null

ID = ("method", "sample")


def _state(t: Column, q: Column, there: Column) -> Column:
    """What the scores are made of, over the cells that are ``there``; ``t`` and ``q`` are NULL where a side has no row."""
    a, b = (F.when(there, F.coalesce(c, F.lit(0.0))) for c in (t, q))
    return F.struct(
        F.sum((a - b) * (a - b)).alias("_dd"),
        F.sum(F.abs(a - b)).alias("_d"),
        F.sum(a).alias("_t"),
        F.max(a).alias("_max"),
        F.min(a).alias("_min"),
        F.count(a).alias("_seen"),
        F.count(t).alias("_true"),
        F.count(q).alias("_predicted"),
    )


def _sums(truth: DataFrame, pred: DataFrame, layer: Sequence[str]) -> DataFrame:
    """States by layer for a truth that has all columns of the layers."""
    cells = [*layer, "spot", "gene"]
    none = F.lit(None).cast("double")
    t = truth.select(*cells, F.log1p("value").alias("t"), none.alias("q"))
    q = pred.select(*cells, none.alias("t"), F.log1p("value").alias("q"))
    pairs = t.unionByName(q).groupBy(*cells).agg(F.sum("t").alias("t"), F.sum("q").alias("q"))
    return pairs.groupBy(*layer).agg(_state(F.col("t"), F.col("q"), F.lit(True)).alias("_s")).select(*layer, "_s.*")


def _sums_of_methods(truth: DataFrame, pred: DataFrame, shared: Sequence[str], layer: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """States by layer, the truth being the same for all methods.

    One grouping by cell holds the truth and a column for each method, so a
    truth row is moved once, whatever the number of methods. Methods are few and named by the caller.
    """
    cells = [*shared, "spot", "gene"]
    none = F.lit(None).cast("double")
    number = F.array_position(F.array(*[F.lit(m) for m in methods]), F.col("method")).cast("int")
    t = truth.select(*cells, F.lit(0).alias("_m"), F.log1p("value").alias("v"))
    q = pred.select(*cells, number.alias("_m"), F.log1p("value").alias("v")).where("_m > 0")
    side = [F.sum(F.when(F.col("_m") == i, F.col("v")).otherwise(none)).alias(f"v{i}") for i in range(len(methods) + 1)]
    pairs = t.unionByName(q).groupBy(*cells).agg(*side)
    return _states(pairs, shared, layer, methods)


def _states(pairs: DataFrame, shared: Sequence[str], layer: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """States by layer of cells with the truth ``v0`` and the methods ``v1``, ``v2``, .."""
    states = [_state(F.col("v0"), F.col(f"v{i + 1}"), F.col("v0").isNotNull() | F.col(f"v{i + 1}").isNotNull()).alias(f"_s{i}") for i in range(len(methods))]
    rows = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"_s{i}").alias("_s")) for i, m in enumerate(methods)])
    return pairs.groupBy(*shared).agg(*states).select(*shared, F.inline(rows)).select(*layer, "_s.*")


def wide_layer_metrics(
    truth: DataFrame, pred: DataFrame, types: Sequence[str], sizes: DataFrame, methods: Sequence[str], normalize: str = "range"
) -> DataFrame:
    """``layer_metrics`` of methods whose predictions ``pred`` hold one row for each (sample, spot, gene).

    Each method is a column of ``pred``, an array by ``types`` with NULL where the long layer would have no row. So
    a cell of the matrix is moved once for all types and methods; it is spread over the types where it meets the truth.
    """
    cells = ["sample", "spot", "gene"]
    sums = [F.sum(F.when(F.col("cell_type") == t, F.log1p("value"))).alias(f"_t{i}") for i, t in enumerate(types)]
    met = truth.groupBy(*cells).agg(*sums).join(pred.select(*cells, *methods), cells, "full")
    sides = [F.struct(F.lit(t).alias("cell_type"), F.col(f"_t{i}").alias("v0"), *[F.log1p(F.get(m, F.lit(i))).alias(f"v{j + 1}") for j, m in enumerate(methods)]) for i, t in enumerate(types)]
    pairs = met.select("sample", F.inline(F.array(*sides)))
    layer = [*ID, "cell_type"]
    return _scores(_states(pairs, ["sample", "cell_type"], layer, methods), sizes, layer, normalize)


def layer_metrics(
    truth: DataFrame,
    pred: DataFrame,
    sizes: DataFrame,
    group: Sequence[str] = ID,
    normalize: str = "range",
    methods: Sequence[str] | None = None,
) -> DataFrame:
    """RMSE, NRMSE and MAE of log1p values per (group, cell type).

    ``sizes`` holds the number of shared genes and spots: columns ``n_genes``
    and ``n_spots`` plus any of the group columns or ``cell_type``. Both fact
    tables must already be restricted to the shared keys. Types without truth
    or without predictions are skipped. ``normalize`` is "range" or "mean" of
    the truth. With the ``methods`` named, and a truth without that column, all
    methods are scored in one grouping and the truth is moved once.
    """
    group = list(group)
    layer = [*group, "cell_type"]
    shared = [c for c in layer if c in truth.columns]
    if methods is not None and set(layer) - set(shared) == {"method"}:
        sums = _sums_of_methods(truth, pred, shared, layer, list(methods))
    else:
        repeated = truth if len(shared) == len(layer) else truth.join(pred.select(*layer).distinct(), shared)
        sums = _sums(repeated, pred, layer)
    return _scores(sums, sizes, layer, normalize)


def line_metrics(truth: DataFrame, pred: DataFrame, genes: DataFrame, group: Sequence[str] = ID, normalize: str = "range") -> DataFrame:
    """``layer_metrics`` of lines of ``scan_lines`` by group, cell type and spot, on the shared ``genes`` by layer and the spots on both sides.

    Lines meet by spot with all their cells, which are spread where they met, so no cell is moved alone.
    Each spot has one cell without a gene, by which spots are counted in the same pass.
    """
    layer = [*group, "cell_type"]
    kind = truth.schema["cells"].dataType
    sides = [df.select(*layer, "spot", *[(F.col("cells") if i == j else F.lit(None).cast(kind)).alias(f"_{j}") for j in (0, 1)]) for i, df in enumerate((truth, pred))]
    met = (
        sides[0].unionByName(sides[1]).groupBy(*layer, "spot")
        .agg(*[F.collect_list(f"_{j}").alias(f"_{j}") for j in (0, 1)])
        .where((F.size("_0") > 0) & (F.size("_1") > 0))
    )
    spot = F.array(F.lit(None).cast(kind.elementType))
    both = F.array(*[F.struct(F.lit(j).alias("m"), c.alias("c")) for j, c in ((0, F.flatten("_0")), (1, F.flatten("_1")), (2, spot))])
    spread = met.select(*layer, "spot", F.explode(both).alias("_s")).select(*layer, "spot", F.col("_s.m").alias("_m"), F.explode("_s.c").alias("_c"))
    cells = spread.select(*layer, "spot", "_m", F.col("_c._name").alias("gene"), cell_value("_c").alias("_v"))
    cells = cells.where(F.col("_v").isNull() | (F.col("_v") != 0))
    pairs = cells.groupBy(*layer, "spot", "gene").agg(*[F.sum(F.when(F.col("_m") == j, F.log1p("_v"))).alias(f"_{j}") for j in (0, 1)])
    known = pairs.join(genes.select(*layer, "gene", F.lit(True).alias("_shared")), [*layer, "gene"], "left")
    there = F.col("_shared").isNotNull()
    state = _state(*[F.when(there, F.col(f"_{j}")) for j in (0, 1)], there)
    sums = known.groupBy(*layer).agg(state.alias("_s"), F.count_if(F.col("gene").isNull()).alias("n_spots")).select(*layer, "_s.*", "n_spots")
    return _scores(sums, genes.groupBy(*layer).agg(F.count(F.lit(1)).alias("n_genes")), layer, normalize)


def _scores(sums: DataFrame, sizes: DataFrame, layer: Sequence[str], normalize: str) -> DataFrame:
    """The scores of layers with a state."""
    if normalize not in ("range", "mean"):
        raise ValueError("normalize must be 'range' or 'mean'")
    sums = sums.where((F.col("_true") > 0) & (F.col("_predicted") > 0))
    by = [c for c in layer if c in sizes.columns]
    size = F.col("n_genes").cast("double") * F.col("n_spots")
    s = (sums.join(sizes, by) if by else sums.withColumns(
        {c: sizes.select(c).scalar() for c in ("n_genes", "n_spots")}
    )).withColumn("_size", size)
    hidden_zero = F.col("_seen") < F.col("_size")
    low = F.when(hidden_zero, F.least(F.col("_min"), F.lit(0.0))).otherwise(F.col("_min"))
    high = F.when(hidden_zero, F.greatest(F.col("_max"), F.lit(0.0))).otherwise(F.col("_max"))
    scale = high - low if normalize == "range" else F.col("_t") / F.col("_size")
    rmse = F.sqrt(F.col("_dd") / F.col("_size"))
    return s.select(
        *layer,
        rmse.alias("rmse"),
        safe_ratio(rmse, scale).alias("nrmse"),
        (F.col("_d") / F.col("_size")).alias("mae"),
    )


def layer_summary(by_type: DataFrame, group: Sequence[str] = ID, skip_nan_rmse: bool = False) -> DataFrame:
    """Average and median over cell types, long: ``metric``, ``value``.

    NRMSE and MAE skip missing values. RMSE does so only with
    ``skip_nan_rmse``; otherwise one missing RMSE makes both figures NaN.
    Groups hold one row per cell type, so the built-in median is safe.
    """
    group = list(group)
    rows = nan_to_null(by_type, ["rmse", "nrmse", "mae"])
    figures, lost = [], F.count(F.lit(1)) > F.count("rmse")
    for label, col in (("RMSE", "rmse"), ("NRMSE", "nrmse"), ("MAE", "mae")):
        for name, fn in (("Average", F.avg), ("Median", F.median)):
            v = fn(col)
            if col == "rmse" and not skip_nan_rmse:
                v = F.when(lost, F.lit(float("nan"))).otherwise(v)
            figures.append(v.alias(f"{name} {label}"))
    wide = rows.groupBy(*group).agg(*figures)
    names = [c for c in wide.columns if c not in group]
    return wide.unpivot(group, names, "metric", "value")
