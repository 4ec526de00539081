"""Scoring of many methods and replicates in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from spotweave.operators import joins, layer_metrics as lm, prop_metrics as pm
from spotweave.session import stored
from spotweave.sources.matrix import scan_layer_lines, scan_wide

RUN = ("method", "sample")


def benchmark_proportions(
    truth: DataFrame,
    pred: DataFrame,
    group: Sequence[str] = RUN,
    zero_rule_on: str = "truth",
    strict: bool = False,
) -> DataFrame:
    """One row per run: jsd, rmse map, sum_rmse, mae map, sum_mae, corr.

    ``strict`` raises when spots or cell types differ from those of the truth.
    Prediction tables must then hold their zeros.
    """
    shared = [c for c in group if c in truth.columns]
    if strict:
        for key in ("spot", "cell_type"):
            joins.require_same_keys(truth, pred, key, shared)
    pairs = stored(pm.pair_rows(truth, pred, group), "pairs")
    jsd = pm.jsd_quantiles(pm.jsd_spot(pairs, group, zero_rule_on), group)
    summary = pm.prop_global(pairs, group).join(jsd.select(*group, F.col("jsd_median").alias("jsd")), list(group))
    return pm.metric_maps(pm.prop_by_type(pairs, group), summary, group)


def shared_sizes(
    truth_genes: DataFrame, truth_spots: DataFrame, pred_genes: DataFrame, pred_spots: DataFrame, within: Sequence[str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(shared genes, shared spots, their numbers per group) from dense key tables."""
    genes = joins.align_shared(truth_genes, pred_genes, "gene", within)
    spots = joins.align_shared(truth_spots, pred_spots, "spot", within)
    n_genes = genes.groupBy(*within).agg(F.count(F.lit(1)).alias("n_genes"))
    n_spots = spots.groupBy(*within).agg(F.count(F.lit(1)).alias("n_spots"))
    return genes, spots, n_genes.join(n_spots, list(within))


def benchmark_layers(
    truth: DataFrame,
    pred: DataFrame,
    genes: DataFrame,
    spots: DataFrame,
    sizes: DataFrame,
    group: Sequence[str] = RUN,
    normalize: str = "range",
) -> tuple[DataFrame, DataFrame]:
    """(per type, averages and medians) of expression errors on the shared keys."""
    by_type = stored(
        lm.layer_metrics(
            joins.restrict(truth, genes, spots), joins.restrict(pred, genes, spots), sizes, group, normalize
        ),
        "layer_scores",
    )
    return by_type, lm.layer_summary(by_type, group)


def benchmark_layer_files(
    spark: SparkSession,
    truth_path: str | Sequence[str],
    pred_path: str | Sequence[str],
    truth_sample: str,
    pred_sample: str,
    normalize: str = "range",
    fields: dict[str, str] | None = None,
    index_label: str = "",
) -> tuple[DataFrame, DataFrame]:
    """(per type, averages and medians) of ``<type>_GT.csv`` against ``<type>_layer.csv`` files.

    All samples of both globs in one job; the sample patterns cut the
    replicate out of the paths. ``fields`` are further run columns of the
    predictions, such as the method. Types or samples on one side only are
    skipped, and so are types without a shared gene or spot.
    """
    truth, t_genes = scan_layer_lines(spark, truth_path, truth_sample, "_GT", index_label=index_label)
    pred, p_genes = scan_layer_lines(spark, pred_path, pred_sample, "_layer", fields, index_label)
    p_genes = stored(p_genes, "genes")
    group = ["sample", *(fields or {})]
    layer = [*group, "cell_type"]
    shared = ["sample", "cell_type"]
    # the truth is the same for all runs of a sample: give it their columns
    runs = stored(p_genes.select(*layer).distinct(), "runs")
    truth, t_genes = (df.join(runs, shared) for df in (truth, t_genes))
    genes = stored(joins.align_shared(t_genes, p_genes, "gene", layer), "shared_genes")
    by_type = stored(lm.line_metrics(truth, pred, genes, group, normalize), "layer_scores")
    return by_type, lm.layer_summary(by_type, group)


def read_proportions(
    spark: SparkSession, path: str | Sequence[str], fields: dict[str, str], index_label: str = ""
) -> DataFrame:
    """Long proportions of wide files, zeros kept, coordinates dropped."""
    long = scan_wide(spark, path, "spot", "cell_type", fields, index_label, keep_zero=True)
    return long.where(~F.col("cell_type").isin("spot_x", "spot_y")).withColumnRenamed("value", "p")


def benchmark_proportion_files(
    spark: SparkSession,
    truth_path: str | Sequence[str],
    pred_path: str | Sequence[str],
    truth_sample: str,
    pred_fields: dict[str, str],
    zero_rule_on: str = "truth",
    strict: bool = True,
    index_label: str = "",
    pred_index_label: str = "",
) -> DataFrame:
    """Scores of all prediction files against the truth file of their sample.

    ``pred_fields`` must give ``sample``; more columns name the run.
    """
    truth = read_proportions(spark, truth_path, {"sample": truth_sample}, index_label)
    pred = read_proportions(spark, pred_path, pred_fields, pred_index_label)
    known = pred.join(truth.select("sample").distinct(), "sample", "left_semi")
    wanted = truth.join(pred.select("sample").distinct(), "sample", "left_semi")
    return benchmark_proportions(wanted, known, list(pred_fields), zero_rule_on, strict)
