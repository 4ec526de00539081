"""Layer and metric sinks, and stage outputs that can be resumed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from spotweave.functions.scalar import underscored


def write_layers(layers: DataFrame, path: str, upper_genes: bool = False, mode: str = "overwrite") -> None:
    """Long layers in folders by sample and cell type.

    Folder names have underscores for spaces. Rebalancing gathers small
    folders and lets Spark split a large one over many tasks.
    """
    out = layers.withColumn("cell_type", underscored(F.col("cell_type")))
    if upper_genes:
        out = out.withColumn("gene", F.upper("gene"))
    out.hint("rebalance", "sample", "cell_type").write.mode(mode).partitionBy("sample", "cell_type").parquet(path)


def write_wide_layers(layers: DataFrame, path: str, genes: Sequence[str] | DataFrame) -> None:
    """Spot x gene CSV files per (sample, type), for tools that need them; many genes are dealt to files with some of them each."""
    from spotweave.sources.matrix import write_wide

    named = layers.withColumn("cell_type", underscored(F.col("cell_type")))
    write_wide(named, path, genes, ("sample", "cell_type"), "spot", "gene", "spot")


def write_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    metrics.write.mode(mode).option("header", True).csv(path)


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def pending(inputs: DataFrame, done: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Input rows of runs that have no finished mark."""
    return inputs if done is None else inputs.join(done, list(keys), "left_anti")


def run_stage(
    inputs: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    path: str,
    keys: Sequence[str] = ("run_id", "sample"),
    rerun: bool = False,
) -> DataFrame:
    """Run ``step`` for the runs that are not finished, and return all results.

    A run is marked after its rows are written. Rows left by a broken attempt
    carry no mark and their folders are replaced when the run is repeated.
    ``step`` must keep the key columns.
    """
    spark = inputs.sparkSession
    marks = f"{path}/finished"
    rows = f"{path}/rows"
    done = None if rerun else _read_or_none(spark, marks)
    todo = pending(inputs, done, keys)
    runs = todo.select(*keys).distinct()
    result = step(todo)
    if not runs.isEmpty():
        (
            result.hint("rebalance", *keys)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*keys)
            .parquet(rows)
        )
        runs.write.mode("overwrite" if rerun else "append").parquet(marks)
    elif _read_or_none(spark, marks) is None:
        return result
    # the known schema keeps keys like "00" text when they come back from folder names
    return spark.read.schema(result.schema).parquet(rows).join(spark.read.parquet(marks), list(keys), "left_semi")
