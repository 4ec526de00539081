"""Assembly of replicate folders into the long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spotweave.functions.scalar import counts_from_log
from spotweave.sources.matrix import path_field, scan_wide


def assemble_replicates(
    spark: SparkSession, base: str, prefix: str = "Wu", index_label: str = "", keep_logged: bool = False
) -> dict[str, DataFrame]:
    """All replicates below ``base`` at once: ``expr``, ``protein``, ``spot``, ``prop``.

    Reads ``ST_sim/<prefix>_ST_<i>_{data,meta,prop}.csv`` and
    ``CITE_sim/<prefix>_CITE_<i>_data.csv``; the number is the sample.
    Expression is turned back from log1p to counts. Truth is joined to spots
    by key and stays NULL where it is missing.
    """
    st, cite = f"{base}/ST_sim/{prefix}_ST_*", f"{base}/CITE_sim/{prefix}_CITE_*"
    number = {"sample": rf"{prefix}_(?:ST|CITE)_(\d+)_"}
    logged = scan_wide(spark, f"{st}_data.csv", "gene", "spot", number, index_label)
    counts = counts_from_log(F.col("value"))
    expr = logged.withColumns({"log_value": F.col("value"), "value": counts}) if keep_logged else (
        logged.withColumn("value", counts)
    )
    protein = scan_wide(spark, f"{cite}_data.csv", "protein", "spot", number, index_label)
    spot = (
        spark.read.option("header", True)
        .csv(f"{st}_meta.csv")
        .select(
            path_field(number["sample"]).alias("sample"),
            "spot",
            F.col("spot_x").cast("double").alias("spot_x"),
            F.col("spot_y").cast("double").alias("spot_y"),
        )
    )
    prop = scan_wide(spark, f"{st}_prop.csv", "spot", "cell_type", number, index_label, keep_zero=True).where(
        ~F.col("cell_type").isin("spot_x", "spot_y")
    )
    prop = spot.join(prop.withColumnRenamed("value", "p"), ["sample", "spot"], "left").drop("spot_x", "spot_y")
    return {"expr": expr.where(F.col("value") != 0), "protein": protein, "spot": spot, "prop": prop}


def assemble_spots(
    expr: DataFrame, protein: DataFrame, spots: DataFrame, prop: DataFrame, types: list[str]
) -> DataFrame:
    """Spot table: coordinates, expression and antibody totals, truth per type."""
    by = ["sample", "spot"]
    genes = expr.groupBy(*by).agg(F.count(F.lit(1)).alias("n_genes"), F.sum("value").alias("expr_total"))
    prots = protein.groupBy(*by).agg(F.count(F.lit(1)).alias("n_proteins"), F.sum("value").alias("protein_total"))
    wide = prop.groupBy(*by).pivot("cell_type", types).agg(F.sum("p"))
    return spots.join(genes, by, "left").join(prots, by, "left").join(wide, by, "left")


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Parquet per table, partitioned by sample; rebalancing splits large samples."""
    for name, df in tables.items():
        df.hint("rebalance", "sample").write.mode("overwrite").partitionBy("sample").parquet(f"{path}/{name}")
