"""Sparse triplet folders: matrix, gene names, barcodes and cell metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from spotweave.operators.sampling import uniform_sample
from spotweave.session import stored


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their number from 1, over all files in name order.

    Row ids grow within a file block, so a line's number is its rank in the
    block plus the lines of earlier blocks. Only the table of blocks is
    ordered as a whole.
    """
    lines = _lines(spark, path)
    blocks = lines.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = W.partitionBy(F.lit(0)).orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return lines.join(starts, ["_file", "_block"]).select(
        (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line"), "value"
    )


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """Triplets without comments and without the size line after them."""
    data = _lines(spark, path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size_line = data.agg(F.min(F.struct("_file", "_block", "_id")).alias("m"))
    parts = F.split(F.trim("value"), "\\s+")
    return (
        data.withColumn("_size", size_line.scalar())
        .where(F.struct("_file", "_block", "_id") != F.col("_size"))
        .select(
            parts[0].cast("bigint").alias("_gene"),
            parts[1].cast("bigint").alias("_cell"),
            F.coalesce(F.get(parts, F.lit(2)).cast("float"), F.lit(1.0).cast("float")).cast("double").alias("value"),
        )
    )


def scan_triplets(
    spark: SparkSession, folder: str, sample_cells: int | None = None, seed: int = 412
) -> tuple[DataFrame, DataFrame]:
    """(cell expression, cell metadata) of a triplet folder.

    Values pass through 32-bit floats. ``sample_cells`` keeps that many
    random cells (test mode).
    """
    # stored: the matrix is shuffled by gene or cell only if the names are too many to broadcast
    genes = stored(
        numbered_lines(spark, f"{folder}/genes.tsv").select(
            F.col("line").alias("_gene"), F.split("value", "\t")[0].alias("gene")
        ),
        "genes",
    )
    cells = stored(
        numbered_lines(spark, f"{folder}/barcodes.tsv").select(F.col("line").alias("_cell"), F.col("value").alias("cell")),
        "barcodes",
    )
    meta = (
        spark.read.option("header", True)
        .csv(f"{folder}/metadata.csv")
        .withColumnRenamed("_c0", "cell")
        .select(
            "cell",
            F.col("`orig.ident`").alias("patient_id"),
            F.col("celltype_major").alias("cell_type"),
            "subtype",
            F.lit("Cancer").alias("tissue"),
        )
    )
    if sample_cells is not None:
        cells = stored(uniform_sample(cells, sample_cells, ["cell"], seed), "sampled_cells")
    expr = (
        _entries(spark, f"{folder}/matrix.mtx").join(cells, "_cell").join(genes, "_gene").select("cell", "gene", "value")
    )
    return expr, cells.select("cell").join(meta, "cell", "left")
