"""Queries on sources and sinks.

Each writes a file layout of the kind it reads into the shared folder, from
the whole driver tables and by Spark, and scans it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spotweave.operators import prop_metrics as pm
from spotweave.plans import inputs as inp
from spotweave.plans.prop_queries import rounded
from spotweave.plans.registry import query
from spotweave.session import scratch_path
from spotweave.sources import matrix, rows as row_files, sinks, text, triplets
from spotweave.sources.assemble import assemble_spots


@query(
    "scan_wide",
    inp.with_sql(inp.PROTEIN_SQL)
    + """SELECT CAST(sample AS VARCHAR) AS sample, CAST(spot AS VARCHAR) AS spot, protein, value FROM protein WHERE value <> 0""",
)
def scan_wide(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "wide")
    matrix.write_wide(inp.protein(spark, sf), path, inp.BRANDS, ["sample"], "spot", "protein", "index")
    return matrix.scan_wide(spark, path + "/*/*.csv", "spot", "protein", {"sample": r"/sample=(\d+)/"}, "index")


@query(
    "scan_rows",
    inp.with_sql(inp.CELLS_SQL)
    + "SELECT spot, cell_type, gene, qty, CAST(sample AS VARCHAR) AS sample FROM cells",
)
def scan_rows(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "rows")
    cells = inp.cells(spark, sf).select("spot", "cell_type", "gene", "qty", "sample")
    cells.write.partitionBy("sample").option("header", True).csv(path)
    return row_files.scan_rows(
        spark, path + "/*/*.csv", "spot bigint, cell_type string, gene bigint, qty double", {"sample": r"/sample=(\d+)/"}
    )


@query(
    "scan_triplets",
    """SELECT CAST(l_suppkey AS VARCHAR) AS cell, p_name || '_' || p_partkey AS gene, CAST(CAST(sum(l_quantity) AS FLOAT) AS DOUBLE) AS value,
       any_value(s_name) AS patient_id, any_value(CAST(s_nationkey AS VARCHAR)) AS cell_type
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
)
def scan_triplets(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_path(spark, "triplets")
    part, sup = inp.table(spark, sf, "part"), inp.table(spark, sf, "supplier")
    part.orderBy("p_partkey").select(
        F.concat_ws("\t", F.concat_ws("_", "p_name", "p_partkey"), F.col("p_brand"))
    ).write.text(f"{folder}/genes.tsv")
    sup.orderBy("s_suppkey").select(F.col("s_suppkey").cast("string")).write.text(f"{folder}/barcodes.tsv")
    sup.select(
        F.col("s_suppkey").alias("cell"),
        F.col("s_name").alias("orig.ident"),
        F.col("s_nationkey").alias("celltype_major"),
        F.lit("ER+").alias("subtype"),
    ).write.option("header", True).csv(f"{folder}/metadata.csv")
    entries = (
        inp.table(spark, sf, "lineitem")
        .groupBy("l_partkey", "l_suppkey")
        .agg(F.sum("l_quantity").alias("v"))
        .select(
            F.lit(2).alias("_o"),
            F.concat_ws(
                " ", (F.col("l_partkey") + 1).cast("string"), (F.col("l_suppkey") + 1).cast("string"), F.col("v").cast("string")
            ).alias("value"),
        )
    )
    sizes = part.agg(F.count(F.lit(1)).alias("g")).select(
        F.concat_ws(" ", F.col("g"), sup.agg(F.count(F.lit(1))).scalar(), F.lit(0))
    )
    head = part.agg(F.count(F.lit(1)).alias("g")).select(
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("_o"), F.lit("%%MatrixMarket matrix coordinate real general").alias("value")),
                F.struct(F.lit(1).alias("_o"), sizes.scalar().alias("value")),
            )
        )
    )
    # ranges on (part of the file, line): the head comes first, entries are split evenly
    head.unionByName(entries).orderBy("_o", "value").select("value").write.text(f"{folder}/matrix.mtx")
    expr, meta = triplets.scan_triplets(spark, folder)
    return expr.join(meta.select("cell", "patient_id", "cell_type"), "cell")


METRIC_FILE = "JSD double, Sum_RMSE double, Sum_MAE double, corr double"


@query(
    "scan_filename_fields",
    inp.METRIC_SQL
    + """SELECT method, CAST(sample AS VARCHAR) AS replicate, 'high_seg' AS pattern, jsd AS "JSD", round(sum_rmse, 8) AS "Sum_RMSE"
FROM (SELECT method, sample, round(jsd, 8) AS jsd, sum_rmse FROM metrics)""",
)
def scan_filename_fields(spark: SparkSession, sf: str) -> DataFrame:
    from spotweave.plans.prop_queries import metrics

    base = scratch_path(spark, "high_seg")
    wide = metrics(spark, sf).withColumn(
        "run", F.concat(F.lit("Prop_metrics_"), "method", F.lit("_map_"), F.col("sample").cast("string"))
    )
    wide.select(
        "run", F.col("jsd").alias("JSD"), F.col("sum_rmse").alias("Sum_RMSE"), F.col("sum_mae").alias("Sum_MAE"), "corr"
    ).write.partitionBy("run").option("header", True).csv(base)
    fields = {
        "method": r"Prop_metrics_([A-Za-z0-9]+)_map_",
        "replicate": r"(?<=_map_)(\d+)",
        "pattern": r"/(high_seg|mixed)/",
    }
    out = row_files.scan_rows(spark, base + "/*/*.csv", METRIC_FILE, fields)
    return rounded(out.select("method", "replicate", "pattern", "JSD", "Sum_RMSE"), "JSD", "Sum_RMSE")


@query(
    "sweep_params",
    """SELECT o_orderkey, round(o_totalprice / 100000, 3) AS lam, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS alpha
FROM orders WHERE o_orderstatus <> 'P'""",
)
def sweep_params(spark: SparkSession, sf: str) -> DataFrame:
    """Run directories named from the orders; some names do not parse and are dropped."""
    lam = F.when(F.col("o_orderstatus") == "P", F.lit("none")).otherwise(
        F.round(F.col("o_totalprice") / 100000, 3).cast("string")
    )
    name = F.concat(
        F.lit("results/radius_4.0_lambda_"), lam, F.lit("_alpha_"),
        ((F.col("o_orderkey") % 10) / 10).cast("string"), F.lit("_max_y_change_0.2./summary.csv"),
    )
    runs = inp.table(spark, sf, "orders").select("o_orderkey", name.alias("path"))
    out = row_files.sweep_params(runs, F.col("path"), {"lam": "lambda_", "alpha": "alpha_"})
    return out.drop("path")


@query(
    "dict_metrics",
    inp.PROP_SQL
    + """, n AS (SELECT method, sample, count(DISTINCT spot) AS n FROM pairs GROUP BY 1, 2)
SELECT method, sample, cell_type, round(sqrt(sum((t - q) ** 2) / max(n)), 8) AS rmse, round(sum(abs(t - q)) / max(n), 8) AS mae
FROM pairs JOIN n USING (method, sample) GROUP BY 1, 2, 3""",
)
def dict_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Per-type metrics written as dictionary text and read back."""
    counted = inp.counts(spark, sf)
    by_type = pm.prop_by_type(pm.pair_rows(inp.truth(counted), inp.predictions(counted)))
    maps = by_type.groupBy("method", "sample").agg(
        *[
            text.to_dict_text(F.map_from_entries(F.collect_list(F.struct("cell_type", c)))).alias(c.upper())
            for c in ("rmse", "mae")
        ]
    )
    path = scratch_path(spark, "dicts")
    maps.write.option("header", True).csv(path)
    back = row_files.scan_rows(spark, path, "method string, sample bigint, RMSE string, MAE string")
    return rounded(text.dict_metrics(back, ["method", "sample"]), "rmse", "mae")


@query(
    "runtime_parse",
    """SELECT event_type AS method, CASE WHEN value >= 20 THEN CAST(user_id % 5 AS INTEGER) END AS replicate,
       CASE WHEN value >= 20 THEN round(value, 2) END AS seconds FROM events""",
)
def runtime_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines of all events; those of small values say something else."""
    ev = inp.table(spark, sf, "events")
    line = F.when(
        F.col("value") >= 20,
        F.concat(
            F.lit("2024-01-01 INFO Replicate "), (F.col("user_id") % 5).cast("string"), F.lit(" took "),
            F.format_string("%.2f", F.col("value")), F.lit(" seconds ("),
            F.format_string("%.2f", F.col("value") / 60), F.lit(" minutes)"),
        ),
    ).otherwise("starting")
    path = scratch_path(spark, "logs")
    ev.select(F.col("event_type").alias("method"), line.alias("value")).write.partitionBy("method").text(path)
    return text.scan_run_logs(spark, path + "/*", r"/method=([^/]+)/")


TYPE_COLS = ", ".join(f"round(sum(p) FILTER (cell_type = '{t}'), 8) AS \"{t}\"" for t in inp.TYPES)


@query(
    "assemble_replicate",
    inp.with_sql(inp.CELLS_SQL, inp.TRUTH_SQL, inp.EXPR_SQL, inp.PROTEIN_SQL, inp.SPOTS_SQL)
    + f""", e AS (SELECT sample, spot, count(*) AS n_genes, sum(round_even(exp(ln(1 + value)) - 1, 0)) AS expr_total FROM expr GROUP BY 1, 2),
a AS (SELECT sample, spot, count(*) AS n_proteins, sum(value) AS protein_total FROM protein GROUP BY 1, 2),
t AS (SELECT sample, spot, {TYPE_COLS} FROM truth GROUP BY 1, 2)
SELECT * FROM spots LEFT JOIN e USING (sample, spot) LEFT JOIN a USING (sample, spot) LEFT JOIN t USING (sample, spot)""",
)
def assemble_replicate(spark: SparkSession, sf: str) -> DataFrame:
    from spotweave.functions.scalar import counts_from_log

    logged = inp.expr(spark, sf).withColumn("value", F.log1p("value"))
    expr = logged.withColumn("value", counts_from_log(F.col("value")))
    prop = inp.truth(inp.counts(spark, sf))
    out = assemble_spots(expr, inp.protein(spark, sf), inp.spots(spark, sf), prop, inp.TYPES)
    return rounded(out, *inp.TYPES)


@query(
    "layer_sink",
    inp.with_sql(inp.CELLS_SQL, inp.LAYERS_SQL)
    + "SELECT sample, replace(cell_type, ' ', '_') AS cell_type, spot, gene, value FROM layers_truth",
)
def layer_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "layers")
    layers = inp.layers_truth(inp.cells(spark, sf))
    sinks.write_layers(layers, path)
    return spark.read.schema(layers.schema).parquet(path)


@query(
    "wide_layer_sink",
    inp.with_sql(inp.CELLS_SQL, inp.LAYERS_SQL)
    + """SELECT CAST(sample AS VARCHAR) AS sample, replace(cell_type, ' ', '_') AS cell_type, CAST(spot AS VARCHAR) AS spot,
       CAST(gene AS VARCHAR) AS gene, value FROM layers_truth WHERE value <> 0""",
)
def wide_layer_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Spot x gene files for each sample and cell type, all parts as columns, written and scanned again."""
    path = scratch_path(spark, "wide_layers")
    sinks.write_wide_layers(inp.layers_truth(inp.cells(spark, sf)), path, inp.table(spark, sf, "part").select("p_partkey"))
    fields = {"sample": r"/sample=(\d+)/", "cell_type": r"/cell_type=([^/]+)/"}
    return matrix.scan_wide(spark, path + "/*/*", "spot", "gene", fields, "spot")


@query(
    "metric_sink",
    inp.METRIC_LONG_SQL + "SELECT method, sample, metric, round(value, 8) AS value FROM metric_rows",
)
def metric_sink(spark: SparkSession, sf: str) -> DataFrame:
    from spotweave.plans.prop_queries import metrics

    path = scratch_path(spark, "metrics")
    sinks.write_metrics(inp.metric_rows(metrics(spark, sf)), path)
    back = row_files.scan_rows(spark, path, "method string, sample bigint, metric string, value double")
    return rounded(back, "value")


@query(
    "resume_pending",
    """WITH c AS (SELECT l_returnflag AS run_id, l_orderkey % 5 AS sample, l_suppkey AS spot, sum(l_quantity) AS total
  FROM lineitem GROUP BY 1, 2, 3)
SELECT run_id, sample, spot, total, CASE run_id WHEN 'A' THEN 1 ELSE 2 END AS attempt FROM c""",
)
def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    """A first call finishes the runs of one flag; the second one does only the rest."""
    path = scratch_path(spark, "stage")
    lines = inp.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("run_id"), (F.col("l_orderkey") % 5).alias("sample"),
        F.col("l_suppkey").alias("spot"), "l_quantity",
    )

    def step(attempt):
        return lambda df: df.groupBy("run_id", "sample", "spot").agg(
            F.sum("l_quantity").alias("total"), F.lit(attempt).alias("attempt")
        )

    sinks.run_stage(lines.where(F.col("run_id") == "A"), step(1), path)
    return sinks.run_stage(lines, step(2), path)
