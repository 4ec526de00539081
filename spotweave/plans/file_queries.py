"""Whole benchmarks from files, as they are run on the results of other tools.

Each writes the folders of a benchmark from the whole driver tables, by Spark,
and scores, assembles or summarises what it reads back from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spotweave.benchmark import benchmark_layer_files, benchmark_proportion_files
from spotweave.operators import reshape, sampling, summary
from spotweave.plans import inputs as inp
from spotweave.plans.prop_queries import SCORED_SQL, metrics, rounded, scored_rows
from spotweave.plans.registry import query
from spotweave.session import dealt, scratch_path, stored
from spotweave.sources import matrix, rows as row_files
from spotweave.sources.assemble import assemble_replicates, assemble_spots

SAMPLE = r"/sample=(\d+)/"
SHARED_BRANDS = inp.BRANDS[1:-1]
TYPES_SQL = "types AS (SELECT unnest([" + ", ".join(f"'{t}'" for t in inp.TYPES) + "]) AS cell_type)"

# layers -----------------------------------------------------------------------------------------------------

LAYER_FILES_SQL = inp.with_sql(
    inp.CELLS_SQL,
    inp.TRUTH_SQL,
    inp.PROTEIN_SQL,
    TYPES_SQL,
    """truth_layers AS (
  SELECT sample, cell_type, spot, p_brand AS gene, sum(qty) AS value FROM cells JOIN part ON gene = p_partkey GROUP BY ALL),
tool_layers AS (
  SELECT 'weighted' AS method, sample, cell_type, spot, protein AS gene, value * p AS value FROM protein JOIN truth USING (sample, spot)
  UNION ALL SELECT 'flat', sample, cell_type, spot, protein, value / 5 FROM protein, types),
met AS (
  SELECT method, sample, cell_type, spot FROM (SELECT DISTINCT method, sample, cell_type, spot FROM tool_layers)
  JOIN (SELECT DISTINCT sample, cell_type, spot FROM truth_layers) USING (sample, cell_type, spot)),"""
    + f"""
sizes AS (SELECT method, sample, cell_type, count(*) * {len(SHARED_BRANDS)} AS n FROM met GROUP BY ALL),
sides AS (
  SELECT method, sample, cell_type, spot, gene, ln(1 + value) AS q, 0::DOUBLE AS t FROM tool_layers
  UNION ALL
  SELECT method, sample, cell_type, spot, gene, 0, ln(1 + value) FROM truth_layers, (SELECT unnest(['weighted', 'flat']) AS method)),
cells_met AS (
  SELECT method, sample, cell_type, spot, gene, sum(q) AS q, sum(t) AS t FROM sides SEMI JOIN met USING (method, sample, cell_type, spot)
  WHERE gene IN ({", ".join(f"'{b}'" for b in SHARED_BRANDS)}) GROUP BY ALL),
layer_scores AS (
  SELECT method, CAST(sample AS VARCHAR) AS sample, replace(cell_type, ' ', '_') AS cell_type,
         sqrt(sum((t - q) ** 2) / any_value(n)) AS rmse, sum(abs(t - q)) / any_value(n) AS mae,
         sqrt(sum((t - q) ** 2) / any_value(n)) / (max(t) - CASE WHEN count(*) < any_value(n) THEN least(min(t), 0) ELSE min(t) END) AS nrmse
  FROM cells_met JOIN sizes USING (method, sample, cell_type) GROUP BY ALL)""",
)


def _by_brand(long: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """A row for each of the ``keys`` with its quantities by brand; long rows are moved once, before they are summed up in wide ones."""
    sums = [F.sum(F.when(F.col("gene") == b, F.col("value"))) for b in inp.BRANDS]
    placed = dealt(long, rows, *keys)
    placed = long.repartition(*keys) if placed is long else placed
    return placed.groupBy(*keys).agg(F.array(*sums).alias("value"))


def _layer_files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Scores of two tools: files of truth have spaces in their names and lack the first gene, those of the tools have underscores and lack the last."""
    base = scratch_path(spark, "layer_files")
    cells = inp.cells(spark, sf)
    brand = inp.table(spark, sf, "part").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("brand"))
    lines = inp.table(spark, sf, "lineitem").count()
    cells = cells.join(brand, "gene").select("sample", "cell_type", "spot", F.col("brand").alias("gene"), F.col("qty").alias("value"))
    # a line of a layer is made once, with all its genes, and read by cell type for the five files of each
    truth_path = scratch_path(spark, "truth_layers")
    truth = _by_brand(cells, ["sample", "cell_type", "spot"], lines)
    truth.write.partitionBy("cell_type").parquet(truth_path)
    truth = spark.read.schema(truth.schema).parquet(truth_path)
    protein = inp.protein(spark, sf).withColumnRenamed("protein", "gene")
    shares = [F.sum(F.when(F.col("cell_type") == t, F.col("p"))) for t in inp.TYPES]
    prop = inp.truth(inp.counts(spark, sf)).groupBy("sample", "spot").agg(F.array(*shares).alias("p"))
    spots = stored(_by_brand(protein, ["sample", "spot"], lines).join(prop, ["sample", "spot"], "left"), "spot_lines")

    def write(rows: DataFrame, path: str, first: int) -> None:
        chosen = rows.select("sample", "spot", F.slice("value", first + 1, len(inp.BRANDS) - 1).alias("value"))
        matrix.write_wide(chosen, path, inp.BRANDS[first:][: len(inp.BRANDS) - 1], ["sample"], "spot", None, "spot")

    # a folder for each cell type, as tools write them: five of each
    for i, t in enumerate(inp.TYPES):
        share = F.get("p", F.lit(i))
        weighted = spots.where(share.isNotNull()).withColumn("value", F.transform("value", lambda v: v * share))
        flat = spots.withColumn("value", F.transform("value", lambda v: v / len(inp.TYPES)))
        write(truth.where(F.col("cell_type") == t), f"{base}/truth/{t}_GT.csv", 1)
        for name, rows in (("weighted", weighted), ("flat", flat)):
            write(rows, f"{base}/{name}_map/{t.replace(' ', '_')}_layer_pass1.csv", 0)
    return benchmark_layer_files(
        spark, f"{base}/truth/*_GT.csv/*/*.csv", f"{base}/*_map/*.csv/*/*.csv", SAMPLE, SAMPLE,
        fields={"method": r"/([a-z]+)_map/"}, index_label="spot",
    )


@query(
    "layer_file_metrics",
    LAYER_FILES_SQL + "SELECT method, sample, cell_type, round(rmse, 8) AS rmse, round(nrmse, 8) AS nrmse, round(mae, 8) AS mae FROM layer_scores",
)
def layer_file_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_layer_files(spark, sf)[0], "rmse", "nrmse", "mae")


@query(
    "layer_file_averages",
    LAYER_FILES_SQL
    + " UNION ALL ".join(f"SELECT method, sample, 'Average {m.upper()}' AS metric, round(avg({m}), 8) AS value FROM layer_scores GROUP BY 1, 2" for m in ("rmse", "nrmse", "mae")),
)
def layer_file_averages(spark: SparkSession, sf: str) -> DataFrame:
    """Of the averages and medians over types, those whose name begins with Average."""
    return rounded(reshape.average_metrics(_layer_files(spark, sf)[1]), "value")


# proportions ------------------------------------------------------------------------------------------------

PROP_FILES_SQL = inp.with_sql(
    inp.CELLS_SQL,
    inp.TRUTH_SQL,
    TYPES_SQL,
    """quantities AS (SELECT sample, spot, cell_type, sum(qty) AS n FROM cells GROUP BY ALL),
pred AS (
  SELECT 'quantity' AS method, sample, spot, cell_type, n / sum(n) OVER (PARTITION BY sample, spot) AS p FROM quantities
  UNION ALL SELECT 'fixed', sample, spot, cell_type, (ascii(cell_type) - 48) / 15 FROM (SELECT DISTINCT sample, spot FROM truth), types)""",
    inp.PAIRS_SQL,
    inp.JSD_SQL,
    inp.METRICS_SQL,
    """by_type AS (
  SELECT method, sample, cell_type, sqrt(sum((pairs.t - pairs.q) ** 2) / any_value(n_spots)) AS rmse, sum(abs(pairs.t - pairs.q)) / any_value(n_spots) AS mae
  FROM pairs JOIN sized USING (method, sample) GROUP BY ALL)""",
)


@query("prop_file_metrics", PROP_FILES_SQL + SCORED_SQL.format("CAST(sample AS VARCHAR)"))
def prop_file_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Strict scores of two tools from wide files; the truth has coordinates as its last columns, which are no cell types."""
    base = scratch_path(spark, "prop_files")
    counted = inp.counts(spark, sf)
    truth = inp.truth(counted)
    places = inp.spots(spark, sf).join(truth.select("sample", "spot").distinct(), ["sample", "spot"], "left_semi")
    coordinates = places.unpivot(["sample", "spot"], ["spot_x", "spot_y"], "cell_type", "p")
    with_places = truth.select("sample", "spot", "cell_type", "p").unionByName(coordinates).withColumnRenamed("p", "value")
    matrix.write_wide(with_places, f"{base}/ST_prop.csv", [*inp.TYPES, "spot_x", "spot_y"], ["sample"], "spot", "cell_type", "spot")
    even = truth.select("sample", "spot").distinct().withColumn("cell_type", F.explode(F.array(*[F.lit(t) for t in inp.TYPES])))
    tools = {
        "quantity": inp.predictions(counted).where(F.col("method") == "quantity").withColumnRenamed("p", "value"),
        # the same shares in every spot: the types are numbered 1 to 5
        "fixed": even.withColumn("value", (F.ascii("cell_type") - 48) / 15),
    }
    for name, prop in tools.items():
        # another order of the columns than that of the truth
        matrix.write_wide(prop, f"{base}/{name}_map.csv", inp.TYPES[::-1], ["sample"], "spot", "cell_type", "spot")
    scores = benchmark_proportion_files(
        spark, f"{base}/ST_prop.csv/*/*.csv", f"{base}/*_map.csv/*/*.csv", SAMPLE,
        {"sample": SAMPLE, "method": r"/([a-z]+)_map\.csv/"}, index_label="spot", pred_index_label="spot",
    )
    return scored_rows(scores)


# replicate folders ------------------------------------------------------------------------------------------

TYPE_SHARES = ", ".join(f"sum(CASE WHEN cell_type = '{t}' THEN p ELSE 0 END) AS t{i}" for i, t in enumerate(inp.TYPES))


@query(
    "assemble_folders",
    inp.with_sql(inp.CELLS_SQL, inp.TRUTH_SQL, inp.EXPR_SQL, inp.PROTEIN_SQL, inp.SPOTS_SQL)
    + f""", e AS (SELECT sample, spot, count(*) AS n_genes, sum(round_even(value, 0)) AS expr_total FROM expr WHERE round_even(value, 0) <> 0 GROUP BY 1, 2),
a AS (SELECT sample, spot, count(*) AS n_proteins, sum(value) AS protein_total FROM protein GROUP BY 1, 2),
t AS (SELECT sample, spot, {TYPE_SHARES} FROM truth GROUP BY 1, 2)
SELECT CAST(sample AS VARCHAR) AS sample, CAST(spot AS VARCHAR) AS spot, spot_x, spot_y, n_genes, expr_total, n_proteins, protein_total,
       {", ".join(f'round(t{i}, 8) AS "{t}"' for i, t in enumerate(inp.TYPES))}
FROM spots LEFT JOIN e USING (sample, spot) LEFT JOIN a USING (sample, spot) LEFT JOIN t USING (sample, spot)""",
)
def assemble_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Replicates written as folders of logged expression, antibodies, coordinates and shares, and assembled from all of them at once."""
    base = scratch_path(spark, "replicates")
    expr = inp.expr_table(spark, sf).withColumn("value", F.log1p("value"))
    protein, spots, prop = inp.protein_table(spark, sf), inp.spots(spark, sf), inp.truth(inp.counts(spark, sf))
    names = inp.table(spark, sf, "supplier").select("s_suppkey")
    for i in range(5):
        here = F.col("sample") == i
        st, cite = f"{base}/ST_sim/Wu_ST_{i}", f"{base}/CITE_sim/Wu_CITE_{i}"
        matrix.write_wide(expr.where(here), f"{st}_data.csv", names, [], "gene", "spot", "")
        matrix.write_wide(protein.where(here), f"{cite}_data.csv", names, [], "protein", "spot", "")
        matrix.write_wide(prop.where(here).withColumnRenamed("p", "value"), f"{st}_prop.csv", inp.TYPES, [], "spot", "cell_type", "")
        spots.where(here).select("spot", "spot_x", "spot_y").write.option("header", True).csv(f"{st}_meta.csv")
    tables = assemble_replicates(spark, base)
    out = assemble_spots(tables["expr"], tables["protein"], tables["spot"], tables["prop"], inp.TYPES)
    return rounded(out, *inp.TYPES)


# sweeps -----------------------------------------------------------------------------------------------------


@query(
    "sweep_files",
    inp.METRIC_LONG_SQL.rstrip()
    + """, points AS (SELECT * FROM (SELECT unnest([0.001, 1.0])::DOUBLE AS lam), (SELECT unnest([0.1, 0.7])::DOUBLE AS alpha)),
scored AS (SELECT lam, alpha, metric, value * (1 + lam * alpha) AS value FROM metric_rows, points)
SELECT lam, alpha, metric, round(avg(value), 8) AS mean, round(stddev_pop(value), 8) AS sd FROM scored GROUP BY ALL""",
)
def sweep_files(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of a grid of parameter points in folders named by them, read at once and summarised by point."""
    base = scratch_path(spark, "sweep")
    grid = sampling.sweep_grid(inp.metric_rows(metrics(spark, sf)), lam=[0.001, 1.0], alpha=[0.1, 0.7])
    name = F.concat(F.lit("radius_4.0_lambda_"), F.col("lam").cast("string"), F.lit("_alpha_"), F.col("alpha").cast("string"), F.lit("_max_y_change_0.2"))
    scored = grid.select(name.alias("run"), "method", "sample", "metric", (F.col("value") * (1 + F.col("lam") * F.col("alpha"))).alias("value"))
    scored.write.partitionBy("run").option("header", True).csv(base)
    rows = row_files.scan_rows(spark, base + "/*/*.csv", "method string, sample bigint, metric string, value double", {"run": r"/run=([^/]+)/"})
    found = row_files.sweep_params(rows, F.col("run"), {"lam": "lambda_", "alpha": "alpha_"})
    return rounded(summary.sweep_summary(found, ["lam", "alpha"]).drop("label"), "mean", "sd")
