"""The long tables of the library derived from the driver tables.

Line items stand for cells: spot = supplier, gene = part, antibody = brand,
cell type = order priority, replicate = order key modulo 5. ``*_SQL`` holds the
same derivations as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spotweave.operators.composition import spot_prop
from spotweave.session import dealt, stored

# fixed values: the cell types, antibodies and neighbourhood radius of the derived data
TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
BRANDS = sorted(f"Brand#{i}" for i in range(1, 26))
RADIUS = 2.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def profile() -> dict[str, dict[str, list[str]]]:
    """Marker profile: sorted brands dealt to the types in turn."""
    return {t: {"Major": BRANDS[i :: len(TYPES)]} for i, t in enumerate(TYPES)}


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """One row per cell: sample, spot, cell_type, gene, qty and its line flags."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_linenumber", "l_returnflag"
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    n = li.count()
    li, orders = dealt(li, n, "l_orderkey"), dealt(orders, n, "o_orderkey")
    return li.join(orders, li.l_orderkey == orders.o_orderkey).select(
        (F.col("l_orderkey") % 5).alias("sample"),
        F.col("l_suppkey").alias("spot"),
        F.col("o_orderpriority").alias("cell_type"),
        F.col("l_partkey").alias("gene"),
        F.col("l_quantity").alias("qty"),
        (((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "R"))).alias("restricted"),
    )


CELLS_SQL = """cells AS (
  SELECT l_orderkey % 5 AS sample, l_suppkey AS spot, o_orderpriority AS cell_type, l_partkey AS gene,
         l_quantity AS qty, (l_linenumber = 1 AND l_returnflag = 'R') AS restricted
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def expr(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 5).alias("sample"), F.col("l_suppkey").alias("spot"), F.col("l_partkey").alias("gene"), "l_quantity"
    )
    return (
        # so a grouping by gene needs no further shuffle
        dealt(li, li.count(), "sample", "gene")
        .groupBy("sample", "spot", "gene")
        .agg(F.sum("l_quantity").alias("value"))
        # stated here so that every use of the table has the same filters and shares one exchange
        .where(F.col("sample").isNotNull() & F.col("spot").isNotNull() & F.col("gene").isNotNull())
    )


def expr_table(spark: SparkSession, sf: str) -> DataFrame:
    """The same, stored: for queries that pass over it more than once."""
    return stored(expr(spark, sf), "expr")


EXPR_SQL = """expr AS (
  SELECT l_orderkey % 5 AS sample, l_suppkey AS spot, l_partkey AS gene, sum(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2, 3)"""


def protein(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return (
        li.join(part, li.l_partkey == part.p_partkey)
        .groupBy((F.col("l_orderkey") % 5).alias("sample"), F.col("l_suppkey").alias("spot"), F.col("p_brand").alias("protein"))
        .agg(F.sum("l_quantity").alias("value"))
    )


def protein_table(spark: SparkSession, sf: str) -> DataFrame:
    return stored(protein(spark, sf), "protein")


PROTEIN_SQL = """protein AS (
  SELECT l_orderkey % 5 AS sample, l_suppkey AS spot, p_brand AS protein, sum(l_quantity) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""


def spots(spark: SparkSession, sf: str) -> DataFrame:
    """Every supplier as a spot of each of the five samples, on a grid ten wide."""
    return table(spark, sf, "supplier").select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("sample"),
        F.col("s_suppkey").alias("spot"),
        (F.col("s_suppkey") % 10).cast("double").alias("spot_x"),
        F.floor(F.col("s_suppkey") / 10).cast("double").alias("spot_y"),
    )


SPOTS_SQL = """spots AS (
  SELECT sample, s_suppkey AS spot, CAST(s_suppkey % 10 AS DOUBLE) AS spot_x,
         CAST(s_suppkey // 10 AS DOUBLE) AS spot_y
  FROM supplier, (SELECT CAST(unnest(range(5)) AS BIGINT) AS sample))"""


def proteins(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_brand").alias("protein")).distinct()


def counts(spark: SparkSession, sf: str) -> DataFrame:
    """Cells, quantity and restricted cells per (sample, spot, cell_type), stored.

    One pass over the line items; truth and predictions both come from it.
    """
    return stored(
        cells(spark, sf)
        .groupBy("sample", "spot", "cell_type")
        .agg(
            F.count(F.lit(1)).cast("double").alias("cells"),
            F.sum("qty").alias("quantity"),
            F.count_if("restricted").cast("double").alias("restricted"),
        ),
        "counts",
    )


def truth(counted: DataFrame) -> DataFrame:
    return spot_prop(counted, weight="cells")


TRUTH_SQL = """counted AS (SELECT sample, spot, cell_type, CAST(count(*) AS DOUBLE) AS n FROM cells GROUP BY 1, 2, 3),
truth AS (SELECT sample, spot, cell_type, n / sum(n) OVER (PARTITION BY sample, spot) AS p FROM counted)"""


def predictions(counted: DataFrame) -> DataFrame:
    """Two methods: share of the quantity, and share among first returned lines.

    The second one has gaps.
    """
    long = counted.unpivot(["sample", "spot", "cell_type"], ["quantity", "restricted"], "method", "n")
    return spot_prop(long.where(F.col("n") > 0), ("method", "sample", "spot"), "n")


PRED_SQL = """pred_counts AS (
  SELECT 'quantity' AS method, sample, spot, cell_type, sum(qty) AS n FROM cells GROUP BY 2, 3, 4
  UNION ALL
  SELECT 'restricted', sample, spot, cell_type, CAST(count(*) AS DOUBLE) FROM cells WHERE restricted GROUP BY 2, 3, 4),
pred AS (SELECT method, sample, spot, cell_type,
                n / sum(n) OVER (PARTITION BY method, sample, spot) AS p FROM pred_counts)"""

# truth t and prediction q of every (method, sample, spot, cell_type) with a row on either side
PAIRS_SQL = """runs AS (SELECT DISTINCT method, sample FROM pred),
pairs AS (
  SELECT method, sample, spot, cell_type, coalesce(t.p, 0) AS t, coalesce(pred.p, 0) AS q
  FROM (SELECT * FROM truth JOIN runs USING (sample)) t
  FULL JOIN pred USING (method, sample, spot, cell_type))"""

JSD_SQL = """scaled AS (
  SELECT *, sum(t) OVER w AS st, sum(q) OVER w AS sq FROM pairs WINDOW w AS (PARTITION BY method, sample, spot)),
terms AS (
  SELECT method, sample, spot, st, sq, t / nullif(st, 0) AS a, q / nullif(sq, 0) AS b FROM scaled),
jsd AS (
  SELECT method, sample, spot,
    CASE WHEN max(sq) = 0 THEN 1.0 WHEN max(st) = 0 THEN 'nan'::DOUBLE ELSE sqrt(greatest(0, sum(
      (CASE WHEN a > 0 THEN a * log2(2 * a / (a + b)) ELSE 0 END
     + CASE WHEN b > 0 THEN b * log2(2 * b / (a + b)) ELSE 0 END) / 2))) END AS jsd
  FROM terms GROUP BY 1, 2, 3)"""

METRICS_SQL = """sized AS (
  SELECT method, sample, count(DISTINCT spot) AS n_spots, count(DISTINCT cell_type) AS n_types,
         count(DISTINCT spot) * count(DISTINCT cell_type) AS n,
         sum((t - q) ** 2) AS dd, sum(abs(t - q)) AS d, sum(t) AS t, sum(q) AS q,
         sum(t * t) AS tt, sum(q * q) AS qq, sum(t * q) AS tq
  FROM pairs GROUP BY 1, 2),
global AS (
  SELECT method, sample, n_spots, n_types, sqrt(dd / n) AS sum_rmse, d / n AS sum_mae,
         (tq - t * q / n) / sqrt((tt - t * t / n) * (qq - q * q / n)) AS corr
  FROM sized),
metrics AS (
  SELECT method, sample, n_spots, n_types, sum_rmse, sum_mae, corr, j.jsd
  FROM global JOIN (SELECT method, sample, quantile_cont(jsd, 0.5) AS jsd FROM jsd GROUP BY 1, 2) j
  USING (method, sample))"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


PROP_SQL = with_sql(CELLS_SQL, TRUTH_SQL, PRED_SQL, PAIRS_SQL)
METRIC_SQL = with_sql(CELLS_SQL, TRUTH_SQL, PRED_SQL, PAIRS_SQL, JSD_SQL, METRICS_SQL)


def metric_rows(metrics: DataFrame) -> DataFrame:
    """Long metric table of the wide one."""
    return metrics.unpivot(["method", "sample"], ["jsd", "sum_rmse", "sum_mae", "corr"], "metric", "value")


METRIC_ROWS_SQL = """metric_rows AS (
  SELECT method, sample, 'jsd' AS metric, jsd AS value FROM metrics
  UNION ALL SELECT method, sample, 'sum_rmse', sum_rmse FROM metrics
  UNION ALL SELECT method, sample, 'sum_mae', sum_mae FROM metrics
  UNION ALL SELECT method, sample, 'corr', corr FROM metrics)"""

METRIC_LONG_SQL = with_sql(CELLS_SQL, TRUTH_SQL, PRED_SQL, PAIRS_SQL, JSD_SQL, METRICS_SQL, METRIC_ROWS_SQL)


def layers_truth(cell_rows: DataFrame) -> DataFrame:
    return cell_rows.groupBy("sample", "cell_type", "spot", "gene").agg(F.sum("qty").alias("value"))


LAYERS_SQL = """layers_truth AS (
  SELECT sample, cell_type, spot, gene, sum(qty) AS value FROM cells GROUP BY 1, 2, 3, 4)"""
