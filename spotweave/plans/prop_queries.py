"""Queries on proportions: truth, alignment and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spotweave.operators import composition, joins, prop_metrics as pm
from spotweave.operators.normalize import normalize_rows
from spotweave.operators.spatial import append_props, dominant_type, natural_order, spatial_wide
from spotweave.plans import inputs as inp
from spotweave.plans.registry import query
from spotweave.session import stored

GROUP = ("method", "sample")


def rounded(df: DataFrame, *cols: str, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


SCORED_SQL = """SELECT method, {} AS sample, cell_type, round(rmse, 8) AS rmse, round(mae, 8) AS mae, round(jsd, 8) AS jsd,
       round(sum_rmse, 8) AS sum_rmse, round(sum_mae, 8) AS sum_mae, round(corr, 8) AS corr
FROM by_type JOIN metrics USING (method, sample)"""


def scored_rows(scores: DataFrame) -> DataFrame:
    """A row for each run and cell type, with the run's figures, from the maps of a proportion benchmark."""
    run = ("method", "sample", "jsd", "sum_rmse", "sum_mae", "corr", "mae")
    rows = scores.select(*run, F.explode("rmse").alias("cell_type", "_rmse")).withColumn("_mae", F.col("mae")[F.col("cell_type")])
    rows = rows.drop("mae").withColumnsRenamed({"_rmse": "rmse", "_mae": "mae"})
    return rounded(rows, "rmse", "mae", "jsd", "sum_rmse", "sum_mae", "corr")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = inp.counts(spark, sf)
    return pm.pair_rows(inp.truth(rows), inp.predictions(rows))


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = inp.counts(spark, sf)
    return pm.prop_metrics(inp.truth(rows), inp.predictions(rows), zero_rule_on="pred")


@query(
    "prop_metrics",
    inp.METRIC_SQL
    + """SELECT method, sample, n_spots, n_types, round(sum_rmse, 8) AS sum_rmse, round(sum_mae, 8) AS sum_mae,
       round(corr, 8) AS corr, round(jsd, 8) AS jsd FROM metrics""",
)
def prop_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics(spark, sf), "sum_rmse", "sum_mae", "corr", "jsd")


@query(
    "prop_global",
    inp.METRIC_SQL
    + """SELECT method, sample, n_spots, n_types, round(sum_rmse, 8) AS sum_rmse, round(sum_mae, 8) AS sum_mae,
       round(corr, 8) AS corr FROM metrics""",
)
def prop_global(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pm.prop_global(_pairs(spark, sf)), "sum_rmse", "sum_mae", "corr")


@query(
    "prop_by_type",
    inp.PROP_SQL
    + """, n AS (SELECT method, sample, count(DISTINCT spot) AS n FROM pairs GROUP BY 1, 2)
SELECT method, sample, cell_type, round(sqrt(sum((t - q) ** 2) / max(n)), 8) AS rmse,
       round(sum(abs(t - q)) / max(n), 8) AS mae
FROM pairs JOIN n USING (method, sample) GROUP BY 1, 2, 3""",
)
def prop_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pm.prop_by_type(_pairs(spark, sf)), "rmse", "mae")


JSD = inp.PROP_SQL.rstrip() + ",\n" + inp.JSD_SQL + "\n"


@query("jsd_spot", JSD + "SELECT method, sample, spot, round(jsd, 6) AS jsd FROM jsd")
def jsd_spot(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pm.jsd_spot(_pairs(spark, sf), zero_rule_on="pred"), "jsd", digits=6)


@query(
    "jsd_quantiles",
    JSD
    + """SELECT method, sample, round(quantile_cont(jsd, 0.25), 6) AS jsd_q1,
       round(quantile_cont(jsd, 0.5), 6) AS jsd_median, round(quantile_cont(jsd, 0.75), 6) AS jsd_q3
FROM jsd GROUP BY 1, 2""",
)
def jsd_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    jsd = pm.jsd_spot(_pairs(spark, sf), zero_rule_on="pred")
    return rounded(pm.jsd_quantiles(jsd), "jsd_q1", "jsd_median", "jsd_q3", digits=6)


@query(
    "spot_prop",
    inp.with_sql(inp.CELLS_SQL, inp.TRUTH_SQL) + "SELECT sample, spot, cell_type, round(p, 8) AS p FROM truth",
)
def spot_prop(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(composition.spot_prop(inp.cells(spark, sf)), "p")


@query(
    "complete_prop",
    inp.with_sql(inp.CELLS_SQL, inp.TRUTH_SQL, inp.PRED_SQL, inp.SPOTS_SQL)
    + """SELECT sample, spot, cell_type, round(coalesce(p, 0), 8) AS p
FROM spots CROSS JOIN (SELECT DISTINCT o_orderpriority AS cell_type FROM orders)
LEFT JOIN (SELECT * FROM pred WHERE method = 'restricted') USING (sample, spot, cell_type)""",
)
def complete_prop(spark: SparkSession, sf: str) -> DataFrame:
    pred = inp.predictions(inp.counts(spark, sf)).where(F.col("method") == "restricted")
    types = inp.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("cell_type"))
    spots = inp.spots(spark, sf).select("sample", "spot")
    return rounded(joins.complete(pred, spots, types, "cell_type", "p"), "p")


@query(
    "normalize_rows",
    inp.with_sql(inp.CELLS_SQL)
    + """, amounts AS (SELECT sample, spot, cell_type, CAST(count_if(restricted) AS DOUBLE) AS p FROM cells GROUP BY 1, 2, 3)
SELECT sample, spot, cell_type,
       round(coalesce(p / nullif(sum(p) OVER (PARTITION BY sample, spot), 0), 0), 8) AS p FROM amounts""",
)
def normalize_rows_query(spark: SparkSession, sf: str) -> DataFrame:
    amounts = inp.counts(spark, sf).select("sample", "spot", "cell_type", F.col("restricted").alias("p"))
    return rounded(normalize_rows(amounts), "p")


@query(
    "dominant_type",
    inp.with_sql(inp.CELLS_SQL, inp.TRUTH_SQL)
    + """SELECT sample, spot, cell_type, round(p, 8) AS p FROM truth
QUALIFY row_number() OVER (PARTITION BY sample, spot ORDER BY p DESC, cell_type) = 1""",
)
def dominant(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dominant_type(inp.truth(inp.counts(spark, sf))), "p")


@query(
    "gt_layers",
    """WITH cell_expr AS (
  SELECT l_orderkey AS cell, l_partkey AS gene, ln(1 + sum(l_quantity)) AS value FROM lineitem GROUP BY 1, 2)
SELECT o_custkey % 5 AS sample, o_orderpriority AS cell_type, o_custkey AS spot, gene,
       sum(round_even(exp(value) - 1, 0)) AS value
FROM cell_expr JOIN orders ON cell = o_orderkey GROUP BY 1, 2, 3, 4""",
)
def gt_layers_query(spark: SparkSession, sf: str) -> DataFrame:
    """Cells are orders here, spots are their customers."""
    index = inp.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("cell"),
        (F.col("o_custkey") % 5).alias("sample"),
        F.col("o_orderpriority").alias("cell_type"),
        F.col("o_custkey").alias("spot"),
    )
    cell_expr = (
        inp.table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("gene"))
        .agg(F.log1p(F.sum("l_quantity")).alias("value"))
    )
    return composition.gt_layers(index, cell_expr)


@query(
    "align_shared",
    inp.with_sql(inp.CELLS_SQL)
    + """SELECT sample, spot, gene, sum(qty) AS value FROM cells
WHERE (sample, gene) IN (SELECT (sample, gene) FROM cells WHERE restricted)
  AND (sample, spot) IN (SELECT (sample, spot) FROM cells WHERE restricted)
GROUP BY 1, 2, 3""",
)
def align_shared(spark: SparkSession, sf: str) -> DataFrame:
    """Expression on the genes and spots shared with the restricted cells."""
    rows = inp.cells(spark, sf)
    other = rows.where("restricted")
    genes = stored(joins.align_shared(rows, other, "gene", ["sample"]), "genes")
    spots = stored(joins.align_shared(rows, other, "spot", ["sample"]), "spots")
    facts = rows.groupBy("sample", "spot", "gene").agg(F.sum("qty").alias("value"))
    return joins.restrict(facts, genes, spots)


@query(
    "key_mismatch",
    inp.with_sql(inp.CELLS_SQL)
    + """, a AS (SELECT DISTINCT sample, spot, cell_type FROM cells),
b AS (SELECT DISTINCT sample, spot, cell_type FROM cells WHERE restricted)
SELECT sample, spot, cell_type, 'left' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT sample, spot, cell_type, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def key_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    rows = inp.cells(spark, sf)
    return joins.key_mismatch(rows, rows.where("restricted"), "cell_type", ["sample", "spot"])


@query(
    "attach_coords",
    inp.with_sql(inp.CELLS_SQL, inp.TRUTH_SQL, inp.SPOTS_SQL)
    + """SELECT sample, spot, cell_type, round(p, 8) AS p, spot_x, spot_y
FROM truth LEFT JOIN spots USING (sample, spot)""",
)
def attach(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(joins.attach_coords(inp.truth(inp.counts(spark, sf)), inp.spots(spark, sf)), "p")


@query(
    "pair_replicates",
    """WITH truth_runs AS (SELECT DISTINCT o_orderstatus AS pattern, o_orderkey % 7 AS replicate FROM orders),
pred_runs AS (SELECT DISTINCT l_linestatus AS pattern, l_linenumber AS replicate, l_returnflag AS method FROM lineitem)
SELECT p.pattern, p.replicate, p.method, t.pattern IS NOT NULL AS paired
FROM pred_runs p LEFT JOIN truth_runs t ON p.pattern = t.pattern AND p.replicate = t.replicate""",
)
def pair(spark: SparkSession, sf: str) -> DataFrame:
    known = inp.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("pattern"), (F.col("o_orderkey") % 7).cast("int").alias("replicate")
    )
    runs = inp.table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("pattern"),
        F.col("l_linenumber").alias("replicate"),
        F.col("l_returnflag").alias("method"),
    )
    return joins.pair_replicates(known, runs, ["pattern", "replicate"])


WIDE_COLS = ", ".join(f"coalesce(sum(p) FILTER (cell_type = '{t}'), 0) AS t{i}" for i, t in enumerate(inp.TYPES))


@query(
    "spatial_wide",
    inp.with_sql(inp.CELLS_SQL, inp.TRUTH_SQL, inp.PRED_SQL, inp.SPOTS_SQL)
    + f""", every AS (SELECT 'truth' AS method, * FROM truth UNION ALL SELECT * FROM pred),
wide AS (SELECT method, sample, spot, {WIDE_COLS} FROM every GROUP BY 1, 2, 3)
SELECT method, sample, spot, spot_x, spot_y, {", ".join(f'round(t{i}, 8) AS "{t}"' for i, t in enumerate(inp.TYPES))}
FROM wide LEFT JOIN spots USING (sample, spot)""",
)
def spatial(spark: SparkSession, sf: str) -> DataFrame:
    rows = inp.counts(spark, sf)
    every = inp.truth(rows).withColumn("method", F.lit("truth")).unionByName(inp.predictions(rows))
    return rounded(spatial_wide(every, inp.spots(spark, sf), inp.TYPES), *inp.TYPES)


@query(
    "append_props",
    inp.with_sql(inp.CELLS_SQL, inp.TRUTH_SQL, inp.PRED_SQL, inp.SPOTS_SQL)
    + f""", wide AS (SELECT sample, spot, {", ".join(f"sum(p) FILTER (cell_type = '{t}') AS t{i}" for i, t in enumerate(inp.TYPES))}
  FROM pred WHERE method = 'restricted' GROUP BY 1, 2)
SELECT sample, spot, spot_x, spot_y, {", ".join(f'round(t{i}, 8) AS "{t}"' for i, t in enumerate(inp.TYPES))}
FROM spots LEFT JOIN wide USING (sample, spot)""",
)
def append(spark: SparkSession, sf: str) -> DataFrame:
    pred = inp.predictions(inp.counts(spark, sf)).where(F.col("method") == "restricted")
    return rounded(append_props(inp.spots(spark, sf), pred, inp.TYPES), *inp.TYPES)


@query(
    "natural_order",
    """WITH ids AS (SELECT 'spot_' || s_suppkey AS spot FROM supplier UNION ALL SELECT s_name FROM supplier)
SELECT spot, CASE WHEN spot LIKE 'spot_%' THEN CAST(regexp_extract(spot, '_(\\d+)', 1) AS BIGINT) END AS number FROM ids
ORDER BY number NULLS LAST, spot""".replace("\\\\", "\\"),
)
def natural(spark: SparkSession, sf: str) -> DataFrame:
    from spotweave.functions.scalar import id_number

    sup = inp.table(spark, sf, "supplier")
    ids = sup.select(F.concat(F.lit("spot_"), F.col("s_suppkey").cast("string")).alias("spot")).unionByName(
        sup.select(F.col("s_name").alias("spot"))
    )
    return natural_order(ids).withColumn("number", id_number(F.col("spot")))
