"""Queries on expression and antibodies: filters, normalisation, layers, deconvolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spotweave.functions import scalar
from spotweave.operators import deconv, filters, joins, layer_metrics as lm, markers, normalize, spatial
from spotweave.plans import inputs as inp
from spotweave.plans.prop_queries import SCORED_SQL, rounded, scored_rows
from spotweave.plans.registry import query
from spotweave.session import stored
from spotweave.sources.text import marker_table

EXPR = inp.with_sql(inp.EXPR_SQL)
SIZES_SQL = "n_spots AS (SELECT sample, count(*) AS n_cells FROM spots GROUP BY 1)"
K = len(inp.TYPES)
TYPE_ROWS = ", ".join(f"('{t}', {i})" for i, t in enumerate(inp.TYPES))


@query("filter_subtype", "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_type = 'PROMO'")
def filter_subtype(spark: SparkSession, sf: str) -> DataFrame:
    return inp.table(spark, sf, "part").where(F.col("p_type") == "PROMO").select("p_partkey", "p_name", "p_brand", "p_type")


@query(
    "mt_split",
    inp.with_sql(inp.PROTEIN_SQL)
    + """SELECT sample, spot, coalesce(sum(value) FILTER (protein LIKE 'Brand#1%'), 0) AS mt_total,
       coalesce(sum(value) FILTER (protein NOT LIKE 'Brand#1%'), 0) AS rest_total,
       round(coalesce(sum(value) FILTER (protein LIKE 'Brand#1%'), 0) / sum(value), 8) AS mt_share
FROM protein GROUP BY 1, 2""",
)
def mt_split(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(filters.prefix_totals(inp.protein(spark, sf), "Brand#1", gene="protein"), "mt_share")


@query(
    "log_counts",
    EXPR
    + """SELECT sample, spot, gene, round(ln(1 + value), 8) AS logged,
       round_even(exp(ln(1 + value)) - 1, 0) AS counts, round_even(value / 2, 0) AS half FROM expr""",
)
def log_counts(spark: SparkSession, sf: str) -> DataFrame:
    logged = inp.expr(spark, sf).withColumn("logged", scalar.log_counts(F.col("value")))
    return logged.select(
        "sample",
        "spot",
        "gene",
        F.round("logged", 8).alias("logged"),
        scalar.counts_from_log(F.col("logged")).alias("counts"),
        F.rint(F.col("value") / 2).alias("half"),
    )


GENE_STATS = inp.with_sql(inp.EXPR_SQL, inp.SPOTS_SQL, SIZES_SQL) + """, stats AS (
  SELECT sample, gene, count(*) AS n_nonzero, avg(value) AS m, any_value(n_cells) AS n
  FROM expr JOIN n_spots USING (sample) GROUP BY 1, 2)
"""


@query(
    "filter_gex",
    GENE_STATS
    + "SELECT sample, spot, gene, value FROM expr JOIN stats USING (sample, gene) WHERE n_nonzero / n >= 0.05 AND m >= 24.1",
)
def filter_gex(spark: SparkSession, sf: str) -> DataFrame:
    return filters.filter_gex(inp.expr_table(spark, sf), 0.05, 24.1, cells=inp.spots(spark, sf))


@query(
    "filter_genes3",
    GENE_STATS
    + """SELECT sample, spot, gene, value FROM expr JOIN stats USING (sample, gene)
WHERE n_nonzero > n * 0.08 OR (n_nonzero > 5 AND m > 26.12)""",
)
def filter_genes3(spark: SparkSession, sf: str) -> DataFrame:
    return filters.filter_genes3(inp.expr_table(spark, sf), 5, 0.08, 26.12, cells=inp.spots(spark, sf))


@query(
    "filter_min",
    EXPR
    + """, kept AS (SELECT sample, spot FROM expr GROUP BY 1, 2 HAVING count(*) >= 100),
remaining AS (SELECT expr.* FROM expr JOIN kept USING (sample, spot)),
genes AS (SELECT sample, gene FROM remaining GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT sample, spot, gene, value FROM remaining JOIN genes USING (sample, gene)""",
)
def filter_min(spark: SparkSession, sf: str) -> DataFrame:
    return filters.filter_min(inp.expr_table(spark, sf), 100, 3)


@query(
    "filter_min_counts",
    EXPR
    + """SELECT sample, spot, gene, value FROM expr
QUALIFY sum(value) OVER (PARTITION BY sample, spot) >= 3000""",
)
def filter_min_counts(spark: SparkSession, sf: str) -> DataFrame:
    return filters.filter_min_counts(inp.expr_table(spark, sf), 3000)


@query(
    "name_norm",
    """SELECT p_partkey, string_split(p_brand, '#')[-1] AS last_token, replace(p_name, ' ', '_') AS underscored,
       upper(p_name) AS upper_name, replace(replace(p_name, ' ', '_') || '_layer_pass1', '_layer_pass1', '_layer') AS layer,
       replace(replace(p_name, ' ', '_'), '_', ' ') AS spaced FROM part""",
)
def name_norm(spark: SparkSession, sf: str) -> DataFrame:
    name = scalar.underscored(F.col("p_name"))
    return inp.table(spark, sf, "part").select(
        "p_partkey",
        scalar.last_token(F.col("p_brand"), "#").alias("last_token"),
        name.alias("underscored"),
        F.upper("p_name").alias("upper_name"),
        scalar.strip_pass(F.concat(name, F.lit("_layer_pass1"))).alias("layer"),
        scalar.spaced(name).alias("spaced"),
    )


@query(
    "data_checks",
    """SELECT l_orderkey % 5 AS sample, count(*) AS n_rows, count(*) FILTER (v < 0) AS n_negative,
       count(*) FILTER (isnan(v)) AS n_nan, count(*) FILTER (v IS NULL) AS n_null, count(*) FILTER (v = 0) AS n_zero
FROM (SELECT l_orderkey, CASE WHEN l_discount = 0.01 THEN NULL WHEN l_discount = 0.02 THEN 'nan'::DOUBLE
             ELSE round(l_discount - 0.05, 4) END AS v FROM lineitem) GROUP BY 1""",
)
def data_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Discounts around their middle, with two of them turned into NULL and NaN."""
    d = F.col("l_discount")
    v = F.when(d == 0.02, F.lit(float("nan"))).when(d != 0.01, F.round(d - 0.05, 4))
    rows = inp.table(spark, sf, "lineitem").select((F.col("l_orderkey") % 5).alias("sample"), v.alias("value"))
    return filters.data_checks(rows)


@query(
    "normalize_total",
    EXPR
    + """SELECT sample, spot, gene, round(ln(1 + value * 10000 / sum(value) OVER (PARTITION BY sample, spot)), 6) AS value
FROM expr""",
)
def normalize_total(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(normalize.normalize_total(inp.expr_table(spark, sf)), "value", digits=6).select(
        "sample", "spot", "gene", "value"
    )


@query(
    "normalize_median",
    EXPR
    + """, totals AS (SELECT sample, spot, sum(value) AS total FROM expr GROUP BY 1, 2),
target AS (SELECT sample, quantile_cont(total, 0.5) AS target FROM totals GROUP BY 1)
SELECT sample, spot, gene, round(ln(1 + value * target / total), 6) AS value
FROM expr JOIN totals USING (sample, spot) JOIN target USING (sample)""",
)
def normalize_median(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(normalize.normalize_total(inp.expr_table(spark, sf), None), "value", digits=6).select(
        "sample", "spot", "gene", "value"
    )


DENSE_SQL = """dense AS (
  SELECT sample, spot, protein, coalesce(value, 0) AS value
  FROM spots CROSS JOIN (SELECT DISTINCT p_brand AS protein FROM part) LEFT JOIN protein USING (sample, spot, protein)),
bounds AS (
  SELECT sample, protein, quantile_cont(value, 0.05) AS low, quantile_cont(value, 0.95) AS high FROM dense GROUP BY 1, 2),
logged AS (
  SELECT sample, spot, protein, ln(1 + greatest(low, least(high, value))) AS v FROM dense JOIN bounds USING (sample, protein)),
clr AS (SELECT sample, spot, protein, v - avg(v) OVER (PARTITION BY sample, spot) AS value FROM logged)"""
CLR_SQL = inp.with_sql(inp.PROTEIN_SQL, inp.SPOTS_SQL, DENSE_SQL)


def clr(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.antibody_clr(inp.protein_table(spark, sf), inp.spots(spark, sf), inp.proteins(spark, sf))


@query("antibody_clr", CLR_SQL + "SELECT sample, spot, protein, round(value, 6) AS value FROM clr")
def antibody_clr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clr(spark, sf), "value", digits=6)


# marker position: sorted brands are dealt to the types in turn, first two each
MARKER_SQL = f"""types AS (SELECT * FROM (VALUES {TYPE_ROWS}) v(cell_type, i)),
brands AS (SELECT p_brand AS protein, row_number() OVER (ORDER BY p_brand) - 1 AS r FROM (SELECT DISTINCT p_brand FROM part)),
marker AS (SELECT cell_type, protein, CAST(r // 5 AS INTEGER) AS pos FROM brands JOIN types ON r % 5 = i WHERE r < 10),
evidence AS (
  SELECT sample, spot, cell_type, greatest(avg(value), 0) AS e FROM clr JOIN marker USING (protein) GROUP BY 1, 2, 3),
markers_p AS (
  SELECT sample, spot, cell_type, CASE WHEN sum(e) OVER w > 0 THEN e / sum(e) OVER w ELSE 1.0 / {K} END AS p
  FROM evidence WINDOW w AS (PARTITION BY sample, spot))"""
GLOBAL_SQL = inp.with_sql(inp.PROTEIN_SQL, inp.SPOTS_SQL, DENSE_SQL, MARKER_SQL)


@query(
    "marker_table",
    """WITH brands AS (SELECT p_brand AS protein, row_number() OVER (ORDER BY p_brand) - 1 AS r
  FROM (SELECT DISTINCT p_brand FROM part)),
types AS (SELECT * FROM (VALUES """
    + TYPE_ROWS
    + """) v(cell_type, i))
SELECT cell_type, 'Major' AS tier, CAST(r // 5 AS INTEGER) AS pos, protein
FROM brands JOIN types ON r % 5 = i WHERE r < 10""",
)
def marker_table_query(spark: SparkSession, sf: str) -> DataFrame:
    """Profile of the brands in the part table, built as a map column, first two markers each."""
    from pyspark.sql import Window as W

    from spotweave.sources.text import marker_rows

    # one row per brand: the window is over the 25 names of the antibody panel
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("protein")) - 1
    names = F.array(*[F.lit(t) for t in inp.TYPES])
    dealt = inp.proteins(spark, sf).withColumn("r", rank).withColumn("cell_type", F.get(names, F.col("r") % K))
    lists = dealt.groupBy("cell_type").agg(F.array_sort(F.collect_list("protein")).alias("Major"))
    profile = lists.agg(F.map_from_entries(F.collect_list(F.struct("cell_type", F.struct("Major")))).alias("profile"))
    return marker_rows(profile, n=2)


def global_props(spark: SparkSession, sf: str) -> DataFrame:
    marker = marker_table(spark, inp.profile(), 2)
    parts = normalize.clr_parts(inp.protein_table(spark, sf), inp.spots(spark, sf), inp.proteins(spark, sf))
    return deconv.marker_props_sparse(parts, marker, inp.TYPES)


@query("marker_props", GLOBAL_SQL + "SELECT sample, spot, cell_type, round(p, 6) AS p FROM markers_p")
def marker_props(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(deconv.to_long(global_props(spark, sf), inp.TYPES), "p", digits=6)


@query(
    "radius_neighbors",
    inp.with_sql(inp.SPOTS_SQL)
    + f"""SELECT a.sample, a.spot, b.spot AS neighbor,
       round(sqrt((a.spot_x - b.spot_x) ** 2 + (a.spot_y - b.spot_y) ** 2), 8) AS distance
FROM spots a JOIN spots b ON a.sample = b.sample AND a.spot <> b.spot
 AND b.spot_y BETWEEN a.spot_y - {inp.RADIUS} AND a.spot_y + {inp.RADIUS}
WHERE (a.spot_x - b.spot_x) ** 2 + (a.spot_y - b.spot_y) ** 2 <= {inp.RADIUS**2}""",
)
def radius_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spatial.radius_neighbors(inp.spots(spark, sf), inp.RADIUS), "distance")


@query(
    "neighbor_counts",
    inp.with_sql(inp.SPOTS_SQL)
    + f"""SELECT a.sample, a.spot, count(*) - 1 AS n_neighbors
FROM spots a JOIN spots b ON a.sample = b.sample AND b.spot_y BETWEEN a.spot_y - {inp.RADIUS} AND a.spot_y + {inp.RADIUS}
WHERE (a.spot_x - b.spot_x) ** 2 + (a.spot_y - b.spot_y) ** 2 <= {inp.RADIUS**2} GROUP BY 1, 2""",
)
def neighbor_counts(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.neighbor_counts(inp.spots(spark, sf), inp.RADIUS)


SKEWED_SQL = """skewed AS (
  SELECT c_custkey AS spot, (c_custkey % 97)::DOUBLE AS weight,
         (c_custkey * 7919 % 1000) / CASE WHEN c_custkey % 2 = 0 THEN 500.0::DOUBLE ELSE 5.0 END AS spot_x,
         (c_custkey * 104729 % 1000) / CASE WHEN c_custkey % 2 = 0 THEN 500.0::DOUBLE ELSE 5.0 END AS spot_y
  FROM customer)"""
SKEWED_RADIUS = 1.0


@query(
    "radius_skewed",
    inp.with_sql(SKEWED_SQL)
    + f"""SELECT a.spot, count(*) - 1 AS n_neighbors, sum(b.weight) - any_value(a.weight) AS weight
FROM skewed a JOIN skewed b ON b.spot_y BETWEEN a.spot_y - {SKEWED_RADIUS} AND a.spot_y + {SKEWED_RADIUS}
WHERE (a.spot_x - b.spot_x) ** 2 + (a.spot_y - b.spot_y) ** 2 <= {SKEWED_RADIUS**2} GROUP BY 1""",
)
def radius_skewed(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours and the sum of their weights where half of all spots lie in one grid cell."""
    key = F.col("c_custkey")
    size = F.when(key % 2 == 0, 500.0).otherwise(5.0)
    spots = inp.table(spark, sf, "customer").select(
        F.lit(0).alias("sample"), key.alias("spot"), (key % 97).cast("double").alias("weight"),
        (key * 7919 % 1000 / size).alias("spot_x"), (key * 104729 % 1000 / size).alias("spot_y"),
    )
    plan = spatial.cell_plan(spots, spots, SKEWED_RADIUS, work=1 << 16)
    sums = spatial.neighbor_sums(spots, spots, SKEWED_RADIUS, ["weight"], plan)
    return sums.select("spot", (F.col("near_n") - 1).alias("n_neighbors"), (F.col("near_weight") - F.col("weight")).alias("weight"))


LAM, ALPHA, CAP = 1.0, 0.7, 0.2
TOLERANCE, ROUNDS = 1e-4, 20
NEAR_SQL = f"""near AS MATERIALIZED (
  SELECT a.sample, a.spot, b.spot AS neighbor FROM spots a JOIN spots b ON a.sample = b.sample AND a.spot <> b.spot
   AND b.spot_y BETWEEN a.spot_y - {inp.RADIUS} AND a.spot_y + {inp.RADIUS}
  WHERE (a.spot_x - b.spot_x) ** 2 + (a.spot_y - b.spot_y) ** 2 <= {inp.RADIUS**2})"""


def refine_sql(points: list[dict], rounds: int) -> str:
    """Rounds of the smoothing for all points; a point whose largest change was below the tolerance stays as it is."""
    runs = ", ".join(f"({q['run_id']}, {q['lam']}, {q['alpha']}, {q['cap']})" for q in points)
    out = f"""{NEAR_SQL},
sweep(run_id, lam, alpha, cap) AS (VALUES {runs}),
start AS MATERIALIZED (SELECT * FROM markers_p),
p0 AS MATERIALIZED (
  SELECT run_id, lam * (1 - alpha) AS pull, lam * alpha / ({K} * (1 + lam * (1 - alpha))) AS least, cap::DOUBLE AS cap,
         sample, spot, cell_type, p AS e, p, 0 AS steps, false AS settled
  FROM start, (SELECT run_id, lam::DOUBLE AS lam, alpha::DOUBLE AS alpha, cap FROM sweep))"""
    for r in range(rounds):
        out += f""",
around{r} AS (
  SELECT run_id, near.sample, near.spot, cell_type, avg(p) AS n
  FROM near JOIN p{r} m ON near.sample = m.sample AND near.neighbor = m.spot WHERE NOT settled GROUP BY ALL),
moved{r} AS (
  SELECT p{r}.*, greatest(p + least(greatest(
           greatest((e + pull * coalesce(n, e)) / (1 + pull) - least, 0) - p, -cap), cap), 0) AS y
  FROM p{r} LEFT JOIN around{r} USING (run_id, sample, spot, cell_type)),
fresh{r} AS MATERIALIZED (
  SELECT * EXCLUDE y, CASE WHEN NOT settled AND sum(y) OVER w > 0 THEN y / sum(y) OVER w ELSE p END AS q
  FROM moved{r} WINDOW w AS (PARTITION BY run_id, sample, spot)),
p{r + 1} AS MATERIALIZED (
  SELECT run_id, pull, least, cap, sample, spot, cell_type, e, q AS p, CASE WHEN settled THEN steps ELSE {r + 1} END AS steps,
         settled OR max(abs(q - p)) OVER (PARTITION BY run_id) < {TOLERANCE} AS settled
  FROM fresh{r})"""
    return out


def _sweep() -> list[dict]:
    from spotweave.operators.sampling import sweep_points

    return sweep_points(lam=[0.001, 1.0], alpha=[0.1, 0.7], cap=[0.1, 0.2, 0.4])


@query(
    "refine_step",
    GLOBAL_SQL.rstrip() + ",\n" + refine_sql([{"run_id": 0, "lam": LAM, "alpha": ALPHA, "cap": CAP}], 1)
    + "\nSELECT sample, spot, cell_type, round(p, 6) AS p FROM p1",
)
def refine_step(spark: SparkSession, sf: str) -> DataFrame:
    """One smoothing step from the global proportions."""
    point = {"lam": LAM, "alpha": ALPHA, "cap": CAP}
    fine = deconv.refine_props(global_props(spark, sf), inp.spots(spark, sf), inp.TYPES, inp.RADIUS, point, max_iterations=1)
    return rounded(deconv.to_long(fine, inp.TYPES), "p", digits=6)


@query(
    "refine_props",
    GLOBAL_SQL.rstrip() + ",\n" + refine_sql(_sweep(), ROUNDS)
    + f"\nSELECT run_id, sample, spot, cell_type, steps, settled AS converged, round(p, 6) AS p FROM p{ROUNDS}",
)
def refine_props(spark: SparkSession, sf: str) -> DataFrame:
    """Iterated until each of twelve parameter points has converged, all in one run."""
    start, spots = global_props(spark, sf), inp.spots(spark, sf)
    fine = deconv.refine_props(start, spots, inp.TYPES, inp.RADIUS, _sweep(), TOLERANCE, ROUNDS)
    by = ("run_id", "sample", "spot", "steps", "converged")
    return rounded(deconv.to_long(fine, inp.TYPES, by), "p", digits=6)


def _expr_props(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(expression, truth proportions, the same wide)."""
    prop = inp.truth(inp.counts(spark, sf))
    return inp.expr_table(spark, sf), prop, deconv.to_wide(prop, inp.TYPES)


BASE_SQL = inp.with_sql(inp.CELLS_SQL, inp.TRUTH_SQL, inp.EXPR_SQL)
PASS1_SQL = """weights AS (SELECT sample, cell_type, sum(p) AS w FROM truth GROUP BY 1, 2),
mu AS (
  SELECT sample, cell_type, gene, sum(value * p) / any_value(w) AS m
  FROM expr JOIN truth USING (sample, spot) JOIN weights USING (sample, cell_type) GROUP BY 1, 2, 3),
pass1 AS (
  SELECT sample, cell_type, spot, gene, value * p * m / sum(p * m) OVER (PARTITION BY sample, spot, gene) AS value
  FROM expr JOIN truth USING (sample, spot) JOIN mu USING (sample, cell_type, gene))"""
PRIOR_SQL = """prior AS (
  SELECT sample, cell_type, gene, sum(value * p) / any_value(w) AS prior
  FROM pass1 JOIN truth USING (sample, cell_type, spot) JOIN weights USING (sample, cell_type) GROUP BY 1, 2, 3)"""


@query(
    "weighted_layers",
    BASE_SQL
    + "SELECT sample, cell_type, spot, gene, round(value * p, 6) AS value FROM expr JOIN truth USING (sample, spot)",
)
def weighted_layers(spark: SparkSession, sf: str) -> DataFrame:
    expr, prop, _ = _expr_props(spark, sf)
    return rounded(deconv.weighted_layers(expr, prop), "value", digits=6)


@query(
    "expr_pass1",
    BASE_SQL.rstrip() + ",\n" + PASS1_SQL + "\nSELECT sample, cell_type, spot, gene, round(value, 6) AS value FROM pass1",
)
def expr_pass1(spark: SparkSession, sf: str) -> DataFrame:
    expr, _, wide = _expr_props(spark, sf)
    return rounded(deconv.expr_pass1(expr, wide, inp.TYPES), "value", digits=6)


@query(
    "expr_prior",
    BASE_SQL.rstrip()
    + ",\n"
    + PASS1_SQL
    + ",\n"
    + PRIOR_SQL
    + "\nSELECT sample, cell_type, gene, round(prior, 6) AS prior FROM prior",
)
def expr_prior(spark: SparkSession, sf: str) -> DataFrame:
    expr, _, wide = _expr_props(spark, sf)
    return rounded(deconv.pass1_prior(expr, wide, inp.TYPES), "prior", digits=6)


@query(
    "expr_pass2",
    BASE_SQL.rstrip()
    + ",\n"
    + PASS1_SQL
    + ",\n"
    + PRIOR_SQL
    + """, mixed AS (
  SELECT sample, cell_type, gene, 0.5 * m + 0.5 * coalesce(prior, 0) AS m
  FROM mu LEFT JOIN prior USING (sample, cell_type, gene))
SELECT sample, cell_type, spot, gene,
       round(value * p * m / sum(p * m) OVER (PARTITION BY sample, spot, gene), 6) AS value
FROM expr JOIN truth USING (sample, spot) JOIN mixed USING (sample, cell_type, gene)""",
)
def expr_pass2(spark: SparkSession, sf: str) -> DataFrame:
    expr, _, wide = _expr_props(spark, sf)
    return rounded(deconv.expr_pass2(expr, wide, inp.TYPES, 0.5), "value", digits=6)


@query(
    "expr_ledger",
    BASE_SQL.rstrip()
    + ",\n"
    + PASS1_SQL
    + """, i AS (SELECT sample, sum(value) AS input FROM expr GROUP BY 1),
o AS (SELECT sample, sum(value) AS output FROM pass1 GROUP BY 1)
SELECT sample, round(input, 3) AS input, round(output, 3) AS output, round(abs(input - output), 3) AS lost FROM i JOIN o USING (sample)""",
)
def expr_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Expression that goes into the first pass and comes out of it, by sample."""
    expr, _, wide = _expr_props(spark, sf)
    sums = deconv.mass_ledger(expr, deconv.expr_pass1(expr, wide, inp.TYPES))
    return rounded(sums.withColumn("lost", F.abs("lost")), "input", "output", "lost", digits=3)


@query(
    "expr_pass1_local",
    inp.with_sql(inp.CELLS_SQL, inp.TRUTH_SQL, inp.EXPR_SQL, inp.SPOTS_SQL)
    + f""", near AS (
  SELECT a.sample, a.spot, b.spot AS neighbor FROM spots a JOIN spots b ON a.sample = b.sample
   AND b.spot_y BETWEEN a.spot_y - {inp.RADIUS} AND a.spot_y + {inp.RADIUS}
  WHERE (a.spot_x - b.spot_x) ** 2 + (a.spot_y - b.spot_y) ** 2 <= {inp.RADIUS**2}),
weights AS (
  SELECT near.sample, near.spot, cell_type, sum(p) AS w
  FROM near JOIN truth ON near.sample = truth.sample AND near.neighbor = truth.spot GROUP BY 1, 2, 3),
sums AS (
  SELECT near.sample, near.spot, cell_type, gene, sum(value * p) AS x
  FROM near JOIN expr ON near.sample = expr.sample AND near.neighbor = expr.spot
  JOIN truth ON near.sample = truth.sample AND near.neighbor = truth.spot GROUP BY 1, 2, 3, 4),
mu AS (SELECT sample, spot, cell_type, gene, x / w AS m FROM sums JOIN weights USING (sample, spot, cell_type))
SELECT sample, cell_type, spot, gene,
       round(value * p * m / sum(p * m) OVER (PARTITION BY sample, spot, gene), 6) AS value
FROM expr JOIN truth USING (sample, spot) JOIN mu USING (sample, spot, cell_type, gene)""",
)
def expr_pass1_local(spark: SparkSession, sf: str) -> DataFrame:
    expr, _, wide = _expr_props(spark, sf)
    out = deconv.expr_pass1_local(expr, wide, inp.spots(spark, sf), inp.TYPES, inp.RADIUS)
    return rounded(out, "value", digits=6)


SCORE_SQL = """grid AS (SELECT (SELECT count(*) FROM part) * (SELECT count(*) FROM supplier) AS n),
types AS (SELECT DISTINCT sample, cell_type FROM layers_truth),
pred_layers AS (
  SELECT 'weighted' AS method, sample, cell_type, spot, gene, value * p AS value FROM expr JOIN truth USING (sample, spot)
  UNION ALL SELECT 'pass1', * FROM pass1),
both_sides AS (
  SELECT method, sample, cell_type, spot, gene, ln(1 + value) AS q, CAST(0 AS DOUBLE) AS t FROM pred_layers
  UNION ALL
  SELECT method, sample, cell_type, spot, gene, 0, ln(1 + value)
  FROM layers_truth, (SELECT unnest(['weighted', 'pass1']) AS method)),
joined AS (SELECT method, sample, cell_type, spot, gene, sum(q) AS q, sum(t) AS t FROM both_sides GROUP BY ALL),
scores AS (
  SELECT method, sample, cell_type, sqrt(sum((t - q) ** 2) / max(n)) AS rmse,
         sqrt(sum((t - q) ** 2) / max(n)) / max(t) AS nrmse, sum(abs(t - q)) / max(n) AS mae
  FROM joined, grid GROUP BY 1, 2, 3)"""
SCORES_SQL = (
    inp.with_sql(inp.CELLS_SQL, inp.TRUTH_SQL, inp.EXPR_SQL, inp.LAYERS_SQL).rstrip() + ",\n" + PASS1_SQL + ",\n" + SCORE_SQL + "\n"
)


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Two layer predictions against the truth on the full gene x spot grid."""
    rows = inp.cells(spark, sf)
    expr, _, wide = _expr_props(spark, sf)
    sizes = inp.table(spark, sf, "part").agg(F.count(F.lit(1)).alias("n_genes")).withColumn(
        "n_spots", inp.table(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()
    )
    pred = deconv.wide_layers(expr, wide, inp.TYPES)
    return lm.wide_layer_metrics(inp.layers_truth(rows), pred, inp.TYPES, sizes, ["weighted", "pass1"])


@query(
    "layer_metrics",
    SCORES_SQL
    + "SELECT method, sample, cell_type, round(rmse, 8) AS rmse, round(nrmse, 8) AS nrmse, round(mae, 8) AS mae FROM scores",
)
def layer_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scores(spark, sf), "rmse", "nrmse", "mae")


SUMMARY_COLS = " UNION ALL ".join(
    f"SELECT method, sample, '{n} {m.upper()}' AS metric, round({f}({m}), 8) AS value FROM scores GROUP BY 1, 2"
    for m in ("rmse", "nrmse", "mae")
    for n, f in (("Average", "avg"), ("Median", "median"))
)


@query("layer_summary", SCORES_SQL + SUMMARY_COLS)
def layer_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(lm.layer_summary(scores(spark, sf)), "value")


LABEL_SQL = """labels_spot AS (
  SELECT sample, spot, cell_type FROM truth
  QUALIFY row_number() OVER (PARTITION BY sample, spot ORDER BY p DESC, cell_type) = 1),
sizes AS (SELECT cell_type, count(*) AS n1, sum(count(*)) OVER () - count(*) AS n2 FROM labels_spot GROUP BY 1),
all_genes AS (SELECT gene, sum(value) AS s, sum(value * value) AS ss FROM expr GROUP BY 1),
own AS (SELECT cell_type, gene, sum(value) AS s1, sum(value * value) AS ss1
        FROM expr JOIN labels_spot USING (sample, spot) GROUP BY 1, 2),
moments AS (
  SELECT cell_type, gene, n1, n2, coalesce(s1, 0) / n1 AS m1, (s - coalesce(s1, 0)) / n2 AS m2,
         coalesce(ss1, 0) AS ss1, ss - coalesce(ss1, 0) AS ss2
  FROM sizes CROSS JOIN all_genes LEFT JOIN own USING (cell_type, gene)),
ranked AS (
  SELECT cell_type, gene, m1 AS mean_in, m2 AS mean_out,
         round((m1 - m2) / nullif(sqrt((ss1 - n1 * m1 * m1) / (n1 - 1) / n1 + (ss2 - n2 * m2 * m2) / (n2 - 1) / n2), 0), 6) AS t
  FROM moments)"""
RANK_SQL = inp.with_sql(inp.CELLS_SQL, inp.TRUTH_SQL, inp.EXPR_SQL).rstrip() + ",\n" + LABEL_SQL + "\n"


def ranked_markers(spark: SparkSession, sf: str) -> DataFrame:
    labels = spatial.dominant_type(inp.truth(inp.counts(spark, sf)))
    return markers.rank_markers(inp.expr(spark, sf), labels, 100, ("sample", "spot"))


@query(
    "rank_markers",
    RANK_SQL
    + """SELECT cell_type, gene, round(mean_in, 6) AS mean_in, round(mean_out, 6) AS mean_out, t,
       CAST(row_number() OVER (PARTITION BY cell_type ORDER BY t DESC NULLS LAST, gene) AS INTEGER) AS rank
FROM ranked QUALIFY rank <= 100""",
)
def rank_markers(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranked_markers(spark, sf), "mean_in", "mean_out", "t", digits=6)


@query(
    "mark_subset",
    RANK_SQL
    + """, best AS (SELECT DISTINCT gene FROM (SELECT gene, row_number() OVER (
    PARTITION BY cell_type ORDER BY t DESC NULLS LAST, gene) AS rank FROM ranked) WHERE rank <= 100)
SELECT sample, spot, gene, value FROM expr WHERE gene IN (SELECT gene FROM best)""",
)
def mark_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Expression of the union of the best markers."""
    chosen = stored(markers.marker_union(ranked_markers(spark, sf)), "markers")
    return joins.mark_subset(inp.expr(spark, sf), chosen)


MOMENT_SQL = inp.with_sql(inp.EXPR_SQL, inp.SPOTS_SQL, SIZES_SQL) + """, moments AS (
  SELECT sample, gene, sum(value) / any_value(n_cells) AS mean,
    greatest(0, (sum(value * value) - sum(value) ** 2 / any_value(n_cells)) / (any_value(n_cells) - 1)) AS variance
  FROM expr JOIN n_spots USING (sample) GROUP BY 1, 2)
"""


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return inp.spots(spark, sf).groupBy("sample").agg(F.count(F.lit(1)).alias("n_cells"))


@query(
    "variable_features",
    MOMENT_SQL
    + """SELECT sample, gene, round(mean, 6) AS mean, round(variance, 6) AS variance,
       round(variance / mean, 6) AS dispersion,
       CAST(row_number() OVER (PARTITION BY sample ORDER BY round(variance / mean, 9) DESC, gene) AS INTEGER) AS rank
FROM moments QUALIFY rank <= 200""",
)
def variable_features(spark: SparkSession, sf: str) -> DataFrame:
    best = markers.variable_features(inp.expr(spark, sf), _sizes(spark, sf), 200)
    return rounded(best, "mean", "variance", "dispersion", digits=6)


@query(
    "scale_genes",
    MOMENT_SQL
    + """SELECT sample, spot, gene, round(least((value - mean) / nullif(sqrt(variance), 0), 10), 6) AS value,
       round(-mean / nullif(sqrt(variance), 0), 6) AS zero_value
FROM expr JOIN moments USING (sample, gene)""",
)
def scale_genes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(markers.scale_genes(inp.expr_table(spark, sf), _sizes(spark, sf)), "value", "zero_value", digits=6)


SCORES_OF_RUN_SQL = (
    GLOBAL_SQL.rstrip()
    + ",\n"
    + refine_sql([{"run_id": 0, "lam": LAM, "alpha": ALPHA, "cap": CAP}], ROUNDS)
    + ",\n"
    + ",\n".join((inp.CELLS_SQL, inp.TRUTH_SQL))
    + f""",
pred AS (
  SELECT 'global' AS method, sample, spot, cell_type, p FROM start
  UNION ALL SELECT 'finetuned', sample, spot, cell_type, p FROM p{ROUNDS}),
"""
    + ",\n".join((inp.PAIRS_SQL, inp.JSD_SQL, inp.METRICS_SQL))
    + """,
by_type AS (
  SELECT method, sample, cell_type, sqrt(sum((pairs.t - pairs.q) ** 2) / any_value(n_spots)) AS rmse, sum(abs(pairs.t - pairs.q)) / any_value(n_spots) AS mae
  FROM pairs JOIN sized USING (method, sample) GROUP BY ALL)
"""
)


@query("model_scores", SCORES_OF_RUN_SQL + SCORED_SQL.format("sample"))
def model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Whole run of the model: global and fine-tuned proportions scored against the truth."""
    from spotweave.benchmark import benchmark_proportions
    from spotweave.model import SpotModel
    from spotweave.operators.reshape import union_methods

    model = SpotModel(inp.expr(spark, sf), inp.protein_table(spark, sf), inp.spots(spark, sf))
    model.load_profile(inp.profile())
    model.preprocess_antibody(proteins=inp.proteins(spark, sf))
    rough, fine = model.run_proportions(inp.RADIUS, LAM, ALPHA, CAP, TOLERANCE, ROUNDS, n_markers=2)
    scores = benchmark_proportions(inp.truth(inp.counts(spark, sf)), union_methods({"global": rough, "finetuned": fine}))
    return scored_rows(scores)
