"""Queries on metric tables: summaries, tests, samples and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spotweave.functions.scalar import significance
from spotweave.operators import anova, reshape, sampling, summary
from spotweave.plans import inputs as inp
from spotweave.plans.prop_queries import metrics, rounded
from spotweave.plans.registry import query


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as metric rows: method = event type, replicate = user modulo 5."""
    return inp.table(spark, sf, "events").select(
        F.col("event_type").alias("method"), (F.col("user_id") % 5).alias("replicate"), "value"
    )


EVENTS_SQL = "WITH ev AS (SELECT event_type AS method, user_id % 5 AS replicate, value FROM events)\n"


def metric_rows(spark: SparkSession, sf: str) -> DataFrame:
    return inp.metric_rows(metrics(spark, sf))


@query(
    "improvement",
    inp.METRIC_LONG_SQL
    + """SELECT a.sample, a.metric, round(a.value, 6) AS first_value, round(b.value, 6) AS second_value,
       round((a.value - b.value) / a.value * 100, 4) AS improvement_percentage
FROM metric_rows a JOIN metric_rows b ON a.sample = b.sample AND a.metric = b.metric
WHERE a.method = 'restricted' AND b.method = 'quantity'""",
)
def improvement(spark: SparkSession, sf: str) -> DataFrame:
    rows = metric_rows(spark, sf)
    out = summary.improvement(
        rows.where(F.col("method") == "restricted"), rows.where(F.col("method") == "quantity"), ["sample", "metric"]
    )
    return out.withColumns(
        {
            "first_value": F.round("first_value", 6),
            "second_value": F.round("second_value", 6),
            "improvement_percentage": F.round("improvement_percentage", 4),
        }
    )


@query(
    "flip_corr",
    inp.METRIC_LONG_SQL
    + """SELECT method, sample, metric, round(CASE WHEN metric = 'corr' THEN -value ELSE value END, 6) AS value
FROM metric_rows""",
)
def flip_corr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.flip_corr(metric_rows(spark, sf)), "value", digits=6)


@query(
    "metric_pivot",
    inp.METRIC_LONG_SQL
    + "SELECT method, sample, round(jsd, 6) AS jsd, round(sum_rmse, 6) AS sum_rmse, round(sum_mae, 6) AS sum_mae, "
    "round(corr, 6) AS corr FROM metrics",
)
def metric_pivot(spark: SparkSession, sf: str) -> DataFrame:
    names = ["jsd", "sum_rmse", "sum_mae", "corr"]
    return rounded(reshape.metric_pivot(metric_rows(spark, sf), ["method", "sample"], names), *names, digits=6)


@query(
    "metric_unpivot",
    """SELECT l_orderkey, l_linenumber, l_returnflag AS method, m.metric, m.value FROM lineitem,
LATERAL (VALUES ('l_quantity', l_quantity), ('l_extendedprice', l_extendedprice), ('l_discount', l_discount)) m(metric, value)""",
)
def metric_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    wide = inp.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("method"), "l_quantity", "l_extendedprice", "l_discount"
    )
    return reshape.metric_unpivot(
        wide, ["l_orderkey", "l_linenumber", "method"], ["l_quantity", "l_extendedprice", "l_discount"]
    )


@query(
    "collapse_metrics",
    """SELECT l_returnflag AS method, l_linenumber AS replicate, l_linestatus AS reference,
       round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice,
       round(avg(CASE WHEN l_discount <> 0.02 THEN l_discount END), 8) AS l_discount
FROM lineitem GROUP BY 1, 2, 3""",
)
def collapse_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """One discount level is turned into NaN and must not count."""
    rows = inp.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("method"),
        F.col("l_linenumber").alias("replicate"),
        F.col("l_linestatus").alias("reference"),
        "l_quantity",
        "l_extendedprice",
        F.when(F.col("l_discount") == 0.02, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("l_discount"),
    )
    out = summary.collapse_metrics(
        rows, ["method", "replicate", "reference"], ["l_quantity", "l_extendedprice", "l_discount"]
    )
    return out.withColumns(
        {
            "l_quantity": F.round("l_quantity", 6),
            "l_extendedprice": F.round("l_extendedprice", 4),
            "l_discount": F.round("l_discount", 8),
        }
    )


@query(
    "mean_se",
    EVENTS_SQL
    + """SELECT method, replicate, round(avg(v), 6) AS mean_score, round(stddev_samp(v) / sqrt(count(*)), 6) AS se
FROM (SELECT method, replicate, CASE WHEN value >= 20 THEN value END AS v FROM ev) GROUP BY 1, 2""",
)
def mean_se(spark: SparkSession, sf: str) -> DataFrame:
    """Small values are missing, and still count in the divisor."""
    rows = events(spark, sf).withColumn("value", F.when(F.col("value") >= 20, F.col("value")))
    return rounded(summary.mean_se(rows, ["method", "replicate"]), "mean_score", "se", digits=6)


@query(
    "sweep_summary",
    """SELECT l_discount AS lam, l_tax AS alpha, l_returnflag AS metric, round(avg(l_quantity), 6) AS mean,
       round(stddev_pop(l_quantity), 6) AS sd, printf('%.3f (±%.3f)', avg(l_quantity), stddev_pop(l_quantity)) AS label
FROM lineitem GROUP BY 1, 2, 3""",
)
def sweep_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = inp.table(spark, sf, "lineitem").select(
        F.col("l_discount").alias("lam"),
        F.col("l_tax").alias("alpha"),
        F.col("l_returnflag").alias("metric"),
        F.col("l_quantity").alias("value"),
    )
    return rounded(summary.sweep_summary(rows, ["lam", "alpha"]), "mean", "sd", digits=6)


@query(
    "sweep_matrix",
    """SELECT l_returnflag AS metric, l_discount AS lam, round(avg(l_quantity) FILTER (l_linenumber = 1), 6) AS "1",
       round(avg(l_quantity) FILTER (l_linenumber = 2), 6) AS "2", round(avg(l_quantity) FILTER (l_linenumber = 9), 6) AS "9"
FROM lineitem GROUP BY 1, 2""",
)
def sweep_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The point 9 was never run."""
    rows = inp.table(spark, sf, "lineitem").select(
        F.col("l_discount").alias("lam"),
        F.col("l_linenumber").alias("alpha"),
        F.col("l_returnflag").alias("metric"),
        F.col("l_quantity").alias("value"),
    )
    matrix = summary.sweep_matrix(summary.sweep_summary(rows, ["lam", "alpha"]), "lam", "alpha", [1, 2, 9])
    return rounded(matrix, "1", "2", "9", digits=6)


@query(
    "zscore_global",
    """SELECT c_custkey, c_mktsegment, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) AS z
FROM customer""",
)
def zscore_global(spark: SparkSession, sf: str) -> DataFrame:
    rows = inp.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return rounded(summary.zscore(rows, "c_acctbal").drop("c_acctbal"), "z", digits=6)


@query(
    "zscore_by",
    """SELECT c_custkey, c_mktsegment,
       round((c_acctbal - avg(c_acctbal) OVER w) / stddev_samp(c_acctbal) OVER w, 6) AS z
FROM customer WINDOW w AS (PARTITION BY c_mktsegment)""",
)
def zscore_by(spark: SparkSession, sf: str) -> DataFrame:
    rows = inp.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return rounded(summary.zscore(rows, "c_acctbal", ["c_mktsegment"]).drop("c_acctbal"), "z", digits=6)


ANOVA_SQL = (
    EVENTS_SQL.rstrip()
    + """, m AS (SELECT method, count(*) AS n, avg(value) AS mean, var_pop(value) * count(*) AS css FROM ev GROUP BY 1),
g AS (SELECT sum(n * mean) / sum(n) AS grand FROM m),
a AS (SELECT count(*) - 1 AS df_method, CAST(sum(n) AS BIGINT) - count(*) AS df_error,
             sum(n * (mean - grand) ** 2) AS ss_method, sum(css) AS ss_error FROM m, g)
"""
)


@query(
    "anova_oneway",
    ANOVA_SQL
    + """SELECT df_method, df_error, round(ss_method, 4) AS ss_method, round(ss_error, 2) AS ss_error,
       round(ss_method / df_method / (ss_error / df_error), 6) AS f FROM a""",
)
def anova_oneway(spark: SparkSession, sf: str) -> DataFrame:
    out = anova.anova_oneway(events(spark, sf), p_value=False)
    return out.withColumns(
        {"ss_method": F.round("ss_method", 4), "ss_error": F.round("ss_error", 2), "f": F.round("f", 6)}
    )


def f_tail_sql(f: str, df1: str, df2: str) -> str:
    """P(F > f) by the midpoint rule, after the substitution t = exp(-u / a) in the beta integral."""
    a, b = f"({df2} / 2.0)", f"({df1} / 2.0)"
    return f"""CASE WHEN {f} <= 0 THEN 1.0 ELSE exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) / {a} * list_sum(list_transform(
  range(20000), lambda i: 0.002 * exp(-({a} * ln(1 + {df1} * {f} / {df2}) + (i + 0.5) * 0.002))
    * pow(1 - exp(-({a} * ln(1 + {df1} * {f} / {df2}) + (i + 0.5) * 0.002) / {a}), {b} - 1))) END"""


@query(
    "anova_pvalues",
    f"""WITH long AS (
  SELECT l_returnflag AS method, unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS metric,
         unnest([l_quantity, l_extendedprice, l_discount]) AS value FROM lineitem),
m AS (SELECT metric, method, count(*) AS n, avg(value) AS mean, var_pop(value) * count(*) AS css FROM long GROUP BY 1, 2),
g AS (SELECT metric, avg(value) AS grand FROM long GROUP BY 1),
a AS (
  SELECT metric, count(*) - 1 AS df_method, (sum(n) - count(*))::BIGINT AS df_error, sum(n * (mean - grand) ** 2) AS ss_method,
         sum(css) AS ss_error FROM m JOIN g USING (metric) GROUP BY 1),
t AS (SELECT *, ss_method / df_method / (ss_error / df_error) AS f FROM a)
SELECT metric, df_method, df_error, round(f, 6) AS f, round({f_tail_sql("f", "df_method", "df_error")}, 5) AS p FROM t""",
)
def anova_pvalues(spark: SparkSession, sf: str) -> DataFrame:
    """F tests of three line-item measures between return flags, with p."""
    rows = inp.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("method"), "l_quantity", "l_extendedprice", "l_discount"
    )
    long = reshape.metric_unpivot(rows, ["method"], ["l_quantity", "l_extendedprice", "l_discount"])
    out = anova.anova_oneway(long, keys=["metric"])
    return out.select("metric", "df_method", "df_error", F.round("f", 6).alias("f"), F.round("p", 5).alias("p"))


@query(
    "anova_block_keys",
    f"""WITH r AS (SELECT l_linenumber AS line, l_returnflag AS method, l_suppkey AS block, l_quantity AS y FROM lineitem),
g AS (SELECT line, avg(y) AS g, var_pop(y) * count(*) AS yy, count(*) AS n_all FROM r GROUP BY 1),
e AS (
  SELECT line, block, count(*) AS n, sum(y - g) AS t, count(*) FILTER (method = 'A') AS na, count(*) FILTER (method = 'R') AS nr,
         coalesce(sum(y - g) FILTER (method = 'A'), 0) AS ta, coalesce(sum(y - g) FILTER (method = 'R'), 0) AS tr
  FROM r JOIN g USING (line) GROUP BY 1, 2),
m AS (SELECT line, sum(t * t / n) AS by_method FROM (SELECT line, method, sum(y - g) AS t, count(*) AS n FROM r JOIN g USING (line) GROUP BY 1, 2) GROUP BY 1),
q AS (
  SELECT line, sum(na - na * na / n) AS caa, -sum(na * nr / n) AS car, sum(nr - nr * nr / n) AS crr, sum(ta - na * t / n) AS qa,
         sum(tr - nr * t / n) AS qr, sum(t * t / n) AS by_block, count(*) AS blocks FROM e GROUP BY 1),
s AS (
  SELECT line, 2::BIGINT AS df_method, blocks - 1 AS df_block, n_all - blocks - 2 AS df_error, by_method AS ss_method,
         by_block + (crr * qa * qa - 2 * car * qa * qr + caa * qr * qr) / (caa * crr - car * car) AS fitted, yy
  FROM q JOIN m USING (line) JOIN g USING (line)),
t AS (SELECT *, fitted - ss_method AS ss_block, yy - fitted AS ss_error, ss_method / 2 / ((yy - fitted) / df_error) AS f FROM s)
SELECT line, df_method, df_block, df_error, round(ss_method, 4) AS ss_method, round(ss_block, 4) AS ss_block,
       round(ss_error, 4) AS ss_error, round(f, 6) AS f, round({f_tail_sql("f", "df_method", "df_error")}, 5) AS p FROM t""",
)
def anova_block_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Quantity by return flag with suppliers as blocks, for each line number: unbalanced designs with many blocks."""
    rows = inp.table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("method"), F.col("l_suppkey").alias("block"), F.col("l_quantity").alias("value")
    )
    out = anova.anova_block(rows, block="block", keys=["line"])
    digits = {"ss_method": 4, "ss_block": 4, "ss_error": 4, "f": 6, "p": 5}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


BLOCK_SQL = (
    EVENTS_SQL.rstrip()
    + """, c AS (SELECT method, replicate, avg(value) AS y FROM ev GROUP BY 1, 2),
s AS (
  SELECT *, avg(y) OVER () AS g, avg(y) OVER (PARTITION BY method) AS gm, avg(y) OVER (PARTITION BY replicate) AS gb FROM c),
t AS (
  SELECT count(DISTINCT method) - 1 AS df_method, count(DISTINCT replicate) - 1 AS df_block,
         count(*) - count(DISTINCT method) - count(DISTINCT replicate) + 1 AS df_error,
         sum((gm - g) ** 2) AS ss_method, sum((gb - g) ** 2) AS ss_block, sum((y - gm - gb + g) ** 2) AS ss_error FROM s)
"""
)


def _collapsed_events(spark: SparkSession, sf: str) -> DataFrame:
    return summary.collapse_metrics(events(spark, sf), ["method", "replicate"], ["value"])


@query(
    "anova_block",
    BLOCK_SQL
    + """SELECT df_method, df_block, df_error, round(ss_method, 6) AS ss_method, round(ss_block, 6) AS ss_block,
       round(ss_error, 6) AS ss_error, round(ss_method / df_method / (ss_error / df_error), 6) AS f FROM t""",
)
def anova_block(spark: SparkSession, sf: str) -> DataFrame:
    out = anova.anova_block(_collapsed_events(spark, sf), block="replicate", p_value=False)
    return rounded(out, "ss_method", "ss_block", "ss_error", "f", digits=6)


@query(
    "tukey_pairs",
    ANOVA_SQL
    + """SELECT x.method AS group1, y.method AS group2, round(y.mean - x.mean, 6) AS diff,
       round(abs(y.mean - x.mean) / sqrt(ss_error / df_error / 2 * (1 / x.n + 1 / y.n)), 6) AS q,
       (SELECT count(*) FROM m) AS k, df_error
FROM m x JOIN m y ON x.method < y.method, a""",
)
def tukey_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(anova.tukey_pairs(events(spark, sf), p_value=False), "diff", "q", digits=6)


# fixed values: rational approximation of the normal distribution function (Hart 1968, no. 5666), highest power first
_UPPER_SQL = [3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
_LOWER_SQL = [8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]


def cdf_sql(z: str) -> str:
    """Normal distribution function of a column ``z``."""

    def horner(values: list[float]) -> str:
        out = repr(values[0])
        for v in values[1:]:
            out = f"({out} * abs({z}) + {v!r})"
        return out

    half = f"CASE WHEN abs({z}) < 7.07 THEN exp(-0.5 * {z} * {z}) * {horner(_UPPER_SQL)} / {horner(_LOWER_SQL)} ELSE 0 END"
    return f"(CASE WHEN {z} > 0 THEN 1 - ({half}) ELSE {half} END)"


@query(
    "tukey_pvalues",
    BLOCK_SQL.rstrip()
    + f""", e AS (SELECT method, avg(y) AS mean, count(*) AS n FROM c GROUP BY 1),
pairs AS (
  SELECT x.method AS group1, o.method AS group2, o.mean - x.mean AS diff,
         abs(o.mean - x.mean) / sqrt(ss_error / df_error / 2 * (1 / x.n + 1 / o.n)) AS q, (SELECT count(*) FROM e) AS k, df_error
  FROM e x JOIN e o ON x.method = 'purchase' AND o.method <> 'purchase', t),
nodes AS (SELECT -8.5 + (i + 0.5) * 17.0 / 800 AS z FROM range(800) r(i)),
phi AS (SELECT z, exp(-0.5 * z * z) / sqrt(2 * pi()) * 17.0 / 800 AS phi, {cdf_sql("z")} AS cdf FROM nodes),
scale AS (
  SELECT group1, group2, q, k, s, exp((df_error - 1) * ln(s) - 0.5 * df_error * (s - 1) * (s + 1)) AS p
  FROM (SELECT *, (i + 0.5) * (1 + 9 / sqrt(2 * df_error)) / 800 AS s FROM pairs, range(800) r(i))),
gaps AS (SELECT group1, group2, k, s, p, phi, cdf, z - q * s AS x FROM scale, phi),
inside AS (SELECT group1, group2, s, any_value(p) AS p, any_value(k) * sum(phi * pow(greatest(cdf - {cdf_sql("x")}, 0), k - 1)) AS below FROM gaps GROUP BY 1, 2, 3),
tails AS (SELECT group1, group2, 1 - sum(p * below) / sum(p) AS p_adj FROM inside GROUP BY 1, 2)
SELECT group1, group2, round(diff, 6) AS diff, round(q, 6) AS q, k, df_error, round(p_adj, 5) AS p_adj,
       CASE WHEN p_adj <= 0.001 THEN '***' WHEN p_adj <= 0.01 THEN '**' WHEN p_adj <= 0.05 THEN '*' ELSE 'ns' END AS signif
FROM pairs JOIN tails USING (group1, group2)""",
)
def tukey_pvalues(spark: SparkSession, sf: str) -> DataFrame:
    """Comparisons of one method with the others in the block design, with p and stars."""
    rows = _collapsed_events(spark, sf)
    errors = anova.anova_block(rows, block="replicate", p_value=False)
    out = anova.tukey_pairs(rows, focal="purchase", errors=errors)
    return rounded(out, "diff", "q", digits=6).withColumn("p_adj", F.round("p_adj", 5))


@query(
    "signif_bin",
    """WITH p AS (SELECT round(l_discount * l_tax * 12.5, 6) AS p, count(*) AS n FROM lineitem GROUP BY 1)
SELECT p, n,
  CASE WHEN p <= 0 THEN NULL WHEN p <= 0.001 THEN '***' WHEN p <= 0.01 THEN '**' WHEN p <= 0.05 THEN '*' WHEN p <= 1 THEN 'ns' END AS open_right,
  CASE WHEN p < 0 THEN NULL WHEN p <= 0.001 THEN '***' WHEN p <= 0.01 THEN '**' WHEN p <= 0.05 THEN '*' WHEN p <= 1 THEN 'ns' END AS with_zero,
  CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' WHEN p < 1 THEN 'NS' END AS left_closed
FROM p""",
)
def signif_bin(spark: SparkSession, sf: str) -> DataFrame:
    p = F.round(F.col("l_discount") * F.col("l_tax") * 12.5, 6)
    rows = inp.table(spark, sf, "lineitem").groupBy(p.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumns(
        {
            "open_right": significance(F.col("p")),
            "with_zero": significance(F.col("p"), include_lowest=True),
            "left_closed": significance(F.col("p"), right=False, ns="NS"),
        }
    )


@query(
    "type_counts",
    inp.with_sql(inp.CELLS_SQL)
    + """SELECT cell_type, count(*) AS n_cells, count(*) FILTER (restricted) AS n_part,
       round(count(*) FILTER (restricted) / count(*), 8) AS ratio FROM cells GROUP BY 1""",
)
def type_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = inp.cells(spark, sf)
    return rounded(summary.count_ratio(rows.where("restricted"), rows), "ratio")


@query(
    "describe_totals",
    inp.with_sql(inp.EXPR_SQL)
    + """, totals AS (SELECT sample, spot, sum(value) AS total FROM expr GROUP BY 1, 2)
SELECT sample, count(*) AS n, round(avg(total), 6) AS mean, round(stddev_samp(total), 6) AS sd, min(total) AS min,
       max(total) AS max, quantile_cont(total, 0.25) AS q1, quantile_cont(total, 0.5) AS median,
       quantile_cont(total, 0.75) AS q3 FROM totals GROUP BY 1""",
)
def describe_totals(spark: SparkSession, sf: str) -> DataFrame:
    totals = inp.expr(spark, sf).groupBy("sample", "spot").agg(F.sum("value").alias("total"))
    return rounded(summary.describe(totals, ["sample"], "total"), "mean", "sd", digits=6)


@query(
    "box_stats",
    EVENTS_SQL.rstrip()
    + """, q AS (SELECT method, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q3 FROM ev GROUP BY 1)
SELECT method, min(value) FILTER (inside) AS lower, max(value) FILTER (inside) AS upper, round(avg(value), 6) AS mean,
       count(*) FILTER (NOT inside) AS n_outliers, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
       round(any_value(q3), 6) AS q3
FROM (SELECT *, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM ev JOIN q USING (method))
GROUP BY 1""",
)
def box_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        summary.box_stats(events(spark, sf).select("method", "value"), ["method"], "value"),
        "mean", "q1", "median", "q3", digits=6,
    )


RESAMPLES = 50


def _mixed_sql(x: str) -> str:
    """The mixer of the draws on unsigned 64-bit numbers held in 128 bits."""
    wide = 1 << 64
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        # the 128-bit product wraps by halves: low half times factor, and high half times factor modulo 2^32
        y = f"xor({x}, {x} // {1 << shift}::UHUGEINT)"
        x = f"(({y} % 4294967296 * {factor}::UHUGEINT + ({y} // 4294967296 * {factor}::UHUGEINT) % 4294967296 * 4294967296) % {wide}::UHUGEINT)"
    return f"xor({x}, {x} // {1 << 31}::UHUGEINT)"


@query(
    "bootstrap_ci",
    EVENTS_SQL.rstrip()
    + f""", merged AS (SELECT method, value AS v, count(*) AS n FROM ev WHERE value IS NOT NULL GROUP BY 1, 2),
parts AS (
  SELECT method, v, least(16, n - 16 * part) AS n,
         ('0x' || substr(md5('1:' || method || ':' || v || ':' || part), 1, 15))::BIGINT AS h
  FROM (SELECT *, unnest(range(0, (n - 1) // 16 + 1)) AS part FROM merged)),
start AS (
  SELECT method, v, n, b, (h::UHUGEINT + (b::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT) % {1 << 64}::UHUGEINT) % {1 << 64}::UHUGEINT AS x
  FROM parts, range(1, {RESAMPLES + 1}) r(b)),
drawn AS (SELECT method, v, n, b, (({_mixed_sql("x")} // 2048)::DOUBLE + 0.5) / 9007199254740992.0 AS u FROM start),
cdf AS (
  SELECT n, k, sum(exp(k * ln(n) - n - lgamma(k + 1))) OVER (PARTITION BY n ORDER BY k) AS below
  FROM range(1, 17) a(n), range(0, 120) c(k)),
lists AS (SELECT n, list(below ORDER BY k) AS below FROM cdf GROUP BY n),
weights AS (SELECT method, v, b, len(list_filter(below, lambda c: c <= u)) AS w FROM drawn JOIN lists USING (n)),
means AS (SELECT method, b, sum(w * v) / sum(w) AS mean FROM weights GROUP BY 1, 2 HAVING sum(w) > 0),
ends AS (SELECT method, quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high FROM means GROUP BY 1)
SELECT method, round(mean, 6) AS mean, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high
FROM (SELECT method, avg(value) AS mean FROM ev GROUP BY 1) JOIN ends USING (method)""",
)
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.bootstrap_ci(events(spark, sf), ["method"], "value", RESAMPLES), "mean", "ci_low", "ci_high", digits=6)


@query(
    "metric_domain",
    """SELECT metric, min(value) AS min, max(value) AS max, quantile_cont(value, 0.5) AS median
FROM (SELECT 'price' AS metric, l_extendedprice AS value FROM lineitem
      UNION ALL SELECT 'quantity', l_quantity FROM lineitem) GROUP BY 1""",
)
def metric_domain(spark: SparkSession, sf: str) -> DataFrame:
    wide = inp.table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity")
    )
    return summary.metric_domain(reshape.metric_unpivot(wide, [], ["price", "quantity"]))


@query(
    "union_methods",
    """SELECT 'lines' AS method, l_orderkey AS cell, l_quantity AS score, l_tax AS extra FROM lineitem
UNION ALL SELECT 'events', event_id, value, NULL FROM events""",
)
def union_methods(spark: SparkSession, sf: str) -> DataFrame:
    lines = inp.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("cell"), F.col("l_quantity").alias("score"), F.col("l_tax").alias("extra")
    )
    ev = inp.table(spark, sf, "events").select(F.col("event_id").alias("cell"), F.col("value").alias("score"))
    return reshape.union_methods({"lines": lines, "events": ev})


@query(
    "factor_order",
    """SELECT method, n, CAST(list_position(['view', 'click', 'purchase', 'signup', 'error'], method) AS INTEGER) AS level,
       CASE method WHEN 'view' THEN '30k cells' WHEN 'click' THEN '8k cells' ELSE method END AS label
FROM (SELECT event_type AS method, count(*) AS n FROM events GROUP BY 1)""",
)
def factor_order(spark: SparkSession, sf: str) -> DataFrame:
    counts = events(spark, sf).groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    levels = reshape.ranked(counts, "method", ["view", "click", "purchase", "signup", "error"])
    return reshape.relabel(levels.withColumn("label", F.col("method")), "label", {"view": "30k cells", "click": "8k cells"})


def sample_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as cells with an id; the types are unbalanced by their status."""
    return inp.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("cell"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(F.col("o_orderstatus")).alias("cell_type"),
    )


QUOTA_SQL = """WITH c AS (SELECT CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE o_orderstatus END AS cell_type,
                 count(*) AS available FROM orders GROUP BY 1),
q AS (SELECT *, CAST(round_even(available / sum(available) OVER () * 1200, 0) AS BIGINT) AS quota FROM c),
g AS (SELECT *, 1200 - CAST(sum(quota) OVER () AS BIGINT) AS gap,
             row_number() OVER (ORDER BY quota DESC, available DESC, cell_type) AS top,
             row_number() OVER (ORDER BY quota, available DESC, cell_type) AS low FROM q)
"""


@query(
    "stratified_sample",
    QUOTA_SQL
    + """SELECT cell_type, quota + CASE WHEN gap > 0 AND top = 1 THEN gap WHEN gap < 0 AND low = 1 THEN gap ELSE 0 END AS sampled,
       quota + CASE WHEN gap > 0 AND top = 1 THEN gap WHEN gap < 0 AND low = 1 THEN gap ELSE 0 END AS different
FROM g""",
)
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the drawn sample per type, and its different cells."""
    drawn = sampling.stratified_sample(sample_cells(spark, sf), 1200)
    return drawn.groupBy("cell_type").agg(
        F.count(F.lit(1)).alias("sampled"), F.count_distinct("cell").alias("different")
    )


CELLS_SQL = """cells AS (
  SELECT o_orderkey AS cell, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE o_orderstatus END AS cell_type,
         ('0x' || substr(md5('412:' || o_orderkey), 1, 15))::BIGINT AS h FROM orders)"""


@query(
    "stratified_rows",
    QUOTA_SQL.rstrip()
    + ",\n"
    + CELLS_SQL
    + """, drawn AS (
  SELECT cells.*, row_number() OVER (PARTITION BY cell_type ORDER BY h, cell) AS r,
         quota + CASE WHEN gap > 0 AND top = 1 THEN gap WHEN gap < 0 AND low = 1 THEN gap ELSE 0 END AS quota
  FROM cells JOIN g USING (cell_type))
SELECT cell, cell_type FROM drawn WHERE r <= quota""",
)
def stratified_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified_sample(sample_cells(spark, sf), 1200)


@query("uniform_sample", f"WITH {CELLS_SQL} SELECT cell, cell_type FROM cells ORDER BY h, cell LIMIT 1000")
def uniform_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.uniform_sample(sample_cells(spark, sf), 1000)


@query(
    "sweep_grid",
    """SELECT sample, run_id, [0.001, 1.0][run_id // 6 + 1]::DOUBLE AS lam, [0.1, 0.7][run_id // 3 % 2 + 1]::DOUBLE AS alpha,
       [0.1, 0.2, 0.4][run_id % 3 + 1]::DOUBLE AS cap
FROM (SELECT DISTINCT l_orderkey % 5 AS sample FROM lineitem), (SELECT CAST(unnest(range(12)) AS INTEGER) AS run_id)""",
)
def sweep_grid(spark: SparkSession, sf: str) -> DataFrame:
    runs = inp.table(spark, sf, "lineitem").select((F.col("l_orderkey") % 5).alias("sample")).distinct()
    return sampling.sweep_grid(runs, lam=[0.001, 1.0], alpha=[0.1, 0.7], cap=[0.1, 0.2, 0.4])
