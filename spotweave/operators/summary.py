"""Replicate summaries, sweeps, scaling and spread of metric tables."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from spotweave.functions.scalar import mean_sd_label, safe_ratio
from spotweave.operators.order_stats import exact_quantiles
from spotweave.session import stored
from spotweave.tables import nan_to_null

# workers get the resampling helper with the task and need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def improvement(first: DataFrame, second: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Percent by which ``second`` lowers the metric of ``first``."""
    a = first.select(*keys, F.col(value).alias("first_value"))
    b = second.select(*keys, F.col(value).alias("second_value"))
    gain = safe_ratio(F.col("first_value") - F.col("second_value"), F.col("first_value")) * 100
    return a.join(b, list(keys)).withColumn("improvement_percentage", gain)


def collapse_metrics(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric column per group, missing and NaN values skipped."""
    return nan_to_null(rows, metrics).groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def mean_se(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean and standard error. The divisor counts missing values as well."""
    return (
        nan_to_null(rows, [value])
        .groupBy(*keys)
        .agg(
            F.avg(value).alias("mean_score"),
            (F.stddev_samp(value) / F.sqrt(F.count(F.lit(1)))).alias("se"),
        )
    )


def sweep_summary(rows: DataFrame, point: Sequence[str], metric: str = "metric", value: str = "value") -> DataFrame:
    """Mean, population deviation and label per parameter point and metric."""
    return (
        rows.groupBy(*point, metric)
        .agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
        .withColumn("label", mean_sd_label(F.col("mean"), F.col("sd")))
    )


def sweep_matrix(summary: DataFrame, row: str, col: str, columns: Sequence[float], metric: str = "metric") -> DataFrame:
    """Means as a matrix; points that were not run stay NULL."""
    return summary.groupBy(metric, row).pivot(col, list(columns)).agg(F.first("mean"))


def zscore(rows: DataFrame, value: str, by: Sequence[str] = (), out: str = "z") -> DataFrame:
    """Centre and scale by the sample deviation, over all rows or per group."""
    stats = rows.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    if by:
        joined = rows.join(stored(stats, "stats"), list(by))
    else:
        joined = rows.withColumns({c: stats.select(c).scalar() for c in ("_mean", "_sd")})
    return joined.withColumn(out, safe_ratio(F.col(value) - F.col("_mean"), F.col("_sd"))).drop("_mean", "_sd")


def flip_corr(rows: DataFrame, metric: str = "metric", value: str = "value", name: str = "corr") -> DataFrame:
    """Negate the correlation so that lower is better for every metric."""
    return rows.withColumn(value, F.when(F.col(metric) == name, -F.col(value)).otherwise(F.col(value)))


def type_counts(cells: DataFrame, by: Sequence[str] = ("cell_type",)) -> DataFrame:
    return cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cells"))


def count_ratio(part: DataFrame, whole: DataFrame, by: Sequence[str] = ("cell_type",)) -> DataFrame:
    """Share of the cells of each type found in ``part``; absent types give NULL."""
    n = type_counts(part, by).withColumnRenamed("n_cells", "n_part")
    return type_counts(whole, by).join(n, list(by), "left").withColumn("ratio", F.col("n_part") / F.col("n_cells"))


def describe(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum."""
    rows = nan_to_null(rows, [value])
    keys = list(keys)
    basic = rows.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    quart = exact_quantiles(rows, keys, value, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    if keys:
        return basic.join(quart, keys)
    return basic.withColumns({c: quart.select(c).scalar() for c in ("q1", "median", "q3")})


def box_stats(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Whiskers within 1.5 interquartile ranges, quartiles, mean and outlier count."""
    rows = nan_to_null(rows, [value])
    keys = list(keys)
    q = exact_quantiles(rows, keys, value, [0.25, 0.5, 0.75], ["q1", "median", "q3"]).withColumns(
        {
            "_lo": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
            "_hi": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")),
        }
    )
    q = stored(q, "quartiles")
    v = F.col(value)
    inside = (v >= F.col("_lo")) & (v <= F.col("_hi"))
    spread = (
        rows.join(q, keys)
        .groupBy(*keys)
        .agg(
            F.min(F.when(inside, v)).alias("lower"),
            F.max(F.when(inside, v)).alias("upper"),
            F.avg(v).alias("mean"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )
    return spread.join(q.drop("_lo", "_hi"), keys)


def metric_domain(rows: DataFrame, keys: Sequence[str] = ("metric",), value: str = "value") -> DataFrame:
    """Minimum, median and maximum per metric: the anchors of a colour scale."""
    rows = nan_to_null(rows, [value])
    ends = rows.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"))
    return ends.join(exact_quantiles(rows, keys, value, [0.5], ["median"]), list(keys))


#: Copies of a value that are drawn together; more copies are the sum of several such draws.
PART = 16
#: Groups whose sums a task holds at once.
HELD_GROUPS = 500


def _uniforms(h: np.ndarray, resamples: int) -> np.ndarray:
    """A number in (0, 1) for each hash and resample, by a counter-based mixer (splitmix64) that knows no order of rows."""
    with np.errstate(over="ignore"):
        x = h.astype(np.uint64)[:, None] + (np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _poisson(rates: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Poisson draws of the rates 1 to ``PART`` by inversion: the number of k whose distribution function is at most ``u``."""
    out = np.empty(u.shape)
    for rate in np.unique(rates):
        ks = np.arange(0, 120)
        log_p = ks * np.log(rate) - rate - np.concatenate([[0.0], np.cumsum(np.log(ks[1:]))])
        pick = rates == rate
        out[pick] = np.searchsorted(np.cumsum(np.exp(log_p)), u[pick], side="right")
    return out


def bootstrap_ci(
    rows: DataFrame, keys: Sequence[str], value: str, resamples: int = 1000, level: float = 0.95, seed: int = 1
) -> DataFrame:
    """Percentile bootstrap interval of the mean by Poisson weights.

    Equal values are merged first: the weights of n copies add up to a Poisson
    number of rate n. It is drawn as the sum of independent parts of rate ``PART``
    and one of the rest, each by inversion of its distribution, so every count of
    copies is drawn in the same, exact way. A part's draws are fixed by the MD5
    of seed, keys, value and part. Sums of all parts of a task leave it as one row for each group.
    """
    keys = list(keys)
    merged = (
        nan_to_null(rows.select(*keys, F.col(value).cast("double").alias("_v")), ["_v"])
        .where(F.col("_v").isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    merged = stored(merged, "merged_values")
    last = F.floor((F.col("_n") - 1) / PART)
    parts = merged.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    name = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in [*keys, "_v", "_part"]))
    parts = parts.select(
        *keys,
        "_v",
        F.least(F.lit(PART), F.col("_n") - PART * F.col("_part")).alias("_n"),
        # 60 bits: exact in a bigint
        F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint").alias("_h"),
    )
    fields = [f"`{k}` {merged.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*fields, "_sw array<double>", "_sx array<double>"])

    def partial(batches):
        held: dict[tuple, list[np.ndarray]] = {}

        def rows_of() -> pd.DataFrame:
            return pd.DataFrame([(*key, *sums) for key, sums in held.items()], columns=[*keys, "_sw", "_sx"])

        for pdf in batches:
            for start in range(0, len(pdf), 2000):
                part = pdf.iloc[start : start + 2000].reset_index(drop=True)
                w = _poisson(part["_n"].to_numpy(), _uniforms(part["_h"].to_numpy(), resamples))
                v = part["_v"].to_numpy()
                groups = part.groupby(keys, sort=False, dropna=False).indices if keys else {(): np.arange(len(part))}
                for key, idx in groups.items():
                    key = key if isinstance(key, tuple) else (key,)
                    sums = held.setdefault(key, [np.zeros(resamples), np.zeros(resamples)])
                    sums[0] += w[idx].sum(axis=0)
                    sums[1] += v[idx] @ w[idx]
                if len(held) > HELD_GROUPS:
                    yield rows_of()
                    held.clear()
        if held:
            yield rows_of()

    sums = (
        parts.mapInPandas(partial, schema)
        .select(*keys, F.posexplode(F.arrays_zip("_sw", "_sx")).alias("_b", "_s"))
        .groupBy(*keys, "_b")
        .agg(F.sum("_s._sw").alias("_sw"), F.sum("_s._sx").alias("_sx"))
        .where(F.col("_sw") > 0)
        .withColumn("_mean", F.col("_sx") / F.col("_sw"))
    )
    tail = (1.0 - level) / 2.0
    # a group has `resamples` means here, so the built-in percentile is safe
    ci = sums.groupBy(*keys).agg(
        F.percentile("_mean", F.lit(tail)).alias("ci_low"), F.percentile("_mean", F.lit(1.0 - tail)).alias("ci_high")
    )
    mean = merged.groupBy(*keys).agg((F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean"))
    return mean.join(ci, keys) if keys else mean.withColumns({c: ci.select(c).scalar() for c in ("ci_low", "ci_high")})
