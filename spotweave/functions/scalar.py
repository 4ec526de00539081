"""Column expressions built only from Spark built-ins."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def counts_from_log(value: Column) -> Column:
    """Counts behind log1p values, rounded half to even."""
    return F.rint(F.expm1(value))


def log_counts(value: Column) -> Column:
    return F.log1p(value)


def safe_ratio(num: Column, den: Column, zero_as: float | None = None) -> Column:
    """``num / den``; a zero divisor gives ``zero_as`` (NULL by default)."""
    return F.when(den != 0, num / den).otherwise(F.lit(zero_as).cast("double"))


def entropy_term(a: Column, m: Column) -> Column:
    """``a * log2(a / m)`` with 0 for ``a = 0``."""
    return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))


def significance(p: Column, right: bool = True, include_lowest: bool = False, ns: str = "ns") -> Column:
    """Bins of a p value: 0, .001, .01, .05, 1 give ``***``, ``**``, ``*``, ``ns``.

    ``right`` closes bins on the right, and then p = 0 falls in no bin unless
    ``include_lowest``. Left-closed bins leave p = 1 out unless
    ``include_lowest``.
    """
    if right:
        low = (p >= 0) if include_lowest else (p > 0)
        return (
            F.when(low & (p <= 0.001), "***")
            .when((p > 0.001) & (p <= 0.01), "**")
            .when((p > 0.01) & (p <= 0.05), "*")
            .when((p > 0.05) & (p <= 1), ns)
        )
    high = (p <= 1) if include_lowest else (p < 1)
    return (
        F.when((p >= 0) & (p < 0.001), "***")
        .when((p >= 0.001) & (p < 0.01), "**")
        .when((p >= 0.01) & (p < 0.05), "*")
        .when((p >= 0.05) & high, ns)
    )


def last_token(name: Column, sep: str = "_") -> Column:
    return F.element_at(F.split(name, sep), -1)


def underscored(name: Column) -> Column:
    return F.translate(name, " ", "_")


def spaced(name: Column) -> Column:
    return F.translate(name, "_", " ")


def strip_pass(file_name: Column) -> Column:
    """``x_layer_pass1`` becomes ``x_layer``."""
    return F.regexp_replace(file_name, "_layer_pass\\d+", "_layer")


def canonical_type(name: Column) -> Column:
    """One spelling for ``Cancer Epithelial`` and ``Cancer_Epithelial``."""
    return underscored(F.trim(name))


def id_number(spot: Column) -> Column:
    """Number in ids like ``spot_12``; NULL when there is none."""
    return F.regexp_extract(spot, "_(\\d+)", 1).try_cast("bigint")


def mean_sd_label(mean: Column, sd: Column) -> Column:
    return F.when(mean.isNotNull(), F.format_string("%.3f (±%.3f)", mean, sd)).otherwise(F.lit("N/A"))
