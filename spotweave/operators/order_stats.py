"""Exact quantiles of groups of any size, one way for all.

Values are counted per group, then dealt to ranges of (group, value), so a group
that holds a third of the table is spread over many tasks. The weight of each
range, summed over the ranges before it, gives the rank at which a range begins;
within a range the running sum gives the rank of each value. No task holds more
than a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spotweave.session import stored


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    weight: str | None = None,
    nan_result: bool = False,
) -> DataFrame:
    """Quantiles by linear interpolation (numpy's default), one row per group.

    NULL values are skipped. NaN values are skipped too, unless
    ``nan_result``, where one NaN makes the quantiles of its group NaN.
    ``weight`` is a column of repeat counts, e.g. to add implicit zeros.
    Groups with no usable value are absent, except NaN groups under
    ``nan_result``.
    """
    keys = list(keys)
    repeat = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = stored(
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(repeat.cast("bigint").alias("_n"))
        .where(F.col("_n") > 0),
        "counted",
    )
    finite = counted.where(~F.isnan("_v"))
    out = _ranked_quantiles(finite, keys, probs, names)
    if not keys:
        return out
    if nan_result:
        broken = counted.groupBy(*keys).agg(F.max(F.isnan("_v").cast("int")).alias("_nan"))
        out = broken.join(out, keys, "left").select(
            *keys, *[F.when(F.col("_nan") == 1, F.lit(float("nan"))).otherwise(F.col(n)).alias(n) for n in names]
        )
    return out


def _ranked_quantiles(finite: DataFrame, keys: list[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Quantiles of counted values by exact ranks within ranges."""
    ids = keys or ["_all"]
    finite = finite if keys else finite.withColumn("_all", F.lit(0))
    ranged = stored(finite.repartitionByRange(*ids, "_v").withColumn("_range", F.spark_partition_id()), "ranges")
    # one row for each group and range
    weights = ranged.groupBy(*ids, "_range").agg(F.sum("_n").alias("_in_range"))
    all_of = W.partitionBy(*ids)
    before = all_of.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = weights.select(
        *ids,
        "_range",
        F.coalesce(F.sum("_in_range").over(before), F.lit(0)).alias("_offset"),
        F.sum("_in_range").over(all_of).alias("_total"),
    )
    positions = [F.lit(float(p)) * (F.col("_total") - 1) for p in probs]
    ranks = [r for pos in positions for r in (F.floor(pos), F.ceil(pos))]

    def holds(start, count):
        hit = F.lit(False)
        for r in ranks:
            hit = hit | ((r >= start) & (r < start + count))
        return hit

    inside = W.partitionBy(*ids, "_range").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    located = (
        ranged.join(starts, [*ids, "_range"])
        .withColumn("_start", F.col("_offset") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .where(holds(F.col("_start"), F.col("_n")))
    )

    def value_at(rank):
        return F.max(F.when((rank >= F.col("_start")) & (rank < F.col("_start") + F.col("_n")), F.col("_v")))

    picks = []
    for i, pos in enumerate(positions):
        picks += [
            value_at(F.floor(pos)).alias(f"_lo{i}"),
            value_at(F.ceil(pos)).alias(f"_hi{i}"),
            F.max(pos - F.floor(pos)).alias(f"_f{i}"),
        ]
    found = located.groupBy(*ids).agg(*picks)
    out = found.select(
        *ids,
        *[
            F.when(F.col(f"_lo{i}") == F.col(f"_hi{i}"), F.col(f"_lo{i}"))
            .otherwise((1 - F.col(f"_f{i}")) * F.col(f"_lo{i}") + F.col(f"_f{i}") * F.col(f"_hi{i}"))
            .alias(n)
            for i, n in enumerate(names)
        ],
    )
    return out if keys else out.drop("_all")


#: Bits of a digit, digits of a hash, and rows of a slot that are ranked at once.
DIGIT, DIGITS, RANKED = 15, 4, 4096


def seeded_hash(order: Sequence[str], seed: int) -> Column:
    """60 bits of the MD5 of the seed and the columns, as a bigint."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in order))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def first_by_hash(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    quota: DataFrame | int,
    seed: int,
    ranked: int = RANKED,
) -> DataFrame:
    """Rows with the smallest seeded hashes, ``quota`` per group; a group with fewer rows is an error.

    A radix selection. The hashes are read in digits: the rows of a group are
    counted by their first digit, and the slot is found in which the quota is reached. Slots before it
    are taken whole; in it the next digit decides in the same way, until the
    slot has ``ranked`` rows at most, which are ranked. So neither a hot group nor a
    sample of a whole table is ever sorted in one task. The borders, one row per
    group, are stored, so Spark knows that they are small. ``quota`` is a number, or a table
    of ``keys`` plus ``quota``; groups without a quota give no rows.
    """
    # a constant key, so that joins have a key also without ``keys``
    groups = [*keys, "_all"]
    hashed = df.withColumns({"_all": F.lit(0), "_h": seeded_hash(order, seed)})
    wanted = hashed.groupBy(*groups).agg(F.count(F.lit(1)).alias("_held"))
    if isinstance(quota, int):
        wanted = wanted.withColumn("_left", F.lit(quota).cast("bigint"))
    else:
        wanted = wanted.join(quota.withColumnRenamed("quota", "_left"), list(keys))
    # the number of rows with a hash below ``_low`` that are taken whole, and what is left to take in the slot that begins there
    borders = stored(wanted.withColumn("_low", F.lit(0).cast("bigint")).select(*groups, "_low", "_left", "_held"), "borders")
    short = borders.where(F.col("_held") < F.col("_left")).limit(3).collect()
    if short or (isinstance(quota, int) and quota > 0 and borders.isEmpty()):
        raise ValueError(f"more rows are asked for than there are, e.g. {[r.asDict() for r in short]}")
    for digit in range(DIGITS):
        rest = DIGIT * (DIGITS - 1 - digit)  # bits of the digits that follow
        open_ = hashed.join(borders.where("_left > 0"), groups)
        inside = open_.where((F.col("_h") >= F.col("_low")) & (F.shiftright(F.col("_h") - F.col("_low"), rest + DIGIT) == 0))
        slot = F.shiftright(F.col("_h") - F.col("_low"), rest)
        # at most 2**DIGIT rows per group
        counts = inside.groupBy(*groups, "_low", "_left", slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
        run = F.coalesce(F.sum("_n").over(W.partitionBy(*groups).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        reached = counts.withColumn("_before", run).where((F.col("_before") < F.col("_left")) & (F.col("_before") + F.col("_n") >= F.col("_left")))
        next_low = F.col("_low") + F.shiftleft(F.col("_slot"), rest)
        borders = stored(reached.select(*groups, next_low.alias("_low"), (F.col("_left") - F.col("_before")).alias("_left"), F.col("_n").alias("_held")), "borders")
        if (borders.agg(F.max("_held")).first()[0] or 0) <= ranked:
            break
    met = hashed.join(borders, groups)
    whole = met.where(F.col("_h") < F.col("_low"))
    slot_rows = met.where((F.col("_h") >= F.col("_low")) & (F.shiftright(F.col("_h") - F.col("_low"), rest) == 0))
    rank = F.row_number().over(W.partitionBy(*groups).orderBy("_h", *order))
    taken = slot_rows.withColumn("_r", rank).where(F.col("_r") <= F.col("_left")).drop("_r")
    return whole.unionByName(taken).select(*(F.col(f"`{c}`") for c in df.columns))
