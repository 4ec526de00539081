"""Radius neighbourhoods, labels and map tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spotweave.operators.joins import attach_coords
from spotweave.session import stored

AT = ("spot_x", "spot_y")
#: Pairs of a target and a source that meet under one key, about.
WORK = 1 << 20
#: Targets of a part at least: a source is copied to no more parts than a 64th of the pairs it makes.
LEAST = 64
#: How often a grid cell is halved at most.
DEEPEST = 5


def placed(rows: DataFrame, spots: DataFrame, by: Sequence[str] = ("sample", "spot")) -> DataFrame:
    """Rows with the coordinates of their spot; a row whose spot has none is an error where it is used."""
    out = rows.join(spots.select(*by, *AT), list(by), "left")
    lost = F.raise_error(F.concat_ws(" ", F.lit("spot without coordinates:"), *(F.col(c).cast("string") for c in by)))
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), lost.cast("double")) for c in AT})


def _side(radius: float) -> float:
    return 2.0 * float(radius)


def _home(df: DataFrame, radius: float) -> DataFrame:
    """Grid cell ``_cx, _cy`` that holds each row."""
    return df.withColumns({k: F.floor(F.col(c) / _side(radius)) for k, c in zip(("_cx", "_cy"), AT)})


def _reach(df: DataFrame, radius: float) -> DataFrame:
    """Each row in every grid cell that its circle may touch: about four."""

    def cells(c: str):
        low, high = (F.floor((F.col(c) + m) / _side(radius)) for m in (-_margin(c, radius), _margin(c, radius)))
        return F.explode(F.sequence(low, high))

    return df.withColumn("_cx", cells(AT[0])).withColumn("_cy", cells(AT[1]))


def _fine(value: Column, cell: str, level: Column, radius: float) -> Column:
    """Number of the part of a grid cell, halved ``level`` times, that holds a coordinate; never falls as it grows."""
    parts = F.pow(F.lit(2.0), level)
    at = F.floor((value - F.col(cell) * _side(radius)) * parts / _side(radius))
    return F.least(F.greatest(at, F.lit(0).cast("bigint")), parts.cast("bigint") - 1)


def _margin(c: str, radius: float) -> Column:
    # a little wider than the radius, so that rounding never loses a neighbour
    return F.lit(radius * (1 + 1e-9)) + F.abs(F.col(c)) * 1e-15


def _with_quarters(rows: DataFrame, level: Column, radius: float) -> DataFrame:
    """Sources of a grid cell in every quarter ``_sub`` of it that their circle may touch."""
    for c, cell, out in (*zip(AT, ("_cx", "_cy"), ("_sx", "_sy")),):
        low, high = (_fine(F.col(c) + m, cell, level, radius) for m in (-_margin(c, radius), _margin(c, radius)))
        rows = rows.withColumn(out, F.explode(F.sequence(low, high)))
    return rows.withColumn("_sub", F.col("_sx") * (1 << DEEPEST) + F.col("_sy")).drop("_sx", "_sy")


def _quarter(level: Column, radius: float) -> Column:
    return _fine(F.col(AT[0]), "_cx", level, radius) * (1 << DEEPEST) + _fine(F.col(AT[1]), "_cy", level, radius)


def cell_plan(
    targets: DataFrame, sources: DataFrame, radius: float, within: Sequence[str] = ("sample",), work: int = WORK, piled: bool = True
) -> DataFrame:
    """How dense grid cells are split: a quadtree by the product of targets and sources, then parts of targets.

    A cell with more than ``work`` pairs of a target and a source in reach is
    quartered until the pairs of a quarter would be about ``work`` if its spots lay evenly
    (``_level``). Quarters that are still denser get parts (``_parts``: quarter to number), by the
    hash of the target, of ``LEAST`` targets or more. Sources go only to the
    quarters in their reach, so quartering also leaves out pairs. Cells without a row are not
    split. ``piled``: sources are summed by position before they meet targets.
    """
    at = [*within, "_cx", "_cy"]
    home = _home(targets.select(*within, *AT), radius)
    reach = sources.select(*within, *AT)
    reach = _reach(reach.distinct() if piled else reach, radius)
    pairs = F.col("_t") * F.col("_s").cast("double") / work
    sizes = home.groupBy(*at).agg(F.count(F.lit(1)).alias("_t")).join(reach.groupBy(*at).agg(F.count(F.lit(1)).alias("_s")), at)
    level = F.least(F.ceil(F.log2(pairs) / 2), F.lit(DEEPEST)).cast("int").alias("_level")
    dense = stored(sizes.where(pairs > 1).select(*at, level), "dense_cells")
    level = F.col("_level")
    held = home.join(dense, at).groupBy(*at, _quarter(level, radius).alias("_sub")).agg(F.count(F.lit(1)).alias("_t"))
    met = _with_quarters(reach.join(dense, at), level, radius).groupBy(*at, "_sub").agg(F.count(F.lit(1)).alias("_s"))
    parts = F.least(F.ceil(pairs), F.ceil(F.col("_t") / LEAST)).cast("int")
    split = held.join(met, [*at, "_sub"]).withColumn("_n", parts).where(F.col("_n") > 1)
    # at most 4^DEEPEST quarters for a cell
    maps = split.groupBy(*at).agg(F.map_from_entries(F.collect_list(F.struct("_sub", "_n"))).alias("_parts"))
    return stored(dense.join(maps, at, "left"), "cell_plan")


def targets_at(
    targets: DataFrame, radius: float, plan: DataFrame, spread: Sequence[str], keys: Sequence[str] = ("sample",)
) -> tuple[DataFrame, list[str]]:
    """Targets with the one place ``_cx, _cy, _sub, _part`` where they wait for sources, and the columns to join on."""
    at = [c for c in plan.columns if c not in ("_level", "_parts")]
    rows = _home(targets, radius).join(plan, at, "left")
    rows = rows.withColumn("_sub", _quarter(F.coalesce("_level", F.lit(0)), radius))
    parts = F.coalesce(F.try_element_at("_parts", F.col("_sub")), F.lit(1))
    return rows.withColumn("_part", F.pmod(F.xxhash64(*spread), parts)).drop("_level", "_parts"), [*keys, "_cx", "_cy", "_sub", "_part"]


def sources_at(sources: DataFrame, radius: float, plan: DataFrame) -> DataFrame:
    """Sources ``near_x, near_y`` at every place where targets in their reach may wait."""
    at = [c for c in plan.columns if c not in ("_level", "_parts")]
    rows = _reach(sources.withColumnsRenamed({"near_x": AT[0], "near_y": AT[1]}), radius).join(plan, at, "left")
    rows = _with_quarters(rows, F.coalesce("_level", F.lit(0)), radius)
    parts = F.coalesce(F.try_element_at("_parts", F.col("_sub")), F.lit(1)).cast("bigint")
    rows = rows.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    return rows.drop("_level", "_parts").withColumnsRenamed({AT[0]: "near_x", AT[1]: "near_y"})


def in_range(placed_targets: DataFrame, placed_sources: DataFrame, on: Sequence[str], radius: float) -> DataFrame:
    """Targets and sources that wait at the same place and are within ``radius``; ``_d2`` is the square of their distance."""
    dx, dy = F.col(AT[0]) - F.col("near_x"), F.col(AT[1]) - F.col("near_y")
    joined = placed_targets.join(placed_sources, list(on)).withColumn("_d2", dx * dx + dy * dy)
    return joined.where(F.col("_d2") <= float(radius) ** 2)


def radius_neighbors(spots: DataFrame, radius: float, within: Sequence[str] = ("sample",), work: int = WORK) -> DataFrame:
    """Pairs of different spots within ``radius``; the output is these pairs.

    For sums or means over neighbours use ``neighbor_sums``, which lists no
    pairs of spots.
    """
    s = spots.select(*within, "spot", *AT)
    other = s.withColumnsRenamed({"spot": "neighbor", AT[0]: "near_x", AT[1]: "near_y"})
    plan = cell_plan(s, s, radius, within, work, piled=False)
    waiting, on = targets_at(s, radius, plan, ["spot"], within)
    pairs = in_range(waiting, sources_at(other, radius, plan), on, radius)
    return pairs.where(F.col("spot") != F.col("neighbor")).select(
        *within, "spot", "neighbor", F.sqrt("_d2").alias("distance")
    )


def neighbor_sums(
    targets: DataFrame,
    sources: DataFrame,
    radius: float,
    columns: Sequence[str],
    plan: DataFrame,
    keys: Sequence[str] = ("sample",),
    row: Sequence[str] = ("spot",),
    prefix: str = "near_",
) -> DataFrame:
    """Targets with sums of source ``columns`` over all sources within ``radius``.

    Sources are summed by position (and ``keys``) first: a pile of copies on one
    position is one row, so sums stay linear in the rows. ``row`` names, with
    ``keys``, one target. ``<prefix>n`` counts source rows; a target is its own
    neighbour. A target never leaves its place of the ``plan``, so its sums need no shuffle
    after the join. Targets without any source in range are dropped.
    """
    keys = list(keys)
    piles = (
        sources.groupBy(*keys, F.col(AT[0]).alias("near_x"), F.col(AT[1]).alias("near_y"))
        .agg(F.count(F.lit(1)).alias(f"{prefix}n"), *[F.sum(c).alias(f"{prefix}{c}") for c in columns])
    )
    waiting, on = targets_at(targets, radius, plan, [*keys, *row], keys)
    pairs = in_range(waiting, sources_at(piles, radius, plan), on, radius)
    carried = [c for c in targets.columns if c not in {*keys, *row}]
    return (
        pairs.groupBy(*on, *row)
        .agg(
            *[F.any_value(c).alias(c) for c in carried],
            F.sum(f"{prefix}n").alias(f"{prefix}n"),
            *[F.sum(f"{prefix}{c}").alias(f"{prefix}{c}") for c in columns],
        )
        .drop("_cx", "_cy", "_sub", "_part")
    )


def neighbor_counts(spots: DataFrame, radius: float, within: Sequence[str] = ("sample",), work: int = WORK) -> DataFrame:
    """Number of other spots within ``radius`` of each spot."""
    s = spots.select(*within, "spot", *AT)
    sums = neighbor_sums(s, s, radius, [], cell_plan(s, s, radius, within, work), within)
    return sums.select(*within, "spot", (F.col("near_n") - 1).alias("n_neighbors"))


def dominant_type(prop: DataFrame, by: Sequence[str] = ("sample", "spot")) -> DataFrame:
    """Type with the largest share; ties go to the first name."""
    return (
        prop.groupBy(*by)
        .agg(F.min_by(F.struct("cell_type", "p"), F.struct(-F.col("p"), F.col("cell_type"))).alias("_top"))
        .select(*by, F.col("_top.cell_type").alias("cell_type"), F.col("_top.p").alias("p"))
    )


def spatial_wide(
    prop: DataFrame, spots: DataFrame, types: Sequence[str], by: Sequence[str] = ("method", "sample", "spot")
) -> DataFrame:
    """Map table: spot, coordinates and one column per cell type."""
    wide = prop.groupBy(*by).pivot("cell_type", list(types)).agg(F.sum("p")).fillna(0.0, list(types))
    return attach_coords(wide, spots)


def append_props(spot_table: DataFrame, prop: DataFrame, types: Sequence[str]) -> DataFrame:
    """Spot table with one proportion column per type; spots without any keep NULL."""
    wide = prop.groupBy("sample", "spot").pivot("cell_type", list(types)).agg(F.sum("p"))
    return spot_table.join(wide, ["sample", "spot"], "left")


def natural_order(spots: DataFrame, within: Sequence[str] = (), spot: str = "spot") -> DataFrame:
    """Total order of spot ids by their number, ids without one last.

    This sorts the result globally by ranges, which needs no single task.
    """
    from spotweave.functions.scalar import id_number

    return spots.orderBy(*within, id_number(F.col(spot)).asc_nulls_last(), F.col(spot))
