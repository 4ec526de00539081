"""Cell-type proportions from antibodies, and expression per cell type.

Proportions travel as one column per cell type: the types are the entries of
the marker profile given by the caller, so their number is small and known,
and all arithmetic stays in generated code without exploding rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from spotweave.operators.blocks import Blocks, Move, block_plan, smoothed
from spotweave.operators.normalize import ClrParts
from spotweave.operators.spatial import AT, WORK, cell_plan, in_range, neighbor_sums, placed, sources_at, targets_at
from spotweave.session import Bucketed, dealt, dealt_by_some_keys, forget, stored

SPOT = ("sample", "spot")


def _p(i: int) -> str:
    return f"p_{i}"


def to_wide(prop: DataFrame, types: Sequence[str], by: Sequence[str] = SPOT) -> DataFrame:
    """One row per spot, columns ``p_0 .. p_{K-1}`` in the order of ``types``; a share of another type is an error."""
    wrong = F.raise_error(F.concat(F.lit("cell type not in the profile: "), F.coalesce(F.col("cell_type").cast("string"), F.lit("null"))))
    known = F.col("cell_type").isin(list(types)) | (F.coalesce(F.col("p"), F.lit(0.0)) == 0)
    prop = prop.withColumn("p", F.when(F.coalesce(known, F.lit(False)), F.col("p")).otherwise(wrong.cast("double")))
    return prop.groupBy(*by).agg(
        *[F.sum(F.when(F.col("cell_type") == t, F.col("p")).otherwise(0.0)).alias(_p(i)) for i, t in enumerate(types)]
    )


def to_long(wide: DataFrame, types: Sequence[str], by: Sequence[str] = SPOT, keep_zero: bool = True) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(t).alias("cell_type"), F.col(_p(i)).alias("p")) for i, t in enumerate(types)])
    out = wide.select(*by, F.inline(rows))
    return out if keep_zero else out.where(F.col("p") != 0)


def _total(cols: Sequence[Column]) -> Column:
    return reduce(add, cols)


def _share(cols: Sequence[Column], otherwise: Sequence[Column]) -> list[Column]:
    total = _total(cols)
    return [F.when(total > 0, c / total).otherwise(o) for c, o in zip(cols, otherwise)]


def _even_share(signal: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    """Signals ``p_i`` scaled to sum 1; a spot with no signal gets equal shares."""
    cols = [F.col(_p(i)) for i in range(k)]
    return signal.select(*by, *[c.alias(_p(i)) for i, c in enumerate(_share(cols, [F.lit(1.0 / k)] * k))])


def marker_props(clr: DataFrame, marker: DataFrame, types: Sequence[str], by: Sequence[str] = SPOT) -> DataFrame:
    """Global proportions: mean marker signal per type, cut at 0, scaled to sum 1.

    ``clr`` is dense. The result is wide.
    """
    means = [
        F.greatest(
            F.coalesce(F.avg(F.when(F.col("cell_type") == t, F.col("value"))), F.lit(0.0)), F.lit(0.0)
        ).alias(_p(i))
        for i, t in enumerate(types)
    ]
    signal = clr.join(marker.select("protein", "cell_type"), "protein").groupBy(*by).agg(*means)
    return _even_share(signal, len(types), by)


def marker_props_sparse(parts: ClrParts, marker: DataFrame, types: Sequence[str], by: Sequence[str] = SPOT) -> DataFrame:
    """The same from the parts of a sparse antibody table.

    The mean over the markers of a type is that of their zeros, plus what the
    nonzero rows add, less the centre of the spot. Only nonzero rows of
    markers are shuffled, once.
    """
    k = len(types)
    named = marker.select("protein", "cell_type")
    within = [c for c in by if c != "spot"]

    def per_type(value: Column, name: str) -> list[Column]:
        return [
            F.sum(F.when(F.col("cell_type") == t, value).otherwise(0.0)).alias(f"{name}_{i}") for i, t in enumerate(types)
        ]

    added = parts.facts.join(named, "protein").groupBy(*by).agg(*per_type(F.col("a") - F.col("b"), "a"))
    zeros = parts.base.join(named, "protein").groupBy(*within).agg(*per_type(F.col("b"), "b"), *per_type(F.lit(1.0), "n"))
    rows = parts.centre.join(added, list(by), "left").join(zeros, within)
    signal = [
        F.when(
            F.col(f"n_{i}") > 0,
            F.greatest(
                (F.coalesce(F.col(f"a_{i}"), F.lit(0.0)) + F.col(f"b_{i}")) / F.col(f"n_{i}") - F.col("centre"), F.lit(0.0)
            ),
        )
        .otherwise(0.0)
        .alias(_p(i))
        for i in range(k)
    ]
    return _even_share(rows.select(*by, *signal), k, by)


@dataclass
class _Point:
    """A parameter point of a run: its settings, and how it ended."""

    run_id: int
    lam: float
    alpha: float
    cap: float
    steps: int = 0
    settled: bool = False

    def move(self, steps: int, k: int) -> Move:
        pull = self.lam * (1 - self.alpha)
        return Move(pull, self.lam * self.alpha / (k * (1 + pull)), self.cap, steps)


def _literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _moved(points: Sequence[_Point], live: Sequence[int], k: int) -> Column:
    """New ``p`` (an array of shares for each point) from ``e``, ``p``, and sums ``s`` of the live points over ``s_n`` rows in range."""
    pull, threshold, cap = (_literal(v) for v in list(zip(*(q.move(1, k) for q in points)))[:3])
    slot = F.array(*[F.lit(live.index(j) if j in live else -1) for j in range(len(points))])
    others = F.col("s_n") - 1

    def point(own: Column, j: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            e = F.get("e", i)
            mean = F.when(others > 0, (F.get("s", F.get(slot, j) * k + i) - p) / others).otherwise(e)
            z = F.greatest((e + F.get(pull, j) * mean) / (1 + F.get(pull, j)) - F.get(threshold, j), F.lit(0.0))
            return F.greatest(p + F.least(F.greatest(z - p, -F.get(cap, j)), F.get(cap, j)), F.lit(0.0))

        def scaled(y: Column) -> Column:
            total = F.aggregate(y, F.lit(0.0), lambda a, b: a + b)
            return F.when(total > 0, F.transform(y, lambda v: v / total)).otherwise(own)

        return F.when(F.get(slot, j) >= 0, F.get(F.transform(F.array(F.transform(own, one)), scaled), F.lit(0))).otherwise(own)

    return F.transform("p", point)


def _refine_step(state: DataFrame, plan: DataFrame, on: Sequence[str], radius: float, points: Sequence[_Point], k: int) -> DataFrame:
    """One smoothing step of all points that haven't settled; adds ``delta``, the largest change for each point.

    The spots wait where they were placed before the first step; only the
    sources move, once for all points, summed by position before.
    """
    live = [j for j, q in enumerate(points) if not q.settled]
    width = len(live) * k
    shares = [F.get(F.get("p", F.lit(j)), F.lit(i)) for j in live for i in range(k)]
    piles = state.groupBy(*on, F.col(AT[0]).alias("near_x"), F.col(AT[1]).alias("near_y")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"q_{m}") for m, c in enumerate(shares)]
    )
    piles = piles.select("sample", "near_x", "near_y", "n", F.array(*[f"q_{m}" for m in range(width)]).alias("q"))
    # merge joins also for little data: the files are dealt by these keys, so the spots don't move
    waiting = state.select(*on, "spot", *AT).hint("merge")
    pairs = in_range(waiting, sources_at(piles, radius, plan), on, radius)
    sums = pairs.groupBy(*on, "spot").agg(
        F.sum("n").alias("s_n"), *[F.sum(F.get("q", F.lit(m))).alias(f"s_{m}") for m in range(width)]
    )
    sums = sums.select(*on, "spot", "s_n", F.array(*[f"s_{m}" for m in range(width)]).alias("s"))
    both = state.hint("merge").join(sums, [*on, "spot"]).withColumn("fresh", _moved(points, live, k))
    gap = F.transform(
        F.arrays_zip(F.col("p").alias("a"), F.col("fresh").alias("b")),
        lambda x: F.array_max(F.zip_with(x["a"], x["b"], lambda a, b: F.abs(a - b))),
    )
    return both.select(*on, "spot", *AT, "e", F.col("fresh").alias("p"), gap.alias("delta"))


def refine_props(
    global_props: DataFrame,
    spots: DataFrame,
    types: Sequence[str],
    radius: float = 4.0,
    params: dict | Sequence[dict] | None = None,
    tolerance: float = 1e-4,
    max_iterations: int = 20,
    work: int = WORK,
) -> DataFrame:
    """Spatially fine-tuned proportions (wide), for one or many parameter points.

    Also ``steps``, the steps made, and ``converged``, whether the last one changed
    nothing by ``tolerance`` or more. A list of points (``run_id``, ``lam``,
    ``alpha``, ``cap``) adds ``run_id``; a single one (a dict) doesn't.

    The shares of all points are an array in the row of their spot. Spots are smoothed in blocks, several steps for
    one shuffle; where they lie too densely for a block to fit a task, a step at a time, by pairs in grid cells.
    A point that has settled keeps its state and moves no more, so it ends as in a run of its own.
    """
    single = params is None or isinstance(params, dict)
    given = [params or {"lam": 0.001, "alpha": 0.7, "cap": 0.2}] if single else params
    points = [_Point(int(q.get("run_id", 0)), *(float(q[c]) for c in ("lam", "alpha", "cap"))) for q in given]
    k = len(types)
    start = F.array(*[_p(i) for i in range(k)])
    rows = stored(placed(global_props, spots).select(*SPOT, *AT, start.alias("e")), "start")
    blocks = block_plan(rows, radius, len(points) * k, work)
    if blocks:
        done = _refined_in_blocks(rows, blocks, radius, points, k, tolerance, max_iterations)
    else:
        done = _refined_by_pairs(rows, radius, points, k, tolerance, max_iterations, work)
    runs = F.array(
        *[
            F.struct(
                F.lit(q.run_id).alias("run_id"),
                *[F.get(F.get("p", F.lit(j)), F.lit(i)).alias(_p(i)) for i in range(k)],
                F.lit(q.steps).alias("steps"),
                F.lit(q.settled).alias("converged"),
            )
            for j, q in enumerate(points)
        ]
    )
    out = done.select(*SPOT, F.inline(runs))
    return out.drop("run_id") if single else out


def _block_round(state: DataFrame, blocks: Blocks, radius: float, moves: dict[int, Move], n: int, k: int) -> tuple[DataFrame, dict[int, list[float]]]:
    """The state after ``n`` steps or fewer of the points in ``moves``, and the largest change of each of them by step."""
    live = list(moves)
    others = [j for j in range(n) if j not in moves]
    flat = F.flatten(F.array(*[F.get("p", F.lit(j)) for j in live])).alias("p")
    rest = [F.array(*[F.get("p", F.lit(j)) for j in others]).alias("rest")] if others else []
    out = smoothed(state.select(*SPOT, *AT, "e", flat, *rest), blocks, radius, k, list(moves.values()))
    seen = Observation()
    out = out.observe(seen, *[F.max(F.get("gaps", F.lit(i))).alias(f"gap_{i}") for i in range(blocks.steps * len(live))])
    p = F.array(*[F.slice("p", live.index(j) * k + 1, k) if j in moves else F.get("rest", F.lit(others.index(j))) for j in range(n)])
    out = stored(out.select(*SPOT, *AT, "e", p.alias("p")), "state")
    return out, {j: [seen.get[f"gap_{t * len(live) + i}"] or 0.0 for t in range(blocks.steps)] for i, j in enumerate(live)}


def _refined_in_blocks(
    rows: DataFrame, blocks: Blocks, radius: float, points: Sequence[_Point], k: int, tolerance: float, max_iterations: int
) -> DataFrame:
    """``refine_props`` by blocks; a round in which a point settles before its last step is made again with so many steps of it."""
    state, last, made = rows.withColumn("p", F.array_repeat("e", len(points))), rows, 0
    while made < max_iterations and not all(q.settled for q in points):
        n = min(blocks.steps, max_iterations - made)
        steps = {j: n for j, q in enumerate(points) if not q.settled}
        ends: dict[int, int] = {}
        for again in (False, True):
            moves = {j: points[j].move(ends.get(j, s), k) for j, s in steps.items()}
            fresh, gaps = _block_round(state, blocks._replace(steps=n), radius, moves, len(points), k)
            if again:
                break
            ends = {j: t for j, g in gaps.items() for t in [next((t for t, v in enumerate(g, 1) if v < tolerance), 0)] if t}
            if all(t == n for t in ends.values()):
                break
            forget(fresh)
        for j, s in steps.items():
            points[j].steps, points[j].settled = made + ends.get(j, s), j in ends
        forget(last)
        state, last, made = fresh, fresh, made + n
    return state


def _refined_by_pairs(
    rows: DataFrame, radius: float, points: Sequence[_Point], k: int, tolerance: float, max_iterations: int, work: int
) -> DataFrame:
    """``refine_props`` by pairs of a target and a pile of sources.

    Spots are placed on the grid once, in a stored table that is dealt to files by
    grid cell. So a step is one job over
    cells that stay where they are: distances are found once for all points,
    and the largest changes are noted while the new state is written. The state before is then deleted.
    """
    plan = cell_plan(rows, rows, radius, work=work)
    waiting, on = targets_at(rows, radius, plan, ["sample", "spot"])
    columns = [*on, "spot", *AT, "e", F.array_repeat("e", len(points)).alias("p")]
    state = Bucketed(waiting.select(*columns), "state", on)
    forget(rows)
    for step in range(1, max_iterations + 1):
        seen = Observation()
        gaps = [F.max(F.get("delta", F.lit(j))).alias(f"gap_{j}") for j in range(len(points))]
        moved = _refine_step(state.rows, plan, on, radius, points, k).observe(seen, *gaps).drop("delta")
        before = state
        with dealt_by_some_keys(moved.sparkSession):
            state = Bucketed(moved, "state", on)
        before.delete()
        for j, q in enumerate(points):
            if not q.settled:
                q.steps, q.settled = step, (seen.get[f"gap_{j}"] or 0.0) < tolerance
        if all(q.settled for q in points):
            break
    return state.plain()


def weighted_layers(expr: DataFrame, prop: DataFrame) -> DataFrame:
    """Expression split by weights: value times share, per type."""
    return (
        expr.join(prop.where(F.col("p") != 0), list(SPOT))
        .select("sample", "cell_type", "spot", "gene", (F.col("value") * F.col("p")).alias("value"))
    )


def _weights(props: DataFrame, k: int) -> DataFrame:
    """Sums ``w_i`` of the shares of each type over all spots; stored: a row for each sample."""
    return stored(props.groupBy("sample").agg(*[F.sum(_p(i)).alias(f"w_{i}") for i in range(k)]), "weights")


def _means(rows: DataFrame, values: Sequence[Column], name: str, k: int) -> DataFrame:
    """``rows`` with the weighted means ``<name>_i`` of ``values`` over all spots, per (sample, gene), from sums ``w_i`` of the shares.

    Zeros count: the divisor is the sum of shares over all spots of the sample.
    """
    gene = W.partitionBy("sample", "gene")
    return rows.withColumns(
        {f"{name}_{i}": F.when(F.col(f"w_{i}") > 0, F.sum(v * F.col(_p(i))).over(gene) / F.col(f"w_{i}")).otherwise(0.0) for i, v in enumerate(values)}
    )


def _with_profiles(expr: DataFrame, props: DataFrame, k: int) -> DataFrame:
    """Expression with ``p_i`` and ``w_i`` of its spot and sample, and the profile ``m_i`` of each type for its gene.

    The rows of a gene of a sample (one for each spot at most) are brought together once; every later step per gene leaves them there.
    """
    rows = dealt(_with_props(expr, props, k), expr.count(), "sample", "gene")
    return _means(rows.join(_weights(props, k), "sample"), [F.col("value")] * k, "m", k)


def _parts(k: int) -> list[Column]:
    """A value shared out by ``p_i * m_i``; the parts sum to the value.

    Where no type has weight, the shares ``p_i`` alone decide.
    """
    weights = [F.col(_p(i)) * F.col(f"m_{i}") for i in range(k)]
    shares = _share(weights, _share([F.col(_p(i)) for i in range(k)], [F.lit(0.0)] * k))
    return [F.col("value") * s for s in shares]


def _split(expr_pm: DataFrame, types: Sequence[str], ledger: Observation | None = None) -> DataFrame:
    """One row per (spot, gene, type) with its part of the value; ``ledger`` notes the values and the parts on their way."""
    parts = _parts(len(types))
    if ledger is not None:
        expr_pm = expr_pm.observe(ledger, F.sum("value").alias("input"), F.sum(_total(parts)).alias("output"))
    rows = F.array(*[F.struct(F.lit(t).alias("cell_type"), p.alias("value")) for t, p in zip(types, parts)])
    return (
        expr_pm.select("sample", "spot", "gene", F.inline(rows))
        .where(F.col("value") != 0)
        .select("sample", "cell_type", "spot", "gene", "value")
    )


def _with_props(expr: DataFrame, props: DataFrame, k: int) -> DataFrame:
    """Expression with the shares of its spot; expression of a spot without shares is an error, as it would be lost."""
    n = expr.count()
    own = dealt(props.select(*SPOT, *[_p(i) for i in range(k)]), n, *SPOT)
    met = dealt(expr.select("sample", "spot", "gene", "value"), n, *SPOT).join(own, list(SPOT), "left")
    lost = F.raise_error(F.concat_ws(" ", F.lit("expression of a spot with no shares:"), F.col("sample").cast("string"), F.col("spot").cast("string")))
    return met.withColumns({_p(i): F.coalesce(F.col(_p(i)), lost.cast("double")) for i in range(k)})


def mass_ledger(expr: DataFrame, layers: DataFrame) -> DataFrame:
    """sample, input, output, lost: sums of the expression and of its parts, in one grouping.

    Parts add up to the whole unless a spot has no shares above 0. For one pass alone, give the
    expression pass an ``Observation`` instead: it notes both sums while the pass is written.
    """
    both = expr.select("sample", F.col("value").alias("input"), F.lit(0.0).alias("output")).unionByName(
        layers.select("sample", F.lit(0.0).alias("input"), F.col("value").alias("output"))
    )
    sums = both.groupBy("sample").agg(F.sum("input").alias("input"), F.sum("output").alias("output"))
    return sums.withColumn("lost", F.col("input") - F.col("output"))


def expr_pass1(expr: DataFrame, props: DataFrame, types: Sequence[str], ledger: Observation | None = None) -> DataFrame:
    """Expression per type with one profile per (sample, type).

    ``props`` is wide. Rows stay one per nonzero until the final split.
    """
    return _split(_with_profiles(expr, props, len(types)), types, ledger)


def wide_layers(expr: DataFrame, props: DataFrame, types: Sequence[str]) -> DataFrame:
    """``weighted`` and ``pass1``, arrays by type, for each (sample, spot, gene): the rows of ``weighted_layers`` and ``expr_pass1``, NULL where they have none."""
    k = len(types)
    met = _with_profiles(expr, props, k)
    weighted = [F.when(F.col(_p(i)) != 0, F.col("value") * F.col(_p(i))) for i in range(k)]
    return met.select("sample", "spot", "gene", F.array(*weighted).alias("weighted"), F.array(*[F.nullif(v, F.lit(0.0)) for v in _parts(k)]).alias("pass1"))


def expr_pass1_local(
    expr: DataFrame, props: DataFrame, spots: DataFrame, types: Sequence[str], radius: float
) -> DataFrame:
    """Pass 1 with profiles from the spots within ``radius`` only, own spot included.

    A profile is needed only for genes found in the spot itself, so the rows of a gene are brought together
    once. There they are summed by position, listed at the places of the grid in their reach, and met by the targets of that place.
    """
    k = len(types)
    cols = [_p(i) for i in range(k)]
    at = placed(props.select(*SPOT, *cols), spots)
    plan = cell_plan(at, at, radius)
    weighted = stored(neighbor_sums(at, at, radius, cols, plan, prefix="w_").drop("w_n"), "around")
    around, n = [f"w_{c}" for c in cols], expr.count()
    targets = dealt(expr.select("sample", "spot", "gene", "value"), n, *SPOT).join(dealt(weighted, n, *SPOT), list(SPOT), "left")
    lost = F.raise_error(F.concat_ws(" ", F.lit("expression of a spot with no shares:"), F.col("sample").cast("string"), F.col("spot").cast("string")))
    targets = targets.withColumns({c: F.coalesce(F.col(c), lost.cast("double")) for c in [*cols, *around]})
    # a row is at about four places
    rows = dealt(targets, 4 * n, "sample", "gene")
    pile = W.partitionBy("sample", "gene", *AT)
    rows = rows.withColumn("_first", F.row_number().over(pile.orderBy("spot")) == 1)
    rows = rows.withColumns({f"x_{i}": F.sum(F.col("value") * F.col(c)).over(pile) for i, c in enumerate(cols)})
    place = ["_cx", "_cy", "_sub", "_part"]
    homes, on = targets_at(rows, radius, plan, ["sample", "gene", "spot"], ["sample", "gene"])
    homes = homes.withColumn("_home", F.struct(*place)).drop(*place).withColumnsRenamed({AT[0]: "near_x", AT[1]: "near_y"})
    sources = [F.col(c) for c in ("near_x", "near_y", *(f"x_{i}" for i in range(k)))]
    listed = sources_at(homes, radius, plan).select(
        *on,
        *sources,
        F.when(F.struct(*place) == F.col("_home"), F.struct("spot", "value", *cols, *around)).alias("target"),
        F.when(F.col("_first"), F.struct(*sources)).alias("source"),
    )
    listed = listed.where(F.col("target").isNotNull() | F.col("source").isNotNull())
    met = listed.withColumn("near", F.collect_list("source").over(W.partitionBy(*on))).where(F.col("target").isNotNull())

    def in_reach(o: Column) -> Column:
        dx, dy = F.col("near_x") - o["near_x"], F.col("near_y") - o["near_y"]
        return dx * dx + dy * dy <= float(radius) ** 2

    def total(name: str) -> Column:
        return F.aggregate("near", F.lit(0.0), lambda a, o: a + o[name])

    met = met.select("sample", "gene", "target.*", F.filter("near", in_reach).alias("near"))
    sums = [total(f"x_{i}") for i in range(k)]
    local = [F.when(F.col(w) > 0, sums[i] / F.col(w)).otherwise(0.0).alias(f"m_{i}") for i, w in enumerate(around)]
    return _split(met.select("sample", "spot", "gene", "value", *cols, *local), types)


def expr_prior(layers: DataFrame, prop: DataFrame) -> DataFrame:
    """Weighted mean of pass-1 expression over spots, per (sample, type, gene)."""
    weight = prop.groupBy("sample", "cell_type").agg(F.sum("p").alias("_w"))
    return (
        layers.join(prop, ["sample", "spot", "cell_type"])
        .groupBy("sample", "cell_type", "gene")
        .agg(F.sum(F.col("value") * F.col("p")).alias("_x"))
        .join(weight, ["sample", "cell_type"])
        .select("sample", "cell_type", "gene", (F.col("_x") / F.col("_w")).alias("prior"))
    )


def pass1_prior(expr: DataFrame, props: DataFrame, types: Sequence[str]) -> DataFrame:
    """``expr_prior`` of ``expr_pass1``: types become rows only after the grouping."""
    k = len(types)
    parts = _parts(k)
    sums = _with_profiles(expr, props, k).groupBy("sample", "gene").agg(
        *[F.any_value(f"w_{i}").alias(f"w_{i}") for i in range(k)],
        *[F.sum(F.when(part != 0, part * F.col(_p(i)))).alias(f"x_{i}") for i, part in enumerate(parts)],
    )
    rows = F.array(*[F.struct(F.lit(t).alias("cell_type"), (F.col(f"x_{i}") / F.col(f"w_{i}")).alias("prior")) for i, t in enumerate(types)])
    # no sum: no spot has a part of this type
    return sums.select("sample", "gene", F.inline(rows)).where(F.col("prior").isNotNull()).select("sample", "cell_type", "gene", "prior")


def expr_pass2(
    expr: DataFrame,
    props: DataFrame,
    types: Sequence[str],
    prior_weight: float = 0.5,
    prior: DataFrame | None = None,
    ledger: Observation | None = None,
) -> DataFrame:
    """Pass 1 with profiles mixed with the prior: ``(1 - w) * profile + w * prior``.

    ``prior`` is the long result of ``expr_prior``; without it the prior of
    pass 1 is computed here.
    """
    k = len(types)
    own, w = _with_profiles(expr, props, k), float(prior_weight)
    if prior is None:
        both = _means(own, _parts(k), "r", k)
    else:
        wide = prior.groupBy("sample", "gene").agg(
            *[
                F.sum(F.when(F.col("cell_type") == t, F.col("prior")).otherwise(0.0)).alias(f"r_{i}")
                for i, t in enumerate(types)
            ]
        )
        both = own.join(stored(wide, "prior"), ["sample", "gene"], "left")
    mixed = [((1 - w) * F.col(f"m_{i}") + w * F.coalesce(F.col(f"r_{i}"), F.lit(0.0))).alias(f"m_{i}") for i in range(k)]
    return _split(both.select("sample", "spot", "gene", "value", *[_p(i) for i in range(k)], *mixed), types, ledger)
