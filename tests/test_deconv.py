"""Neighbourhoods and deconvolution against brute force in numpy."""

import re

import numpy as np
import pytest
from pyspark.sql import Observation, functions as F

from spotweave.model import SpotModel
from spotweave.operators import blocks, deconv, normalize, spatial
from spotweave.operators.sampling import sweep_points
from spotweave.session import dealt, stored
from spotweave.sources.text import marker_table

TYPES = ["t0", "t1", "t2"]


@pytest.fixture(scope="module")
def slide():
    """Random spots, a third of them copies of one position, and one far away."""
    rng = np.random.default_rng(2)
    xy = rng.integers(0, 12, (60, 2)).astype(float) - 4
    xy[:20] = xy[0]
    xy[59] = 500
    return xy


@pytest.fixture(scope="module")
def spots(spark, slide):
    rows = [("s", i, float(x), float(y)) for i, (x, y) in enumerate(slide)]
    return spark.createDataFrame(rows, "sample string, spot int, spot_x double, spot_y double")


def near(xy, r):
    d = ((xy[:, None, :] - xy[None, :, :]) ** 2).sum(-1)
    m = d <= r * r
    np.fill_diagonal(m, False)
    return m


@pytest.mark.parametrize("radius", [1.0, 2.5, 4.0])
def test_radius_neighbors(spots, slide, radius):
    m = near(slide, radius)
    got = {(r.spot, r.neighbor) for r in spatial.radius_neighbors(spots, radius).collect()}
    assert got == set(zip(*map(lambda a: a.tolist(), np.nonzero(m))))
    assert all((b, a) in got for a, b in got)
    counts = {r.spot: r.n_neighbors for r in spatial.neighbor_counts(spots, radius).collect()}
    assert [counts[i] for i in range(60)] == m.sum(1).tolist()


@pytest.mark.parametrize("work", [1, 20, 100])
def test_dense_cells_are_split_exactly(spots, slide, monkeypatch, work):
    monkeypatch.setattr(spatial, "LEAST", 3)
    m = near(slide, 2.5)
    plan = spatial.cell_plan(spots, spots, 2.5, work=work)
    assert plan.agg(F.max("_level")).first()[0] >= 1
    if work == 1:  # a third of the spots on one position can't be quartered, so they are in parts
        assert max(max(r._parts.values()) for r in plan.where("_parts IS NOT NULL").collect()) >= 3
    out = spatial.neighbor_sums(spots, spots.withColumn("v", F.col("spot") * 1.0), 2.5, ["v"], plan).collect()
    got = {r.spot: (r.near_n, r.near_v) for r in out}
    full = m + np.eye(60, dtype=bool)
    assert [got[i][0] for i in range(60)] == full.sum(1).tolist()
    assert [got[i][1] for i in range(60)] == (full @ np.arange(60.0)).tolist()
    pairs = {(r.spot, r.neighbor) for r in spatial.radius_neighbors(spots, 2.5, work=work).collect()}
    assert pairs == set(zip(*map(lambda a: a.tolist(), np.nonzero(m))))


def test_dense_cell_loads_no_task(spark):
    """Half of all spots in one cell: pairs by task, as dealt by the join keys, are within 3 times the median."""
    rng = np.random.default_rng(1)
    n = 6000
    xy = np.concatenate([rng.random((n // 2, 2)) * 2, rng.random((n // 2, 2)) * 60])
    spots = spark.createDataFrame([("s", i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "sample string, spot int, spot_x double, spot_y double")
    near_spots = spots.withColumnsRenamed({"spot_x": "near_x", "spot_y": "near_y"})

    def loads(work):
        plan = spatial.cell_plan(spots, spots, 1.0, work=work)
        a, on = spatial.targets_at(spots, 1.0, plan, ["spot"])
        b = spatial.sources_at(near_spots, 1.0, plan)
        size = a.groupBy(*on).agg(F.count("*").alias("t")).join(b.groupBy(*on).agg(F.count("*").alias("s")), on)
        task = F.pmod(F.hash(*on), F.lit(8))
        return sorted(r.w for r in size.groupBy(task.alias("task")).agg(F.sum(F.col("t") * F.col("s")).alias("w")).collect())

    even, one = loads(4000), loads(1 << 40)
    assert len(even) == 8 and even[-1] <= 3 * even[4]
    assert one[-1] > 8 * one[4] and sum(even) < sum(one)


def step(e, p, m, lam, alpha, cap):
    k = e.shape[1]
    n = m.sum(1, keepdims=True)
    mean = np.where(n > 0, m @ p / np.maximum(n, 1), e)
    pull = lam * (1 - alpha)
    z = np.maximum((e + pull * mean) / (1 + pull) - lam * alpha / (k * (1 + pull)), 0)
    y = np.maximum(p + np.clip(z - p, -cap, cap), 0)
    s = y.sum(1, keepdims=True)
    return np.where(s > 0, y / np.where(s > 0, s, 1), p)


@pytest.fixture(scope="module")
def evidence():
    return np.random.default_rng(4).dirichlet(np.ones(3), 60)


def wide_props(spark, p):
    return spark.createDataFrame(
        [("s", i, *map(float, row)) for i, row in enumerate(p)], "sample string, spot int, p_0 double, p_1 double, p_2 double"
    )


def to_matrix(df):
    rows = {r.spot: [r.p_0, r.p_1, r.p_2] for r in df.collect()}
    return np.array([rows[i] for i in range(len(rows))])


def test_refine_equals_numpy(spark, spots, slide, evidence):
    m = near(slide, 2.5).astype(float)
    p = evidence
    for _ in range(20):
        new = step(evidence, p, m, 1.0, 0.7, 0.05)
        delta, p = np.abs(new - p).max(), new
        if delta < 1e-3:
            break
    got = deconv.refine_props(
        wide_props(spark, evidence), spots, TYPES, 2.5, {"lam": 1.0, "alpha": 0.7, "cap": 0.05}, tolerance=1e-3
    )
    got = to_matrix(got)
    assert np.allclose(got, p, atol=1e-12) and np.allclose(got.sum(1), 1)


@pytest.mark.parametrize("work", [1, spatial.WORK])
def test_refine_reports_and_keeps_little(spark, spots, evidence, work):
    from pathlib import Path

    from spotweave.session import scratch_root

    points = [{"run_id": 7, "lam": 0.0, "alpha": 0.0, "cap": 1.0}, {"run_id": 3, "lam": 1.0, "alpha": 0.1, "cap": 0.02}]
    jobs = {}
    for steps in (1, 6):
        before = set(Path(scratch_root(spark)).rglob("state"))
        spark.sparkContext.setJobGroup(f"refine{work}-{steps}", "refine")
        fine = deconv.refine_props(wide_props(spark, evidence), spots, TYPES, 2.5, points, max_iterations=steps, work=work)
        spark.sparkContext.setJobGroup("other", "other")
        jobs[steps] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"refine{work}-{steps}"))
    ends = {(r.run_id, r.steps, r.converged) for r in fine.select("run_id", "steps", "converged").distinct().collect()}
    assert ends == {(7, 1, True), (3, 6, False)}
    assert len(set(Path(scratch_root(spark)).rglob("state")) - before) == 1
    # a step is a job that moves the sources, one for the small plan of cells, and the write
    assert jobs[6] - jobs[1] <= 3 * 5
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("spotweave_")]


def test_spots_need_coordinates(spark, spots, evidence):
    with pytest.raises(Exception, match="spot without coordinates: s 5"):
        deconv.refine_props(wide_props(spark, evidence), spots.where("spot < 50"), TYPES, 2.5)


def test_sweep_equals_single_runs(spark, spots, evidence):
    points = [
        {"run_id": 0, "lam": 0.001, "alpha": 0.7, "cap": 0.2},
        {"run_id": 1, "lam": 1.0, "alpha": 0.1, "cap": 0.02},
    ]
    start = wide_props(spark, evidence)
    both = deconv.refine_props(start, spots, TYPES, 2.5, points, max_iterations=4)
    for q in points:
        alone = deconv.refine_props(start, spots, TYPES, 2.5, q, max_iterations=4)
        assert "run_id" not in alone.columns
        assert np.allclose(to_matrix(both.where(F.col("run_id") == q["run_id"])), to_matrix(alone), atol=1e-12)


def test_blocks_equal_numpy_with_few_jobs(spark, monkeypatch):
    """Many small blocks, points that settle within a round, a pile of spots: as numpy over the whole slide, in a few jobs a round."""
    rng = np.random.default_rng(8)
    xy = np.vstack([rng.random((390, 2)) * [20, 60], np.full((10, 2), 7.5)]) - [5, 30]
    spots = spark.createDataFrame([("s", i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "sample string, spot int, spot_x double, spot_y double")
    e = rng.dirichlet(np.ones(3), 400)
    start = wide_props(spark, e)
    monkeypatch.setattr(blocks, "ROWS", 200)
    plan = blocks.block_plan(spots, 1.0, 6)
    held = blocks.with_border(spots, plan, 1.0)
    assert plan.steps > 1 and held.select("_bx", "_by").distinct().count() >= 4
    assert held.where("_own").count() == 400 < held.count()
    points = [{"run_id": 0, "lam": 0.5, "alpha": 0.3, "cap": 0.5}, {"run_id": 1, "lam": 1.0, "alpha": 0.1, "cap": 0.02}]
    jobs = {}
    for steps in (4, 12):
        spark.sparkContext.setJobGroup(f"blocks-{steps}", "blocks")
        fine = deconv.refine_props(start, spots, TYPES, 1.0, points, tolerance=1e-3, max_iterations=steps)
        spark.sparkContext.setJobGroup("other", "other")
        jobs[steps] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"blocks-{steps}"))
    # two more rounds of four steps, of which one is made again: a step had three jobs before
    assert jobs[12] - jobs[4] <= 9
    m, ends = near(xy, 1.0).astype(float), {}
    for q in points:
        p = e
        for t in range(1, 13):
            new = step(e, p, m, q["lam"], q["alpha"], q["cap"])
            gap, p = np.abs(new - p).max(), new
            if gap < 1e-3:
                break
        ends[q["run_id"]] = (t, bool(gap < 1e-3))
        assert np.allclose(to_matrix(fine.where(F.col("run_id") == q["run_id"])), p, atol=1e-12)
    assert {r.run_id: (r.steps, r.converged) for r in fine.select("run_id", "steps", "converged").distinct().collect()} == ends
    assert ends[0][1] and ends[0][0] % plan.steps and not ends[1][1]


def test_too_dense_for_blocks(spark):
    """A pile above the work of a task leaves the run to the pairs of grid cells; an empty run has no blocks either."""
    spots = spark.createDataFrame([("s", i, 0.0, 0.0) for i in range(300)], "sample string, spot int, spot_x double, spot_y double")
    assert blocks.block_plan(spots, 1.0, 3) and not blocks.block_plan(spots, 1.0, 3, work=1000)
    assert not blocks.block_plan(spots.limit(0), 1.0, 3)


@pytest.fixture(scope="module")
def tissue(spark, evidence):
    rng = np.random.default_rng(6)
    x = rng.poisson(1.0, (60, 15)).astype(float)
    x[7] = 0
    p = evidence.copy()
    p[3] = [1.0, 0.0, 0.0]
    rows = [("s", i, f"g{j:02d}", float(v)) for (i, j), v in np.ndenumerate(x) if v]
    return x, p, spark.createDataFrame(rows, "sample string, spot int, gene string, value double")


def dense_layers(df):
    out = np.zeros((3, 60, 15))
    for r in df.collect():
        out[TYPES.index(r.cell_type), r.spot, int(r.gene[1:])] += r.value
    return out


def split(x, p, mu):
    w = p.T[:, :, None] * mu
    s = w.sum(0)
    return x[None] * w / np.where(s > 0, s, 1)


def test_pass1_prior_pass2(spark, tissue):
    x, p, expr = tissue
    props = wide_props(spark, p)
    mu = (p.T @ x) / p.sum(0)[:, None]
    want = split(x, p, mu[:, None, :])
    first = deconv.expr_pass1(expr, props, TYPES)
    got = dense_layers(first)
    assert np.allclose(got, want) and np.allclose(got.sum(0), x)
    prior = np.einsum("kig,ik->kg", want, p) / p.sum(0)[:, None]
    long_props = deconv.to_long(props, TYPES, keep_zero=False)
    got_prior = {(r.cell_type, r.gene): r.prior for r in deconv.expr_prior(first, long_props).collect()}
    assert all(got_prior.get((t, f"g{g:02d}"), 0) == pytest.approx(prior[k, g]) for k, t in enumerate(TYPES) for g in range(15))
    want2 = split(x, p, ((1 - 0.3) * mu + 0.3 * prior)[:, None, :])
    assert np.allclose(dense_layers(deconv.expr_pass2(expr, props, TYPES, 0.3)), want2)
    given = deconv.expr_prior(first, long_props)
    assert np.allclose(dense_layers(deconv.expr_pass2(expr, props, TYPES, 0.3, given)), want2)
    weighted = dense_layers(deconv.weighted_layers(expr, long_props))
    assert np.allclose(weighted, x[None] * p.T[:, :, None])


def test_local_pass1(spark, spots, slide, tissue):
    x, p, expr = tissue
    m = near(slide, 2.5).astype(float) + np.eye(60)
    mu = np.einsum("ij,jk,jg->kig", m, p, x) / np.maximum(m @ p, 1e-300).T[:, :, None]
    got = dense_layers(deconv.expr_pass1_local(expr, wide_props(spark, p), spots, TYPES, 2.5))
    assert np.allclose(got, split(x, p, mu)) and np.allclose(got.sum(0), x)


def test_clr_and_marker_props(spark):
    rng = np.random.default_rng(9)
    x = rng.poisson(2.0, (40, 6)).astype(float)
    x[5] = 0
    names = [f"P{j}" for j in range(6)]
    protein = spark.createDataFrame(
        [("s", i, names[j], float(v)) for (i, j), v in np.ndenumerate(x) if v],
        "sample string, spot int, protein string, value double",
    )
    spots = spark.createDataFrame([("s", i) for i in range(40)], "sample string, spot int")
    panel = spark.createDataFrame([(n,) for n in names], "protein string")
    clr = normalize.antibody_clr(protein, spots, panel, 0.1, 0.9)
    lo, hi = np.quantile(x, [0.1, 0.9], axis=0)
    logged = np.log1p(np.clip(x, lo, hi))
    want = logged - logged.mean(1, keepdims=True)
    got = np.zeros_like(x)
    for r in clr.collect():
        got[r.spot, names.index(r.protein)] = r.value
    assert np.allclose(got, want)
    profile = {t: {"Major": names[i::3]} for i, t in enumerate(TYPES)}
    props = to_matrix(deconv.marker_props(clr, marker_table(spark, profile), TYPES))
    e = np.maximum(np.stack([want[:, i::3].mean(1) for i in range(3)], 1), 0)
    s = e.sum(1, keepdims=True)
    assert np.allclose(props, np.where(s > 0, e / np.where(s > 0, s, 1), 1 / 3))
    parts = normalize.clr_parts(protein, spots, panel, 0.1, 0.9)
    sparse = to_matrix(deconv.marker_props_sparse(parts, marker_table(spark, profile), TYPES))
    assert np.allclose(sparse, props)


def test_clr_of_a_large_panel(spark):
    """2000 proteins, a spot with none of them, one with the first and the last, one sample without spots of its own values."""
    rng = np.random.default_rng(3)
    names = [f"P{j:04d}" for j in range(2000)]
    x = np.where(rng.random((12, 2000)) < 0.02, rng.integers(1, 50, (12, 2000)), 0).astype(float)
    x[0], x[1] = 0, 0
    x[1, [0, -1]] = 4
    protein = spark.createDataFrame([("s", i, names[j], float(v)) for (i, j), v in np.ndenumerate(x) if v], "sample string, spot int, protein string, value double")
    spots = spark.createDataFrame([("s", i) for i in range(12)], "sample string, spot int")
    clr = normalize.antibody_clr(protein, spots, spark.createDataFrame([(n,) for n in names], "protein string"), 0.0, 1.0)
    got = np.full(x.shape, np.nan)
    for r in clr.collect():
        got[r.spot, int(r.protein[1:])] = r.value
    logged = np.log1p(x)
    assert np.allclose(got, logged - logged.mean(1, keepdims=True), atol=1e-9)


def test_lost_mass_and_unknown_types_raise(spark, tissue):
    x, p, expr = tissue
    props = wide_props(spark, p)
    some = props.where("spot <> 5")
    for split in (deconv.expr_pass1, deconv.expr_pass2):
        with pytest.raises(Exception, match="no shares"):
            split(expr, some, TYPES).count()
    long = deconv.to_long(props, TYPES)
    with pytest.raises(Exception, match="not in the profile"):
        deconv.to_wide(long, TYPES[:2]).collect()
    ledger = deconv.mass_ledger(expr, deconv.expr_pass1(expr, props, TYPES)).first()
    assert (ledger.input, ledger.output) == pytest.approx((x.sum(), x.sum())) and ledger.lost == pytest.approx(0, abs=1e-9)
    none = props.withColumns({c: F.when(F.col("spot") == 5, 0.0).otherwise(F.col(c)) for c in ("p_0", "p_1", "p_2")})
    seen = Observation()
    deconv.expr_pass1(expr, none, TYPES, seen).write.format("noop").mode("overwrite").save()
    assert seen.get["input"] == pytest.approx(x.sum()) and seen.get["output"] == pytest.approx(x.sum() - x[5].sum())
    assert deconv.mass_ledger(expr, deconv.expr_pass1(expr, none, TYPES)).first().lost == pytest.approx(x[5].sum())


def test_model_run_and_resume(spark, spots, tissue, tmp_path):
    x, p, expr = tissue
    rng = np.random.default_rng(1)
    counts = rng.poisson(1 + 20 * p)
    protein = spark.createDataFrame(
        [("s", i, f"P{k}", float(v)) for (i, k), v in np.ndenumerate(counts)],
        "sample string, spot int, protein string, value double",
    )
    model = SpotModel(expr, protein, spots)
    model.load_profile({t: {"Major": [f"P{k}"]} for k, t in enumerate(TYPES)})
    assert {r.source: r.n_negative for r in model.check_inputs().collect()} == {"expr": 0, "protein": 0}
    with pytest.raises(RuntimeError):
        model.append_proportions()
    model.filter_gex(0.01, 0.5)
    model.preprocess_antibody()
    rough, fine = model.run_proportions(2.5, 0.001, 0.7, 0.2, max_iterations=2)
    assert rough.count() == fine.count() == 180
    sweep = model.run_sweep(sweep_points(lam=[0.001, 0.1], alpha=[0.7], cap=[0.2]), 2.5, max_iterations=2)
    assert sweep.count() == 360
    same = sweep.where("run_id = 0").join(fine.withColumnRenamed("p", "q"), ["sample", "spot", "cell_type"])
    assert same.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-12
    wide = model.append_proportions().toPandas()
    assert len(wide) == 60 and np.allclose(wide[TYPES].sum(axis=1), 1)
    out = model.run_expression_pass1(output_dir=str(tmp_path / "stage"))
    again = model.run_expression_pass1(output_dir=str(tmp_path / "stage"), rerun=False)
    total = float(x.sum())
    assert out.agg(F.sum("value")).first()[0] == pytest.approx(total)
    assert again.agg(F.sum("value")).first()[0] == pytest.approx(total)
    second = model.run_expression_pass2(model.expression_prior(out))
    assert second.agg(F.sum("value")).first()[0] == pytest.approx(total)


def test_dominant_and_wide(spark):
    prop = spark.createDataFrame(
        [("m", "s", 1, "b", 0.4), ("m", "s", 1, "a", 0.4), ("m", "s", 1, "c", 0.2), ("m", "s", 2, "c", 1.0)],
        "method string, sample string, spot int, cell_type string, p double",
    )
    top = {r.spot: r.cell_type for r in spatial.dominant_type(prop).collect()}
    assert top == {1: "a", 2: "c"}
    at = spark.createDataFrame([("s", 1, 3.0, 4.0)], "sample string, spot int, spot_x double, spot_y double")
    wide = {r.spot: r for r in spatial.spatial_wide(prop, at, ["a", "b", "c"]).collect()}
    assert wide[1].spot_x == 3.0 and wide[2].spot_x is None and wide[2].a == 0.0 and wide[2].c == 1.0


def test_natural_order(spark):
    ids = spark.createDataFrame([("spot_10",), ("spot_2",), ("other",), ("spot_1",)], "spot string")
    assert [r.spot for r in spatial.natural_order(ids).collect()] == ["spot_1", "spot_2", "spot_10", "other"]


def _shuffles(df):
    """Shuffles and the tasks they deal to, of the plan before it runs."""
    return [int(n) for n in re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\), (?:ENSURE|REPARTITION)", df._jdf.queryExecution().executedPlan().toString())]


def _small_slide(spark):
    rng = np.random.default_rng(3)
    spots = [(s, i, float(i % 4), float(i // 4)) for s in (0, 1) for i in range(24)]
    spots += [(0, 24 + i, 1.0, 1.0) for i in range(3)]  # a pile
    expr = [(s, i, g, float(rng.integers(1, 9))) for s, i, *_ in spots for g in range(5) if rng.random() < 0.6]
    props = [(s, i, p, 1 - p) for (s, i, *_), p in zip(spots, rng.random(len(spots)).tolist())]
    return (
        stored(spark.createDataFrame(expr, "sample long, spot long, gene long, value double"), "expr"),
        spark.createDataFrame(props, "sample long, spot long, p_0 double, p_1 double"),
        spark.createDataFrame(spots, "sample long, spot long, spot_x double, spot_y double"),
    )


def test_passes_move_expression_once_by_spot_and_once_by_gene(spark):
    expr, props, spots = _small_slide(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        assert len(_shuffles(deconv.expr_pass2(expr, stored(props, "props"), ["a", "b"]))) <= 2
        assert len(_shuffles(deconv.expr_pass1_local(expr, props, spots, ["a", "b"], 1.5))) <= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_prior_of_pass1_without_long_layers(spark):
    expr, props, _ = _small_slide(spark)
    props = props.withColumn("p_1", F.when(F.col("sample") == 0, 0.0).otherwise(F.col("p_1")))
    long = deconv.to_long(props, ["a", "b"], keep_zero=False)
    want = {(r.sample, r.cell_type, r.gene): r.prior for r in deconv.expr_prior(deconv.expr_pass1(expr, props, ["a", "b"]), long).collect()}
    got = {(r.sample, r.cell_type, r.gene): r.prior for r in deconv.pass1_prior(expr, props, ["a", "b"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_tasks_follow_the_rows(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 100)
    assert dealt(rows, 1000, "k", task_rows=50).rdd.getNumPartitions() == 20
    assert dealt(rows, 1000, "k", task_rows=500) is rows  # the session's own number suffices
