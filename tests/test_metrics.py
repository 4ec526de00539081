"""Proportion and layer scores against plain numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spotweave.operators import joins, layer_metrics as lm, order_stats, prop_metrics as pm


def jsd(x, y):
    if y.sum() == 0:
        return 1.0
    if x.sum() == 0:
        return math.nan
    x, y = x / x.sum(), y / y.sum()
    m = (x + y) / 2

    def rel(a):
        ok = a > 0
        return (a[ok] * np.log2(a[ok] / m[ok])).sum()

    return math.sqrt(max(0.0, (rel(x) + rel(y)) / 2))


def dense_scores(test, comp):
    n, k = test.shape
    dist = np.array([jsd(test[i], comp[i]) for i in range(n)])
    return {
        "jsd": np.quantile(dist, 0.5),
        "rmse": np.sqrt(((test - comp) ** 2).sum(0) / n),
        "sum_rmse": np.sqrt(((test - comp) ** 2).sum() / (n * k)),
        "mae": np.abs(test - comp).mean(0),
        "sum_mae": np.abs(test - comp).mean(0).mean(),
        "corr": np.corrcoef(test.ravel(), comp.ravel())[0, 1],
    }


def long(spark, mats, drop_zero=True):
    """{(method, sample): matrix} to rows."""
    rows = [
        (m, s, f"spot_{i}", f"t{j}", float(mat[i, j]))
        for (m, s), mat in mats.items()
        for i in range(mat.shape[0])
        for j in range(mat.shape[1])
        if not drop_zero or mat[i, j] != 0 or j == 0
    ]
    return spark.createDataFrame(rows, "method string, sample string, spot string, cell_type string, p double")


@pytest.fixture(scope="module")
def mats():
    rng = np.random.default_rng(3)
    truth = {s: rng.dirichlet(np.ones(5) * 0.4, 41) * (rng.random((41, 5)) > 0.3) for s in ("0", "1")}
    truth["0"][4] = 0
    pred = {(m, s): rng.dirichlet(np.ones(5), 41) * (rng.random((41, 5)) > 0.2) for m in ("a", "b") for s in truth}
    for p in pred.values():
        p[p.sum(1) == 0, 1] = 0.5
    return truth, pred


@pytest.mark.parametrize("drop_zero", [True, False])
def test_prop_metrics_equal_numpy(spark, mats, drop_zero):
    truth, pred = mats
    t = long(spark, {("", s): m for s, m in truth.items()}, drop_zero).drop("method")
    got = {(r.method, r.sample): r for r in pm.prop_metrics(t, long(spark, pred, drop_zero)).collect()}
    assert len(got) == 4
    for key, p in pred.items():
        want, r = dense_scores(p, truth[key[1]]), got[key]
        for name in ("jsd", "sum_rmse", "sum_mae", "corr"):
            assert r[name] == pytest.approx(want[name], abs=1e-9), name
        assert (r.n_spots, r.n_types) == (41, 5)


def test_by_type_and_maps(spark, mats):
    truth, pred = mats
    t = long(spark, {("", s): m for s, m in truth.items()}).drop("method")
    pairs = pm.pair_rows(t, long(spark, pred))
    by_type, total = pm.prop_by_type(pairs), pm.prop_global(pairs)
    for r in pm.metric_maps(by_type, total).collect():
        want = dense_scores(pred[(r.method, r.sample)], truth[r.sample])
        assert [r.rmse[f"t{j}"] for j in range(5)] == pytest.approx(list(want["rmse"]))
        assert [r.mae[f"t{j}"] for j in range(5)] == pytest.approx(list(want["mae"]))
        assert r.sum_rmse**2 == pytest.approx(np.mean(want["rmse"] ** 2))
        assert r.sum_mae == pytest.approx(np.mean(want["mae"]))


def test_zero_rule_sides(spark):
    t = {("", "0"): np.array([[0.0, 0.0], [1.0, 0.0]])}
    p = {("a", "0"): np.array([[0.5, 0.5], [0.0, 0.0]])}
    pairs = pm.pair_rows(long(spark, t, False).drop("method"), long(spark, p, False))
    by_truth = {r.spot: r.jsd for r in pm.jsd_spot(pairs).collect()}
    assert by_truth["spot_0"] == 1.0 and math.isnan(by_truth["spot_1"])
    by_pred = {r.spot: r.jsd for r in pm.jsd_spot(pairs, zero_rule_on="pred").collect()}
    assert math.isnan(by_pred["spot_0"]) and by_pred["spot_1"] == 1.0
    q = pm.jsd_quantiles(pm.jsd_spot(pairs)).first()
    assert math.isnan(q.jsd_median)


def test_jsd_bounds_and_symmetry(spark, mats):
    truth, pred = mats
    one = {("a", "0"): pred[("a", "0")]}
    t = long(spark, {("", "0"): pred[("b", "0")]}).drop("method")
    ab = {r.spot: r.jsd for r in pm.jsd_spot(pm.pair_rows(t, long(spark, one))).collect()}
    t2 = long(spark, {("", "0"): pred[("a", "0")]}).drop("method")
    ba = {
        r.spot: r.jsd
        for r in pm.jsd_spot(pm.pair_rows(t2, long(spark, {("a", "0"): pred[("b", "0")]}))).collect()
    }
    same = pm.jsd_spot(pm.pair_rows(t2, long(spark, one))).agg(F.max("jsd")).first()[0]
    assert ab == pytest.approx(ba) and all(0 <= v <= 1 for v in ab.values()) and same == pytest.approx(0, abs=1e-7)


def test_runs_without_partner_are_skipped(spark, mats):
    truth, pred = mats
    t = long(spark, {("", "0"): truth["0"], ("", "9"): truth["1"]}).drop("method")
    got = pm.prop_metrics(t, long(spark, pred)).select("method", "sample").collect()
    assert sorted(map(tuple, got)) == [("a", "0"), ("b", "0")]


def layers(spark, mats):
    rows = [
        (*key, f"s{i}", f"g{j}", float(v))
        for key, mat in mats.items()
        for (i, j), v in np.ndenumerate(mat)
        if v != 0
    ]
    return spark.createDataFrame(rows, "method string, sample string, cell_type string, spot string, gene string, value double")


@pytest.mark.parametrize("normalize", ["range", "mean"])
@pytest.mark.parametrize("methods", [None, ["a", "b"]])
def test_layer_metrics_sparse_equals_dense(spark, normalize, methods):
    rng = np.random.default_rng(5)

    def mat(density):
        return rng.poisson(3, (30, 40)) * (rng.random((30, 40)) < density)

    truth = {("", "0", c): mat(d) for c, d in (("x", 0.2), ("y", 1.1), ("z", 0.1))}
    truth[("", "0", "y")] += 1
    pred = {("a", "0", "x"): mat(0.3), ("a", "0", "y"): mat(0.9) + 1, ("b", "0", "x"): mat(0.1), ("b", "0", "w"): mat(0.1)}
    sizes = spark.createDataFrame([("0", 40, 30)], "sample string, n_genes long, n_spots long")
    out = lm.layer_metrics(
        layers(spark, truth).drop("method"), layers(spark, pred), sizes, normalize=normalize, methods=methods
    )
    got = {(r.method, r.cell_type): r for r in out.collect()}
    assert set(got) == {("a", "x"), ("a", "y"), ("b", "x")}
    for (m, c), r in got.items():
        t, p = np.log1p(truth[("", "0", c)]), np.log1p(pred[(m, "0", c)])
        rmse = np.sqrt(((t - p) ** 2).mean())
        scale = t.max() - t.min() if normalize == "range" else t.mean()
        assert r.rmse == pytest.approx(rmse) and r.nrmse == pytest.approx(rmse / scale)
        assert r.mae == pytest.approx(np.abs(t - p).mean())


def test_layer_summary_nan_rules(spark):
    rows = spark.createDataFrame(
        [("a", "0", "x", 1.0, math.nan, 2.0), ("a", "0", "y", math.nan, 4.0, 6.0), ("a", "0", "z", 5.0, 2.0, math.nan)],
        "method string, sample string, cell_type string, rmse double, nrmse double, mae double",
    )
    strict = {r.metric: r.value for r in lm.layer_summary(rows).collect()}
    loose = {r.metric: r.value for r in lm.layer_summary(rows, skip_nan_rmse=True).collect()}
    assert math.isnan(strict["Average RMSE"]) and math.isnan(strict["Median RMSE"])
    assert strict["Average NRMSE"] == 3 and strict["Median MAE"] == 4 and loose["Average RMSE"] == 3


def test_exact_quantiles(spark):
    rng = np.random.default_rng(8)
    groups = {
        "normal": rng.normal(size=20001),
        "ties": np.repeat([1.0, 2.0, 7.0], [10, 5000, 3]),
        "one": np.array([4.0]),
        "two": np.array([1.0, 2.0]),
        "tail": rng.pareto(0.3, 5000),
    }
    pdf = pd.concat([pd.DataFrame({"g": k, "v": v}) for k, v in groups.items()])
    df = spark.createDataFrame(pdf).repartition(7)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    names = [f"q{i}" for i in range(5)]
    out = order_stats.exact_quantiles(df, ["g"], "v", probs, names)
    for r in out.collect():
        assert [r[n] for n in names] == pytest.approx(list(np.quantile(groups[r.g], probs)), rel=1e-12)
    whole = order_stats.exact_quantiles(df, [], "v", probs, names).first()
    assert list(whole) == pytest.approx(list(np.quantile(pdf.v, probs)), rel=1e-12)


def test_weighted_quantiles_and_nan(spark):
    df = spark.createDataFrame(
        [("a", 0.0, 7), ("a", 3.0, 2), ("a", 9.0, 1), ("b", math.nan, 1), ("b", 2.0, 1)], "g string, v double, n long"
    )
    plain = order_stats.exact_quantiles(df, ["g"], "v", [0.5, 0.75], ["m", "q"], weight="n")
    got = {r.g: (r.m, r.q) for r in plain.collect()}
    assert got["a"] == pytest.approx(tuple(np.quantile([0] * 7 + [3] * 2 + [9], [0.5, 0.75]))) and got["b"] == (2, 2)
    nan = order_stats.exact_quantiles(
        df, ["g"], "v", [0.5], ["m"], weight="n", nan_result=True
    )
    got = {r.g: r.m for r in nan.collect()}
    assert got["a"] == 0 and math.isnan(got["b"])


def test_keys(spark):
    a = spark.createDataFrame([("0", "x"), ("0", "y"), ("1", "x")], "sample string, gene string")
    b = spark.createDataFrame([("0", "y"), ("0", "z")], "sample string, gene string")
    assert [tuple(r) for r in joins.align_shared(a, b, "gene", ["sample"]).collect()] == [("0", "y")]
    odd = sorted(map(tuple, joins.key_mismatch(a, b, "gene", ["sample"]).collect()))
    assert odd == [("0", "x", "left"), ("0", "z", "right"), ("1", "x", "left")]
    joins.require_same_keys(a, a, "gene", ["sample"])
    with pytest.raises(ValueError):
        joins.require_same_keys(a, b, "gene", ["sample"])
    runs = joins.pair_replicates(a, b.union(a), ["sample", "gene"])
    assert {tuple(r) for r in runs.collect()} == {("0", "x", True), ("0", "y", True), ("1", "x", True), ("0", "z", False)}


def test_grid_paths_agree(spark, monkeypatch):
    rows = spark.range(7).select(F.col("id").alias("spot"))
    cols = spark.createDataFrame([("a",), ("b",), ("c",)], "cell_type string")
    facts = spark.createDataFrame([(1, "b", 0.5)], "spot long, cell_type string, p double")
    short = sorted(map(tuple, joins.complete(facts, rows, cols, "cell_type", "p").collect()))
    monkeypatch.setattr(joins, "few_values", lambda *a, **k: None)
    long_ = sorted(map(tuple, joins.complete(facts, rows, cols, "cell_type", "p").collect()))
    assert short == long_ and len(short) == 21 and sum(r[2] for r in short) == 0.5


def test_match_types(spark):
    facts = spark.createDataFrame([("Cancer_Epithelial",), ("PVL",), ("B-cells",)], "cell_type string")
    names = spark.createDataFrame([("Cancer Epithelial",), ("PVL",)], "cell_type string")
    got = sorted(r[0] for r in joins.match_types(facts, names).collect())
    assert got == ["B-cells", "Cancer Epithelial", "PVL"]


def test_wide_layers_are_scored_like_long_ones(spark):
    """A cell of the matrix is moved once for all types and methods, and the scores are those of long layers."""
    from spotweave.operators import deconv

    rng = np.random.default_rng(11)
    types = ["x", "y", "z"]
    p = rng.random((30, 3)) * (rng.random((30, 3)) < 0.7)
    p[:, 0] += 0.1
    cells = [(str(s % 2), f"s{s}", f"g{g}", float(v)) for s in range(30) for g, v in enumerate(rng.poisson(0.5, 20)) if v]
    expr = spark.createDataFrame(cells, "sample string, spot string, gene string, value double")
    prop = spark.createDataFrame([(str(s % 2), f"s{s}", t, float(p[s, i])) for s in range(30) for i, t in enumerate(types)], "sample string, spot string, cell_type string, p double")
    truth = spark.createDataFrame(
        [(str(s % 2), types[i], f"s{s}", f"g{g}", float(v)) for s in range(40) for i in range(2) for g, v in enumerate(rng.poisson(0.3, 25)) if v],
        "sample string, cell_type string, spot string, gene string, value double",
    )
    sizes = spark.createDataFrame([(25, 40)], "n_genes long, n_spots long")
    props = deconv.to_wide(prop, types)
    long_rows = deconv.weighted_layers(expr, prop).withColumn("method", F.lit("weighted")).unionByName(
        deconv.expr_pass1(expr, props, types).withColumn("method", F.lit("pass1"))
    )
    pred = deconv.wide_layers(expr, props, types)
    assert pred.count() == len(cells)
    want = {(r.method, r.sample, r.cell_type): r for r in lm.layer_metrics(truth, long_rows, sizes, methods=["weighted", "pass1"]).collect()}
    got = {(r.method, r.sample, r.cell_type): r for r in lm.wide_layer_metrics(truth, pred, types, sizes, ["weighted", "pass1"]).collect()}
    assert set(got) == set(want) and len(got) == 8
    for k, r in got.items():
        assert r[3:] == pytest.approx(want[k][3:])
