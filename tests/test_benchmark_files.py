"""File-based scoring against a direct pandas computation."""

import math

import numpy as np
import pandas as pd
import pytest

from spotweave import benchmark


def test_layer_files(spark, tmp_path):
    rng = np.random.default_rng(11)
    want = {}
    for sample in range(2):
        gt_dir = tmp_path / f"sample_{sample}" / "layers"
        gt_dir.mkdir(parents=True)
        for method in ("m1", "m2"):
            pred_dir = tmp_path / f"{method}_map_{sample}" / "layers"
            pred_dir.mkdir(parents=True)
            for c, pred_name in (("Cancer Epithelial", "Cancer_Epithelial_layer_pass1"), ("PVL", "PVL_layer"), ("Lost", None)):
                spots, genes = [f"spot_{i}" for i in range(12)], [f"G{j}" for j in range(9)]
                file = gt_dir / f"{c}_GT.csv"
                if not file.exists():
                    gt = rng.poisson(1.0, (12, 9)).astype(float)
                    gt[:, 4] = 0
                    pd.DataFrame(gt, spots, genes).to_csv(file)
                gt = pd.read_csv(file, index_col=0)
                if pred_name is None:
                    continue
                pred = pd.DataFrame(rng.poisson(1.0, (12, 9)) * 1.5, spots[2:] + ["spot_x1", "spot_x2"], genes[1:] + ["Z"])
                if method == "m2" and c == "PVL":
                    pred.index = [f"other_{i}" for i in range(12)]
                pred.to_csv(pred_dir / f"{pred_name}.csv")
                rows, cols = gt.index.intersection(pred.index), gt.columns.intersection(pred.columns)
                if len(rows) == 0:
                    continue
                a, b = np.log1p(gt.loc[rows, cols].to_numpy()), np.log1p(pred.loc[rows, cols].to_numpy())
                rmse = math.sqrt(((a - b) ** 2).mean())
                want[(method, str(sample), c.replace(" ", "_"))] = (rmse, rmse / (a.max() - a.min()), np.abs(a - b).mean())
    by_type, summary = benchmark.benchmark_layer_files(
        spark,
        str(tmp_path / "sample_*/layers/*_GT.csv"),
        str(tmp_path / "m*_map_*/layers/*.csv"),
        r"/sample_(\d+)/",
        r"_map_(\d+)/",
        fields={"method": r"/(m\d)_map_"},
    )
    got = {(r.method, r.sample, r.cell_type): (r.rmse, r.nrmse, r.mae) for r in by_type.collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k])
    figures = {(r.method, r.sample, r.metric): r.value for r in summary.collect()}
    mine = [v[0] for k, v in want.items() if k[:2] == ("m1", "0")]
    assert figures[("m1", "0", "Average RMSE")] == pytest.approx(np.mean(mine)) and len(figures) == 24


def test_proportion_files(spark, tmp_path):
    rng = np.random.default_rng(12)
    types, spots = ["b", "a", "c"], [f"spot_{i}" for i in range(15)]
    frames = {}
    for i in range(2):
        t = pd.DataFrame(rng.dirichlet(np.ones(3), 15), spots, types).assign(spot_x=1.0, spot_y=2.0)
        p = pd.DataFrame(rng.dirichlet(np.ones(3), 15), spots[::-1], sorted(types))
        t.to_csv(tmp_path / f"ST_{i}_prop.csv")
        p.to_csv(tmp_path / f"tool_map_{i}.csv", index_label="spot")
        frames[str(i)] = (t.sort_index()[sorted(types)], p.sort_index())
    args = (
        spark, str(tmp_path / "ST_*_prop.csv"), str(tmp_path / "tool_map_*.csv"), r"ST_(\d+)_prop",
        {"sample": r"_map_(\d+)\.csv", "method": r"/([a-z]+)_map_"},
    )
    got = {r.sample: r for r in benchmark.benchmark_proportion_files(*args, pred_index_label="spot").collect()}
    for i, (t, p) in frames.items():
        d = p.to_numpy() - t.to_numpy()
        assert got[i].sum_rmse == pytest.approx(math.sqrt((d**2).mean()))
        assert got[i].rmse == pytest.approx(dict(zip(sorted(types), np.sqrt((d**2).mean(0)))))
        assert got[i]["corr"] == pytest.approx(np.corrcoef(t.to_numpy().ravel(), p.to_numpy().ravel())[0, 1])
    pd.DataFrame(np.ones((1, 3)) / 3, ["spot_99"], types).to_csv(tmp_path / "tool_map_1.csv", index_label="spot")
    with pytest.raises(ValueError):
        benchmark.benchmark_proportion_files(*args, pred_index_label="spot")


def test_layers_of_files_are_made_once(spark, monkeypatch):
    """What is written by cell type comes from stored layers: no join or grouping is repeated for a type."""
    from spotweave.plans import file_queries

    plans = []
    monkeypatch.setattr(file_queries.matrix, "write_wide", lambda facts, *a, **k: plans.append(facts._jdf.queryExecution().optimizedPlan().toString()))
    monkeypatch.setattr(file_queries, "benchmark_layer_files", lambda *a, **k: None)
    file_queries._layer_files(spark, "/root/testdata/sf0.001")
    assert len(plans) == 15 and not any("Join" in p or "Aggregate" in p for p in plans)


def test_layers_are_written_as_lines(spark, monkeypatch):
    """A writer gets one row for a line of a file, not one for each of its cells."""
    from spotweave.plans import file_queries

    rows = []
    monkeypatch.setattr(file_queries.matrix, "write_wide", lambda facts, *a, **k: rows.append((facts.count(), facts.select("sample", "spot").distinct().count())))
    monkeypatch.setattr(file_queries, "benchmark_layer_files", lambda *a, **k: None)
    file_queries._layer_files(spark, "/root/testdata/sf0.001")
    assert len(rows) == 15 and all(n == spots > 0 for n, spots in rows)


def test_lines_written_as_they_are(spark, tmp_path):
    from spotweave.sources import matrix

    rows = spark.createDataFrame([("a,b", [1.0, None]), ("c", [0.0, 2.5])], "spot string, value array<double>")
    matrix.write_wide(rows, str(tmp_path / "w"), ["x", "y,z"], [], "spot", None, "spot")
    text = sorted(line for f in (tmp_path / "w").glob("*.csv") for line in f.read_text().split("\n"))
    assert set(text) == {"", 'spot,x,"y,z"', '"a,b",1.0,0.0', "c,0.0,2.5"}


def test_layer_files_in_blocks_and_parts(spark, tmp_path):
    """Rows in several files, odd numbers, missing cells and files read in blocks: the scores of the cells moved one by one."""
    from pyspark.sql import functions as F

    from spotweave.operators import joins
    from spotweave.sources import matrix

    rng = np.random.default_rng(21)
    for name, n in (("T_GT", 0), ("T_layer", 1)):
        for part in range(2):
            genes = [f"G{j}" for j in range(6 * part + n, 6 * part + 6)]
            x = pd.DataFrame(rng.poisson(1.0, (60, len(genes))).astype(float), [f"spot_{i}" for i in range(3 * n, 60 + 3 * n)], genes)
            x.iloc[4] = 0
            x.iloc[5, 2] = np.nan
            text = x.to_csv(index_label="spot").replace(",2.0", ',"2"').replace(",3.0", ",3.00")
            (tmp_path / f"s_1_{part}").mkdir(exist_ok=True)
            (tmp_path / f"s_1_{part}" / f"{name}.csv").write_text(text)
    paths = str(tmp_path / "s_*/*_GT.csv"), str(tmp_path / "s_*/*_layer.csv")
    t, t_genes, t_spots = matrix.scan_layers(spark, paths[0], r"/s_(\d+)_", "_GT", index_label="spot")
    p, p_genes, p_spots = matrix.scan_layers(spark, paths[1], r"/s_(\d+)_", "_layer", index_label="spot")
    genes, spots, sizes = benchmark.shared_sizes(t_genes, t_spots, p_genes, p_spots, ["sample", "cell_type"])
    want = [tuple(r) for r in benchmark.benchmark_layers(t, p, genes, spots, sizes, ["sample"])[0].collect()]
    assert len(want) == 1 and t.where(F.col("value").isNull()).count() == 2 and joins.restrict(t, genes, spots).count() > 0
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for block in (old, "500"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        try:
            got = benchmark.benchmark_layer_files(spark, *paths, r"/s_(\d+)_", r"/s_(\d+)_", index_label="spot")[0].collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert [tuple(r)[:2] for r in got] == [w[:2] for w in want] and tuple(got[0])[2:] == pytest.approx(want[0][2:])


def test_cells_of_lines_move_together(spark):
    """No shuffle of the scores of lines is by gene."""
    from spotweave.operators import layer_metrics as lm

    lines = spark.createDataFrame(
        [("m", "0", "T", "s1", [("G", 1.0, None), ("H", 2.0, None)])],
        "method string, sample string, cell_type string, spot string, cells array<struct<_name string, _value double, _text string>>",
    )
    genes = spark.createDataFrame([("m", "0", "T", "G")], "method string, sample string, cell_type string, gene string")
    scores = lm.line_metrics(lines, lines, genes)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert any("spot#" in s for s in shuffles) and not any("gene#" in s and "spot#" in s for s in shuffles)
    assert [tuple(r)[3:] for r in scores.collect()] == [(0.0, None, 0.0)]
