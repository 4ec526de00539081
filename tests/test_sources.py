"""Readers, writers and resumable stages on small files."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spotweave.functions import scalar
from spotweave.operators import composition, filters
from spotweave.session import shared_dir
from spotweave.sources import assemble, matrix, rows as row_files, sinks, text, tool_outputs, triplets


def test_scan_wide_many_columns(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = {}
    for i in range(2):
        x = rng.poisson(0.3, (20, 1500)).astype(float)
        x[3] = 0
        pd.DataFrame(x, index=[f"g{r}" for r in range(20)], columns=[f"spot_{c + i}" for c in range(1500)]).to_csv(
            tmp_path / f"Wu_ST_{i}_data.csv"
        )
        want |= {(str(i), f"g{r}", f"spot_{c + i}"): v for (r, c), v in np.ndenumerate(x) if v}
    path, fields = str(tmp_path / "*_data.csv"), {"sample": r"_(\d+)_data"}
    got = {(r.sample, r.gene, r.spot): r.value for r in matrix.scan_wide(spark, path, fields=fields).collect()}
    assert got == want
    genes, spots = matrix.wide_keys(spark, path, fields=fields)
    assert genes.count() == 40 and spots.count() == 3000
    assert matrix.scan_wide(spark, path, fields=fields, keep_zero=True).count() == 60000


def test_scan_wide_missing_and_quotes(spark, tmp_path):
    (tmp_path / "m.csv").write_text('"","a b","c"\n"g1",1.5,\n"g2",NaN,2\n')
    rows = matrix.scan_wide(spark, str(tmp_path / "m.csv")).collect()
    got = {(r.gene, r.spot): r.value for r in rows}
    assert got == {("g1", "a b"): 1.5, ("g1", "c"): None, ("g2", "a b"): None, ("g2", "c"): 2.0}
    assert filters.data_checks(matrix.scan_wide(spark, str(tmp_path / "m.csv")), []).first().n_null == 2


def test_write_wide_round_trip(spark, tmp_path):
    facts = spark.createDataFrame(
        [("0", "s1", "B cell", "g1", 2.0), ("0", "s2", "B cell", "g2", 3.0)],
        "sample string, spot string, cell_type string, gene string, value double",
    )
    sinks.write_wide_layers(facts, str(tmp_path / "l"), ["g1", "g2", "g3"])
    back = matrix.scan_wide(
        spark, str(tmp_path / "l/*/*/*.csv"), "spot", "gene", {"cell_type": r"cell_type=([^/]+)/"}, "spot"
    )
    assert sorted(map(tuple, back.collect())) == [("B_cell", "s1", "g1", 2.0), ("B_cell", "s2", "g2", 3.0)]


def test_wide_lines_of_many_genes(spark, tmp_path):
    """5000 genes, most cells zero: gaps of zeros are exact, at both ends as well, and the export is quick."""
    import time

    rng = np.random.default_rng(5)
    genes = [f"g{i}" for i in range(4998)] + ['odd "name"', "last,one"]
    x = np.where(rng.random((60, 5000)) < 0.05, rng.integers(1, 90, (60, 5000)) / 4, 0.0)
    x[0], x[1, 1:], x[2, :-1] = 0, 0, 0
    x[1, 0] = x[2, -1] = 7.5
    rows = [("a,b" if i == 5 else f"s{i:02d}", genes[j], float(x[i, j])) for i, j in np.ndindex(60, 5000) if x[i, j] or j == 7]
    facts = spark.createDataFrame([*rows, ("s00", "unknown", 3.0)], "spot string, gene string, value double")
    facts.count()
    start = time.time()
    matrix.write_wide(facts, str(tmp_path / "w"), genes, [], "spot", "gene", "index")
    assert time.time() - start < 10
    import csv

    got = {}
    for f in (tmp_path / "w").glob("*.csv"):
        with f.open(newline="") as file:
            lines = list(csv.reader(file))
        assert lines[0] == ["index", *genes]
        got |= {r[0]: [float(v) for v in r[1:]] for r in lines[1:]}
    assert len(got) == 60
    assert all(got["a,b" if i == 5 else f"s{i:02d}"] == x[i].tolist() for i in range(60))


def test_triplets(spark, tmp_path):
    cells = [f"c{i}" for i in range(9)]
    genes = [f"g{i}" for i in range(7)]
    rng = np.random.default_rng(0)
    trip = [(g, c, round(float(rng.random()) + 0.1, 3)) for g in range(7) for c in range(9) if rng.random() < 0.5]
    (tmp_path / "matrix.mtx").write_text(
        "%%MatrixMarket matrix coordinate real general\n%note\n"
        f"7 9 {len(trip)}\n" + "".join(f"{g + 1} {c + 1} {v}\n" for g, c, v in trip)
    )
    (tmp_path / "genes.tsv").write_text("".join(f"{g}\tx\n" for g in genes))
    (tmp_path / "barcodes.tsv").write_text("\n".join(cells))
    meta = pd.DataFrame({"orig.ident": "p", "celltype_major": "B", "subtype": "ER+"}, index=cells)
    meta.iloc[:8].to_csv(tmp_path / "metadata.csv")
    expr, obs = triplets.scan_triplets(spark, str(tmp_path))
    got = {(r.gene, r.cell): r.value for r in expr.collect()}
    assert got == {(genes[g], cells[c]): float(np.float32(v)) for g, c, v in trip}
    kinds = {r.cell: r.cell_type for r in obs.collect()}
    assert len(kinds) == 9 and kinds["c8"] is None and kinds["c0"] == "B"
    small, obs = triplets.scan_triplets(spark, str(tmp_path), sample_cells=4)
    assert obs.count() == 4 and {r.cell for r in small.collect()} <= {r.cell for r in obs.collect()}


def test_numbered_lines_over_blocks(spark, tmp_path):
    lines = [f"line {i:05d} {'x' * (i % 50)}" for i in range(4000)]
    (tmp_path / "long.txt").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {r.line: r.value for r in triplets.numbered_lines(spark, str(tmp_path / "long.txt")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i + 1: v for i, v in enumerate(lines)}


def test_dict_text(spark):
    rows = spark.createDataFrame(
        [("a", "{'B-cells': 0.1, 'T cells': 0.25}", "{'B-cells': 1e-05, 'T cells': nan, 'X': 3}")],
        "method string, RMSE string, MAE string",
    )
    got = {r.cell_type: (r.rmse, r.mae) for r in text.dict_metrics(rows, ["method"]).collect()}
    assert got["B-cells"] == (0.1, 1e-05) and got["T cells"][0] == 0.25 and math.isnan(got["T cells"][1])
    assert got["X"] == (None, 3.0)


def test_run_log(spark):
    lines = spark.createDataFrame(
        [("INFO Replicate 3 took 12.5 seconds (0.2 minutes)",), ("took 7 seconds",), ("start",)], "value string"
    )
    got = [(r.replicate, r.seconds) for r in text.parse_run_log(lines).collect()]
    assert got == [(3, 12.5), (None, 7.0), (None, None)]


def test_sweep_params(spark):
    paths = [
        "r/radius_4.0_lambda_0.001_alpha_0.7_max_y_change_0.2./x.csv",
        "r/radius_400_lambda_1e-05_alpha_1_max_y_change_0.4./x.csv",
        "r/radius_4.0_lambda_x_alpha_0.7_max_y_change_0.2./x.csv",
        "r/radius_2.0_lambda_prior_weight_0.5./x.csv",
    ]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    names = {"radius": "radius_", "lam": "lambda_", "alpha": "alpha_", "cap": "max_y_change_"}
    got = sorted(tuple(r)[1:] for r in row_files.sweep_params(df, F.col("path"), names).collect())
    assert got == [(4.0, 0.001, 0.7, 0.2), (400.0, 1e-05, 1.0, 0.4)]
    prior = row_files.sweep_params(df, F.col("path"), {"radius": "radius_", "w": "lambda_prior_weight_"})
    assert [tuple(r)[1:] for r in prior.collect()] == [(2.0, 0.5)]


def test_scan_rows_nan_and_proportions(spark, tmp_path):
    (tmp_path / "Prop_metrics_other_map_2.csv").write_text("JSD,corr\nNaN,0.5\nNA,1\n")
    rows = row_files.scan_rows(
        spark, str(tmp_path / "*.csv"), "JSD double, corr double", {"replicate": r"(?<=_map_)(\d+)", "method": r"metrics_(\w+?)_map"}
    ).collect()
    assert [tuple(r) for r in rows] == [(None, 0.5, "2", "other"), (None, 1.0, "2", "other")]
    wide = spark.createDataFrame([("s1", 0.2, 0.8, 1.0, 2.0)], "spot string, b double, a double, spot_x double, spot_y double")
    assert sorted(map(tuple, row_files.proportions_long(wide, ["spot"]).collect())) == [("s1", "a", 0.8), ("s1", "b", 0.2)]


def test_stage_resume(spark, tmp_path):
    data = spark.createDataFrame([("00", "a", 1), ("00", "b", 2), ("01", "a", 3)], "run_id string, sample string, v int")
    seen = []

    def step(df):
        seen.append(df.count())
        return df.withColumn("v", F.col("v") * 10)

    path = str(tmp_path / "st")
    sinks.run_stage(data.where("run_id = '00'"), step, path)
    out = sinks.run_stage(data, step, path)
    assert seen == [2, 1] and sorted(tuple(r[c] for c in ("run_id", "sample", "v")) for r in out.collect()) == [
        ("00", "a", 10), ("00", "b", 20), ("01", "a", 30),
    ]
    sinks.run_stage(data, step, path)
    assert seen[-1] == 0
    assert sinks.run_stage(data, step, path, rerun=True).count() == 3 and seen[-1] == 3


def test_assemble(spark, tmp_path):
    (tmp_path / "ST_sim").mkdir()
    (tmp_path / "CITE_sim").mkdir()
    for i in range(2):
        spots = [f"spot_{k}" for k in range(3)]
        counts = np.array([[0, 2, 5], [1, 0, 0]]) + i
        pd.DataFrame(np.log1p(counts), index=["A", "B"], columns=spots).to_csv(tmp_path / f"ST_sim/Wu_ST_{i}_data.csv")
        pd.DataFrame([[1, 0, 7]], index=["P"], columns=spots).to_csv(tmp_path / f"CITE_sim/Wu_CITE_{i}_data.csv")
        pd.DataFrame({"spot": spots, "spot_x": [0, 1, 2], "spot_y": 0}).to_csv(tmp_path / f"ST_sim/Wu_ST_{i}_meta.csv")
        pd.DataFrame({"T": [1.0, 0.0], "U": [0.0, 1.0], "spot_x": 0, "spot_y": 0}, index=spots[:2]).to_csv(
            tmp_path / f"ST_sim/Wu_ST_{i}_prop.csv"
        )
    t = assemble.assemble_replicates(spark, str(tmp_path))
    expr = {(r.sample, r.gene, r.spot): r.value for r in t["expr"].collect()}
    assert expr[("0", "A", "spot_2")] == 5 and expr[("1", "B", "spot_0")] == 2 and ("0", "A", "spot_0") not in expr
    assert t["protein"].count() == 4 and t["spot"].count() == 6
    prop = {(r.sample, r.spot, r.cell_type): r.p for r in t["prop"].collect()}
    assert prop[("1", "spot_1", "U")] == 1.0 and prop[("0", "spot_2", None)] is None
    wide = assemble.assemble_spots(t["expr"], t["protein"], t["spot"], t["prop"].dropna(), ["T", "U"])
    row = wide.where("sample = '0' and spot = 'spot_2'").first()
    assert (row.n_genes, row.expr_total, row.protein_total, row["T"]) == (1, 5.0, 7.0, None)
    assemble.write_tables(t, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/expr")).count() == t["expr"].count()


def test_truth_from_cells(spark):
    index = spark.createDataFrame(
        [("0", "c1", "T", "s1"), ("0", "c2", "T", "s1"), ("0", "c3", "U", "s1"), ("0", "c4", "U", "s2")],
        "sample string, cell string, cell_type string, spot string",
    )
    expr = spark.createDataFrame(
        [("c1", "g", math.log1p(2)), ("c2", "g", math.log1p(3)), ("c3", "g", 0.0), ("c4", "h", math.log1p(1))],
        "cell string, gene string, value double",
    )
    got = {(r.cell_type, r.spot, r.gene): r.value for r in composition.gt_layers(index, expr).collect()}
    assert got == {("T", "s1", "g"): 5.0, ("U", "s2", "h"): 1.0}
    prop = {(r.spot, r.cell_type): r.p for r in composition.spot_prop(index).collect()}
    assert prop == pytest.approx({("s1", "T"): 2 / 3, ("s1", "U"): 1 / 3, ("s2", "U"): 1.0})


def test_filters(spark):
    expr = spark.createDataFrame(
        [("0", s, g, v) for s, g, v in (("a", "MT-1", 1.0), ("a", "x", 2.0), ("b", "x", 4.0), ("b", "y", 1.0), ("c", "x", 1.0))],
        "sample string, spot string, gene string, value double",
    )
    spots = spark.createDataFrame([("0", s) for s in "abcd"], "sample string, spot string")
    rest, mt = filters.split_prefix(expr)
    assert (rest.count(), mt.count()) == (4, 1)
    assert {r.gene for r in filters.filter_gex(expr, 0.75, 1.1, cells=spots).collect()} == {"x"}
    assert filters.filter_gex(expr, 0.76, 1.1, cells=spots).count() == 0
    assert {r.gene for r in filters.filter_genes3(expr, 0, 0.5, 0.9, cells=spots).collect()} == {"MT-1", "x", "y"}
    assert {r.gene for r in filters.filter_genes3(expr, 0, 0.5, 1.0, cells=spots).collect()} == {"x"}
    left = filters.filter_min(expr, 2, 2).collect()
    assert {(r.spot, r.gene) for r in left} == {("a", "x"), ("b", "x")}
    assert {r.spot for r in filters.filter_min_counts(expr, 3).collect()} == {"a", "b"}
    bad = spark.createDataFrame([("0", -1.0), ("0", math.nan), ("0", None), ("0", 0.0)], "sample string, value double")
    c = filters.data_checks(bad).first()
    assert (c.n_rows, c.n_negative, c.n_nan, c.n_null, c.n_zero) == (4, 1, 1, 1, 1)


def test_half_even_and_names(spark):
    df = spark.createDataFrame([(math.log1p(2.5), "x_y_Cancer Epithelial", "spot_7"), (math.log1p(3.5), "B", "z")], "v double, n string, s string")
    got = df.select(F.rint(F.lit(2.5)), scalar.counts_from_log(F.log1p(F.lit(7.0))), scalar.last_token(F.col("n")),
                    scalar.canonical_type(F.col("n")), scalar.id_number(F.col("s"))).collect()
    assert tuple(got[0]) == (2.0, 7.0, "Cancer Epithelial", "x_y_Cancer_Epithelial", 7)
    assert got[1][4] is None


def test_tool_outputs(spark):
    rows = spark.createDataFrame(
        [("0", "a", "q05_T", 1.0), ("0", "a", "q05_U", 3.0), ("0", "b", "q05_T", 0.0)],
        "sample string, spot string, cell_type string, p double",
    )
    got = {(r.spot, r.cell_type): r.p for r in tool_outputs.abundance_props(rows).collect()}
    assert got[("a", "U")] == 0.75 and math.isnan(got[("b", "T")])
    assert {r.p for r in tool_outputs.mapping_props(rows.where("spot = 'b'")).collect()} == {0.0}


def test_mapping_layers_and_labels(spark):
    expr = spark.createDataFrame([("0", "a", "g1", 2.0)], "sample string, spot string, gene string, value double")
    w = spark.createDataFrame(
        [("0", "a", "T", 3.0), ("0", "a", "U", 0.0), ("0", "a", "max", 9.0)],
        "sample string, spot string, cell_type string, p double",
    )
    kept = tool_outputs.label_scores(w, ["T", "U"])
    got = [tuple(r) for r in tool_outputs.mapping_layers(expr, kept).collect()]
    assert kept.count() == 2 and got == [("0", "T", "a", "G1", 6.0)]


def test_incomplete_metrics(spark):
    rows = spark.createDataFrame(
        [("x", 1.0, math.nan, 1.0), ("y", 1.0, 1.0, 1.0), ("z", None, 1.0, 1.0)],
        "cell_type string, rmse double, nrmse double, mae double",
    )
    assert {r.cell_type for r in filters.incomplete_metrics(rows).collect()} == {"x", "z"}


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_wide_row_named_as_the_label(spark, tmp_path):
    (tmp_path / "a.csv").write_text("gene|s1|s2\ngene|1|0\nB|0|2\n")
    rows = matrix.scan_wide(spark, str(tmp_path / "a.csv"), index_label="gene", sep="|").collect()
    assert sorted((r.gene, r.spot, r.value) for r in rows) == [("B", "s2", 2.0), ("gene", "s1", 1.0)]


@pytest.mark.parametrize("text, message", [("gene,s1\nA,1,2\n", "another width"), ("A,1\nB,2\n", "no header")])
def test_wide_refuses_files_it_would_mislabel(spark, tmp_path, text, message):
    (tmp_path / "a.csv").write_text(text)
    with pytest.raises(Exception, match=message):
        matrix.scan_wide(spark, str(tmp_path / "a.csv"), index_label="gene").collect()


@pytest.mark.parametrize("table", [True, False])
def test_matrix_of_many_columns_grows_with_its_cells(spark, tmp_path, monkeypatch, table):
    monkeypatch.setattr(matrix, "SHEET_ROWS", 50)
    rng = np.random.default_rng(3)
    n, width = 1100, 64
    cells = {(f"t {i % 2}" if i % 7 else None, int(r), int(g)): float(v) for i, (r, g, v) in enumerate(zip(rng.integers(0, 400, 900), rng.integers(0, n, 900), rng.integers(1, 9, 900)))}
    cells |= {("t 0", 1000, 0): 0.0, ("t 0", 1001, n + 5): 3.0}  # a row of zeros, and one with a cell of no column alone
    facts = spark.createDataFrame([(t, r, g, v) for (t, r, g), v in cells.items()], "cell_type string, spot long, gene long, value double")
    genes = spark.range(n).select(F.col("id").alias("gene")).repartition(5) if table else [str(i) for i in range(n)]
    path = str(tmp_path / "w")
    matrix.write_wide(facts, path, genes, ["cell_type"], "spot", "gene", "spot", width)
    fields = {"cell_type": r"cell_type=([^/]+)/"}
    back = matrix.scan_wide(spark, path + "/*/part-*", "spot", "gene", fields, "spot")
    none = "__HIVE_DEFAULT_PARTITION__"
    want = {(t or none, str(r), str(g)): v for (t, r, g), v in cells.items() if v and g < n}
    assert {(r.cell_type, r.spot, r.gene): r.value for r in back.collect()} == want and back.count() == len(want)
    rows, cols = matrix.wide_keys(spark, path + "/*/part-*", "spot", "gene", fields, "spot")
    assert {(r.cell_type, r.spot) for r in rows.collect()} == {(t or none, str(r)) for t, r, _ in cells}
    assert cols.count() == 3 * n
    lines = [v.value for v in spark.read.text(path + "/*/part-*").collect()]
    # one matrix of all columns has 4 characters at least for each row and column
    assert max(len(v.split(",")) for v in lines) == width + 1
    assert sum(map(len, lines)) < 4 * rows.count() * n / 3


@pytest.mark.parametrize("tall", [True, False])
def test_sheets_of_a_sparse_matrix_are_few_and_short(spark, tmp_path, tall):
    """Rows (or columns) of 24 cells among 20,000 places: text and files follow the cells, not blocks of columns."""
    rng = np.random.default_rng(8)
    lines = [(i, int(g)) for i in range(600) for g in rng.choice(20000, 24, replace=False)]
    want = {(str(r if tall else g), str(g if tall else r)): float(v) for (r, g), v in zip(lines, rng.integers(1, 50, len(lines)))}
    facts = spark.createDataFrame([(r, int(c), v) for (r, c), v in want.items()], "spot string, gene long, value double")
    matrix.write_wide(facts, str(tmp_path / "w"), spark.range(20000 if tall else 600).select(F.col("id").alias("gene")), [], "spot", "gene", "spot")
    files = list((tmp_path / "w").glob("part-*"))
    lengths = [len(r.value) for r in spark.read.text(str(tmp_path / "w")).collect()]
    assert len(files) < 30 and sum(lengths) < 500 * len(want)
    back = matrix.scan_wide(spark, str(tmp_path / "w"), "spot", "gene", {}, "spot").collect()
    assert {(r.spot, r.gene): r.value for r in back} == want and len(back) == len(want)


def test_sheets_of_rows_without_names(spark, tmp_path):
    """A null row is another row than one with an empty name; a row with more cells than a sheet has places is cut."""
    facts = spark.createDataFrame([(None, i, 1.0) for i in range(9)] + [("", i, 2.0) for i in range(9)], "spot string, gene long, value double")
    matrix.write_wide(facts, str(tmp_path / "w"), spark.range(12).select(F.col("id").alias("gene")), [], "spot", "gene", "spot", 4)
    back = matrix.scan_wide(spark, str(tmp_path / "w"), "spot", "gene", {}, "spot").collect()
    assert sorted((int(r.gene), r.value) for r in back) == sorted((i, v) for i in range(9) for v in (1.0, 2.0))


def test_wide_file_read_in_blocks(spark, tmp_path):
    """A file larger than a block gives the same cells and keys as the same file read whole."""
    rng = np.random.default_rng(9)
    x = rng.poisson(0.4, (300, 40)).astype(float)
    x[5], x[7, 39], x[8] = 0, np.nan, np.nan
    frame = pd.DataFrame(x, [f"g{i}" for i in range(299)] + ["gene"], [f'"s {i}"' for i in range(40)])
    text = frame.to_csv(index_label="gene", quoting=3, escapechar="\\").replace("\\", "")
    head = text[: text.index("\n") + 1]
    (tmp_path / "a.csv").write_text("\n" + text + "  \n" + head + "last" + ",0" * 39 + ",\n")
    want = {(f"g{r}" if r < 299 else "gene", f"s {c}"): None if math.isnan(v) else v for (r, c), v in np.ndenumerate(x) if v} | {("last", "s 39"): None}

    def read():
        cells = matrix.scan_wide(spark, str(tmp_path / "a.csv"), index_label="gene").collect()
        rows, cols = matrix.wide_keys(spark, str(tmp_path / "a.csv"), index_label="gene")
        dense = matrix.scan_wide(spark, str(tmp_path / "a.csv"), index_label="gene", keep_zero=True).count()
        return {(r.gene, r.spot): r.value for r in cells}, len(cells), {r.gene for r in rows.collect()}, {r.spot for r in cols.collect()}, dense

    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    whole = read()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        blocks = read()
        (tmp_path / "b.csv").write_text("gene,s1\n" + "".join(f"g{i},0\n" for i in range(900)) + "bad,0,0\n")
        with pytest.raises(Exception, match="another width"):
            matrix.scan_wide(spark, str(tmp_path / "b.csv"), index_label="gene").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert whole == blocks == (want, len(want), {*frame.index, "last"}, {f"s {i}" for i in range(40)}, 301 * 40)


def test_tasks_on_files_need_no_copy_of_the_library(tmp_path):
    """Executors without the package can load the tasks that cut and make files."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    work = "import pickle, sys; list(pickle.load(sys.stdin.buffer)(iter([])))"
    for task in (matrix._cut_lines(["sample"], True, False, ","), matrix._cut_sheets(1, True, "spot", 8)):
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        subprocess.run([sys.executable, "-c", work], input=cloudpickle.dumps(task), cwd=tmp_path, env=env, check=True)
