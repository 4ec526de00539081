"""The registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import check_queries as cq

SF = "/root/testdata/sf0.001"
# one or more of each module; check_queries.py runs them all
NAMES = [
    "prop_metrics", "jsd_quantiles", "complete_prop", "gt_layers", "filter_gex", "antibody_clr", "refine_step",
    "expr_pass1", "layer_metrics", "rank_markers", "anova_block", "tukey_pairs", "box_stats", "stratified_sample",
    "scan_wide", "scan_triplets", "layer_sink", "resume_pending", "radius_skewed", "refine_props", "expr_ledger",
    "anova_block_keys", "anova_pvalues", "tukey_pvalues", "bootstrap_ci", "stratified_rows", "uniform_sample",
    "wide_layer_sink", "layer_file_metrics", "prop_file_metrics", "assemble_folders", "sweep_files",
]


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    import duckdb

    con = duckdb.connect()
    for t in cq.TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    # every query on the reference's own operators has its SQL
    assert {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"} <= set(entry.oracle_sql())
    assert len(entry.queries()) >= 70


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, tables, name):
    df = entry.queries()[name](spark, SF)
    cur = tables.execute(entry.oracle_sql()[name])
    columns, types = [d[0] for d in cur.description], [str(d[1]) for d in cur.description]
    assert cq.compare(df.columns, df.collect(), dict(df.dtypes), columns, cur.fetchall(), types) == "ok"


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_model_run_has_few_jobs(spark, tables):
    """Twenty smoothing steps are a few rounds, not two or three jobs each."""
    spark.sparkContext.setJobGroup("model-scores", "model_scores")
    entry.queries()["model_scores"](spark, SF)
    spark.sparkContext.setJobGroup("other", "other")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("model-scores")) <= 100
