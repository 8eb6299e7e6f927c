"""Shapes of physical plans that must hold at scale."""

from compare import plan, sf_dir

from tablelens.operators import cleaning, explore, preview, profile
from tablelens.queries.tables import read

SCALE = "0.001"


def test_top_values_are_cut_before_the_exchange(spark):
    text = plan(explore.top_values(read(spark, sf_dir(SCALE), "part")))
    assert text.count("WindowGroupLimit") >= 2
    text = plan(profile.sample_values(read(spark, sf_dir(SCALE), "part"), 5, ["p_partkey"], ["p_name"]))
    assert text.count("WindowGroupLimit") >= 2


def test_pages_do_not_sort_globally(spark):
    df = read(spark, sf_dir(SCALE), "orders")
    assert "TakeOrderedAndProject" in plan(preview.page(df, 2, 10, ["o_orderkey"]))
    sample = plan(explore.sample_exact(df, 100, ["o_orderkey"]))
    assert "TakeOrderedAndProject" not in sample and "Exchange" not in sample


def test_scans_read_only_what_is_needed(spark):
    df = read(spark, sf_dir(SCALE), "lineitem")
    text = plan(explore.correlations(df, ["l_quantity", "l_tax"]))
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in text
    text = plan(profile.missing_by_column(df, ["l_returnflag"]))
    assert "ReadSchema: struct<l_returnflag:string>" in text
    gaps = plan(cleaning.drop_missing(read(spark, sf_dir(SCALE), "orders"), "o_orderpriority"))
    assert "PushedFilters: [IsNotNull(o_orderpriority)]" in gaps


def test_duplicates_collapse_before_the_exchange(spark):
    text = plan(profile.table_profile(read(spark, sf_dir(SCALE), "documents").select("text", "lang")))
    assert text.count("Exchange") == 2 * 2  # listed once in the tree and once in the details
    assert "sha2" in text
