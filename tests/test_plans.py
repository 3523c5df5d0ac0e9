"""Guards on physical plans: what must not appear at scale."""

import re

import pytest
from pyspark.sql import functions as F

from tabkit.operators import decode as D
from tabkit.operators import encode as E
from tabkit.operators import prompt as K
from tabkit.plans import QUERIES
from tabkit.plans.queries_text import simple_profile
from tabkit.sources.tables import read_table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = [n for n in QUERIES if n not in ("ml_classification", "ml_regression", "utility_scores", "linear_models", "pmse", "pmse_category", "dcr", "dcr_wide", "generate_run")]


@pytest.mark.parametrize("name", sorted(LAZY))
def test_no_products_and_no_python(spark, data, name):
    text = plan(QUERIES[name].run(spark, data))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert bad not in text, f"{bad} in {name}"


def test_encode_and_decode_are_one_stage(spark, data):
    df = read_table(spark, f"{data}/customer.parquet")
    prof = simple_profile({"c_custkey": "integer", "c_name": "id", "c_acctbal": "float"})
    for mode in ("json", "flexible"):
        texts = E.encode(df.select("c_custkey", "c_name", "c_acctbal"), prof, mode).select(F.col("c_custkey").alias("prompt_id"), "text")
        assert "Exchange" not in plan(D.decode(texts, prof, mode))


def test_scan_reads_only_needed_columns(spark, data):
    df = read_table(spark, f"{data}/lineitem.parquet")
    from tabkit.operators.sample import describe

    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(describe(df, ["l_tax"])))
    assert schemas and all(s.startswith("l_tax") and "," not in s for s in schemas)


def test_draws_number_the_pool_inside_buckets(spark, data):
    pool = read_table(spark, f"{data}/orders.parquet")
    text = plan(K.dense_index(pool, ["o_orderkey"], 1))
    windows = re.findall(r"Window \[row_number[^\n]*", text)
    assert windows and all("_bucket" in w for w in windows)


@pytest.mark.parametrize("name", ["histogram", "box_stats", "boundary_adherence", "representative_by_source"])
def test_small_sides_are_broadcast_by_their_real_size(spark, data, name):
    assert "BroadcastHashJoin" in plan(QUERIES[name].run(spark, data))


@pytest.mark.parametrize("name", ["profile_topk", "inspect_values"])
def test_top_k_is_cut_before_the_shuffle(spark, data, name):
    assert "WindowGroupLimit" in plan(QUERIES[name].run(spark, data))


def test_domain_limit_is_cut_before_the_shuffle(spark, data):
    from tabkit.operators import profile as P

    counts = P.value_counts(read_table(spark, f"{data}/part.parquet"), ["p_name"])
    assert "WindowGroupLimit" in plan(P.ranked(counts, P.INLINE_DOMAIN))


def test_pairs_of_columns_share_a_scan(spark, data):
    from tabkit.operators import metrics as N
    from tabkit.plans.base import halves

    df = halves(spark, data)
    text = plan(N.contingency_similarity(df, ["l_returnflag", "l_linestatus", "l_discount", "l_tax", "l_quantity"], "real", "synthetic"))
    assert text.count("FileScan parquet") == 1 and text.count("Expand [") == 1
