import math

import pytest
from pyspark.sql import functions as F

from tabkit.operators import prompt as K
from tabkit.operators.profile import profile
from tabkit.plans.generate import generate, generate_sweep
from tabkit.plans.queries_text import simple_profile
from tabkit.sources.tables import read_table


def shots_of(df, key="id"):
    out = {}
    for r in df.collect():
        out.setdefault(r["prompt_id"], []).append((r["shot_no"], r[key]))
    return {p: [k for _, k in sorted(v)] for p, v in out.items()}


@pytest.mark.parametrize(("pool", "k", "want"), [(100, 7, 7), (20, 7, 7), (5, 7, 5), (7, 7, 7), (1, 3, 1)])
def test_draws_are_different_rows(spark, pool, k, want):
    got = shots_of(K.draw_shots(spark.range(pool), spark.range(40).withColumnRenamed("id", "prompt_id"), ["id"], k))
    assert len(got) == 40 and all(len(set(v)) == len(v) == want for v in got.values())
    if pool > k + 1:
        assert len({tuple(v) for v in got.values()}) > 30


def test_draws_do_not_depend_on_partitions(spark):
    prompts = spark.range(10).withColumnRenamed("id", "prompt_id")
    want = None
    for parts in (1, 4, 17):
        got = shots_of(K.draw_shots(spark.range(500).repartition(parts), prompts.repartition(parts), ["id"], 6))
        assert want is None or got == want
        want = got


def test_copies_are_rows_of_their_own(spark):
    pool = spark.range(30).select(F.when(F.col("id") < 12, 0).otherwise(F.col("id")).alias("v"))
    got = K.draw_shots(pool, spark.range(3).withColumnRenamed("id", "prompt_id"), None, 30)
    assert got.count() == 90 and got.where("v = 0").count() == 36


def test_dense_index(spark):
    got = [r["idx"] for r in K.dense_index(spark.range(3000), ["id"], 5).collect()]
    assert sorted(got) == list(range(3000))


def test_spread_copies(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("v"))
    got = K.spread_copies(df, per_task=64)
    assert got.count() == 1000 and got.distinct().count() == 1000 and got.where("v = 0").agg(F.max("copy_no")).first()[0] == 399


def test_stratified_quotas(spark):
    df = spark.range(100).withColumn("s", F.when(F.col("id") < 61, "a").when(F.col("id") < 95, "b").otherwise("c"))
    quotas = {r["s"]: r["quota"] for r in K.stratum_quotas(df, ["s"], 10).collect()}
    assert quotas == {"a": 6, "b": 3, "c": 1}
    got = K.draw_shots(df, spark.range(5).withColumnRenamed("id", "prompt_id"), ["id"], 10, strata=["s"])
    counts = {(r["prompt_id"], r["s"]): r["count"] for r in got.groupBy("prompt_id", "s").count().collect()}
    assert counts == {(p, s): q for p in range(5) for s, q in quotas.items()}
    assert got.select("prompt_id", "id").distinct().count() == 50
    rare = spark.range(1000).withColumn("s", F.col("id"))
    assert K.stratum_quotas(rare, ["s"], 5).agg(F.sum("quota")).first()[0] == 5


def test_structured_prompt_text(spark):
    df = spark.createDataFrame([(i, i * 1.5, "x") for i in range(1, 6)], "a int, b double, c string")
    prof = profile(df)
    prompts = spark.range(1).withColumnRenamed("id", "prompt_id")
    shots = K.draw_shots(df, prompts, ["a"], 2)
    for mode in ("json", "flexible"):
        p = K.build_prompts(shots, prof, 3, mode, conditions={"c": "x"}, train=df).first()["prompt"]
        assert "## Examples (2 rows):\n1. " in p and "\n2. " in p and p.endswith("\n\n## Generated Data:")
        assert "Correlation Matrix (numerical features):" in p and "**Constraint**: All rows must have c=x\n\n**Requirements**:" in p
        assert ("Format: NUMBER." in p) == (mode == "flexible") and ('Example: 1. {"a": 35, "b": ..., "c": ...}' in p) == (mode == "json")
        assert "Output 3 rows, one per line, numbered 1 to 3." in p and "\0" not in p
    assert "  a: integer, min=1.00, max=5.00, mean=3.00, std=1.58, q25=2.00, q50=3.00, q75=4.00\n" in p
    plain = K.build_prompts(shots, prof, 3, "json", train=None).first()["prompt"]
    assert "Correlation" not in plain.split("## Examples")[0] and "**Constraint**" not in plain


def test_zero_quantile_is_shown():
    prof = simple_profile({"z": "float"})
    p = prof.columns["z"]
    p.min_val, p.max_val, p.mean, p.std, p.q25, p.q50, p.q75 = 0.0, 1.0, 0.5, 0.1, 0.0, 0.5, 1.0
    assert K.schema_lines(prof) == ["  z: float, min=0.00, max=1.00, mean=0.50, std=0.10, q25=0.00, q50=0.50, q75=1.00"]


def test_conditions():
    assert K.parse_conditions(["a=b", "c = d=e"]) == {"a": "b", "c": "d=e"}
    with pytest.raises(ValueError):
        K.parse_conditions(["a"])


def test_budgets_and_rounds():
    assert K.fallback_tokens(80, 25) == (6900, 2056)
    assert K.schema_tokens(25, 10) == 2730
    assert K.plan_next_round(5000, 0, 0, 25, 300) == 300
    assert K.plan_next_round(100, 0, 0, 25, 300) == math.ceil(100 / 7.5 * 1.5)
    assert K.plan_next_round(100, 80, 10, 25, 300) == math.ceil(20 / 8 * 1.5)
    assert K.plan_next_round(100, 99, 1, 25, 300) == 1


def test_plan(spark):
    got = [tuple(r) for r in K.plan_prompts(spark, 60, 25, 2, remainder=True).orderBy("prompt_id").collect()]
    assert got == [(0, 0, 25), (1, 0, 25), (2, 1, 10)]


def echo_model():
    def echo(batch, max_tokens):
        """A model that repeats the examples of its prompt, and sometimes fails."""
        import re

        out = []
        for prompt in batch:
            rows = re.findall(r"^\d+\. \{.*\}$", prompt.split("## Examples")[1].split("## Instructions")[0], re.M)
            out.append("" if hash(prompt) % 5 == 0 else "<think>hm</think>\n" + "\n".join(rows))
        return out

    return echo


def test_generate(spark, data):
    train = read_table(spark, f"{data}/customer.parquet")
    rows, prof = generate(train, echo_model(), 100, ["c_custkey"], k_shot=6, rows_per_prompt=5, prompts_per_batch=20)
    got = rows.collect()
    assert len(got) == 100 and rows.columns == train.columns
    real = {tuple(r) for r in train.collect()}
    assert all(tuple(r) in real for r in got)


def test_generate_gives_up(spark, data):
    train = read_table(spark, f"{data}/region.parquet")
    with pytest.warns(UserWarning), pytest.raises(RuntimeError):
        generate(train, lambda batch, limit: ["no rows"] * len(batch), 10, ["r_regionkey"], k_shot=2, first_prompts=1, representative_threshold=None, correlations=False)


def test_sweep(spark, data):
    train = read_table(spark, f"{data}/nation.parquet")
    rows = generate_sweep(train, echo_model(), 10, ["n_nationkey"], (3, 5), rows_per_prompt=5, prompts_per_batch=8, representative_threshold=None, correlations=False)
    assert {r["k_shot"]: r["count"] for r in rows.groupBy("k_shot").count().collect()} == {3: 10, 5: 10}


def test_counter_may_be_a_pandas_function(spark, data):
    import pandas as pd

    @F.pandas_udf("bigint")
    def words(s: pd.Series) -> pd.Series:
        return s.str.split().str.len()

    c = read_table(spark, f"{data}/customer.parquet")
    got = K.token_stats(c, ["c_custkey"], 10, counter=words).first()
    assert got["rows"] == c.count() and got["avg_row_tokens"] >= 15
    assert K.fit_rows_per_prompt(c, counter=words).first()["rows_per_prompt"] == 25
