"""Plans and steps that once grew with the table in one task or on the driver."""

from pyspark.sql import functions as F

from tabkit.functions import quantiles as Q
from tabkit.operators import decode as D
from tabkit.operators import prompt as K
from tabkit.plans.generate import generate
from tabkit.plans.ledger import Ledger
from tabkit.plans.queries_generate import echo_model
from tabkit.plans.queries_text import simple_profile
from tabkit.sources.tables import read_table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_values_meet_the_ranges_of_quantiles_without_a_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 37).cast("double").alias("x"), (F.col("id") * 0.5).alias("y"))
    long = df.unpivot([], [F.col("x"), F.col("y")], "column", "value")
    ranges = long.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    state = Q._held(ranges.select("column", "lo", "hi", F.lit(0).cast("bigint").alias("below"), F.array(F.lit(5).cast("bigint")).alias("ranks")), [])
    narrowed = plan(Q._narrow(long, state, ["column"], 16))
    assert "SortMergeJoin" not in narrowed and narrowed.count("BroadcastHashJoin") == 2
    assert {r["column"]: r["q"] for r in Q.quantiles(df, ["x", "y"], [0.0, 1.0], (), 0).collect()} == {"x": [0.0, 36.0], "y": [0.0, 499.5]}


def test_draws_are_never_gathered_on_the_driver(spark):
    pool, prompts = spark.range(500).withColumn("s", F.col("id") % 3), spark.range(50).coalesce(1).withColumnRenamed("id", "prompt_id")
    for strata in ([], ["s"]):
        draws = K.draw_shots(pool, prompts, ["id"], 6, strata=strata)
        top = plan(draws).split("Window [row_number")[0]  # what lies above the numbering of the pool
        assert "SortMergeJoin" in top and "BroadcastExchange" not in top.split("SortMergeJoin")[0]
        assert "RoundRobinPartitioning" in plan(draws)  # one file of prompts is not one task's draws
        assert draws.count() == 300 and draws.groupBy("prompt_id").agg(F.count_distinct("id").alias("n")).where("n <> 6").isEmpty()


def test_a_round_makes_its_prompts_and_rows_in_one_step_each(spark, data, monkeypatch):
    train = read_table(spark, f"{data}/customer.parquet")
    noted = []
    monkeypatch.setattr(Ledger, "_note", lambda self, step, path, schema, keep=Ledger._note: (noted.append(step), keep(self, step, path, schema)))
    rows, _ = generate(train, echo_model("c_custkey"), 90, ["c_custkey"], k_shot=6, rows_per_prompt=3, prompts_per_batch=10, representative_threshold=None, correlations=False, seed=3, first_prompts=25)
    kinds = [s.split("-")[-1] for s in noted if s.startswith("round-")]
    rounds = len({s.split("-")[1] for s in noted if s.startswith("round-")})
    assert rows.count() == 90 and kinds.count("texts") >= 3 + rounds - 1
    assert kinds.count("prompts") == rounds and kinds.count("rows") == rounds


def test_sentences_are_parsed_once(spark):
    prof = simple_profile({"a": "integer", "b": "float", "c": "text"})
    texts = spark.createDataFrame([(0, "a is 1, b is 2.5, c is x"), (1, "a is 1, b is no, c is y"), (2, "a is 3, c is z, b is 4")], "prompt_id long, text string")
    rows = D.decode(texts, prof, "flexible")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 2  # name and value of a clause
    assert sorted((r["a"], r["b"], r["c"]) for r in rows.collect()) == [(1, 2.5, "x"), (3, 4.0, "z")]
