import numpy as np
import pytest
from pyspark.sql import functions as F

from tabkit.functions.ordered import running_sums
from tabkit.functions.quantiles import quantiles
from tabkit.operators import sample as S
from tabkit.operators.decode import first_rows


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_match_the_built_in(spark, by):
    df = spark.sql("SELECT id % 3 AS g, CASE WHEN id % 3 = 0 THEN 7.0 ELSE pow(id % 997, 1.5) END AS x, IF(id % 5 = 0, NULL, id) AS y, CAST(NULL AS double) AS z FROM range(20000)")
    probs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    found = {tuple(r)[:-1]: r["q"] for r in quantiles(df, ["x", "y"], probs, by).collect()}
    want = df.groupBy(*by).agg(*[F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias(c) for c in ("x", "y")]).collect()
    assert found == {(*[r[b] for b in by], c): r[c] for r in want for c in ("x", "y")}
    if not by:
        y = np.array([i for i in range(20000) if i % 5])
        assert found["y",] == pytest.approx(np.quantile(y, probs).tolist())


def test_running_sums(spark):
    df = spark.range(1000).selectExpr("id % 2 AS g", "id AS o", "id AS m").repartition(7)
    got = {(r["g"], r["o"]): r["m"] for r in running_sums(df, ["g"], ["o"], ["m"]).collect()}
    for g in (0, 1):
        total = 0
        for o in range(g, 1000, 2):
            total += o
            assert got[g, o] == total


FEW = [(1, 1.0, 1.0, 1.0), (2, 2.0, 9.0, 2.0), (3, 3.0, 3.0, 9.0), (4, 4.0, 2.0, 3.0), (5, 9.0, 8.0, 8.0), (6, None, 2.5, 2.5)]


def test_methods_match_a_plain_count(spark):
    df = spark.createDataFrame(FEW, "k int, a double, b double, c double")
    cols = {i: np.array([np.nan if r[i] is None else r[i] for r in FEW]) for i in (1, 2, 3)}
    hits = sum(((v >= np.nanquantile(v, 0.25)) & (v <= np.nanquantile(v, 0.75))).astype(int) for v in cols.values())
    for method, need in (("strict", 3), ("flexible", int(3 * 0.7)), ("individual", 1)):
        got = S.representative(df, method, 0.7, ["a", "b", "c"], fallback=False)
        assert {r["k"] for r in got.collect()} == {r[0] for r, h in zip(FEW, hits) if h >= need}


def test_fallback_when_strict_is_empty(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (2, 5.0, 0.0), (3, 5.0, 10.0), (4, 10.0, 5.0)], "k int, a double, b double")
    assert S.representative(df, "strict", features=["a", "b"], lo=0.3, hi=0.6, fallback=False).count() == 0
    assert S.representative(df, "strict", features=["a", "b"], lo=0.3, hi=0.6).count() == 4
    with pytest.raises(ValueError):
        S.representative(df, "loose", features=["a"])


def test_feature_choice(spark):
    df = spark.sql("SELECT 1 AS a, 2.0D AS b, 'x' AS c")
    assert S.select_features(df) == ["a", "b"]
    with pytest.warns(UserWarning):
        assert S.select_features(df, ["b", "c"]) == ["b"]
    with pytest.warns(UserWarning):
        assert S.select_features(df, ["c"]) == ["a", "b"]


def test_sample_does_not_depend_on_partitions(spark):
    want = None
    for parts in (1, 4, 17):
        df = spark.range(5000).withColumn("v", F.col("id") % 7).repartition(parts)
        got = rows(S.sample_rows(df, 100, 3, ["id"]), "id")
        assert len(got) == 100 and (want is None or got == want)
        want = got
    assert S.sample_rows(spark.range(10), 100).count() == 10


def test_cutoff_sample_is_the_same_sample(spark):
    df = spark.range(5000).withColumn("v", F.col("id") % 3)
    top = rows(S.sample_rows(df, 700, 3, ["id"]), "id")
    assert rows(S.sample_by_cutoff(df, 700, 3, ["id"]), "id") == top
    copies = spark.range(6000).select((F.col("id") % 2).alias("v"))
    assert S.sample_by_cutoff(copies, 1000, 3, ["v"]).count() == 1000


def test_samples_sort_few_rows(spark):
    """The threshold cuts before the sort, also where one row has most of the copies."""
    df = spark.range(20000).withColumn("v", F.col("id") % 3)
    plan = S.sample_rows(df, 50, 3, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan
    assert rows(S.sample_rows(df, 50, 3, ["id"]), "id") == rows(df.withColumn("h", F.md5(F.concat_ws(":", F.lit("3"), F.col("id").cast("string")))).orderBy("h").limit(50), "id")
    hot = spark.range(3000).selectExpr("if(id < 2900, 0, id) AS v")
    for n in (1, 40, 2950, 2999, 3000, 4000):
        assert S.sample_rows(hot, n, 5).count() == min(n, 3000)


def test_first_rows_both_routes(spark):
    df = spark.range(2000).selectExpr("id % 3 AS round", "id % 50 AS prompt_id", "id AS row_idx")
    a = rows(first_rows(df, 777), "round", "prompt_id", "row_idx")
    assert rows(first_rows(df, 777, top_n=10), "round", "prompt_id", "row_idx") == a and len(a) == 777


def test_no_numeric_columns(spark):
    df = spark.sql("SELECT 'a' AS s UNION ALL SELECT 'b'")
    assert S.representative(df, "strict").count() == 2 and S.representative(df, "flexible").count() == 2
    with pytest.warns(UserWarning):
        assert S.representative(df, "individual").count() == 0


def test_sources_have_their_own_bounds(spark):
    df = spark.range(200).selectExpr("IF(id < 150, 'hot', CAST(id AS string)) AS s", "id AS x", "id % 10 AS y")
    got = {r["s"]: r["count"] for r in S.representative_by_source(df, "s", 1.0).groupBy("s").count().collect()}
    assert got["160"] == 1 and 20 < got["hot"] < 100
