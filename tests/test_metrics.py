import json

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabkit.operators import compare as C
from tabkit.operators import inspect as I
from tabkit.operators import metrics as N
from tabkit.operators import ml as M
from tabkit.sources.tables import read_scores


@pytest.mark.parametrize("leaf, fan", [(2, 3), (1000, 16)])
def test_closest_distance_is_exact(spark, leaf, fan):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        x = float(rng.choice([0.0, 0.01, 5.0])) + float(rng.exponential(0.001))
        rows.append((i, "real" if i % 2 else "synthetic", x, float(rng.integers(0, 5)), str(rng.integers(0, 3)), "n" if i % 20 == 0 else "abc"[i % 3]))
    rows += [(900, "synthetic", 50.0, -3.0, "9", "z"), (901, "real", 7.0, 2.0, "9", "a"), (902, "synthetic", 7.0, 2.0, "9", "a")]
    df = spark.createDataFrame(rows, "id int, dataset string, x double, y double, c string, e string")
    real = [r for r in rows if r[1] == "real"]
    span = [max(r[i] for r in real) - min(r[i] for r in real) for i in (2, 3)]
    want = {
        s[0]: min(abs(s[2] - r[2]) / span[0] + abs(s[3] - r[3]) / span[1] + (s[4] != r[4]) + (s[5] != r[5]) for r in real)
        for s in rows if s[1] == "synthetic"
    }
    got = {r["id"]: r["dcr"] for r in N.closest_record_distance(df, "id", ["x", "y"], ["c", "e"], "real", "synthetic", leaf, fan).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9), k


def test_closest_distance_with_nulls(spark):
    """Null equals null and differs by 1 from every value, also from the smallest of its column; without real rows there is no distance."""
    rng = np.random.default_rng(5)
    some = lambda v: None if rng.random() < 0.2 else v
    rows = [(i, "real" if i % 3 else "synthetic", some(float(rng.integers(0, 4))), some(float(rng.normal())), None, some("abc"[i % 3]), some(str(rng.integers(0, 30)))) for i in range(200)]
    rows += [(900, "synthetic", None, None, None, None, None), (901, "synthetic", 0.0, None, 3.0, "a", None)]
    df = spark.createDataFrame(rows, "id int, dataset string, x double, y double, z double, c string, e string")
    real = [r for r in rows if r[1] == "real"]
    span = {i: (max(v) - min(v)) or 1.0 if (v := [r[i] for r in real if r[i] is not None]) else 1.0 for i in (2, 3, 4)}

    def gap(s, r, i):
        if s[i] is None or r[i] is None or i > 4:
            return float(s[i] != r[i])
        return abs(s[i] - r[i]) / span[i]

    want = {s[0]: min(sum(gap(s, r, i) for i in range(2, 7)) for r in real) for s in rows if s[1] == "synthetic"}
    for fan, leaf in ((2, 1), (4, 8)):
        got = {r["id"]: r["dcr"] for r in N.closest_record_distance(df, "id", ["x", "y", "z"], ["c", "e"], "real", "synthetic", leaf, fan).collect()}
        assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    none = N.closest_record_distance(df.where("dataset <> 'real'"), "id", ["x"], ["c"], "real", "synthetic").collect()
    assert len(none) == len(want) and {r["dcr"] for r in none} == {None}


def test_closest_distance_search_leaves_most_of_the_tree(spark):
    """Rows on a line: a row meets the leaves around it, not all points."""
    df = spark.range(4000).selectExpr("id", "if(id % 2 = 0, 'real', 'synthetic') AS dataset", "cast(id as double) AS x")
    reals = df.where("dataset = 'real'").selectExpr("x / 3998 AS x0")
    leaves, levels = N._packed_tree(reals, ["x0"], [], 16, 4)
    assert [n.count() for n in levels] == [125, 32, 8, 2] and leaves.count() == 2000
    boxes = sorted((r["lo_x0"], r["hi_x0"]) for r in levels[0].collect())
    assert all(a[1] < b[0] for a, b in zip(boxes, boxes[1:]))
    got = {round(r["dcr"] * 3998, 6) for r in N.closest_record_distance(df, "id", ["x"], [], "real", "synthetic", 16, 4).collect()}
    assert got == {1.0}


def test_closest_distance_with_many_columns_moves_blocks_not_pairs(spark, monkeypatch):
    """Numbers and categories without structure leave no node out: rows still meet points in blocks, so little is written for all these pairs."""
    from tabkit import session

    rng = np.random.default_rng(8)
    rows = [(i, "real" if i % 2 else "synthetic", *map(float, rng.uniform(0, 1, 4)), *map(str, rng.integers(0, 5, 4))) for i in range(1200)]
    names = [f"n{i}" for i in range(4)], [f"k{i}" for i in range(4)]
    df = spark.createDataFrame(rows, ["id", "dataset", *names[0], *names[1]])
    pairs = []

    def counted(step, name="step"):
        out = session.materialize(step, name)
        if name in ("dcr-pairs", "dcr-met"):
            pairs.append(out.count())
        return out

    monkeypatch.setattr(N, "materialize", counted)
    got = {r["id"]: r["dcr"] for r in N.closest_record_distance(df, "id", *names, "real", "synthetic").collect()}
    real = [r for r in rows if r[1] == "real"]
    x, k = np.array([r[2:6] for r in real]), np.array([r[6:] for r in real])
    span = x.max(0) - x.min(0)
    for r in rows:
        if r[1] == "synthetic":
            assert got[r[0]] == pytest.approx((np.abs(x - r[2:6]) / span).sum(1).__add__((k != np.array(r[6:])).sum(1)).min(), abs=1e-9)
    assert max(pairs) < 100  # 600 rows and 3 leaves: by rows, 1800


def test_closest_distance_in_several_blocks_and_parts(spark, monkeypatch):
    """Blocks of few rows, leaves dealt to several tasks, a beam of one node: the result is that of all pairs."""
    for name, small in (("BLOCK_ROWS", 16), ("MET", 2), ("TASK", 3), ("BEAM", 1), ("LISTED", 3)):
        monkeypatch.setattr(N, name, small)
    rng = np.random.default_rng(11)
    rows = [(i, "real" if i % 2 else "synthetic", None if i % 11 == 0 else float(rng.uniform()), float("nan") if i % 7 == 0 else float(rng.normal()), None if i % 5 == 0 else str(rng.integers(0, 6))) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, dataset string, x double, y double, c string")
    clean = [(*r[:3], None if r[3] != r[3] else r[3], r[4]) for r in rows]
    real = [r for r in clean if r[1] == "real"]
    span = {i: max(v) - min(v) for i in (2, 3) if (v := [r[i] for r in real if r[i] is not None])}
    gap = lambda s, r, i: float(s[i] != r[i]) if i == 4 or s[i] is None or r[i] is None else abs(s[i] - r[i]) / span[i]
    want = {s[0]: min(sum(gap(s, r, i) for i in (2, 3, 4)) for r in real) for s in clean if s[1] == "synthetic"}
    got = {r["id"]: r["dcr"] for r in N.closest_record_distance(df, "id", ["x", "y"], ["c"], "real", "synthetic", 8, 4).collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_ks_on_ties(spark):
    df = spark.createDataFrame([("r", 1.0)] * 3 + [("r", 2.0)] + [("s", 2.0)] * 2 + [("s", 3.0)] * 2, "dataset string, x double")
    assert N.ks_statistic(df, ["x"], "r", "s").first()["ks"] == pytest.approx(0.75)


def test_identical_and_disjoint(spark):
    same = spark.sql("SELECT d AS dataset, CAST(id % 9 AS double) AS x, CAST(id % 3 AS string) AS c FROM range(90), (VALUES ('r'), ('s')) v(d)")
    assert {r["hellinger"] for r in N.hellinger(same, ["x"], ["c"], "r", "s").collect()} == {0.0}
    apart = same.withColumn("c", F.concat("dataset", "c"))
    assert N.hellinger(apart, [], ["c"], "r", "s").first()["hellinger"] == 1.0
    assert N.contingency_similarity(apart.withColumn("e", F.lit("k")), ["c", "e"], "r", "s").first()["similarity"] == pytest.approx(0.0)


def test_constant_column_histogram(spark):
    df = spark.sql("SELECT 'r' AS dataset, 4.0D AS x FROM range(10)")
    got = C.histogram(df, ["x"], 4).orderBy("bin").collect()
    assert [r["n"] for r in got] == [0, 0, 10, 0] and got[0]["left"] == 3.5 and got[2]["density"] == 4.0


def test_histogram_matches_numpy(spark):
    x = np.round(np.random.default_rng(3).uniform(0, 1, 500), 2)
    df = spark.createDataFrame([("r", float(v)) for v in x], "dataset string, x double")
    want, edges = np.histogram(x, 30)
    got = C.histogram(df, ["x"]).orderBy("bin").collect()
    assert [r["n"] for r in got] == want.tolist() and got[-1]["right"] == pytest.approx(edges[-1])


def test_normalise_keeps_the_sign_flip(spark):
    df = spark.createDataFrame([("a", "c", -2.0), ("b", "c", -4.0), ("a", "z", 0.0)], "dataset string, column string, mean double")
    got = {(r["dataset"], r["column"]): r["mean"] for r in C.normalise_by_max(df, ["mean"]).collect()}
    assert got == {("a", "c"): 1.0, ("b", "c"): 2.0, ("a", "z"): 0.0}


def test_common_columns(spark):
    a, b = spark.sql("SELECT 1 AS x, 'p' AS y, 2 AS z"), spark.sql("SELECT '1' AS x, 'q' AS y, 2.5D AS z, 1 AS w")
    assert C.common_columns({"a": a, "b": b}) == (["z"], ["x", "y"])
    both, numeric, other = C.union_datasets({"a": a, "b": b})
    assert both.count() == 2 and numeric == ["z"] and other == ["x", "y"]
    assert C.compare_correlations(both, numeric).count() == 0


def test_report_files(spark, tmp_path):
    report = {"Report": {"KS": {"Scores": {"age": 0.9}}, "Size": {"Scores": 1}, "Correlation_Similarity": {"Scores": {"age__hours": 0.8, "age__pay": None}},
                         "Bad": {"Scores": {}}, "Odd": 3, "Nested": {"Scores": {"age": {"statistic": 1}}}}}
    (tmp_path / "a.json").write_text(json.dumps(report, indent=2))
    (tmp_path / "b.json").write_text('{"Other": 1}')
    scores = C.report_scores(read_scores(spark, str(tmp_path)))
    got = {(r["metric"], r["kind"], r["key"], r["key2"], r["value"]) for r in scores.collect()}
    assert got == {
        ("KS", "column", "age", None, 0.9), ("Size", "single", None, None, 1.0), ("Correlation_Similarity", "pair", "age", "hours", 0.8),
        ("Correlation_Similarity", "pair", "age", "pay", None), ("Bad", "empty", None, None, None), ("Odd", "empty", None, None, None),
    }
    matrix = {(r["col_a"], r["col_b"]): r["value"] for r in C.pair_matrix(scores).collect()}
    assert matrix["age", "age"] == 1.0 and matrix["hours", "age"] == 0.8 and matrix["pay", "age"] == 0.0 and matrix["hours", "pay"] == 1.0


def test_f1_and_r2(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "z")], "t string, p string")
    row = M.macro_f1(df, "t", "p").first()
    assert row["macro_f1"] == pytest.approx((2 / 3 + 2 / 3 + 0 + 0) / 4) and row["classes"] == 4
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "t double, p double")
    assert M.r2_score(flat, "t", "p").first()["r2"] is None


def test_split_sizes(spark):
    assert M.split_sizes(6000, 5000, 1000) == (5000, 1000)
    assert M.split_sizes(101, 5000, 1000) == (80, 21)
    parts = M.split(spark.range(50), ["id"], 30, 10)
    assert {r["is_train"]: r["count"] for r in parts.groupBy("is_train").count().collect()} == {True: 30, False: 10}


def test_date_features_from_text(spark):
    df = spark.createDataFrame([("2021-03-05", "2021-03-07"), (None, "x")], "a string, b string")
    got = M.date_features(df, ["a", "b"]).orderBy("duration_days").collect()
    assert got[0]["duration_days"] == 0.0 and got[1]["duration_days"] == 2.0 and "a" not in got[0].asDict()
    assert got[0]["date_month_sin"] == pytest.approx(0.5) and got[1]["date_hour_cos"] == 1.0
    assert M.safe_name("a/b\\c") == "a_b_c"


def test_models_on_text_and_classes(spark):
    df = spark.range(300).selectExpr("id", "id % 7 AS n", "IF(id % 4 = 0, NULL, CAST(id % 3 AS string)) AS c", "CASE WHEN id % 7 > 4 THEN 'x' WHEN id % 7 > 2 THEN 'y' ELSE 'z' END AS t")
    got = {(r["dataset"], r["model"]): r["score"] for r in M.evaluate_utility(
        df, {("e", "s_8_shots"): df}, "t", "classification", ["id"], 200, 50, id_column="id", models=["LinearSVC", "DecisionTree", "MLPClassifier"]).collect()}
    assert len(got) == 8 and got["real", "DecisionTree"] == pytest.approx(1.0)
    assert got["real", "Average"] == pytest.approx(np.mean([v for (d, m), v in got.items() if d == "real" and m != "Average"]))


def test_inspection(spark):
    df = spark.sql("SELECT * FROM VALUES (1.0D, 'a'), (2.0D, 'a'), (4.0D, 'b'), (9.0D, NULL), (9.0D, NULL) v(x, s)")
    o = I.overview(df).first()
    assert (o["rows"], o["columns"], o["duplicate_rows"], o["missing_cells"], o["missing_percent"]) == (5, 2, 1, 2, 20.0)
    four = df.limit(4).where("x < 9").union(spark.sql("SELECT 9.0D, 'c'"))
    assert I.numeric_detail(four, ["x"]).first()["skew"] == pytest.approx(1.3309, abs=1e-4)
    few = spark.sql("SELECT 1.0D AS x UNION ALL SELECT 2.0D")
    assert I.numeric_detail(few, ["x"]).first()["skew"] is None
    assert I.target_report(df, "s")[0] == "classification"
    assert I.target_report(spark.range(50).selectExpr("id * 1.5D AS t"), "t")[0] == "regression"
    assert [r["value"] for r in I.sample_values(df, ["s"]).orderBy("example_no").collect()] == ["a", "b"]
    assert I.date_range(spark.sql("SELECT '2021-03-05' AS d UNION ALL SELECT 'x'"), ["d"]).first()["min_date"].startswith("2021-03-05")
    meta = {(r["table"], r["column"]): r["sdtype"] for r in I.describe_metadata(spark, {"t": df}).collect()}
    assert meta == {("t", "x"): "numerical", ("t", "s"): "categorical"}


def test_ridge_and_plain_regression_are_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3)) * [1.0, 5.0, 0.3]
    y = x @ [3.0, -2.0, 1.0] + rng.normal(size=60) * 4 + 10
    rows = spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x, y)], ["label", "features"])
    models = M.regressors(60, float(np.std(y)))
    centred, target = x - x.mean(0), y - y.mean()
    for name, penalty in (("Ridge", M.RIDGE_PENALTY), ("LinearRegression", 0.0)):
        want = np.linalg.solve(centred.T @ centred + penalty * np.eye(3), centred.T @ target)
        assert np.allclose(models[name].fit(rows).coefficients.toArray(), want, rtol=1e-8), name


def test_logistic_penalty_is_on_the_sum_of_losses(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 2))
    y = (x @ [1.0, -2.0] + rng.normal(size=80) > 0.3).astype(float)
    rows = spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x, y)], ["label", "features"])
    fitted = M.classifiers(2, 2, 80)["LogisticRegression"].setTol(1e-12).fit(rows)
    w, b = fitted.coefficients.toArray(), fitted.intercept
    residual = 1 / (1 + np.exp(-(x @ w + b))) - y
    # The gradient of sum(loss) + penalty / 2 * |w|^2 vanishes at the optimum.
    assert np.allclose(x.T @ residual + M.LOGISTIC_PENALTY * w, 0, atol=1e-4) and abs(residual.sum()) < 1e-4


def test_constant_target(spark):
    rows = spark.createDataFrame([(5.0, Vectors.dense([float(i)])) for i in range(9)], ["label", "features"])
    assert np.allclose(M.regressors(9, 0.0)["Ridge"].fit(rows).transform(rows).toPandas()["prediction"], 5.0)


def test_pmse_of_one_category_is_its_share(spark):
    cells = [("a", "real", 30), ("a", "syn", 10), ("b", "real", 5), ("b", "syn", 25), (None, "real", 4), (None, "syn", 4), ("other", "left out", 50)]
    rows = spark.createDataFrame([(k, d) for k, d, n in cells for _ in range(n)], "k string, dataset string")
    got = N.pmse(rows, [], ["k"], "real", "syn").first()
    share = 39 / 78
    want = (40 * (10 / 40 - share) ** 2 + 30 * (25 / 30 - share) ** 2 + 8 * (4 / 8 - share) ** 2) / 78
    assert got["rows"] == 78 and got["synthetic_share"] == share and abs(got["pmse"] - want) < 1e-7
    one = rows.where("k = 'a'")
    assert abs(N.pmse(one, [], ["k"], "real", "syn").first()["pmse"]) < 1e-12


@pytest.mark.parametrize("block", [2, 3, 8])
def test_contingency_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(N, "PAIR_BLOCK", block)
    rng = np.random.default_rng(2)
    names = ["a", "b", "pair", "v0", "x y"]
    rows = [("r" if i % 3 else "s", *[None if rng.random() < 0.1 else str(rng.integers(0, 3)) for _ in names]) for i in range(200)] + [("other", *"00000")] * 50
    df = spark.createDataFrame(rows, "dataset string, a string, b string, pair string, v0 string, `x y` string")
    got = {(r["col_a"], r["col_b"]): r["similarity"] for r in N.contingency_similarity(df, names, "r", "s").collect()}
    assert len(got) == 10
    total = {d: sum(r[0] == d for r in rows) for d in "rs"}
    for i, x in enumerate(names):
        for j, y in list(enumerate(names))[i + 1 :]:
            cells = {(r[1 + i], r[1 + j]) for r in rows}
            at = lambda d, c: sum(r[0] == d and (r[1 + i], r[1 + j]) == c for r in rows) / total[d]
            assert got[x, y] == pytest.approx(1 - sum(abs(at("r", c) - at("s", c)) for c in cells) / 2)


def test_contingency_without_synthetic_rows(spark):
    df = spark.createDataFrame([("r", "1", "2")], "dataset string, a string, b string")
    assert [r["similarity"] for r in N.contingency_similarity(df, ["a", "b"], "r", "s").collect()] == [None]
