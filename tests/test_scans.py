"""Plans that read a table few times, and exact quantiles by narrowing."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tabkit.functions import quantiles as Q
from tabkit.operators import profile as P
from tabkit.sources.tables import read_table


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """200 columns of numbers, texts, times and booleans."""
    kinds = ["id * {k} % 97", "id / {k}", "concat('t', id % {k})", "timestamp_seconds(id * {k})", "id % {k} = 0"]
    path = str(tmp_path_factory.mktemp("wide") / "wide.parquet")
    spark.range(50).select(*[F.expr(kinds[k % 5].format(k=k + 2)).alias(f"c.{k}") for k in range(200)]).write.parquet(path)
    return read_table(spark, path)


def test_types_of_200_columns_take_four_scans(wide):
    found = P.infer_types(wide)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4
    rows = {r["column"]: r for r in found.collect()}
    assert len(rows) == 200
    assert [rows[f"c.{k}"]["dtype"] for k in range(5)] == ["integer", "float", "categorical", "datetime", "boolean"]
    assert rows["c.2"]["unique_count"] == 4 and rows["c.0"]["rows"] == 50


def test_texts_are_not_shuffled_for_their_facts(spark):
    df = spark.createDataFrame([("x" * 5000 + str(i), f"{i}", "2021-03-05" if i else "see 2021-03-05 " + "y" * 100) for i in range(20)], "long string, number string, day string")
    facts = {r["column"]: r for r in P.column_facts(df).collect()}
    assert facts["long"]["avg_length"] == sum(5000 + len(str(i)) for i in range(20)) / 20
    assert facts["number"]["like_num"] == 1.0 and facts["number"]["unique_count"] == 20
    assert facts["day"]["like_date"] == 0.0  # one value that looks like a date is no date
    only = df.where("number <> '0'")
    assert {r["column"]: r["like_date"] for r in P.column_facts(only).collect()}["day"] == 1.0


def test_distinct_counts_of_every_type(spark):
    df = spark.sql("select * from values (1, 1.5D, 'a', true, date'2021-01-01', 2.50), (1, -0.0D, null, false, null, 2.50), (null, 0.0D, 'A', true, date'2021-01-02', null) as t(i, d, s, b, t, x)")
    want = {"i": 1, "d": 2, "s": 2, "b": 2, "t": 2, "x": 1}
    assert {r["column"]: r["unique_count"] for r in P.distinct_counts(df).collect()} == want
    assert {r["column"]: r["unique_count"] for r in P.distinct_counts(df, exact=False).collect()} == want
    assert {r["column"]: r["unique_count"] for r in P.distinct_counts(df.limit(0)).collect()} == dict.fromkeys(want, 0)
    assert {r["column"]: (r["rows"], r["dtype"]) for r in P.infer_types(df.limit(0)).collect()} == dict.fromkeys(want, (0, "categorical"))


SHAPES = {
    "normal": lambda r: r.gauss(0, 1),
    "magnitudes": lambda r: 10 ** r.uniform(-300, 300),
    "negative": lambda r: -(10 ** r.uniform(-30, 30)),
    "both signs": lambda r: r.choice([-1, 0, 1]) * 10 ** r.uniform(-323, 308),
    "tiny": lambda r: r.choice([-5e-324, 0.0, 5e-324, 1e-323]),
    "ends": lambda r: r.choice([-1.7e308, 1.7e308, 0.0]),
    "one": lambda r: 3.5,
    "few": lambda r: r.choice([1.0, 2.0, 5.0]),
    "some": lambda r: r.choice([None, None, float(r.randrange(9))]),
    "none": lambda r: None,
}


@pytest.mark.parametrize("by, cells", [([], 4096), (["g"], 64)])
def test_quantiles_match_sorted_values(spark, by, cells):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), *[shape(rng) for shape in SHAPES.values()]) for _ in range(700)]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"`{c}` double" for c in SHAPES)).repartition(3)
    probs = [0.0, 0.05, 0.25, 0.5, 0.751, 1.0]
    got = {(r["g"] if by else None, r["column"]): r["q"] for r in Q.quantiles(df, list(SHAPES), probs, by, cells).collect()}
    for g in ["a", "b", None] if by else [None]:
        for k, c in enumerate(SHAPES, 1):
            own = sorted(r[k] for r in rows if r[k] is not None and (not by or r[0] == g))
            if not own:
                assert got[g, c] is None
                continue
            for p, q in zip(probs, got[g, c], strict=True):
                at = (len(own) - 1) * p
                a, b = own[math.floor(at)], own[math.ceil(at)]
                assert q == (a if math.floor(at) == math.ceil(at) else (math.ceil(at) - at) * a + (at - math.floor(at)) * b)
    assert len(got) == len(SHAPES) * (3 if by else 1)


def test_quantiles_shuffle_counts_only(spark, data):
    """A round sends one row per cell and task, however many rows there are."""
    li = read_table(spark, f"{data}/lineitem.parquet")
    assert Q.quantiles(li.limit(0), ["l_tax"], [0.5]).collect() == []
    long = li.select(F.lit("c0").alias("column"), F.col("l_extendedprice").alias("value"))
    state = spark.createDataFrame([("c0", 0.0, 1e6, 0, [10, 11])], "column string, lo double, hi double, below long, ranks array<long>")
    plan = Q._narrow(long, state, ["column"], 16)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Sort [value" not in plan
    (one,) = Q._narrow(long, state, ["column"], 16).collect()
    assert one["below"] <= 10 and one["ranks"] == [10, 11]


def test_correlations_of_many_columns_and_groups(spark):
    """More columns than a scan takes, more groups than a task holds; nulls pair by pair, constants, values far from zero."""
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(90)] for _ in range(5)]
    columns = {f"c{k}": [None if rng.random() < 0.1 else 1e6 * (k % 3) + base[k % 5][i] + rng.gauss(0, 0.5) for i in range(90)] for k in range(9)}
    columns |= {"same": [0.1] * 90, "none": [None] * 90, "one": [1.0] + [None] * 89}
    names = list(columns)
    rows = [(["x", None][i % 2], *[columns[c][i] for c in names]) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"{c} double" for c in names)).repartition(4)

    def r(a, b, keep):
        both = [(x, y) for i, (x, y) in enumerate(zip(columns[a], columns[b])) if keep(i) and x is not None and y is not None]
        if len({x for x, _ in both}) < 2 or len({y for _, y in both}) < 2:
            return None
        mx, my = (math.fsum(v) / len(both) for v in zip(*both))
        cov = math.fsum((x - mx) * (y - my) for x, y in both)
        return cov / math.sqrt(math.fsum((x - mx) ** 2 for x, _ in both) * math.fsum((y - my) ** 2 for _, y in both))

    old = P.GRAM_COLUMNS, P.HELD_GROUPS
    P.GRAM_COLUMNS, P.HELD_GROUPS = 6, 1
    try:
        for by, sides in (([], {(): lambda i: True}), (["g"], {("x",): lambda i: i % 2 == 0, (None,): lambda i: i % 2})):
            got = {tuple(x[:-1]): x["r"] for x in P.correlation_matrix(df, names, by).collect()}
            assert len(got) == len(sides) * len(names) ** 2
            for side, keep in sides.items():
                for a in names:
                    for b in names:
                        assert got[*side, a, b] == (None if (w := r(a, b, keep)) is None else pytest.approx(w, abs=1e-8)), (side, a, b)
    finally:
        P.GRAM_COLUMNS, P.HELD_GROUPS = old
    empty = P.correlation_matrix(df.limit(0), names[:2]).collect()
    assert len(empty) == 4 and {x["r"] for x in empty} == {None}


def test_correlations_of_64_columns_take_one_scan(wide):
    numbers = [c for c in wide.columns if int(c[2:]) % 5 == 0][:40] + [c for c in wide.columns if int(c[2:]) % 5 == 1][:24]
    plan = P.pair_correlations(wide, numbers)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_distinct_values_are_shuffled_in_few_bytes(spark):
    """Whole numbers go as they are, other short values by one hash, longer ones by two; the name of the column does not go with every value."""
    df = spark.sql("""SELECT CAST(id % 7 AS int) AS a_rather_long_name, IF(id % 3 = 0, NULL, id * 4611686018427) AS big, CAST(NULL AS bigint) AS none, IF(id % 5 = 0, -0.0D, IF(id % 5 = 1, 0.0D, id / 9)) AS d,
      IF(id % 2 = 0, FLOAT('NaN'), CAST(id AS float)) AS f, DATE '2020-01-01' + CAST(id % 4 AS int) AS day, timestamp_micros(id) AS at, CAST(id % 9 AS decimal(20, 2)) AS dec, IF(id = 8, '', CONCAT('t', id % 6)) AS s, id % 2 = 0 AS b FROM range(100)""")
    got = {r["column"]: r["unique_count"] for r in P.distinct_counts(df).collect()}
    want = df.agg(*[F.count_distinct(c).alias(c) for c in df.columns]).first().asDict()
    assert got == want and got["none"] == 0
    assert {r["column"]: r["unique_count"] for r in P.distinct_counts(df.limit(0)).collect()} == dict.fromkeys(df.columns, 0)
    plan = P.distinct_counts(df.select("a_rather_long_name", "big"))._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning(place" in line]
    assert dealt and not any("column" in line for line in dealt)
    assert "xxhash64" not in plan
