"""Checked queries: splits, features, models, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.operators import ml as M
from tabkit.plans.base import query, rounded, table, union_all

_PICKED = "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) AS no, count(*) OVER () AS total FROM orders"


@query(f"SELECT o_orderkey, no <= 5000 AS is_train FROM ({_PICKED}) WHERE no <= 6000 AND total >= 6000 UNION ALL SELECT o_orderkey, no <= least(5000, total - ceil(total * 0.2)) FROM ({_PICKED}) WHERE total < 6000 AND no <= least(5000, total - ceil(total * 0.2)) + least(1000, ceil(total * 0.2))")
def split_rows_ml(spark, d) -> DataFrame:
    return M.split(table(spark, d, "orders"), ["o_orderkey"]).select("o_orderkey", "is_train")


@query(f"""WITH p AS ({_PICKED}), s AS (SELECT *, CASE WHEN total >= 6000 THEN 5000 ELSE least(5000, total - ceil(total * 0.2)) END AS tr, CASE WHEN total >= 6000 THEN 1000 ELSE least(1000, ceil(total * 0.2)) END AS te FROM p)
SELECT no <= tr AS is_train, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS key_sum FROM s WHERE no <= tr + te GROUP BY 1""")
def split_counts(spark, d) -> DataFrame:
    parts = M.split(table(spark, d, "orders"), ["o_orderkey"])
    return parts.groupBy("is_train").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))


@query("""WITH t AS (SELECT event_id, nullif(ts, (SELECT min(ts) FROM events)) AS a, CASE WHEN event_id % 10 <> 0 THEN ts + INTERVAL 1 HOUR * (user_id + 1) END AS b FROM events)
SELECT event_id, round(coalesce((epoch_us(b) - epoch_us(a)) / 86400000000.0::DOUBLE, 0), 7) AS duration_days,
  round(sin(2 * pi() * coalesce(month(a), 1) / 12), 7) + 0.0 AS date_month_sin, round(cos(2 * pi() * coalesce(month(a), 1) / 12), 7) + 0.0 AS date_month_cos,
  round(sin(2 * pi() * coalesce(hour(a), 0) / 24), 7) + 0.0 AS date_hour_sin, round(cos(2 * pi() * coalesce(hour(a), 0) / 24), 7) + 0.0 AS date_hour_cos FROM t""")
def date_features(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    first = e.agg(F.min("ts")).first()[0]
    later = F.when(F.col("event_id") % 10 != 0, F.col("ts") + F.make_dt_interval(F.lit(0), F.col("user_id") + 1))
    rows = e.select("event_id", F.nullif("ts", F.lit(first).cast("timestamp_ntz")).alias("a"), later.alias("b"))
    return rounded(M.date_features(rows, ["a", "b"]))


@query("""WITH t AS (SELECT o_orderkey, o_orderkey % 5 > 0 AS is_train, CASE WHEN o_orderkey % 11 <> 3 THEN o_totalprice END AS price, nullif(o_custkey, 0) AS cust FROM orders)
SELECT o_orderkey, is_train, round(coalesce(price, (SELECT avg(price) FROM t WHERE is_train)), 7) AS price, round(coalesce(cust, (SELECT avg(cust) FROM t WHERE is_train))::DOUBLE, 7) AS cust FROM t""")
def impute_mean(spark, d) -> DataFrame:
    rows = table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 5 > 0).alias("is_train"), F.when(F.col("o_orderkey") % 11 != 3, F.col("o_totalprice")).alias("price"), F.expr("nullif(o_custkey, 0)").alias("cust")
    )
    return rounded(M.impute_mean(rows, ["price", "cust"]))


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'none') AS o_orderstatus FROM orders")
def fill_none(spark, d) -> DataFrame:
    return M.fill_none(table(spark, d, "orders").selectExpr("o_orderkey", "nullif(o_orderstatus, 'P') AS o_orderstatus"), ["o_orderstatus"])


_STATUS, _PRIORITY = ["F", "O", "P"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{v}')::INTEGER AS \"o_orderstatus_{v}\"" for v in _STATUS) + ", " + ", ".join(f"(o_orderpriority = '{v}')::INTEGER AS \"o_orderpriority_{v}\"" for v in _PRIORITY) + " FROM orders")
def one_hot(spark, d) -> DataFrame:
    return M.one_hot(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS label FROM orders")
def label_index(spark, d) -> DataFrame:
    return M.label_index(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority").select("o_orderkey", "label")


# Truth and a made-up prediction, with a class only in each.
_PREDICTED = "SELECT l_linestatus AS part, CASE WHEN l_linenumber = 7 THEN 'T' ELSE l_returnflag END AS truth, CASE WHEN l_quantity < 10 THEN 'A' WHEN l_quantity > 45 THEN 'Z' ELSE l_returnflag END AS guess FROM lineitem"


@query(f"""WITH p AS ({_PREDICTED}), c AS (SELECT part, truth AS k FROM p UNION SELECT part, guess FROM p),
f AS (SELECT c.part, k, 2.0::DOUBLE * count(*) FILTER (truth = k AND guess = k) / (count(*) FILTER (truth = k) + count(*) FILTER (guess = k)) AS f1 FROM c JOIN p ON p.part = c.part GROUP BY ALL)
SELECT part, round(avg(f1), 7) AS macro_f1, count(*)::BIGINT AS classes FROM f GROUP BY part""")
def macro_f1(spark, d) -> DataFrame:
    guess = F.when(F.col("l_quantity") < 10, "A").when(F.col("l_quantity") > 45, "Z").otherwise(F.col("l_returnflag"))
    rows = table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("part"), F.when(F.col("l_linenumber") == 7, "T").otherwise(F.col("l_returnflag")).alias("truth"), guess.alias("guess")
    )
    return rounded(M.macro_f1(rows, "truth", "guess", ["part"]))


@query("""SELECT l_returnflag, round(1 - sum((l_extendedprice - p) ^ 2) / sum((l_extendedprice - m) ^ 2), 7) + 0.0 AS r2
FROM (SELECT *, 1000.0 * l_quantity + 500 AS p, avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) GROUP BY 1""")
def r2_score(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("p", 1000.0 * F.col("l_quantity") + 500)
    return rounded(M.r2_score(rows, "l_extendedprice", "p", ["l_returnflag"]))


@query(r"SELECT doc_id, name, TRY_CAST(regexp_extract(name, '(\d+)_shots?$', 1) AS INTEGER) AS k_shot FROM (SELECT doc_id, source || '_' || n_chars || CASE doc_id % 3 WHEN 0 THEN '_shots' WHEN 1 THEN '_shot' ELSE '_rows' END AS name FROM documents)")
def kshot_from_name(spark, d) -> DataFrame:
    end = F.when(F.col("doc_id") % 3 == 0, "_shots").when(F.col("doc_id") % 3 == 1, "_shot").otherwise("_rows")
    name = F.concat("source", F.lit("_"), "n_chars", end)
    return table(spark, d, "documents").select("doc_id", name.alias("name")).withColumn("k_shot", M.kshot_from_name(F.col("name")))


def _labelled(spark, d) -> DataFrame:
    """Labelled documents with simple text measures."""
    docs = table(spark, d, "documents").select(
        "doc_id", "lang", "source", "n_chars",
        F.length("text").alias("size"),
        F.regexp_count("text", F.lit(r"\s+")).alias("blanks"),
        F.regexp_count("text", F.lit(r"[.,;!?]")).alias("marks"),
        F.regexp_count("text", F.lit(r"\d")).alias("digits"),
    )
    return table(spark, d, "labels").join(docs, "doc_id").withColumn("quality", F.col("quality").cast("string"))


@query()
def ml_classification(spark, d) -> DataFrame:
    return M.evaluate_utility(_labelled(spark, d), {}, "quality", "classification", ["doc_id"], id_column="doc_id")


_LINES = ["line_no", "l_quantity", "l_discount", "l_returnflag", "l_shipdate", "l_extendedprice"]


def _keyed_lines(spark, d) -> DataFrame:
    """Lines whose price depends on quantity and discount, with the given price as noise."""
    no = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    price = F.col("l_quantity") * 1000.0 - F.col("l_discount") * 50000.0 + F.col("l_extendedprice") / 20
    return table(spark, d, "lineitem").withColumns({"line_no": no, "l_extendedprice": price}).select(*_LINES)


# Normal equations of two scaled features, with and without the penalty on the sum of squares.
_LINEAR = f"""WITH p AS ({_PICKED}), s AS (SELECT o_orderkey, no, CASE WHEN total >= 6000 THEN 5000 ELSE least(5000, total - ceil(total * 0.2)) END AS tr, CASE WHEN total >= 6000 THEN 1000 ELSE least(1000, ceil(total * 0.2)) END AS te FROM p),
r AS (SELECT no <= tr AS is_train, o_custkey::DOUBLE AS a, (o_orderkey % 100)::DOUBLE AS b, 0.5::DOUBLE * o_custkey + 20.0::DOUBLE * (o_orderkey % 100) + o_totalprice / 1000 AS y FROM s JOIN orders USING (o_orderkey) WHERE no <= tr + te),
d AS (SELECT stddev_samp(a) AS da, stddev_samp(b) AS db FROM r), z AS (SELECT is_train, a / da AS a, b / db AS b, y FROM r, d),
m AS (SELECT model, k, var_pop(a) + k / count(*) AS aa, var_pop(b) + k / count(*) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb, avg(a) AS ma, avg(b) AS mb, avg(y) AS my
  FROM z, (VALUES ('LinearRegression', 0.0::DOUBLE), ('Ridge', 1.0::DOUBLE)) AS v(model, k) WHERE is_train GROUP BY model, k),
w AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM m),
f AS (SELECT model, 1 - sum((y - my - wa * (a - ma) - wb * (b - mb)) ^ 2) / (var_pop(y) * count(*)) AS score FROM w, z WHERE NOT is_train GROUP BY model)
SELECT '' AS experiment, 'real' AS dataset, model, round(score, 7) + 0.0 AS score FROM (SELECT * FROM f UNION ALL SELECT 'Average', avg(score) FROM f)"""


@query(_LINEAR)
def linear_models(spark, d) -> DataFrame:
    target = 0.5 * F.col("o_custkey") + 20.0 * (F.col("o_orderkey") % 100) + F.col("o_totalprice") / 1000
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 100).alias("part"), target.alias("y"))
    return rounded(M.evaluate_utility(rows, {}, "y", "regression", ["o_orderkey"], id_column="o_orderkey", models=["Ridge", "LinearRegression"]))


@query()
def ml_regression(spark, d) -> DataFrame:
    return M.evaluate_utility(_keyed_lines(spark, d), {}, "l_extendedprice", "regression", ["line_no"], date_columns=["l_shipdate"], id_column="line_no")


@query()
def utility_scores(spark, d) -> DataFrame:
    lines = _keyed_lines(spark, d)
    noisy = lines.withColumn("l_extendedprice", F.col("l_extendedprice") * 0.9 + F.col("l_quantity") * 100)
    return M.evaluate_utility(
        lines, {("noise", "synthetic_40_shots"): noisy}, "l_extendedprice", "regression", ["line_no"],
        date_columns=["l_shipdate"], id_column="line_no", models=["Ridge", "LinearRegression"],
    )
