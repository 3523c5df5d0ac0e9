"""Checked queries: comparison of datasets, score reports, named metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.operators import compare as C
from tabkit.operators import metrics as N
from tabkit.plans.base import HALVES_CATEGORICAL, HALVES_NUMERIC, HALVES_SQL, halves, query, rounded, table, union_all
from tabkit.plans.queries_profile import corr_sql

NUM, CAT = HALVES_NUMERIC, HALVES_CATEGORICAL
REAL, SYN = "real", "synthetic"
_WITH = f"WITH h AS ({HALVES_SQL})"
_STATS = union_all([
    f"SELECT dataset, '{c}' AS \"column\", avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, quantile_cont({c}, 0.5) AS median FROM h GROUP BY dataset" for c in NUM
])


@query(f'{_WITH} SELECT dataset, "column", round(mean, 7) AS mean, round(std, 7) AS std, round(min, 7) AS min, round(max, 7) AS max, round(median, 7) AS median FROM ({_STATS})')
def compare_numeric(spark, d) -> DataFrame:
    return rounded(C.numeric_stats(halves(spark, d), NUM))


@query(f'{_WITH} SELECT dataset, "column", ' + ", ".join(
    f'round(CASE WHEN max({s}) OVER (PARTITION BY "column") = 0 THEN 0 ELSE {s} / max({s}) OVER (PARTITION BY "column") END, 7) AS {s}' for s in C.STATISTICS
) + f" FROM ({_STATS})")
def compare_normalised(spark, d) -> DataFrame:
    return rounded(C.normalise_by_max(C.numeric_stats(halves(spark, d), NUM), C.STATISTICS))


def _cat_sql(c: str) -> str:
    return f"""SELECT dataset, '{c}' AS "column", count(*)::BIGINT AS unique_count, first({c} ORDER BY n DESC, {c}) AS most_frequent, max(n)::BIGINT AS frequency,
  max(n) * 100.0 / any_value(t) AS percentage FROM (SELECT dataset, {c}, count(*) AS n, sum(count(*)) OVER (PARTITION BY dataset) AS t FROM h GROUP BY dataset, {c}) GROUP BY dataset"""


_CATS = union_all([_cat_sql(c) for c in CAT])


@query(f'{_WITH} SELECT * REPLACE (round(percentage::DOUBLE, 7) AS percentage) FROM ({_CATS})')
def compare_categorical(spark, d) -> DataFrame:
    return rounded(C.categorical_stats(halves(spark, d), CAT))


@query(f"""{_WITH}, s AS ({_STATS}), c AS ({_CATS})
SELECT s."column", 'numerical' AS type, s.dataset, round(s.mean, 7) AS mean, round(s.std, 7) AS std, round(abs(s.mean - r.mean) / r.mean * 100, 7) AS mean_diff_percent,
  round(abs(s.std - r.std) / r.std * 100, 7) AS std_diff_percent, NULL::BIGINT AS unique_count, NULL::VARCHAR AS mode, NULL::DOUBLE AS unique_diff_percent
FROM s JOIN s r ON r."column" = s."column" AND r.dataset = 'real'
UNION ALL SELECT c."column", 'categorical', c.dataset, NULL, NULL, NULL, NULL, c.unique_count, c.most_frequent, round(abs(c.unique_count - r.unique_count) / r.unique_count * 100, 7)
FROM c JOIN c r ON r."column" = c."column" AND r.dataset = 'real'""")
def compare_summary(spark, d) -> DataFrame:
    return rounded(C.summary(halves(spark, d), NUM, CAT, REAL))


def _bin_sql(x: str, lo: str, hi: str, bins: int) -> str:
    guess = f"least(floor(({x} - {lo}) * ({float(bins)}::DOUBLE / ({hi} - {lo}))), {bins - 1})"
    return f"(SELECT g - ({x} < {lo} + g * (({hi} - {lo}) / {bins}))::INTEGER + (g < {bins - 1} AND {x} >= {lo} + (g + 1) * (({hi} - {lo}) / {bins}))::INTEGER FROM (SELECT {guess} AS g))"


def _hist_sql(c: str, bins: int) -> str:
    return f"""SELECT r.dataset, '{c}' AS "column", b::INTEGER AS bin, round(lo + b * ((hi - lo) / {bins}), 7) AS "left", round(lo + (b + 1) * ((hi - lo) / {bins}), 7) AS "right",
  coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / (t * ((hi - lo) / {bins})), 7) AS density
FROM (SELECT dataset, min({c}) AS lo, max({c}) AS hi, count({c}) AS t FROM h GROUP BY 1) r CROSS JOIN range({bins}) x(b)
LEFT JOIN (SELECT dataset, bin, count(*) AS n FROM (SELECT h.dataset, {_bin_sql('v', 'lo', 'hi', bins)} AS bin
  FROM (SELECT dataset, {c} AS v FROM h) h JOIN (SELECT dataset, min({c}) AS lo, max({c}) AS hi FROM h GROUP BY 1) q USING (dataset)) GROUP BY ALL) n ON n.dataset = r.dataset AND n.bin = b"""


@query(f"{_WITH} " + union_all([_hist_sql(c, 30) for c in NUM]))
def histogram(spark, d) -> DataFrame:
    return rounded(C.histogram(halves(spark, d), NUM, 30))


def _share_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", v AS value, k.dataset, round(coalesce(n, 0) / t, 7) AS share FROM (SELECT DISTINCT {c} AS v FROM h)
CROSS JOIN (SELECT dataset, count(*) AS t FROM h GROUP BY 1) k LEFT JOIN (SELECT dataset, {c} AS v, count(*) AS n FROM h GROUP BY ALL) n USING (dataset, v)"""


@query(f"{_WITH} " + union_all([_share_sql(c) for c in CAT]))
def category_shares(spark, d) -> DataFrame:
    return rounded(C.category_shares(halves(spark, d), CAT, [REAL, SYN]))


def _box_sql(c: str) -> str:
    return f"""SELECT dataset, '{c}' AS "column", round(q25, 7) AS q25, round(median, 7) AS median, round(q75, 7) AS q75,
  round(min(v) FILTER (v BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)), 7) AS whisker_low,
  round(max(v) FILTER (v BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)), 7) AS whisker_high,
  (count(*) FILTER (NOT v BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)))::BIGINT AS outliers
FROM (SELECT dataset, {c} AS v FROM h) JOIN (SELECT dataset, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q75 FROM h GROUP BY 1) USING (dataset) GROUP BY ALL"""


@query(f"WITH h AS ({HALVES_SQL.replace('l_discount, l_tax', 'l_discount * l_discount * l_discount AS l_discount, l_tax')}) " + union_all([_box_sql(c) for c in NUM]))
def box_stats(spark, d) -> DataFrame:
    # The cube of the discount has outliers.
    return rounded(C.box_stats(halves(spark, d).withColumn("l_discount", F.col("l_discount") * F.col("l_discount") * F.col("l_discount")), NUM))


@query(f"{_WITH} " + corr_sql("h", NUM, "dataset"))
def compare_correlations(spark, d) -> DataFrame:
    return rounded(C.compare_correlations(halves(spark, d), NUM))


@query(f"""{_WITH}, s AS ({_STATS}), p AS ({union_all([_share_sql(c) for c in CAT])})
SELECT "column", 'mean' AS item, round(max(mean) FILTER (dataset = 'real'), 7) AS real, round(max(mean) FILTER (dataset = 'synthetic'), 7) AS synthetic FROM s GROUP BY 1
UNION ALL SELECT "column", 'std', round(max(std) FILTER (dataset = 'real'), 7), round(max(std) FILTER (dataset = 'synthetic'), 7) FROM s GROUP BY 1
UNION ALL SELECT "column", value, max(share) FILTER (dataset = 'real'), max(share) FILTER (dataset = 'synthetic') FROM p GROUP BY 1, 2""")
def column_stats(spark, d) -> DataFrame:
    return rounded(C.column_stats(halves(spark, d), NUM, CAT, REAL, SYN))


# ---- reports ----------------------------------------------------------------
def _reports(spark, d) -> DataFrame:
    """One evaluation report per return flag, written as JSON from statistics of lineitem."""
    li = table(spark, d, "lineitem")
    stats = li.groupBy(F.col("l_returnflag").alias("report")).agg(
        F.count("*").alias("n"), F.max("l_quantity").alias("q"), F.max("l_discount").alias("disc"), F.max("l_linenumber").alias("no")
    )
    return stats.select("report", F.format_string(
        '{"Report": {"Size": {"Scores": %d}, "KS": {"Scores": {"quantity": %s, "discount": %s}}, "Correlation_Similarity": {"Scores": {"quantity__discount": %s, "quantity__number": null, "number__discount": 0.25}},'
        ' "Nested": {"Scores": {"quantity": {"statistic": 1}}}, "Bad": {"Scores": {}}, "None": {"Scores": null}, "Odd": 3}}',
        F.col("n"), F.col("q").cast("string"), F.col("disc").cast("string"), (F.col("no") / 10).cast("string"),
    ).alias("text"))


@query("""WITH s AS (SELECT l_returnflag AS report, count(*) AS n, max(l_quantity) AS q, max(l_discount) AS disc, max(l_linenumber) AS no FROM lineitem GROUP BY 1)
SELECT report, 'Size' AS metric, 'single' AS kind, NULL::VARCHAR AS "key", NULL::VARCHAR AS key2, n::DOUBLE AS value FROM s
UNION ALL SELECT report, 'KS', 'column', 'quantity', NULL, q FROM s UNION ALL SELECT report, 'KS', 'column', 'discount', NULL, disc FROM s
UNION ALL SELECT report, 'Correlation_Similarity', 'pair', 'quantity', 'discount', (no / 10)::DOUBLE FROM s
UNION ALL SELECT report, 'Correlation_Similarity', 'pair', 'quantity', 'number', NULL FROM s
UNION ALL SELECT report, 'Correlation_Similarity', 'pair', 'number', 'discount', 0.25 FROM s
UNION ALL SELECT report, unnest(['Bad', 'None', 'Odd']), 'empty', NULL, NULL, NULL FROM s""")
def report_scores(spark, d) -> DataFrame:
    return C.report_scores(_reports(spark, d))


@query("""WITH s AS (SELECT l_returnflag AS report, (max(l_linenumber) / 10)::DOUBLE AS v FROM lineitem GROUP BY 1), k AS (SELECT unnest(['quantity', 'discount', 'number']) AS c)
SELECT report, 'Correlation_Similarity' AS metric, a.c AS col_a, b.c AS col_b,
  CASE WHEN a.c = b.c THEN 1.0::DOUBLE WHEN 'number' NOT IN (a.c, b.c) THEN v WHEN 'discount' IN (a.c, b.c) THEN 0.25 ELSE 0.0 END AS value FROM s, k a, k b""")
def pair_matrix(spark, d) -> DataFrame:
    return C.pair_matrix(C.report_scores(_reports(spark, d)))


# ---- metrics ----------------------------------------------------------------
def _ks_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", round(max(abs(a / ta - b / tb)), 7) AS ks, round(1 - max(abs(a / ta - b / tb)), 7) AS score FROM (
  SELECT {c}, sum(count(*) FILTER (dataset = 'real')) OVER (ORDER BY {c}) AS a, sum(count(*) FILTER (dataset = 'synthetic')) OVER (ORDER BY {c}) AS b,
    sum(count(*) FILTER (dataset = 'real')) OVER () AS ta, sum(count(*) FILTER (dataset = 'synthetic')) OVER () AS tb FROM h GROUP BY {c})"""


@query(f"{_WITH} " + union_all([_ks_sql(c) for c in NUM]))
def ks_statistic(spark, d) -> DataFrame:
    return rounded(N.ks_statistic(halves(spark, d), NUM, REAL, SYN))


def _hell_sql(c: str, value: str, source: str = "h") -> str:
    return f"""SELECT '{c}' AS "column", round(sqrt(greatest(0, 1 - sum(sqrt(a::DOUBLE * b)) / sqrt(sum(a)::DOUBLE * sum(b)))), 7) AS hellinger FROM (
  SELECT {value} AS v, count(*) FILTER (dataset = 'real') AS a, count(*) FILTER (dataset = 'synthetic') AS b FROM {source} GROUP BY 1)"""


@query(f"{_WITH} " + union_all([_hell_sql(c, c) for c in CAT] + [
    _hell_sql(c, _bin_sql("x", "lo", "hi", 30), f"(SELECT dataset, {c} AS x, min({c}) OVER () AS lo, max({c}) OVER () AS hi FROM h)") for c in NUM
]))
def hellinger(spark, d) -> DataFrame:
    return rounded(N.hellinger(halves(spark, d), NUM, CAT, REAL, SYN))


_PAIRS = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1:]]
_CORR_SIDES = union_all([f"SELECT '{a}' AS col_a, '{b}' AS col_b, (SELECT corr({a}, {b}) FROM h WHERE dataset = 'real') AS x, (SELECT corr({a}, {b}) FROM h WHERE dataset = 'synthetic') AS y" for a, b in _PAIRS])


@query(f"{_WITH} SELECT col_a, col_b, round(x, 7) + 0.0 AS r_real, round(y, 7) + 0.0 AS r_synthetic, round(1 - abs(x - y) / 2, 7) AS similarity, round(abs(x - y), 7) AS distance FROM ({_CORR_SIDES})")
def correlation_similarity(spark, d) -> DataFrame:
    return rounded(N.correlation_similarity(halves(spark, d), NUM, REAL, SYN))


@query(f"{_WITH} SELECT round(avg(abs(x - y)), 7) AS mean_distance, round(avg(1 - abs(x - y) / 2), 7) AS mean_similarity FROM ({_CORR_SIDES})")
def pairwise_correlation_distance(spark, d) -> DataFrame:
    return rounded(N.pairwise_correlation_distance(halves(spark, d), NUM, REAL, SYN))


_CONT = ["l_returnflag", "l_linestatus", "l_tax"]


@query(f"{_WITH}, t AS (SELECT count(*) FILTER (dataset = 'real') AS ta, count(*) FILTER (dataset = 'synthetic') AS tb FROM h) " + union_all([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(1 - sum(abs(a / ta - b / tb)) / 2, 7) AS similarity FROM (SELECT {a}, {b}, count(*) FILTER (dataset = 'real') AS a, count(*) FILTER (dataset = 'synthetic') AS b FROM h GROUP BY 1, 2), t"
    for i, a in enumerate(_CONT) for b in _CONT[i + 1:]
]))
def contingency_similarity(spark, d) -> DataFrame:
    return rounded(N.contingency_similarity(halves(spark, d), _CONT, REAL, SYN))


@query(f"{_WITH} " + union_all([f"""SELECT '{c}' AS "column", round(greatest(0, 1 - (greatest((slo - rlo) / (rhi - rlo), 0) + greatest((rhi - shi) / (rhi - rlo), 0))), 7) AS coverage
FROM (SELECT min({c}) FILTER (dataset = 'real') AS rlo, max({c}) FILTER (dataset = 'real') AS rhi, min({c}) FILTER (dataset = 'synthetic') AS slo, max({c}) FILTER (dataset = 'synthetic') AS shi FROM h)""" for c in NUM]))
def range_coverage(spark, d) -> DataFrame:
    return rounded(N.range_coverage(halves(spark, d), NUM, REAL, SYN))


@query(f"{_WITH} " + union_all([f"""SELECT '{c}' AS "column", round(avg(CASE WHEN {c} BETWEEN (SELECT min({c}) FROM h WHERE dataset = 'real') AND (SELECT max({c}) FROM h WHERE dataset = 'real') THEN 1.0::DOUBLE ELSE 0 END), 7) AS adherence
FROM h WHERE dataset = 'synthetic'""" for c in NUM]))
def boundary_adherence(spark, d) -> DataFrame:
    return rounded(N.boundary_adherence(halves(spark, d), NUM, REAL, SYN))


@query("""SELECT l_returnflag, count(DISTINCT (l_orderkey, l_linenumber))::BIGINT AS distinct_keys, count(*)::BIGINT AS rows,
  round(count(DISTINCT (l_orderkey, l_linenumber)) / count(*), 7) AS uniqueness FROM lineitem GROUP BY 1""")
def key_uniqueness(spark, d) -> DataFrame:
    return rounded(N.key_uniqueness(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_returnflag"]))


@query("""WITH p AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
SELECT count(*)::BIGINT AS child_rows, count(*) FILTER (l_orderkey IN (SELECT o_orderkey FROM p))::BIGINT AS matched_rows,
  round(count(*) FILTER (l_orderkey IN (SELECT o_orderkey FROM p)) / count(*), 7) AS integrity FROM lineitem""")
def referential_integrity(spark, d) -> DataFrame:
    parents = table(spark, d, "orders").where(F.col("o_orderstatus") != "P")
    return rounded(N.referential_integrity(table(spark, d, "lineitem"), "l_orderkey", parents, "o_orderkey"))


@query("""WITH a AS (SELECT o_orderkey, count(l_orderkey) AS k FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
b AS (SELECT c_custkey, count(o_custkey) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
v AS (SELECT k, count(*) FILTER (s = 1) AS x, count(*) FILTER (s = 2) AS y FROM (SELECT k, 1 AS s FROM a UNION ALL SELECT k, 2 FROM b) GROUP BY 1),
c AS (SELECT sum(x) OVER (ORDER BY k) / sum(x) OVER () AS fx, sum(y) OVER (ORDER BY k) / sum(y) OVER () AS fy FROM v)
SELECT round(max(abs(fx - fy)), 7) AS ks, round(1 - max(abs(fx - fy)), 7) AS score FROM c""")
def cardinality_shape(spark, d) -> DataFrame:
    orders = table(spark, d, "orders")
    a = (table(spark, d, "lineitem"), "l_orderkey", orders, "o_orderkey")
    b = (orders, "o_custkey", table(spark, d, "customer"), "c_custkey")
    return rounded(N.cardinality_shape(a, b))


_HALF_ORDERS = """SELECT *, CASE WHEN NOT r AND o_orderkey % 50 = 0 THEN 'new' ELSE o_orderpriority END AS q FROM (
  SELECT o_orderkey, o_orderpriority, md5('dcr:' || o_orderkey) < '8' AS r, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS p, (epoch_us(o_orderdate) // 86400000000)::DOUBLE AS day,
    CASE WHEN o_orderkey % 17 <> 0 THEN o_orderstatus END AS s FROM orders)"""
_GAP = lambda x: f"coalesce(abs(y.{x} - x.{x}) / b.{x}, (y.{x} IS DISTINCT FROM x.{x})::INTEGER)"
_OTHER = lambda x: f"(y.{x} IS DISTINCT FROM x.{x})::INTEGER"


@query(f"""WITH o AS ({_HALF_ORDERS})
SELECT y.o_orderkey, round(min({_GAP("p")} + {_GAP("day")} + {_OTHER("s")} + {_OTHER("q")}), 7) + 0.0 AS dcr
FROM o y, (SELECT * FROM o WHERE r) x, (SELECT max(p) - min(p) AS p, max(day) - min(day) AS day FROM o WHERE r) b WHERE NOT y.r GROUP BY 1""")
def dcr(spark, d) -> DataFrame:
    """Synthetic rows have a category that no real row has; numbers and categories are null in some rows of both."""
    o = table(spark, d, "orders")
    is_real = F.md5(F.concat_ws(":", F.lit("dcr"), "o_orderkey")) < "8"
    rows = o.select(
        "o_orderkey",
        F.when(is_real, REAL).otherwise(SYN).alias("dataset"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice")).alias("p"),
        F.unix_date(F.col("o_orderdate").cast("date")).cast("double").alias("day"),
        F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderstatus")).alias("s"),
        F.when(~is_real & (F.col("o_orderkey") % 50 == 0), "new").otherwise(F.col("o_orderpriority")).alias("q"),
    )
    return rounded(N.closest_record_distance(rows, "o_orderkey", ["p", "day"], ["s", "q"], REAL, SYN))


_WIDE_NUMBERS = {"n1": "o_totalprice", "n2": "datediff(DATE '1992-01-01', CAST(o_orderdate AS DATE))", "n3": "c_acctbal", "n4": "o_custkey * 1.0", "n5": "c_nationkey * 1.0", "n6": "o_orderkey % 1009 * 1.0"}
_WIDE_KINDS = {"k1": "o_orderstatus", "k2": "o_orderpriority", "k3": "c_mktsegment", "k4": "month(o_orderdate)", "k5": "dayofmonth(o_orderdate) % 7", "k6": "o_custkey % 3", "k7": "o_orderkey % 5", "k8": "year(o_orderdate)"}
_WIDE_SQL = ", ".join(f"({e}) AS {n}" for n, e in {**_WIDE_NUMBERS, **_WIDE_KINDS}.items()).replace("datediff(DATE '1992-01-01', CAST(o_orderdate AS DATE))", "datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))")


@query(f"""WITH o AS (SELECT o_orderkey, md5('dcr:' || o_orderkey) < '8' AS r, {_WIDE_SQL} FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT y.o_orderkey, round(min({" + ".join([*map(_GAP, _WIDE_NUMBERS), *map(_OTHER, _WIDE_KINDS)])}), 7) + 0.0 AS dcr
FROM o y, (SELECT * FROM o WHERE r) x, (SELECT {", ".join(f"max({n}) - min({n}) AS {n}" for n in _WIDE_NUMBERS)} FROM o WHERE r) b WHERE NOT y.r GROUP BY 1""")
def dcr_wide(spark, d) -> DataFrame:
    """Six numbers and eight categories."""
    both = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    shown = {n: F.expr(e.replace("datediff(DATE '1992-01-01', CAST(o_orderdate AS DATE))", "datediff(CAST(o_orderdate AS DATE), DATE '1992-01-01')")) for n, e in {**_WIDE_NUMBERS, **_WIDE_KINDS}.items()}
    is_real = F.md5(F.concat_ws(":", F.lit("dcr"), "o_orderkey")) < "8"
    rows = both.select("o_orderkey", F.when(is_real, REAL).otherwise(SYN).alias("dataset"), *[e.alias(n) for n, e in shown.items()])
    return rounded(N.closest_record_distance(rows, "o_orderkey", list(_WIDE_NUMBERS), list(_WIDE_KINDS), REAL, SYN))


@query(f"""{_WITH}, k AS (SELECT l_returnflag, l_quantity, l_tax AS s, count(*) FILTER (dataset = 'real') AS a, count(*) FILTER (dataset = 'synthetic') AS b FROM h GROUP BY ALL),
g AS (SELECT l_returnflag, l_quantity, sum(a) AS ta, sum(b) AS tb, sum(a * b) AS hit FROM k GROUP BY ALL)
SELECT sum(ta)::BIGINT AS real_rows, (sum(ta) FILTER (tb > 0))::BIGINT AS matched_rows, round(sum(hit / tb) FILTER (tb > 0) / sum(ta) FILTER (tb > 0), 7) AS cap FROM g""")
def cap_disclosure(spark, d) -> DataFrame:
    return rounded(N.cap_disclosure(halves(spark, d), ["l_returnflag", "l_quantity"], "l_tax", REAL, SYN))


@query()
def pmse(spark, d) -> DataFrame:
    return N.pmse(halves(spark, d), NUM, CAT, REAL, SYN)


@query(f"""WITH h AS ({HALVES_SQL}), c AS (SELECT l_returnflag, count(*) AS n, count(*) FILTER (dataset = 'synthetic') AS s FROM h GROUP BY 1),
t AS (SELECT sum(n)::DOUBLE AS n, sum(s)::DOUBLE AS s FROM c)
SELECT round(sum(c.n * (c.s / c.n - t.s / t.n) ^ 2) / any_value(t.n), 7) + 0.0 AS pmse, round(any_value(t.s / t.n), 7) AS synthetic_share, sum(c.n)::BIGINT AS rows FROM c, t""")
def pmse_category(spark, d) -> DataFrame:
    return rounded(N.pmse(halves(spark, d), [], ["l_returnflag"], REAL, SYN))
