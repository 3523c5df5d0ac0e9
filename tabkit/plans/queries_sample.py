"""Checked queries: representative sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.operators import sample as S
from tabkit.plans.base import query, rounded, table, union_all

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_COLS = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax"
_BOUNDS = ", ".join(f"quantile_cont({c}, 0.25) AS lo_{c}, quantile_cont({c}, 0.75) AS hi_{c}" for c in FEATURES)
_HITS = " + ".join(f"({c} BETWEEN lo_{c} AND hi_{c})::INTEGER" for c in FEATURES)


def _filtered(need: int) -> str:
    return f"SELECT {_COLS} FROM lineitem, (SELECT {_BOUNDS} FROM lineitem) WHERE {_HITS} >= {need}"


def _lines(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(*_COLS.split(", "))


@query(union_all([f"SELECT '{c}' AS \"column\", round(quantile_cont({c}, 0.25), 7) AS lo, round(quantile_cont({c}, 0.75), 7) AS hi FROM lineitem" for c in FEATURES]))
def sample_bounds(spark, d) -> DataFrame:
    return rounded(S.bounds(table(spark, d, "lineitem"), FEATURES))


@query(_filtered(4))
def representative_strict(spark, d) -> DataFrame:
    return S.representative(_lines(spark, d), "strict", features=FEATURES)


@query(_filtered(int(4 * 0.7)))
def representative_flexible(spark, d) -> DataFrame:
    return S.representative(_lines(spark, d), "flexible", 0.7, FEATURES)


@query(_filtered(1))
def representative_individual(spark, d) -> DataFrame:
    return S.representative(_lines(spark, d), "individual", features=FEATURES)


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 500""")
def sample_rows(spark, d) -> DataFrame:
    return S.sample_rows(table(spark, d, "orders"), 500, seed=7, key=["o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


def _describe_sql(stage: str, source: str, c: str) -> str:
    return f"""SELECT '{stage}' AS stage, '{c}' AS "column", count({c})::BIGINT AS count, round(avg({c}), 7) AS mean, round(stddev_samp({c}), 7) AS std,
  min({c}) AS min, round(quantile_cont({c}, 0.25), 7) AS q25, round(quantile_cont({c}, 0.5), 7) AS q50, round(quantile_cont({c}, 0.75), 7) AS q75,
  max({c}) AS max FROM ({source})"""


@query(union_all([_describe_sql(stage, src, c) for stage, src in (("before", f"SELECT {_COLS} FROM lineitem"), ("after", _filtered(2))) for c in FEATURES]))
def sample_summary(spark, d) -> DataFrame:
    lines = _lines(spark, d)
    return rounded(S.sample_summary(lines, S.representative(lines, "flexible", 0.7, FEATURES), FEATURES))


@query(f"""WITH b AS (SELECT l_returnflag, {_BOUNDS} FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, {_COLS} FROM lineitem JOIN b USING (l_returnflag) WHERE {_HITS} >= {int(4 * 0.7)}""")
def representative_by_source(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_returnflag", *_COLS.split(", "))
    return S.representative_by_source(lines, "l_returnflag", 0.7, FEATURES)


@query(f"""WITH s AS ({_filtered(2)})
SELECT (SELECT count(*) FROM lineitem)::BIGINT AS rows_before, count(*)::BIGINT AS rows_after,
  round(count(*) * 100.0 / (SELECT count(*) FROM lineitem), 7) AS percent_kept FROM s""")
def sample_retained(spark, d) -> DataFrame:
    lines = _lines(spark, d)
    return rounded(S.retained(lines, S.representative(lines, "flexible", 0.7, FEATURES)))
