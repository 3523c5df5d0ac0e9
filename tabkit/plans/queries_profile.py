"""Checked queries: profiling and inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.operators import inspect as I
from tabkit.operators import profile as P
from tabkit.plans.base import query, rounded, table, union_all

# Semantic kind of the storage type of each column used in the checks.
SCHEMAS = {
    "customer": {"c_custkey": "num", "c_name": "str", "c_nationkey": "num", "c_acctbal": "num", "c_mktsegment": "str"},
    "supplier": {"s_suppkey": "num", "s_name": "str", "s_nationkey": "num", "s_acctbal": "num"},
    "part": {"p_partkey": "num", "p_name": "str", "p_brand": "str", "p_type": "str", "p_size": "num", "p_retailprice": "num"},
    "orders": {"o_orderkey": "num", "o_custkey": "num", "o_orderstatus": "str", "o_totalprice": "num", "o_orderdate": "ts", "o_orderpriority": "str"},
    "lineitem": {
        "l_orderkey": "num", "l_partkey": "num", "l_suppkey": "num", "l_linenumber": "num", "l_quantity": "num", "l_extendedprice": "num",
        "l_discount": "num", "l_tax": "num", "l_returnflag": "str", "l_linestatus": "str", "l_shipdate": "ts",
    },
    "events": {"event_id": "num", "ts": "ts", "user_id": "num", "event_type": "str", "value": "num", "props": "str"},
    "documents": {"doc_id": "num", "text": "str", "lang": "str", "source": "str", "n_chars": "num"},
    "labels": {"doc_id": "num", "quality": "num", "toxic": "num"},
    "conversations": {"conv_id": "num", "turn": "num", "role": "str", "text": "str"},
    "pages": {"page_id": "num", "url": "str", "html": "str"},
    "nation": {"n_nationkey": "num", "n_name": "str", "n_regionkey": "num"},
    "region": {"r_regionkey": "num", "r_name": "str"},
}
INFERRED = ("customer", "part", "orders", "lineitem", "events", "documents")
NUMBER_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
DATE_RE = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4}"


def _num(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{NUMBER_RE}') THEN try_cast(trim({c}) AS DOUBLE) END"


def _whole(x: str) -> str:
    return f"avg(CASE WHEN abs({x} - round_even({x}, 0)) <= 1e-9 + 1e-9 * abs(round_even({x}, 0)) THEN 1.0 WHEN ({x}) IS NOT NULL THEN 0.0 END)"


def dtype_sql(c: str, kind: str) -> str:
    """The decision list for the semantic type of one column."""
    q = f'"{c}"'
    if kind == "ts":
        return f"CASE WHEN count({q}) = 0 THEN 'categorical' ELSE 'datetime' END"
    if kind == "num":
        return f"CASE WHEN count({q}) = 0 THEN 'categorical' WHEN {_whole(f'({q}::DOUBLE)')} >= 0.95 THEN 'integer' ELSE 'float' END"
    words = [("true", "false"), ("yes", "no"), ("y", "n"), ("1", "0"), ("t", "f")]
    boolean = " OR ".join(f"bool_and(lower({q}) IN ('{a}', '{b}'))" for a, b in words)
    n = f"({_num(q)})"
    return f"""CASE WHEN count({q}) = 0 THEN 'categorical'
      WHEN {boolean} THEN 'boolean'
      WHEN avg(CASE WHEN regexp_matches({q}, '{DATE_RE}') THEN 1.0 WHEN {q} IS NOT NULL THEN 0.0 END) > 0.8 THEN 'datetime'
      WHEN count({n}) / count({q}) > 0.9 THEN CASE WHEN {_whole(n)} >= 0.95 THEN 'integer' ELSE 'float' END
      WHEN count(DISTINCT {q}) <= 20 THEN 'categorical'
      WHEN avg(length({q})) > 50 THEN 'text'
      WHEN count(DISTINCT {q}) / count({q}) > 0.95 AND avg(length({q})) < 30 THEN 'id'
      WHEN count(DISTINCT {q}) / count({q}) > 0.90 AND avg(length({q})) >= 30 THEN 'text'
      ELSE 'categorical' END"""


def counts_sql(tab: str, columns: list[str]) -> str:
    return union_all([f"SELECT '{c}' AS \"column\", \"{c}\"::VARCHAR AS value, count(*)::BIGINT AS n FROM {tab} WHERE \"{c}\" IS NOT NULL GROUP BY ALL" for c in columns])


VC_COLUMNS = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey", "l_shipdate"]


@query(counts_sql("lineitem", VC_COLUMNS))
def value_counts(spark, d) -> DataFrame:
    return P.value_counts(table(spark, d, "lineitem"), VC_COLUMNS)


@query(union_all([f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {dtype_sql(c, k)} AS dtype FROM {t}" for t in INFERRED for c, k in SCHEMAS[t].items()]))
def infer_types(spark, d) -> DataFrame:
    out = None
    for t in INFERRED:
        part = P.infer_types(table(spark, d, t), distinct=False).select(F.lit(t).alias("table"), "column", "dtype")
        out = part if out is None else out.unionByName(part)
    return out


_NULLED = {"l_returnflag": "'R'", "l_linenumber": "1", "l_discount": "0.05"}
_NULLED_SQL = ", ".join(f"nullif({c}, {v}) AS {c}" for c, v in _NULLED.items())


@query(union_all([
    f"SELECT '{c}' AS \"column\", round(1 - count(x) / count(*), 7) AS missing_rate, count(DISTINCT x)::BIGINT AS unique_count FROM (SELECT nullif({c}, {v}) AS x FROM lineitem)"
    for c, v in _NULLED.items()
] + [
    f"SELECT '{c}' AS \"column\", round(1 - count({c}) / count(*), 7) AS missing_rate, count(DISTINCT {c})::BIGINT AS unique_count FROM lineitem"
    for c in ("l_orderkey", "l_extendedprice", "l_shipdate")
]))
def profile_base(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    for c, v in _NULLED.items():
        li = li.withColumn(c, F.expr(f"nullif({c}, {v})"))
    return rounded(P.base_profile(li, [*_NULLED, "l_orderkey", "l_extendedprice", "l_shipdate"]))


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_linenumber"]


@query(union_all([
    f"SELECT '{c}' AS \"column\", min({c})::DOUBLE AS min_val, max({c})::DOUBLE AS max_val, round(avg({c}), 7) AS mean, round(stddev_samp({c}), 7) AS std FROM lineitem" for c in NUMERIC
]))
def profile_numeric(spark, d) -> DataFrame:
    return rounded(P.numeric_profile(table(spark, d, "lineitem"), NUMERIC))


@query(union_all([
    "SELECT '{c}' AS \"column\", ".format(c=c) + ", ".join(f"round(quantile_cont({c}::DOUBLE, {p}), 7) AS q{round(p * 100)}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM lineitem"
    for c in NUMERIC
]))
def profile_quantiles(spark, d) -> DataFrame:
    return rounded(P.quantile_profile(table(spark, d, "lineitem"), NUMERIC))


TOPK_COLUMNS = ["p_name", "p_brand", "p_type"]


@query(f"""SELECT "column", value, n, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM ({counts_sql("part", TOPK_COLUMNS)})
) WHERE rank <= 100""")
def profile_topk(spark, d) -> DataFrame:
    return P.top_values(table(spark, d, "part"), TOPK_COLUMNS)


@query("""WITH b AS (
  SELECT CASE WHEN l_linestatus = 'O' THEN 'Yes' ELSE 'No' END AS open_line,
         CASE WHEN l_returnflag = 'R' THEN 't' WHEN l_returnflag = 'A' THEN 'f' END AS returned FROM lineitem)
SELECT 'open_line' AS "column", count(DISTINCT open_line)::BIGINT AS cardinality,
  max(open_line) FILTER (lower(trim(open_line)) IN ('true','yes','y','1','t')) AS true_label,
  max(open_line) FILTER (lower(trim(open_line)) NOT IN ('true','yes','y','1','t')) AS false_label FROM b
UNION ALL
SELECT 'returned', count(DISTINCT returned)::BIGINT,
  max(returned) FILTER (lower(trim(returned)) IN ('true','yes','y','1','t')),
  max(returned) FILTER (lower(trim(returned)) NOT IN ('true','yes','y','1','t')) FROM b""")
def profile_boolean(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", "Yes").otherwise("No").alias("open_line"),
        F.when(F.col("l_returnflag") == "R", "t").when(F.col("l_returnflag") == "A", "f").alias("returned"),
    )
    return P.boolean_profile(li, ["open_line", "returned"])


# (query column, DuckDB strftime format, Spark pattern)
_DATE_TEXT = [
    ("d_compact", "%Y%m%d", "yyyyMMdd", "%Y%m%d"),
    ("d_iso", "%Y-%m-%d", "yyyy-MM-dd", "%Y-%m-%d"),
    ("d_us", "%m/%d/%Y", "MM/dd/yyyy", "%m/%d/%Y"),
    ("d_day_first", "%d-%m-%Y", "dd-MM-yyyy", "%d-%m-%Y"),
    ("d_words", "%d %b %Y", "dd MMM yyyy", "%d %b %Y"),
    ("d_long", "%b %d, %Y", "MMM dd, yyyy", "%b %d, %Y"),
    ("d_time", "%Y-%m-%d %H:%M:%S", "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
]


@query(union_all([
    f"SELECT '{c}' AS \"column\", '{fmt}' AS date_format, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS min_ts, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS max_ts FROM orders"
    for c, _, _, fmt in _DATE_TEXT
] + ["SELECT 'o_orderdate', NULL, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S'), strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') FROM orders"]))
def profile_datetime(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    texts = o.select("o_orderdate", *[F.date_format("o_orderdate", p).alias(c) for c, _, p, _ in _DATE_TEXT])
    return P.datetime_profile(texts, texts.columns)


TEXT_COLUMNS = ["text", "lang", "source"]


@query(union_all([f"SELECT '{c}' AS \"column\", round(avg(length({c})), 7) AS avg_length, max(length({c}))::INTEGER AS max_length FROM documents" for c in TEXT_COLUMNS]))
def profile_text(spark, d) -> DataFrame:
    return rounded(P.text_profile(table(spark, d, "documents"), TEXT_COLUMNS))


@query("""SELECT 'c_name' AS "column", round(avg(length(c_name)), 7) AS avg_length, max(length(c_name))::INTEGER AS max_length,
  count(DISTINCT c_name)::BIGINT AS unique_count,
  (SELECT string_agg(c_name, '|' ORDER BY h, c_name) FROM (SELECT DISTINCT c_name, md5('42:' || c_name) AS h FROM customer ORDER BY h, c_name LIMIT 3)) AS examples
FROM customer""")
def profile_id(spark, d) -> DataFrame:
    return rounded(P.id_profile(table(spark, d, "customer"), ["c_name"]).withColumn("examples", F.array_join("examples", "|")))


def codes_sql(columns: list[tuple[str, str]]) -> str:
    """Common table expressions ending in ``codes (column, value, code)``: one category after the other, by recursion."""
    counts = union_all([f"SELECT '{c}' AS col, {c} AS value, count(*) AS n FROM {t} WHERE {c} <> '' GROUP BY 2" for t, c in columns])
    return f"""WITH RECURSIVE counts AS ({counts}),
parts AS (SELECT col, value, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS no, upper(value[1:3]) AS head, regexp_extract_all(value, '\\b\\w') AS words,
  regexp_replace(value, '[aeiouAEIOU\\s]', '', 'g') AS bare, value[1:1] || regexp_replace(value[2:], '[aeiouAEIOU\\s]', '', 'g') AS kept FROM counts),
wishes AS (SELECT *, list_filter([CASE WHEN length(value) >= 3 THEN head END, CASE WHEN len(words) >= 2 THEN upper(array_to_string(words[1:3], '')) END,
  CASE WHEN length(bare) >= 3 THEN upper(bare[1:3]) END, CASE WHEN length(kept) >= 3 THEN upper(kept[1:3]) END], lambda x: x IS NOT NULL) AS codes FROM parts),
turns AS (SELECT DISTINCT col, 0::BIGINT AS no, NULL::VARCHAR AS value, NULL::VARCHAR AS code, []::VARCHAR[] AS taken FROM counts
  UNION ALL SELECT col, no, value, code, list_append(taken, code) FROM (
    SELECT w.col, w.no, w.value, t.taken, coalesce(list_filter(w.codes, lambda x: NOT list_contains(t.taken, x))[1],
      coalesce(w.codes[1], w.head) || list_filter(range(w.no + 1), lambda i: NOT list_contains(t.taken, coalesce(w.codes[1], w.head) || i))[1]) AS code
    FROM turns t JOIN wishes w ON w.col = t.col AND w.no = t.no + 1)),
codes AS (SELECT col AS "column", value, code FROM turns WHERE no > 0)"""


_CODED = [("part", "p_name"), ("part", "p_brand"), ("part", "p_type"), ("events", "event_type"), ("events", "props")]


@query(codes_sql(_CODED) + " SELECT * FROM codes")
def abbreviations(spark, d) -> DataFrame:
    counts = P.value_counts(table(spark, d, "part"), ["p_name", "p_brand", "p_type"])
    counts = counts.unionByName(P.value_counts(table(spark, d, "events"), ["event_type", "props"]))
    return P.value_abbreviations(counts)


def corr_sql(tab: str, columns: list[str], group: str | None = None) -> str:
    """The matrix in long form; NaN of a constant column is null."""
    head = f"{group}, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    r = lambda a, b: f"CASE WHEN stddev_samp({a}) > 0 AND stddev_samp({b}) > 0 THEN round(corr({a}, {b}), 7) + 0.0 END"
    return union_all([f"SELECT {head}'{a}' AS col_a, '{b}' AS col_b, {r(a, b)} AS r FROM {tab}{tail}" for a in columns for b in columns])


@query(corr_sql("lineitem", NUMERIC))
def correlation_matrix(spark, d) -> DataFrame:
    return rounded(P.correlation_matrix(table(spark, d, "lineitem"), NUMERIC))


@query("""WITH dom AS (SELECT DISTINCT p_type FROM part),
dec AS (SELECT CASE WHEN p_size > 45 THEN lower(p_type) WHEN p_size < 3 THEN p_type || '?' ELSE p_type END AS v FROM part)
SELECT 'p_type' AS "column", v AS value, count(*)::BIGINT AS n FROM dec WHERE v NOT IN (SELECT p_type FROM dom) GROUP BY ALL""")
def enum_violations(spark, d) -> DataFrame:
    part = table(spark, d, "part")
    changed = F.when(F.col("p_size") > 45, F.lower("p_type")).when(F.col("p_size") < 3, F.concat("p_type", F.lit("?"))).otherwise(F.col("p_type"))
    return P.enum_violations(part.withColumn("p_type", changed), P.value_counts(part, ["p_type"]), ["p_type"])


def profile_sql(tab: str, dtypes: dict[str, str]) -> str:
    parts = []
    for i, (c, t) in enumerate(dtypes.items()):
        numeric, texty, listed = t in ("integer", "float"), t in ("text", "id"), t in ("categorical", "boolean")
        x = f"{c}::DOUBLE"
        opt = lambda on, e, ty="DOUBLE": e if on else f"NULL::{ty}"
        q = ", ".join(f"{opt(numeric, f'round(quantile_cont({x}, {p}), 7)')} AS q{round(p * 100)}" for p in (0.05, 0.25, 0.5, 0.75, 0.95))
        top = f"(SELECT string_agg(v || '=' || n, '|' ORDER BY n DESC, v) FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM {tab} GROUP BY 1 ORDER BY n DESC, v LIMIT 100))"
        parts.append(f"""SELECT '{tab}' AS "table", {i}::INTEGER AS position, '{c}' AS "column", '{t}' AS dtype,
  round(1 - count({c}) / count(*), 7) AS missing_rate, count(DISTINCT {c})::BIGINT AS unique_count,
  {opt(numeric, f'min({x})')} AS min_val, {opt(numeric, f'max({x})')} AS max_val,
  {opt(numeric, f'round(avg({x}), 7)')} AS mean, {opt(numeric, f'round(stddev_samp({x}), 7)')} AS std, {q},
  {opt(t == 'datetime', f"strftime(min({c}), '%Y-%m-%dT%H:%M:%S')", 'VARCHAR')} AS min_ts,
  {opt(t == 'datetime', f"strftime(max({c}), '%Y-%m-%dT%H:%M:%S')", 'VARCHAR')} AS max_ts,
  {opt(texty, f'round(avg(length({c})), 7)')} AS avg_length, {opt(texty, f'max(length({c}))::INTEGER', 'INTEGER')} AS max_length,
  {opt(listed, top, 'VARCHAR')} AS top_values FROM {tab}""")
    return union_all(parts)


PROFILED = {
    "customer": {"c_custkey": "integer", "c_name": "id", "c_nationkey": "integer", "c_acctbal": "float", "c_mktsegment": "categorical"},
    "lineitem": {
        "l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer", "l_quantity": "integer",
        "l_extendedprice": "float", "l_discount": "float", "l_tax": "float", "l_returnflag": "categorical", "l_linestatus": "categorical",
        "l_shipdate": "datetime",
    },
}


@query(union_all([profile_sql(t, cols) for t, cols in PROFILED.items()]))
def profile(spark, d) -> DataFrame:
    out = None
    for t in PROFILED:
        prof = P.profile(table(spark, d, t)).to_df(spark)
        top = F.when(F.col("dtype").isin("categorical", "boolean"), F.array_join(F.transform("top_k", lambda p: F.concat(p["value"], F.lit("="), p["n"])), "|"))
        part = prof.select(
            F.lit(t).alias("table"), "position", "column", "dtype", "missing_rate", "unique_count", "min_val", "max_val", "mean", "std",
            "q5", "q25", "q50", "q75", "q95", "min_ts", "max_ts", "avg_length", "max_length", top.alias("top_values"),
        )
        out = part if out is None else out.unionByName(part)
    return rounded(out)


# ---- inspection -------------------------------------------------------------
@query("""WITH t AS (SELECT nullif(l_returnflag, 'R') AS f, nullif(l_linenumber, 1) AS n, l_linestatus AS s, l_quantity AS q FROM lineitem)
SELECT count(*)::BIGINT AS rows, 4::INTEGER AS columns,
  (count(*) - (SELECT count(*) FROM (SELECT DISTINCT f, n, s, q FROM t)))::BIGINT AS duplicate_rows,
  sum((f IS NULL)::INTEGER + (n IS NULL)::INTEGER)::BIGINT AS missing_cells,
  round(sum((f IS NULL)::INTEGER + (n IS NULL)::INTEGER) * 100.0 / (count(*) * 4), 2) AS missing_percent FROM t""")
def inspect_overview(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").selectExpr("nullif(l_returnflag, 'R') AS f", "nullif(l_linenumber, 1) AS n", "l_linestatus AS s", "l_quantity AS q")
    return I.overview(li)


_TYPES = {"num": "numerical", "str": "categorical", "ts": "categorical"}
_DTYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


@query(union_all([
    f"""SELECT '{c}' AS "column", '{_DTYPES[c]}' AS dtype, '{_TYPES[k]}' AS sdtype, count(DISTINCT {x})::BIGINT AS unique_count,
  (count(*) - count({x}))::BIGINT AS missing_count, round((count(*) - count({x})) * 100.0 / count(*), 2) AS missing_percent,
  {f"strftime(min({x}), '%Y-%m-%dT%H:%M:%S')" if k == 'ts' else 'NULL::VARCHAR'} AS min_date,
  {f"strftime(max({x}), '%Y-%m-%dT%H:%M:%S')" if k == 'ts' else 'NULL::VARCHAR'} AS max_date FROM orders"""
    for c, k in SCHEMAS["orders"].items()
    for x in ["nullif(o_orderstatus, 'P')" if c == "o_orderstatus" else c]
]))
def inspect_columns(spark, d) -> DataFrame:
    return I.column_report(table(spark, d, "orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')")))


@query(union_all([
    f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c})::DOUBLE, 4) AS min,
  round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS q50, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q75,
  round(max({c})::DOUBLE, 4) AS max, round(skewness({c}), 4) + 0.0 AS skew FROM lineitem""" for c in NUMERIC
]))
def inspect_numeric(spark, d) -> DataFrame:
    return rounded(I.numeric_detail(table(spark, d, "lineitem"), NUMERIC))


@query(f"""WITH vc AS ({counts_sql("part", ["p_name", "p_brand", "p_type"])}),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank,
  sum(n) OVER (PARTITION BY "column") AS t, count(*) OVER (PARTITION BY "column") AS u FROM vc)
SELECT "column", value, n, round(n / t, 4) AS share, rank::INTEGER AS rank, u::BIGINT AS unique_count FROM r WHERE rank <= CASE WHEN u <= 15 THEN 15 ELSE 10 END""")
def inspect_values(spark, d) -> DataFrame:
    return I.value_detail(table(spark, d, "part"), ["p_name", "p_brand", "p_type"])


_PAIRS_SQL = "SELECT p_partkey, p_size, p_retailprice, p_retailprice * 2 - p_size AS margin FROM part"


@query(f"""WITH t AS ({_PAIRS_SQL}), c AS (""" + union_all([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM t"
    for i, a in enumerate(["p_partkey", "p_size", "p_retailprice", "margin"]) for b in ["p_partkey", "p_size", "p_retailprice", "margin"][i + 1:]
]) + ") SELECT col_a, col_b, round(r, 4) AS correlation FROM c WHERE abs(r) > 0.5")
def notable_correlations(spark, d) -> DataFrame:
    part = table(spark, d, "part").selectExpr("p_partkey", "p_size", "p_retailprice", "p_retailprice * 2 - p_size AS margin")
    return I.notable_correlations(part)


@query("""SELECT 'l_returnflag' AS target, l_returnflag AS class, round(n / t, 4) AS share, k::BIGINT AS n_classes, m / t > 0.8 AS imbalanced
FROM (SELECT l_returnflag, n, sum(n) OVER () AS t, count(*) OVER () AS k, max(n) OVER () AS m FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1))""")
def target_classes(spark, d) -> DataFrame:
    return I.target_report(table(spark, d, "lineitem"), "l_returnflag")[1]


@query("""SELECT 'o_totalprice' AS target, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std,
  round(min(o_totalprice), 4) AS min, round(max(o_totalprice), 4) AS max, round(skewness(o_totalprice), 4) + 0.0 AS skew FROM orders""")
def target_regression(spark, d) -> DataFrame:
    return rounded(I.target_report(table(spark, d, "orders"), "o_totalprice")[1])
