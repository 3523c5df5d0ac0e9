"""Checked queries: completions to typed rows.

Completions are made from the tables, with the defects that models produce.
Expressions named ``*_EXPR`` are plain SQL that both engines run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.operators import decode as D
from tabkit.operators import profile as P
from tabkit.operators.encode import encode
from tabkit.operators.sample import representative
from tabkit.plans.base import query, rounded, table, union_all
from tabkit.plans.queries_profile import NUMBER_RE, counts_sql
from tabkit.plans.queries_text import simple_profile

_TRIM = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_MISSING = "('missing', 'nan', 'null', 'none')"

THINK_EXPR = "CASE WHEN doc_id % 3 = 0 THEN '<think>' || text || '</think> ' || source WHEN doc_id % 3 = 1 THEN 'a<think></think>' || lang || '<think>' || source || '</think>' ELSE text END"


@query(f"SELECT doc_id, {_TRIM.format(x=f'''regexp_replace({THINK_EXPR}, '<think>.*?</think>', '', 'gs')''')} AS text FROM documents")
def strip_thinking(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", D.strip_thinking(F.expr(THINK_EXPR)).alias("text"))


LINES_EXPR = """CASE o_orderkey % 4
  WHEN 0 THEN '1. total is ' || o_orderkey || chr(10) || 'and so on' || chr(10) || ' 2. status is ' || o_orderstatus || '  '
  WHEN 1 THEN '1. status is ' || o_orderstatus || chr(10) || 'the end'
  WHEN 2 THEN 'status is ' || o_orderstatus || ', priority is ' || o_orderpriority
  ELSE chr(10) || ' 1. a' || chr(10) || '10. ' || o_orderpriority || chr(10) || '11) no' || chr(10) || '3.' END"""


@query(rf"""WITH t AS (SELECT o_orderkey AS prompt_id, {LINES_EXPR} AS text FROM orders),
l AS (SELECT prompt_id, text, list_filter(string_split({_TRIM.format(x='text')}, chr(10)), lambda x: regexp_matches(x, '^\s*\d+\.')) AS lines FROM t),
r AS (SELECT prompt_id, CASE WHEN len(lines) > 1 THEN lines ELSE [text] END AS rows FROM l)
SELECT prompt_id, (i - 1)::INTEGER AS row_idx, rows[i] AS row_text FROM r, LATERAL (SELECT unnest(range(1, len(rows) + 1)) AS i)""")
def split_rows(spark, d) -> DataFrame:
    return D.split_rows(table(spark, d, "orders").select(F.col("o_orderkey").alias("prompt_id"), F.expr(LINES_EXPR).alias("text")))


SENTENCE_EXPR = """CASE o_orderkey % 7
  WHEN 0 THEN '1. 1. total is ' || o_custkey || '.5, status is ' || o_orderstatus || ', place is Hong Kong, China, priority is ' || o_orderpriority || '...'
  WHEN 1 THEN '2. STATUS is ' || o_orderstatus || ',  Total  is  ' || o_custkey || '.'
  WHEN 2 THEN 'total is 1, status is ' || o_orderstatus || ', total is ' || o_custkey || ', total is none'
  WHEN 3 THEN 'city is X, status is ' || o_orderstatus || ', other is y, priority is ' || o_orderpriority
  WHEN 4 THEN 'status is NaN, total is 1_000, priority is missing'
  WHEN 5 THEN ' 12. priority is ' || o_orderpriority || ', place is here, total and more, status is ' || o_orderstatus
  ELSE 'no row at all' END"""
_SENT = {"total": "float", "status": "categorical", "priority": "categorical", "place": "text"}


def _last_clause(name: str, numeric: bool) -> str:
    ok = f"lower(e.v) NOT IN {_MISSING}" + (f" AND regexp_matches(e.v, '{NUMBER_RE}')" if numeric else "")
    return f"list_filter(cl, lambda e: e.n = '{name}' AND length(e.v) > 0 AND {ok})[-1].v AS {name}"


@query(rf"""WITH t AS (SELECT o_orderkey AS prompt_id, regexp_replace(regexp_replace({_TRIM.format(x=f'({SENTENCE_EXPR})')}, '^(\d+\.\s*)+', ''), '\.+$', '') AS body FROM orders),
p AS (SELECT prompt_id, string_split(regexp_replace(body, ',\s*((?:priority|status|total|place)\s+is\s)', chr(1) || '\1', 'gi'), chr(1)) AS parts FROM t),
c AS (SELECT prompt_id, list_transform(parts, lambda x: {{'n': lower(trim(regexp_extract(x, '^\s*(.+?)\s+is\s+(.+)', 1, 'i'))), 'v': trim(regexp_extract(x, '^\s*(.+?)\s+is\s+(.+)', 2, 'i'))}}) AS cl FROM p)
SELECT prompt_id, {', '.join(_last_clause(n, t == 'float') for n, t in _SENT.items())} FROM c""")
def decode_sentence(spark, d) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("prompt_id"), F.expr(SENTENCE_EXPR).alias("row_text"))
    return D.decode_sentence(rows, simple_profile(_SENT))


OBJECT_EXPR = """'{"c_custkey": ' || c_custkey || ', "c_name": "' || c_name || '", "c_mktsegment": ' || CASE WHEN c_custkey % 9 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}'"""
_CUST = {"c_custkey": "integer", "c_name": "id", "c_mktsegment": "categorical"}
_FIELDS = ", ".join(f"json_extract_string(o, '$.{c}') AS {c}" for c in _CUST)


def _blocks(spark, d, parts: str, sep: str) -> DataFrame:
    """Ten customers per completion, in key order."""
    c = table(spark, d, "customer").select(F.expr("c_custkey DIV 10").alias("prompt_id"), "c_custkey", F.expr(parts).alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("c_custkey", "part")))
    return c.groupBy("prompt_id").agg(F.array_join(F.transform(ordered, lambda e: e["part"]), sep).alias("body"))


ARRAY_EXPR = "CASE WHEN prompt_id % 5 = 4 THEN '[' || body || ',' ELSE ' [' || body || ', 5, \"x\", [1]]' END"


@query(f"""WITH b AS (SELECT c_custkey // 10 AS prompt_id, string_agg({OBJECT_EXPR}, ', ' ORDER BY c_custkey) AS body FROM customer GROUP BY 1),
t AS (SELECT prompt_id, trim({ARRAY_EXPR}) AS text FROM b),
o AS (SELECT prompt_id, unnest(CASE WHEN json_valid(text) THEN from_json(text, '["json"]') ELSE [regexp_extract(text, '\\{{[^{{}}]*\\}}')::JSON] END) AS o FROM t)
SELECT prompt_id, {_FIELDS} FROM o WHERE json_type(o) = 'OBJECT'""")
def decode_json_array(spark, d) -> DataFrame:
    blocks = _blocks(spark, d, OBJECT_EXPR, ", ").select("prompt_id", F.expr(ARRAY_EXPR).alias("text"))
    return D.decode_json(blocks, simple_profile(_CUST)).drop("row_idx")


LINE_EXPR = f"""CASE c_custkey % 6
  WHEN 0 THEN (c_custkey % 10 + 1) || '. ' || {OBJECT_EXPR}
  WHEN 1 THEN 'here you go: ' || {OBJECT_EXPR} || ' thanks {{bye}}'
  WHEN 2 THEN (c_custkey % 10 + 1) || '. ' || {OBJECT_EXPR} || ','
  WHEN 3 THEN '{{"c_custkey": ' || c_custkey || ', "c_name": "a}}{{b", "c_extra": [1, 2]}}'
  WHEN 4 THEN '{{"c_custkey": ' || c_custkey || ', "c_name": }}'
  ELSE '{{"c_custkey": ' || c_custkey END"""


@query(rf"""WITH b AS (SELECT c_custkey // 10 AS prompt_id, unnest(string_split(string_agg({LINE_EXPR}, chr(10) ORDER BY c_custkey), chr(10))) AS line FROM customer GROUP BY 1),
o AS (SELECT prompt_id, regexp_extract(line, '^[^{{]*(\{{([^{{}}"]|"[^"]*")*\}})', 1) AS o FROM b)
SELECT prompt_id, {_FIELDS} FROM o WHERE json_valid(o)""")
def decode_json_lines(spark, d) -> DataFrame:
    return D.decode_json(_blocks(spark, d, LINE_EXPR, "\n").withColumnRenamed("body", "text"), simple_profile(_CUST)).drop("row_idx")


FENCED_EXPR = f"""CASE c_custkey % 5
  WHEN 0 THEN '```json' || chr(10) || {OBJECT_EXPR} || chr(10) || '```'
  WHEN 1 THEN '3. ' || {OBJECT_EXPR}
  WHEN 2 THEN ' ' || {OBJECT_EXPR} || chr(10)
  WHEN 3 THEN '[' || {OBJECT_EXPR} || ']'
  ELSE '{{"c_custkey": ' || c_custkey || ',' END"""


@query(rf"""WITH t AS (SELECT c_custkey AS prompt_id, regexp_replace(regexp_replace(regexp_replace({_TRIM.format(x=f'({FENCED_EXPR})')}, '^\d+\.\s*', ''), '^```(?:json)?\s*', ''), '\s*```$', '') AS body FROM customer),
o AS (SELECT prompt_id, CASE WHEN json_valid(body) AND body LIKE '{{%' THEN body END AS o FROM t)
SELECT prompt_id, o IS NOT NULL AS valid, {_FIELDS} FROM o""")
def decode_json_single(spark, d) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("prompt_id"), F.expr(FENCED_EXPR).alias("text"))
    return D.decode_json_single(rows, simple_profile(_CUST))


VALUE_EXPR = """CASE o_orderkey % 13 WHEN 0 THEN CAST(o_totalprice AS VARCHAR(40)) WHEN 1 THEN o_custkey || '.9' WHEN 2 THEN '-' || o_custkey || '.9' WHEN 3 THEN '1_000'
  WHEN 4 THEN 'NaN' WHEN 5 THEN 'None' WHEN 6 THEN ' ' || o_custkey || ' ' WHEN 7 THEN o_custkey || 'e2' WHEN 8 THEN 'Yes' WHEN 9 THEN o_orderstatus
  WHEN 10 THEN 'inf' WHEN 11 THEN '.5' ELSE 'f' END"""
_NUMBER = f"CASE WHEN lower(v) NOT IN {_MISSING} AND regexp_matches(v, '{NUMBER_RE}') THEN try_cast(trim(v) AS DOUBLE) END"


@query(f"""SELECT o_orderkey, trunc({_NUMBER})::BIGINT AS as_integer, {_NUMBER} AS as_float,
  CASE WHEN lower(v) NOT IN {_MISSING} THEN lower(v) IN ('true','yes','1','t','y') END AS as_boolean,
  CASE WHEN lower(v) NOT IN {_MISSING} AND lower(trim(v)) IN ('true','yes','1','t','y','false','no','n','0','f') THEN lower(trim(v)) IN ('true','yes','1','t','y') END AS as_strict,
  CASE WHEN lower(v) NOT IN {_MISSING} THEN v END AS as_text FROM (SELECT o_orderkey, {VALUE_EXPR} AS v FROM orders)""")
def parse_values(spark, d) -> DataFrame:
    v = F.col("v")
    return table(spark, d, "orders").select("o_orderkey", F.expr(VALUE_EXPR).alias("v")).select(
        "o_orderkey",
        D.parse_value(v, "integer").alias("as_integer"),
        D.parse_value(v, "float").alias("as_float"),
        D.parse_value(v, "boolean").alias("as_boolean"),
        D.parse_value(v, "boolean", strict_boolean=True).alias("as_strict"),
        D.parse_value(v, "text").alias("as_text"),
    )


_FORMS = [("%Y%m%d", "yyyyMMdd"), ("%d/%m/%Y", "dd/MM/yyyy"), ("%Y-%m-%d", "yyyy-MM-dd"), ("%d %b %Y", "dd MMM yyyy"), ("%Y-%m-%d %H:%M:%S", "yyyy-MM-dd HH:mm:ss"), ("%b %d, %Y", "MMM dd, yyyy"), ("%m/%d/%Y", "MM/dd/yyyy")]
_ORDERED = ["%Y%m%d", "%d/%m/%Y", "%Y-%m-%d", "%m/%d/%Y", "%d-%m-%Y", "%d %b %Y", "%d %B %Y", "%b %d, %Y", "%Y-%m-%d %H:%M:%S"]


@query(f"""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 9 {' '.join(f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, (f, _) in enumerate(_FORMS))} WHEN 7 THEN 'missing' ELSE 'soon' END AS v FROM orders)
SELECT o_orderkey, strftime(coalesce({', '.join(f"try_strptime(v, '{f}')" for f in _ORDERED)}), '%d/%m/%Y') AS value FROM t""")
def parse_dates(spark, d) -> DataFrame:
    case = F
    for i, (_, p) in enumerate(_FORMS):
        case = case.when(F.col("o_orderkey") % 9 == i, F.date_format("o_orderdate", p))
    text = case.when(F.col("o_orderkey") % 9 == 7, "missing").otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", D.parse_value(text, "datetime", "%d/%m/%Y").alias("value"))


def _changed(c: str) -> str:
    return f"""CASE p_partkey % 7 WHEN 0 THEN lower({c}) WHEN 1 THEN substr({c}, 2, 5) WHEN 2 THEN 'the ' || upper({c}) || ' one' WHEN 3 THEN 'zzz' WHEN 4 THEN substr({c}, 1, 1) WHEN 5 THEN NULL ELSE {c} END"""


def _repair_sql(c: str) -> str:
    return f"""SELECT p_partkey, CASE WHEN v IS NULL OR v IN (SELECT {c} FROM part) THEN v ELSE coalesce(
    (SELECT first(w ORDER BY n DESC, w) FROM dom_{c} WHERE contains(lower(w), lower(v)) OR contains(lower(v), lower(w))),
    (SELECT first(w ORDER BY n DESC, w) FROM dom_{c})) END AS {c} FROM (SELECT p_partkey, {_changed(c)} AS v FROM part)"""


@query(f"""WITH dom_p_brand AS (SELECT p_brand AS w, count(*) AS n FROM part GROUP BY 1), dom_p_name AS (SELECT p_name AS w, count(*) AS n FROM part GROUP BY 1)
SELECT p_partkey, p_brand, p_name FROM ({_repair_sql('p_brand')}) JOIN ({_repair_sql('p_name')}) USING (p_partkey)""")
def repair_category(spark, d) -> DataFrame:
    part = table(spark, d, "part")
    rows = part.select("p_partkey", *[F.expr(_changed(c)).alias(c) for c in ("p_brand", "p_name")])
    prof = P.profile(part.select("p_brand"))
    # p_name takes the route for large domains, p_brand the one for small.
    names = P.value_counts(part, ["p_name"]).select("value", "n")
    return D.repair_by_join(D.repair_category(rows, prof, ["p_brand"]), "p_name", names)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_returnflag = 'R' THEN 'Yes' ELSE 'No' END AS label FROM lineitem""")
def restore_labels(spark, d) -> DataFrame:
    raw = F.when(F.col("l_returnflag") == "R", "true").when(F.col("l_returnflag") == "A", "False").otherwise("none")
    value = D.restore_labels(D.parse_value(raw, "boolean"), "Yes", "No")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", value.alias("label"))


@query("SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus, nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'")
def drop_incomplete(spark, d) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "nullif(o_orderstatus, 'P') AS o_orderstatus", "nullif(o_orderpriority, '5-LOW') AS o_orderpriority")
    prof = simple_profile({"o_orderkey": "integer", "o_orderstatus": "categorical", "o_orderpriority": "categorical"})
    for c, rate in (("o_orderkey", 0.0), ("o_orderstatus", 0.36), ("o_orderpriority", 0.0)):
        prof.columns[c].missing_rate = rate
    return D.drop_incomplete(rows, prof)


@query("SELECT user_id AS prompt_id, event_id AS row_idx, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 25")
def cap_per_prompt(spark, d) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("prompt_id"), F.col("event_id").alias("row_idx"), "event_type")
    return D.cap_per_prompt(rows, 25)


@query("SELECT (event_id % 3)::INTEGER AS round, user_id AS prompt_id, event_id AS row_idx, value FROM events ORDER BY 1, 2, 3 LIMIT 5000")
def assemble(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("prompt_id"), F.col("event_id").alias("row_idx"), "value")
    rounds = [e.where(F.col("row_idx") % 3 == i) for i in range(3)]
    return D.assemble(rounds, 5000).select("round", "prompt_id", "row_idx", "value")


@query("""WITH c AS (SELECT o_custkey % 4 AS round, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderstatus END AS text, CASE WHEN o_orderkey % 21 = 0 THEN 'timeout' END AS error FROM orders),
t AS (SELECT round, count(*) AS texts, count(*) FILTER (text = '') AS empty_texts, count(error) AS errors FROM c GROUP BY 1),
r AS (SELECT o_custkey % 4 AS round, count(*) AS rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 7 <> 0 GROUP BY 1)
SELECT round, texts::BIGINT AS texts, empty_texts::BIGINT AS empty_texts, errors::BIGINT AS errors, coalesce(rows, 0)::BIGINT AS rows,
  round(coalesce(rows, 0) / ((texts - empty_texts) * 10), 7) AS decode_rate FROM t LEFT JOIN r USING (round)""")
def decode_stats(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    completions = o.select(
        (F.col("o_custkey") % 4).alias("round"),
        F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderstatus")).alias("text"),
        F.when(F.col("o_orderkey") % 21 == 0, "timeout").alias("error"),
    )
    kept = o.where(F.col("o_orderkey") % 7 != 0).select("o_orderkey", (F.col("o_custkey") % 4).alias("round"))
    decoded = table(spark, d, "lineitem").join(kept, F.col("l_orderkey") == F.col("o_orderkey")).select("round")
    return rounded(D.decode_stats(completions, decoded, 10))


_CUSTOMER_BOUNDS = ", ".join(f"quantile_cont({c}::DOUBLE, 0.25) AS lo_{c}, quantile_cont({c}::DOUBLE, 0.75) AS hi_{c}" for c in ("c_custkey", "c_nationkey", "c_acctbal"))
_CUSTOMER_HITS = " + ".join(f"({c} BETWEEN lo_{c} AND hi_{c})::INTEGER" for c in ("c_custkey", "c_nationkey", "c_acctbal"))


def _round_trip(spark, d, mode: str) -> DataFrame:
    pool = representative(table(spark, d, "customer"), "flexible", 0.7)
    prof = P.profile(pool, "c_mktsegment")
    encoded = encode(pool, prof, "json" if mode == "json" else "flexible", permute=True, row_key=["c_custkey"])
    completions = encoded.select(F.col("c_custkey").alias("prompt_id"), F.concat(F.lit("<think>\nhm\n</think>\n1. "), "text").alias("text"))
    return D.decode(completions, prof, mode).drop("prompt_id", "row_idx")


_ROUND_SQL = f"SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer, (SELECT {_CUSTOMER_BOUNDS} FROM customer) WHERE {_CUSTOMER_HITS} >= 2"


@query(_ROUND_SQL)
def roundtrip(spark, d) -> DataFrame:
    return _round_trip(spark, d, "json")


@query(_ROUND_SQL)
def roundtrip_sentence(spark, d) -> DataFrame:
    return _round_trip(spark, d, "flexible")
