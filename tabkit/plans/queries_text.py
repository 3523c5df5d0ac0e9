"""Checked queries: row encoders and few-shot prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.operators import encode as E
from tabkit.operators import prompt as K
from tabkit.operators.profile import ColumnProfile, DatasetProfile, value_abbreviations, value_counts
from tabkit.operators.profile import profile as profile_table
from tabkit.plans.base import query, rounded, table, union_all
from tabkit.plans.queries_profile import codes_sql, corr_sql

# ---- encoders ---------------------------------------------------------------
# Orders with a null, a boolean word and a free text made from existing columns.
_ROWS_SQL = """SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority, o_totalprice AS total, CASE WHEN o_orderstatus = 'O' THEN 'yes' ELSE 'no' END AS open,
  o_orderdate AS placed, o_orderstatus || ', "' || o_orderpriority || '"' AS note FROM orders"""
_TYPES = {"o_orderkey": "integer", "priority": "categorical", "total": "float", "open": "boolean", "placed": "datetime", "note": "text"}


def _rows(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.expr("nullif(o_orderpriority, '5-LOW')").alias("priority"),
        F.col("o_totalprice").alias("total"),
        F.when(F.col("o_orderstatus") == "O", "yes").otherwise("no").alias("open"),
        F.col("o_orderdate").alias("placed"),
        F.concat("o_orderstatus", F.lit(', "'), "o_orderpriority", F.lit('"')).alias("note"),
    )


def simple_profile(types: dict[str, str], target: str | None = None) -> DatasetProfile:
    """A profile that only knows types, for encoders."""
    return DatasetProfile(0, {c: ColumnProfile(i, c, t, "") for i, (c, t) in enumerate(types.items())}, target)


_TEXT = {
    "o_orderkey": "coalesce(o_orderkey::VARCHAR, 'Missing')",
    "priority": "coalesce(priority, 'Missing')",
    "total": "coalesce(printf('%.3f', total), 'Missing')",
    "open": "CASE open WHEN 'yes' THEN 'True' ELSE 'False' END",
    "placed": "coalesce(placed::VARCHAR, 'Missing')",
    "note": "'\"' || replace(note, '\"', '\"\"') || '\"'",
}
_JSON = {
    "o_orderkey": "coalesce(o_orderkey::VARCHAR, 'null')",
    "priority": "coalesce(to_json(priority)::VARCHAR, 'null')",
    "total": "coalesce(round(total, 3)::VARCHAR, 'null')",
    "open": "CASE open WHEN 'yes' THEN 'true' ELSE 'false' END",
    "placed": "coalesce(to_json(placed::VARCHAR)::VARCHAR, 'null')",
    "note": "to_json(note)::VARCHAR",
}


def _clause(c: str, style: str = "sentence") -> str:
    return f"'{c} is ' || {_TEXT[c]}" if style == "sentence" else f"'\"{c}\": ' || {_JSON[c]}"


def _join(cols, style: str = "sentence") -> str:
    return " || ', ' || ".join(_clause(c, style) for c in cols)


def _shuffled(cols, style: str = "sentence", tail: str = "", seed: int = 42) -> str:
    items = ", ".join(f"{{'k': md5('{seed}:' || o_orderkey || ':{c}'), 'p': {_clause(c, style)}}}" for c in cols)
    return f"array_to_string(list_transform(list_sort([{items}]), lambda e: e.p), ', '){tail}"


@query("""SELECT o_orderkey, CASE WHEN lower(trim(w)) IN ('true','yes','y','1','t') THEN true WHEN lower(trim(w)) IN ('false','no','n','0','f') THEN false END AS flag
FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'F' WHEN 2 THEN '1' WHEN 3 THEN 'maybe' WHEN 4 THEN 'TRUE' ELSE 'n' END AS w FROM orders)""")
def to_bool(spark, d) -> DataFrame:
    word = F.expr("CASE o_orderkey % 6 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'F' WHEN 2 THEN '1' WHEN 3 THEN 'maybe' WHEN 4 THEN 'TRUE' ELSE 'n' END")
    return table(spark, d, "orders").select("o_orderkey", E.to_bool(word, strict=False).alias("flag"))


@query(f"SELECT o_orderkey, {_join(_TYPES)} || '.' AS text FROM ({_ROWS_SQL})")
def encode_sentence(spark, d) -> DataFrame:
    rows = _rows(spark, d)
    return rows.select("o_orderkey", E.encode_sentence(rows, simple_profile(_TYPES)).alias("text"))


@query(f"SELECT o_orderkey, {_shuffled(_TYPES)} || '.' AS text FROM ({_ROWS_SQL})")
def encode_permuted(spark, d) -> DataFrame:
    rows = _rows(spark, d)
    return rows.select("o_orderkey", E.encode_sentence(rows, simple_profile(_TYPES), permute=True, row_key=["o_orderkey"]).alias("text"))


_FEATURES = [c for c in _TYPES if c != "open"]


@query(f"SELECT o_orderkey, {_join([*_FEATURES, 'open'])} AS text FROM ({_ROWS_SQL})")
def encode_target_last(spark, d) -> DataFrame:
    rows = _rows(spark, d)
    return rows.select("o_orderkey", E.encode_target_last(rows, simple_profile(_TYPES, "open")).alias("text"))


@query(f"SELECT o_orderkey, {_join(_FEATURES)} || ', open is' AS text FROM ({_ROWS_SQL})")
def encode_label_query(spark, d) -> DataFrame:
    rows = _rows(spark, d)
    return rows.select("o_orderkey", E.encode_label_query(rows, simple_profile(_TYPES, "open")).alias("text"))


_PERMUTED_JSON = _shuffled(_FEATURES, "json", " || ', ' || " + _clause("open", "json"))


@query(f"""SELECT o_orderkey, '{{' || {_join(_TYPES, 'json')} || '}}' AS text, '{{' || {_PERMUTED_JSON} || '}}' AS permuted FROM ({_ROWS_SQL})""")
def encode_json(spark, d) -> DataFrame:
    rows = _rows(spark, d)
    return rows.select(
        "o_orderkey",
        E.encode_json(rows, simple_profile(_TYPES)).alias("text"),
        E.encode_json(rows, simple_profile(_TYPES, "open"), permute=True, target_last=True, row_key=["o_orderkey"]).alias("permuted"),
    )


_CODE = "(SELECT any_value(code) FROM codes WHERE \"column\" = '{0}' AND codes.value = part.{0})"


@query(codes_sql([("part", "p_name"), ("part", "p_brand"), ("part", "p_type")]) + f""" SELECT p_partkey, concat_ws(', ', coalesce('P ' || p_partkey, 'P M'),
  'P_ ' || CASE WHEN p_name IS NULL THEN 'M' ELSE coalesce({_CODE.format('p_name')}, p_name[1:3]) END, 'P_0 ' || CASE WHEN p_brand IS NULL THEN 'M' ELSE coalesce({_CODE.format('p_brand')}, p_brand[1:3]) END,
  'P_1 ' || CASE WHEN p_type IS NULL THEN 'M' ELSE coalesce({_CODE.format('p_type')}, p_type[1:3]) END, coalesce('P_2 ' || p_size, 'P_2 M'), coalesce('P_3 ' || printf('%.3f', p_retailprice), 'P_3 M')) AS text FROM part""")
def encode_compact(spark, d) -> DataFrame:
    part = table(spark, d, "part")
    types = {"p_partkey": "integer", "p_name": "categorical", "p_brand": "categorical", "p_type": "categorical", "p_size": "integer", "p_retailprice": "float"}
    codes = value_abbreviations(value_counts(part, ["p_name", "p_brand", "p_type"]))
    return E.encode_compact(part, simple_profile(types), codes).select("p_partkey", "text")


# ---- draws ------------------------------------------------------------------
SEED, SHOTS = 11, 8


def _index_sql(tab: str, key: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"SELECT *, row_number() OVER ({part}ORDER BY md5('{SEED}:' || {key}), {key}) - 1 AS idx FROM {tab}"


def _draw_sql(prompts: str, k: str, prefix: str, n: str, most: int, keys: str) -> str:
    """k different indices per prompt: hashed ones in order, then consecutive ones; few rows are ranked instead."""
    h = lambda j: f"('0x' || substr(md5({prefix} || ':' || ({j})), 1, 15))::BIGINT"
    return f"""SELECT {keys}, idx, row_number() OVER (PARTITION BY {keys} ORDER BY pos) AS shot_no FROM (
    SELECT {keys}, {k} AS kk, idx, min(pos) AS pos FROM (
      SELECT {keys}, {k}, CASE WHEN j < 2 * {k} + 16 THEN {h('j')} % {n} ELSE ({h('0')} + j - 2 * {k} - 15) % {n} END AS idx, lpad(j::VARCHAR, 6, '0') AS pos
      FROM ({prompts}), range({3 * most + 16}) r(j) WHERE 4 * {k} <= {n} AND j < 3 * {k} + 16
      UNION ALL
      SELECT {keys}, {k}, j AS idx, md5({prefix} || ':' || j) AS pos FROM ({prompts}), range({4 * most}) r(j) WHERE 4 * {k} > {n} AND j < {n}
    ) GROUP BY ALL) QUALIFY shot_no <= kk"""


_PROMPTS_SQL = "SELECT DISTINCT c_custkey AS prompt_id, {k} AS k_shot, (SELECT count(*) FROM orders) AS n FROM customer"


def _prompts(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("prompt_id"))


@query(f"""WITH draws AS ({_draw_sql(_PROMPTS_SQL.format(k=SHOTS), 'k_shot', f"'{SEED}:{SHOTS}:' || prompt_id", 'n', SHOTS, 'prompt_id')})
SELECT prompt_id, shot_no::INTEGER AS shot_no, o_orderkey FROM draws JOIN ({_index_sql('orders', 'o_orderkey')}) USING (idx)""")
def draw_shots(spark, d) -> DataFrame:
    shots = K.draw_shots(table(spark, d, "orders"), _prompts(spark, d), ["o_orderkey"], SHOTS, SEED)
    return shots.select("prompt_id", "shot_no", "o_orderkey")


@query(f"""WITH sizes AS (SELECT o_orderpriority AS s, count(*) AS size, (SELECT count(*) FROM orders) AS total FROM orders GROUP BY 1),
shares AS (SELECT s, size, floor(size * {SHOTS} / total) AS base, (size * {SHOTS}) % total AS rest FROM sizes),
quotas AS (SELECT s, size, (base + CASE WHEN row_number() OVER (ORDER BY rest DESC, s) <= {SHOTS} - (SELECT sum(base) FROM shares) THEN 1 ELSE 0 END)::INTEGER AS quota FROM shares),
prompts AS (SELECT c_custkey AS prompt_id, s, size AS n, quota AS k_shot FROM customer, quotas WHERE quota > 0),
draws AS ({_draw_sql("SELECT * FROM prompts", 'k_shot', f"'{SEED}:' || prompt_id || ':' || s", 'n', SHOTS, 'prompt_id, s')})
SELECT prompt_id, s AS o_orderpriority, shot_no::INTEGER AS shot_no, o_orderkey
FROM draws JOIN ({_index_sql('orders', 'o_orderkey', 'o_orderpriority')}) i ON i.idx = draws.idx AND i.o_orderpriority = draws.s""")
def draw_shots_stratified(spark, d) -> DataFrame:
    shots = K.draw_shots(table(spark, d, "orders"), _prompts(spark, d), ["o_orderkey"], SHOTS, SEED, strata=["o_orderpriority"])
    return shots.select("prompt_id", "o_orderpriority", "shot_no", "o_orderkey")


_SWEEP = (4, 8, 12)
_SWEEP_SQL = f"SELECT s_suppkey AS prompt_id, k AS k_shot, (SELECT count(*) FROM orders) AS n FROM supplier, (VALUES {', '.join(f'({k})' for k in _SWEEP)}) v(k)"


@query(f"""WITH draws AS ({_draw_sql(_SWEEP_SQL, 'k_shot', f"'{SEED}:' || k_shot || ':' || prompt_id", 'n', max(_SWEEP), 'prompt_id, k_shot')})
SELECT k_shot::INTEGER AS k_shot, prompt_id, count(*)::BIGINT AS shots, count(DISTINCT o_orderkey)::BIGINT AS different, sum(o_orderkey)::BIGINT AS key_sum
FROM draws JOIN ({_index_sql('orders', 'o_orderkey')}) USING (idx) GROUP BY ALL""")
def kshot_sweep(spark, d) -> DataFrame:
    prompts = K.sweep(table(spark, d, "supplier").select(F.col("s_suppkey").alias("prompt_id")), _SWEEP)
    shots = K.draw_shots(table(spark, d, "orders"), prompts, ["o_orderkey"], None, SEED)
    return shots.groupBy("k_shot", "prompt_id").agg(
        F.count("*").alias("shots"), F.countDistinct("o_orderkey").alias("different"), F.sum("o_orderkey").alias("key_sum")
    )


# ---- schema text ------------------------------------------------------------
_CUST = {"c_custkey": "integer", "c_name": "id", "c_nationkey": "integer", "c_acctbal": "float", "c_mktsegment": "categorical"}
_PART = {"p_partkey": "integer", "p_name": "categorical", "p_brand": "categorical", "p_type": "categorical", "p_size": "integer", "p_retailprice": "float"}


def line_sql(tab: str, c: str, t: str) -> str:
    x = f"{c}::DOUBLE"
    top = lambda k: f"(SELECT string_agg(v, ', ' ORDER BY n DESC, v) FROM (SELECT {c} AS v, count(*) AS n FROM {tab} GROUP BY 1 ORDER BY n DESC, v LIMIT {k}))"
    if t in ("integer", "float"):
        nums = [("min", f"min({x})"), ("max", f"max({x})"), ("mean", f"avg({x})"), ("std", f"stddev_samp({x})")]
        nums += [(f"q{p}", f"quantile_cont({x}, 0.{p})") for p in (25, 50, 75)]
        return f"SELECT '  {c}: {t}, ' || " + " || ', ' || ".join(f"printf('{n}=%.2f', {e})" for n, e in nums) + f" FROM {tab}"
    if t == "categorical":
        return f"""SELECT CASE WHEN count(DISTINCT {c}) > 20 THEN '  {c}: categorical, ' || count(DISTINCT {c}) || ' unique values (examples: ' || {top(3)} || ')'
  ELSE '  {c}: categorical (values: ' || {top(5)} || ')' END FROM {tab}"""
    return f"""SELECT '  {c}: unique identifier (format examples: ' || string_agg(v, ', ' ORDER BY h) || ') — generate novel unique values, do NOT reuse examples'
  FROM (SELECT DISTINCT {c} AS v, md5('42:' || {c}) AS h FROM {tab} ORDER BY h LIMIT 3)"""


def _schema_sql(tab: str, types: dict[str, str]) -> str:
    return " || chr(10) || ".join(f"({line_sql(tab, c, t)})" for c, t in types.items())


@query(union_all([f"SELECT '{t}' AS \"table\", {_schema_sql(t, cols)} AS block" for t, cols in (("customer", _CUST), ("part", _PART))]))
def schema_block(spark, d) -> DataFrame:
    rows = [(t, K.schema_block(profile_table(table(spark, d, t)))) for t in ("customer", "part")]
    return spark.createDataFrame(rows, "table string, block string")


_CORR = ["p_partkey", "p_size", "p_retailprice"]
_WIDTH = 13


def _corr_block_sql(tab: str, cols: list[str], width: int) -> str:
    head = " " * (width + 2) + " ".join(c[:width].rjust(width) for c in cols)
    r = lambda a, b: f"coalesce((SELECT printf('%{width}.2f', CASE WHEN stddev_samp({a}) > 0 AND stddev_samp({b}) > 0 THEN round(corr({a}, {b}), 12) END) FROM {tab}), '{'nan'.rjust(width)}')"
    rows = [f"'  {a[:width].ljust(width)} ' || " + " || ' ' || ".join(r(a, b) for b in cols) for a in cols]
    return f"'{head}'" + "".join(f" || chr(10) || {x}" for x in rows)


@query(f"SELECT {_corr_block_sql('part', _CORR, _WIDTH)} AS block")
def correlation_block(spark, d) -> DataFrame:
    return spark.createDataFrame([("\n".join(K.correlation_lines(table(spark, d, "part"), _CORR)),)], "block string")


# ---- prompts ----------------------------------------------------------------
_CUST_JSON = """'{"c_custkey": ' || c_custkey || ', "c_name": ' || to_json(c_name)::VARCHAR || ', "c_nationkey": ' || c_nationkey || ', "c_acctbal": ' || round(c_acctbal, 3)::VARCHAR || ', "c_mktsegment": ' || to_json(c_mktsegment)::VARCHAR || '}'"""
_CUST_TEXT = """'c_custkey is ' || c_custkey || ', c_name is ' || c_name || ', c_nationkey is ' || c_nationkey || ', c_acctbal is ' || printf('%.3f', c_acctbal) || ', c_mktsegment is ' || c_mktsegment || '.'"""
_CUST_PROMPTS = f"SELECT s_suppkey AS prompt_id, {SHOTS} AS k_shot, (SELECT count(*) FROM customer) AS n FROM supplier"
_CUST_DRAWS = _draw_sql(_CUST_PROMPTS, "k_shot", f"'{SEED}:{SHOTS}:' || prompt_id", "n", SHOTS, "prompt_id")
_HEAD, _EXAMPLES = K.STRUCTURED_HEAD.split("{schema}")


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_JSON_TAIL = K.STRUCTURED_TAIL.format(
    n=25, format=K.JSON_FORMAT.format(example='"c_custkey": 35, "c_name": ..., "c_nationkey": ...'),
    constraint=K.CONSTRAINT.format(condition="c_mktsegment=BUILDING"), rules=K.JSON_RULES, index_rule="",
)


@query(f"""WITH draws AS ({_CUST_DRAWS}), schema_text AS (SELECT {_schema_sql('customer', _CUST)} || chr(10) || chr(10) || 'Correlation Matrix (numerical features):' || chr(10) || {_corr_block_sql('customer', ['c_custkey', 'c_nationkey', 'c_acctbal'], 11)} AS s)
SELECT prompt_id, {SHOTS}::INTEGER AS k_shot, 25::INTEGER AS n_samples, {_lit(_HEAD)} || any_value(s) || {_lit(_EXAMPLES.replace('{shots}', str(SHOTS)))}
  || string_agg(shot_no || '. ' || {_CUST_JSON}, chr(10) ORDER BY shot_no) || chr(10) || {_lit(_JSON_TAIL)} AS prompt
FROM draws JOIN ({_index_sql('customer', 'c_custkey')}) USING (idx), schema_text GROUP BY prompt_id""")
def build_prompts(spark, d) -> DataFrame:
    pool = table(spark, d, "customer")
    prompts = table(spark, d, "supplier").select(F.col("s_suppkey").alias("prompt_id"))
    shots = K.draw_shots(pool, prompts, ["c_custkey"], SHOTS, SEED)
    return K.build_prompts(shots, profile_table(pool), 25, "json", conditions=K.parse_conditions(["c_mktsegment=BUILDING"]), train=pool)


_SIMPLE_HEAD = "Schema:\n" + "\n".join(f"  {c}: {t}" for c, t in _CUST.items()) + "\n\nExamples:\n"


@query(f"""WITH draws AS ({_CUST_DRAWS})
SELECT prompt_id, {SHOTS}::INTEGER AS k_shot, 10::INTEGER AS n_samples, {_lit(_SIMPLE_HEAD)} || string_agg({_CUST_TEXT}, chr(10) ORDER BY shot_no)
  || chr(10) || chr(10) || 'Generate 10 new rows where c_nationkey=3:' || chr(10) AS prompt
FROM draws JOIN ({_index_sql('customer', 'c_custkey')}) USING (idx) GROUP BY prompt_id""")
def build_prompts_simple(spark, d) -> DataFrame:
    pool = table(spark, d, "customer")
    prompts = table(spark, d, "supplier").select(F.col("s_suppkey").alias("prompt_id"))
    shots = K.draw_shots(pool, prompts, ["c_custkey"], SHOTS, SEED)
    return K.build_prompts(shots, simple_profile(_CUST), 10, "flexible", "simple", {"c_nationkey": "3"})


@query(f"""WITH h AS (SELECT *, md5('42:' || c_custkey) AS o, greatest(1, ceil(count(*) OVER () / 100))::BIGINT AS shards FROM customer)
SELECT (('0x' || substr(o, 1, 15))::BIGINT % shards)::BIGINT AS shard, count(*)::BIGINT AS n_rows, string_agg({_CUST_TEXT}, chr(10) ORDER BY o) AS text FROM h GROUP BY 1""")
def training_text(spark, d) -> DataFrame:
    pool = table(spark, d, "customer")
    return K.training_text(E.encode(pool, simple_profile(_CUST), "flexible"), ["c_custkey"], 100)


@query("SELECT o_orderkey, o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AS meets_condition FROM orders")
def condition_flag(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    conditions = K.parse_conditions(["o_orderstatus=F", "o_orderpriority=1-URGENT"])
    return o.select("o_orderkey", K.condition_flag(o, conditions).alias("meets_condition"))


@query("""SELECT i AS prompt_id, (i // 300)::BIGINT AS batch_id, least(25, n - i * 25)::INTEGER AS n_samples
FROM (SELECT count(*) AS n FROM orders), LATERAL (SELECT unnest(range(ceil(n / 25)::BIGINT)) AS i)""")
def plan_prompts(spark, d) -> DataFrame:
    return K.plan_prompts(spark, table(spark, d, "orders").count(), remainder=True)


_ROW_TEXT = "'c_custkey is ' || c_custkey || ', c_name is ' || c_name || ', c_nationkey is ' || c_nationkey || ', c_acctbal is ' || c_acctbal || ', c_mktsegment is ' || c_mktsegment"


@query(f"""WITH t AS (SELECT ceil(length({_ROW_TEXT}) / 4)::BIGINT AS tok, row_number() OVER (ORDER BY md5('42:' || c_custkey), c_custkey) - 1 AS i FROM customer),
c AS (SELECT i // 25 AS ch, sum(tok) AS s, count(*) AS n FROM t GROUP BY 1),
a AS (SELECT sum(n)::BIGINT AS rows, sum(s) / sum(n) AS avg_row_tokens, max(s * (25.0::DOUBLE / n)) AS max_chunk_tokens FROM c)
SELECT rows, round(avg_row_tokens, 7) AS avg_row_tokens, round(max_chunk_tokens, 7) AS max_chunk_tokens,
  trunc((1000.0::DOUBLE + 80 * avg_row_tokens) * 1.1::DOUBLE)::BIGINT AS estimated_input, trunc(max_chunk_tokens * 1.1::DOUBLE)::BIGINT AS estimated_output FROM a""")
def token_stats(spark, d) -> DataFrame:
    return rounded(K.token_stats(table(spark, d, "customer"), ["c_custkey"], 80))


_DOC_JSON = """'{"doc_id": "' || doc_id || '", "lang": ' || to_json(lang)::VARCHAR || ', "source": ' || to_json(source)::VARCHAR || ', "text": ' || to_json(text)::VARCHAR || '}'"""


@query(f"""WITH t AS (SELECT ceil(length({_DOC_JSON}) / 4)::BIGINT AS tok FROM documents),
p AS (SELECT list_sort(list(tok))[least(floor(count(*) * 0.9)::BIGINT, count(*) - 1) + 1] AS p90 FROM t)
SELECT p90 AS p90_tokens, least(25, greatest(5, floor(8192 / floor(p90 * 1.35::DOUBLE))))::INTEGER AS rows_per_prompt FROM p""")
def fit_rows_per_prompt(spark, d) -> DataFrame:
    return K.fit_rows_per_prompt(table(spark, d, "documents").select("doc_id", "lang", "source", "text"))
