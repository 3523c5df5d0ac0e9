"""Few-shot prompts: draws of example rows, schema and correlation text, budgets."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabkit.functions.columns import col, hash_number, join_null_safe, rank_key
from tabkit.operators.encode import encode
from tabkit.operators.profile import DatasetProfile, correlation_matrix, text_of

# ---- Fixed values: the wording of the prompts -------------------------------
STRUCTURED_HEAD = """\
## Task: Generate Synthetic Tabular Data

Generate realistic, diverse, and UNIQUE synthetic tabular data that matches the schema and statistical patterns below.
IMPORTANT: Generate rows that are different from the examples to avoid privacy leakage.

## Schema and Statistics:
{schema}

## Examples ({shots} rows):
"""
STRUCTURED_TAIL = """\

## Instructions:
Generate **only** {n} NEW and UNIQUE synthetic row(s). **Do NOT generate any additional text, explanations, or repeats of the instructions after the {n} rows.**

**Output Format (CRITICAL)**:
Output {n} rows, one per line, numbered 1 to {n}.
{format}

{constraint}**Requirements**:
- Generate UNIQUE rows (different from examples)
{rules}
- Respect column types and statistical ranges
- Maintain realistic correlations between features
- Ensure diversity in generated samples
{index_rule}- Output exactly {n} rows
**- Once row {n} is generated, STOP. No further text should be generated.**

## Generated Data:"""
CONSTRAINT = "**Constraint**: All rows must have {condition}\n\n"
JSON_FORMAT = "Each row must be a valid JSON object with ALL columns as keys.\nExample: 1. {{{example}}}"
JSON_RULES = """\
- Each row MUST be a valid JSON object with ALL column keys
- Use the EXACT column names as JSON keys
- Use correct JSON types: integers as numbers, strings in double quotes"""
SENTENCE_FORMAT = """\
Format: NUMBER. column1 is value1, column2 is value2, ..., columnN is valueN
Example: 1. MedInc is 3.456, HouseAge is 25, ..., MedHouseVal is 2.100"""
SENTENCE_RULES = "- Follow the EXACT format: NUMBER. col1 is val1, col2 is val2, ..."
SENTENCE_INDEX_RULE = "- Make sure NOT TO REPEAT the index twice in the same row, e.g., '1. 1. col1 is val1...' is incorrect\n"
LISTED_CATEGORIES = 20
DEFAULT_SHOTS = (40, 60, 80, 100, 120, 140, 160)
ROWS_PER_PROMPT = 25
PROMPT_OVERHEAD_TOKENS = 1000
TOKEN_BUFFER = 1.1
OUTPUT_FLOOR_TOKENS = 8192
ROW_SAFETY = 1.35
MIN_ROWS_PER_PROMPT = 5
# -----------------------------------------------------------------------------


# ---- K1, K2 -----------------------------------------------------------------
def spread_copies(df: DataFrame, per_task: int = 100_000) -> DataFrame:
    """Number the copies of equal rows, ``copy_no`` from 0, without one task per row value.

    Equal rows are counted first; a large count is expanded in pieces that are
    spread over the cluster, so a row that fills a third of a table is no hot group.
    """
    names = df.columns
    counted = df.groupBy(*[col(c) for c in names]).agg(F.count(F.lit(1)).alias("_m"))
    piece = counted.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("_m") - 1) / per_task))))
    spread = piece.repartition(*[col(c) for c in names], "_piece")
    first = F.col("_piece") * per_task
    last = F.least(first + per_task, F.col("_m")) - 1
    return spread.withColumn("copy_no", F.explode(F.sequence(first, last))).drop("_m", "_piece")


def dense_index(pool: DataFrame, key: Sequence[str], seed: int, by: Sequence[str] = (), hex_digits: int = 3) -> DataFrame:
    """Add ``idx`` 0..N-1 (within ``by``) in md5 order of the key, without a global sort.

    Rows are numbered inside buckets of the hash (even by construction, as
    ``key`` is unique), and the sizes of the buckets before are added.
    """
    keys = [col(b) for b in by]
    hashed = pool.withColumn("_order", rank_key(seed, *key)).withColumn("_bucket", F.substring("_order", 1, hex_digits))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = hashed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy(*keys, "_bucket").orderBy("_order", *[col(k) for k in key])
    placed = join_null_safe(hashed.withColumn("_place", F.row_number().over(inner) - 1), offsets, [*by, "_bucket"])
    return placed.withColumn("idx", F.col("_place") + F.col("_offset")).select(*[col(c) for c in pool.columns], "idx")


def _draw(prefix: Column, k: Column, n: Column) -> Column:
    """``k`` different indices below ``n`` for one prompt, as an array.

    Few rows (n < 4k): the first k of all indices in hash order. Otherwise 2k+16
    hashed indices, then consecutive ones from the first as a reserve that
    always completes k different ones; repeats dropped, first k kept.
    """
    digest = lambda i: F.md5(F.concat_ws(":", prefix, i.cast("string")))
    ranked = F.transform(
        F.array_sort(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.struct(digest(i).alias("h"), i.alias("i")))),
        lambda e: e["i"],
    )
    number = lambda j: hash_number(digest(j)) % n
    hashed = F.transform(F.sequence(F.lit(0), 2 * k + 15), number)
    reserve = F.transform(F.sequence(F.lit(1), k), lambda t: (number(F.lit(0)) + t) % n)
    return F.slice(F.when(4 * k > n, ranked).otherwise(F.array_distinct(F.concat(hashed, reserve))), F.lit(1), k.cast("int"))


def _spread(prompts: DataFrame) -> DataFrame:
    """Prompts dealt evenly to the cluster: a small file of prompts is many draws, which one task would make alone."""
    return prompts.repartition(int(prompts.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def draw_shots(
    pool: DataFrame,
    prompts: DataFrame,
    key: Sequence[str] | None = None,
    k: int | None = None,
    seed: int = 42,
    strata: Sequence[str] = (),
    indexed: DataFrame | None = None,
    size: int | None = None,
) -> DataFrame:
    """K1, K2: for each prompt its own ``k`` pool rows without replacement.

    ``key`` identifies pool rows; without one, equal rows are numbered first so
    that copies stay apart. ``prompts`` needs ``prompt_id`` and, when
    ``k`` is None, its own ``k_shot``. With ``strata`` the k rows are shared out
    in proportion to the stratum sizes (largest remainder). Work is prompts x k
    plus one numbering of the pool; no prompt looks at the whole pool.
    ``indexed`` is a pool already numbered by ``dense_index``, ``size`` its known number of rows, for repeated draws.
    """
    prompts = prompts if k is None else prompts.withColumn("k_shot", F.lit(k))
    if key is None:
        pool = spread_copies(pool)
        key = pool.columns
    if strata:
        if k is None:
            raise ValueError("a stratified draw needs one k for all prompts")
        return _draw_stratified(pool, prompts, key, k, seed, strata)
    total = F.lit(pool.count() if size is None else size).cast("bigint")
    prefix = F.concat_ws(":", F.lit(str(seed)), F.col("k_shot").cast("string"), F.col("prompt_id").cast("string"))
    draws = _spread(prompts).select("*", F.posexplode(_draw(prefix, F.col("k_shot"), total)).alias("_pos", "idx"))
    draws = draws.withColumn("shot_no", F.col("_pos") + 1).drop("_pos")
    # Spark takes the draws to be as small as the prompts and would gather them on the driver; both sides are shuffled instead.
    return draws.hint("merge").join(dense_index(pool, key, seed) if indexed is None else indexed, "idx")


def stratum_quotas(pool: DataFrame, strata: Sequence[str], k: int) -> DataFrame:
    """Rows per stratum out of ``k``, by largest remainder; only strata with a share."""
    sizes = pool.groupBy(*[col(s) for s in strata]).agg(F.count(F.lit(1)).alias("size"))
    total = pool.count()
    share = F.col("size") * F.lit(k) / F.lit(max(total, 1))
    shares = sizes.withColumn("base", F.least(F.floor(share), F.col("size"))).withColumn("rest", F.col("size") * F.lit(k) % F.lit(max(total, 1)))
    given = shares.agg(F.sum("base")).first()[0] or 0
    left = max(min(k, total) - given, 0)
    extra = shares.where(F.col("base") < F.col("size")).orderBy(F.col("rest").desc(), *[col(s) for s in strata]).limit(left)
    quotas = join_null_safe(shares, extra.select(*[col(s) for s in strata], F.lit(1).alias("extra")), list(strata), "left")
    quota = F.col("base") + F.coalesce("extra", F.lit(0))
    return quotas.select(*[col(s) for s in strata], "size", quota.cast("int").alias("quota")).where("quota > 0")


def _draw_stratified(pool: DataFrame, prompts: DataFrame, key: Sequence[str], k: int, seed: int, strata: Sequence[str]) -> DataFrame:
    spark = pool.sparkSession
    # At most k strata have a share, so the list that every prompt carries is small.
    quotas = stratum_quotas(pool, strata, k)
    listed = spark.createDataFrame(quotas.collect(), quotas.schema)
    every = listed.agg(F.array_sort(F.collect_list(F.struct(*[col(s) for s in strata], "size", "quota"))).alias("_strata")).first()[0]
    entries = F.array(*[F.struct(*[F.lit(e[f]).cast(quotas.schema[f].dataType).alias(f) for f in quotas.columns]) for e in every])
    per = _spread(prompts).select("*", F.explode(entries).alias("_s")).select(*[col(c) for c in prompts.columns], "_s.*")
    prefix = F.concat_ws(":", F.lit(str(seed)), F.col("prompt_id").cast("string"), *[col(s).cast("string") for s in strata])
    drawn = per.select("*", F.posexplode(_draw(prefix, F.col("quota"), F.col("size"))).alias("_pos", "idx"))
    drawn = drawn.withColumn("shot_no", F.col("_pos") + 1).drop("_pos", "size", "quota")
    return join_null_safe(drawn.hint("merge"), dense_index(pool, key, seed, strata), [*strata, "idx"])


# ---- K3, K4 -----------------------------------------------------------------
def schema_lines(profile: DatasetProfile) -> list[str]:
    """K3: one line per column with its type and statistics."""
    out = []
    for name, p in profile.columns.items():
        values = [v for v, _ in (p.top_k or [])]
        if p.dtype in ("integer", "float") and p.min_val is not None:
            stats = {"min": p.min_val, "max": p.max_val, "mean": p.mean, "std": float("nan") if p.std is None else p.std}
            if None not in (p.q25, p.q50, p.q75):
                stats.update(q25=p.q25, q50=p.q50, q75=p.q75)
            text = f"{p.dtype}, " + ", ".join(f"{k}={v:.2f}" for k, v in stats.items())
        elif p.dtype == "categorical" and (p.cardinality or 0) > LISTED_CATEGORIES:
            text = f"{p.dtype}, {p.cardinality} unique values (examples: {', '.join(values[:3])})"
        elif p.dtype == "categorical":
            text = f"{p.dtype} (values: {', '.join(values[:5])})"
        elif p.dtype == "id":
            text = f"unique identifier (format examples: {', '.join(values[:3])}) — generate novel unique values, do NOT reuse examples"
        else:
            text = p.dtype
        out.append(f"  {name}: {text}")
    return out


def correlation_lines(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """K4: the correlation matrix as fixed-width text; nothing for fewer than two columns."""
    if len(columns) < 2:
        return []
    r = {(x["col_a"], x["col_b"]): x["r"] for x in correlation_matrix(df, columns).collect()}
    width = min(max(8, *(len(c) for c in columns)), 20)
    show = lambda v: f"{float('nan') if v is None else v:>{width}.2f}"
    lines = [" " * (width + 2) + " ".join(c[:width].rjust(width) for c in columns)]
    for a in columns:
        lines.append(f"  {a[:width].ljust(width)} " + " ".join(show(r[a, b]) for b in columns))
    return lines


def schema_block(profile: DatasetProfile, train: DataFrame | None = None) -> str:
    lines = schema_lines(profile)
    if train is not None:
        matrix = correlation_lines(train, profile.names("integer", "float"))
        if matrix:
            lines += ["", "Correlation Matrix (numerical features):", *matrix]
    return "\n".join(lines)


# ---- K5..K8 -----------------------------------------------------------------
def parse_conditions(items: Sequence[str]) -> dict[str, str]:
    """K8: ``col=val`` strings as a map."""
    pairs = [i.partition("=") for i in items]
    bad = [i for i, (_, sep, _) in zip(items, pairs) if not sep]
    if bad:
        raise ValueError(f"expected column=value, got {bad}")
    return {name.strip(): value.strip() for name, _, value in pairs}


def _condition_text(conditions: Mapping[str, str] | None) -> str:
    return ", ".join(f"{k}={v}" for k, v in (conditions or {}).items())


def condition_flag(df: DataFrame, conditions: Mapping[str, str]) -> Column:
    """K8: whether a row meets every ``col=val`` condition."""
    flag = F.lit(True)
    for name, value in conditions.items():
        flag = flag & F.coalesce(text_of(col(name), df.schema[name].dataType) == value, F.lit(False))
    return flag


def structured_tail(profile: DatasetProfile, n_samples: Column, json_rows: bool, conditions: Mapping[str, str] | None) -> Column:
    order = profile.column_order
    example = ", ".join([f'"{order[0]}": 35', *[f'"{c}": ...' for c in order[1:3]]])
    if len(order) == 1:
        example += ", "
    filled = STRUCTURED_TAIL.format(
        n="\0",
        format=JSON_FORMAT.format(example=example) if json_rows else SENTENCE_FORMAT,
        constraint=CONSTRAINT.format(condition=_condition_text(conditions)) if conditions else "",
        rules=JSON_RULES if json_rows else SENTENCE_RULES,
        index_rule="" if json_rows else SENTENCE_INDEX_RULE,
    )
    pieces = filled.split("\0")
    return F.concat_ws("", *[x for piece in pieces[:-1] for x in (F.lit(piece), n_samples.cast("string"))], F.lit(pieces[-1]))


def build_prompts(
    shots: DataFrame,
    profile: DatasetProfile,
    n_samples: int | None = ROWS_PER_PROMPT,
    mode: str = "json",
    style: str = "structured",
    conditions: Mapping[str, str] | None = None,
    train: DataFrame | None = None,
    permute: bool = False,
    row_key: Sequence[str] = (),
    seed: int = 42,
    schema: str | None = None,
) -> DataFrame:
    """K5, K6: ``(prompt_id, k_shot, n_samples, prompt)`` from drawn rows.

    ``n_samples=None`` takes it from the shots' own column. ``train`` adds the
    correlation matrix of that table; a ``schema`` block made before saves making it again. ``permute`` shuffles columns
    anew for each row of each prompt.
    """
    options = {"permute": True, "row_key": ["prompt_id", *row_key], "seed": seed} if permute else {}
    shots = shots if n_samples is None else shots.withColumn("n_samples", F.lit(n_samples))
    groups = [c for c in ("prompt_id", "batch_id", "k_shot", "n_samples") if c in shots.columns]
    lines = encode(shots, profile, mode, "_text", **options).select(*groups, "shot_no", "_text")
    ordered = F.array_sort(F.collect_list(F.struct("shot_no", "_text")))
    grouped = lines.groupBy(*groups).agg(ordered.alias("_shots"))
    n = F.col("n_samples")
    if style == "structured":
        head = STRUCTURED_HEAD.format(schema=schema_block(profile, train) if schema is None else schema, shots="\0").split("\0")
        numbered = F.transform("_shots", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s["_text"]))
        prompt = F.concat(
            F.lit(head[0]), F.size("_shots").cast("string"), F.lit(head[1]), F.array_join(numbered, "\n"), F.lit("\n"),
            structured_tail(profile, n, mode == "json", conditions),
        )
    elif style == "simple":
        schema = "\n".join(["Schema:", *[f"  {c}: {p.dtype}" for c, p in profile.columns.items()]])
        where = f" where {_condition_text(conditions)}" if conditions else ""
        plain = F.transform("_shots", lambda s: s["_text"])
        prompt = F.concat(
            F.lit(schema + "\n\nExamples:\n"), F.array_join(plain, "\n"), F.lit("\n\nGenerate "), n.cast("string"), F.lit(f" new rows{where}:\n")
        )
    else:
        raise ValueError("style must be 'structured' or 'simple'")
    return grouped.select(*groups, prompt.alias("prompt"))


def training_text(encoded: DataFrame, key: Sequence[str], rows_per_text: int = 1000, text: str = "text", seed: int = 42) -> DataFrame:
    """K7: encoded rows joined by newline, in shards of about ``rows_per_text`` rows.

    ``key`` is unique, so shards are even; a whole table never becomes one string.
    """
    shards = max(1, -(-encoded.count() // rows_per_text))
    hashed = encoded.withColumn("_order", rank_key(seed, *key))
    shard = (hash_number(F.col("_order")) % F.lit(shards)).alias("shard")
    lines = F.array_sort(F.collect_list(F.struct("_order", col(text).alias("line"))))
    joined = F.array_join(F.transform(lines, lambda e: e["line"]), "\n")
    return hashed.groupBy(shard).agg(F.count(F.lit(1)).alias("n_rows"), joined.alias("text"))


# ---- K9..K13 ----------------------------------------------------------------
def plan_prompts(
    spark: SparkSession,
    n_rows: int,
    rows_per_prompt: int = ROWS_PER_PROMPT,
    prompts_per_batch: int = 300,
    remainder: bool = False,
) -> DataFrame:
    """K9: ``ceil(n_rows / rows_per_prompt)`` prompts in batches.

    ``remainder`` makes the last prompt ask only for the rows still missing.
    """
    n_prompts = -(-n_rows // rows_per_prompt)
    prompts = spark.range(n_prompts).withColumnRenamed("id", "prompt_id")
    left = F.lit(n_rows) - F.col("prompt_id") * rows_per_prompt
    samples = F.least(left, F.lit(rows_per_prompt)) if remainder else F.lit(rows_per_prompt)
    return prompts.select("prompt_id", F.floor(F.col("prompt_id") / prompts_per_batch).alias("batch_id"), samples.cast("int").alias("n_samples"))


def sweep(prompts: DataFrame, shots: Sequence[int] = DEFAULT_SHOTS) -> DataFrame:
    """Each prompt once per k, as ``k_shot``."""
    return prompts.withColumn("k_shot", F.explode(F.array(*[F.lit(k) for k in shots])))


def default_counter(text: Column) -> Column:
    """Tokens of a text, taken as a quarter of its characters."""
    return F.ceil(F.length(text) / 4)


def _row_text(df: DataFrame) -> Column:
    parts = [F.concat(F.lit(f"{c} is "), F.coalesce(text_of(col(c), df.schema[c].dataType), F.lit("nan"))) for c in df.columns]
    return F.concat_ws(", ", *parts)


def token_stats(
    df: DataFrame,
    key: Sequence[str],
    k_shot: int,
    rows_per_prompt: int = ROWS_PER_PROMPT,
    counter: Callable[[Column], Column] = default_counter,
    seed: int = 42,
) -> DataFrame:
    """Average tokens per row, largest run of ``rows_per_prompt`` rows, and the lengths to plan for."""
    counted = df.select(*[col(k) for k in key], counter(_row_text(df)).alias("_tokens"))
    indexed = dense_index(counted, key, seed)
    chunk = F.floor(F.col("idx") / rows_per_prompt)
    per = indexed.groupBy(chunk.alias("_chunk")).agg(F.sum("_tokens").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    stats = per.agg(
        F.sum("_n").alias("rows"),
        (F.sum("_sum") / F.sum("_n")).alias("avg_row_tokens"),
        F.max(F.col("_sum") * (F.lit(float(rows_per_prompt)) / F.col("_n"))).alias("max_chunk_tokens"),
    )
    est_in = (F.lit(float(PROMPT_OVERHEAD_TOKENS)) + k_shot * F.col("avg_row_tokens")) * TOKEN_BUFFER
    est_out = F.col("max_chunk_tokens") * TOKEN_BUFFER
    return stats.withColumn("estimated_input", est_in.cast("bigint")).withColumn("estimated_output", est_out.cast("bigint"))


def fallback_tokens(k_shot: int, rows_per_prompt: int) -> tuple[int, int]:
    """Input and output lengths when nothing can be measured."""
    return 500 + 80 * k_shot, int(rows_per_prompt * 40 * 1.8 + 256)


def schema_tokens(rows: int, n_columns: int) -> int:
    """Output length from the number of columns alone."""
    return int(rows * (4 + 8 * n_columns) * 1.3)


def fit_rows_per_prompt(
    df: DataFrame,
    rows_per_prompt: int = ROWS_PER_PROMPT,
    output_tokens: int = 0,
    counter: Callable[[Column], Column] = default_counter,
) -> DataFrame:
    """Rows per prompt that fit the output budget; never raised, never below 5.

    Uses the row at position int(0.9 n) of all rows by token count. Token counts
    are small whole numbers, so the table is reduced to one row per count first.
    """
    pieces = [
        F.concat(F.lit(f'"{c}": '), F.substring(F.to_json(F.array(v)), F.lit(2), F.length(F.to_json(F.array(v))) - 2))
        for c in df.columns
        for v in [F.coalesce(text_of(col(c), df.schema[c].dataType), F.lit("nan"))]
    ]
    tokens = counter(F.concat(F.lit("{"), F.concat_ws(", ", *pieces), F.lit("}")))
    counts = df.groupBy(tokens.alias("tokens")).agg(F.count(F.lit(1)).alias("m"))
    w = Window.orderBy("tokens").rowsBetween(Window.unboundedPreceding, 0)
    seen = counts.withColumn("upto", F.sum("m").over(w)).withColumn("rows", F.sum("m").over(Window.partitionBy()))
    at = F.floor(F.col("rows") * 0.9)
    p90 = seen.agg(F.min(F.when(F.col("upto") > at, F.col("tokens"))).alias("p90_tokens"))
    budget = max(output_tokens, OUTPUT_FLOOR_TOKENS)
    per_row = F.floor(F.col("p90_tokens") * ROW_SAFETY)
    fits = F.greatest(F.lit(MIN_ROWS_PER_PROMPT), F.floor(F.lit(budget) / per_row))
    return p90.select("p90_tokens", F.least(F.lit(rows_per_prompt), fits).cast("int").alias("rows_per_prompt"))


# ---- K10 --------------------------------------------------------------------
FIRST_DECODE_RATE = 0.30
OVERSHOOT = 1.5
MAX_EMPTY_ROUNDS = 5
MAX_RETRY_TOKENS = 131_072


def plan_next_round(
    n_rows: int, rows_so_far: int, prompts_so_far: int, rows_per_prompt: int, prompts_per_batch: int | None
) -> int:
    """Prompts for the next round: rows missing over observed rows per prompt, plus half; at most ``prompts_per_batch``, if given."""
    observed = rows_so_far / prompts_so_far if prompts_so_far and rows_so_far else rows_per_prompt * FIRST_DECODE_RATE
    wanted = math.ceil((n_rows - rows_so_far) / observed * OVERSHOOT) if observed > 0 else prompts_per_batch or 1
    return max(1, wanted if prompts_per_batch is None else min(prompts_per_batch, wanted))
