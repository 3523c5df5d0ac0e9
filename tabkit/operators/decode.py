"""Completions to typed rows: split, parse, repair, check, assemble.

Everything up to the category repair is column expressions in one stage; values
are parsed by built-in functions, never by Python per row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.functions.columns import col, to_number
from tabkit.functions.ordered import running_sums
from tabkit.operators.profile import DATE_FORMATS, TRUE_WORDS, DatasetProfile, any_date, parse_date
from tabkit.session import materialize

# ---- Fixed values -----------------------------------------------------------
MISSING_WORDS = ("missing", "nan", "null", "none")
THINKING_PATTERN = r"(?s)<think>.*?</think>"
NUMBERED_LINE = r"^\s*\d+\."
NUMBERING = r"^(\d+\.\s*)+"
ONE_NUMBERING = r"^\d+\.\s*"
FENCE_START = r"^```(?:json)?\s*"
FENCE_END = r"\s*```$"
MAX_TRIES = 3
RETRY_BASE_SECONDS = 1.0
# -----------------------------------------------------------------------------

# A line from its first brace on; the parser reads one object of any depth and stops.
OBJECT_PATTERN = r"^[^{]*(\{.*)"

# Domains up to this many values are searched in place; larger ones are joined on substrings.
INLINE_REPAIR = 200


# ---- D1 ---------------------------------------------------------------------
def complete(
    prompts: DataFrame,
    fn: Callable[[list[str]], list[str]],
    batch_size: int = 32,
    max_tries: int = MAX_TRIES,
    wait_seconds: float = RETRY_BASE_SECONDS,
    max_concurrency: int | None = None,
    keep: bool = True,
) -> DataFrame:
    """Run ``fn`` (a batch of prompts to a batch of texts) over the prompts table.

    A failing batch is retried with doubling waits, then its prompts one by one;
    a prompt that still fails has empty text and its error. The result is
    written to the shared checkpoint folder: a model's answers are not
    repeatable, so they must not be recomputed. ``keep=False`` leaves the writing to the caller.
    """
    others = [c for c in prompts.columns if c not in ("prompt_id", "prompt")]
    schema = T.StructType(
        [
            T.StructField("prompt_id", T.LongType()),
            *[prompts.schema[c] for c in others],
            T.StructField("text", T.StringType()),
            T.StructField("error", T.StringType()),
        ]
    )

    def attempt(batch: list[str]) -> list[str]:
        import time

        for n in range(max_tries):
            try:
                texts = list(fn(batch))
                if len(texts) != len(batch):
                    raise ValueError(f"{len(batch)} prompts but {len(texts)} texts")
                return texts
            except Exception:
                if n + 1 == max_tries:
                    raise
                time.sleep(wait_seconds * 2**n)
        return []

    def run(frames: Iterator) -> Iterator:
        for pdf in frames:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start : start + batch_size]
                batch = part["prompt"].tolist()
                try:
                    texts, errors = attempt(batch), [None] * len(batch)
                except Exception:
                    texts, errors = [], []
                    for prompt in batch:
                        try:
                            texts.append(attempt([prompt])[0])
                            errors.append(None)
                        except Exception as problem:
                            texts.append("")
                            errors.append(str(problem))
                done = part[["prompt_id", *others]].assign(text=[t or "" for t in texts], error=errors)
                yield done[["prompt_id", *others, "text", "error"]]

    if max_concurrency is not None:
        prompts = prompts.repartition(max_concurrency, "prompt_id")
    answers = prompts.select("prompt_id", *[col(c) for c in others], "prompt").mapInPandas(run, schema)
    return materialize(answers, "completions") if keep else answers


# ---- D2, D3 -----------------------------------------------------------------
def strip_thinking(text: Column) -> Column:
    """Remove reasoning blocks, then trim."""
    return trim(F.regexp_replace(text, THINKING_PATTERN, ""))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def split_rows(completions: DataFrame, text: str = "text") -> DataFrame:
    """D3: one row per numbered line if there are several, else the whole text."""
    whole = trim(col(text))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(NUMBERED_LINE))
    rows = F.when(F.size(lines) > 1, lines).otherwise(F.array(col(text)))
    keep = [col(c) for c in completions.columns if c != text]
    return completions.select(*keep, F.posexplode(rows).alias("row_idx", "row_text"))


# ---- D4 ---------------------------------------------------------------------
def clauses(text: Column, columns: Sequence[str]) -> Column:
    """``array<struct<name, value>>`` of the ``name is value`` parts of a sentence."""
    names = "|".join(re.escape(c).replace(r"\ ", " ") for c in sorted(columns, key=len, reverse=True))
    body = F.regexp_replace(F.regexp_replace(trim(text), NUMBERING, ""), r"\.+$", "")
    parts = F.split(body, rf"(?i),\s*(?=(?:{names})\s+is\s)")
    clause = r"(?i)^\s*(.+?)\s+is\s+(.+)"
    return F.transform(
        parts,
        lambda p: F.struct(
            F.lower(trim(F.regexp_extract(p, clause, 1))).alias("name"),
            trim(F.regexp_extract(p, clause, 2)).alias("value"),
        ),
    )


def decode_sentence(rows: DataFrame, profile: DatasetProfile, text: str = "row_text") -> DataFrame:
    """Raw text value per column; the last usable clause of a column wins."""
    keep = [col(c) for c in rows.columns if c != text]
    parsed = rows.select(*keep, clauses(col(text), profile.column_order).alias("_clauses"))
    values = [_last_value(name, p.dtype).alias(name) for name, p in profile.columns.items()]
    return parsed.select(*keep, *values)


def _last_value(name: str, dtype: str) -> Column:
    def fits(e: Column) -> Column:
        return (e["name"] == name.lower()) & (F.length(e["value"]) > 0) & _usable(e["value"], dtype)

    return F.try_element_at(F.filter(F.col("_clauses"), fits), F.lit(-1))["value"]


def _usable(value: Column, dtype: str) -> Column:
    present = ~F.lower(value).isin(*MISSING_WORDS)
    if dtype in ("integer", "float"):
        return present & F.coalesce(to_number(value).isNotNull(), F.lit(False))
    if dtype == "datetime":
        return present & date_of(value).isNotNull()
    return present


# ---- D5..D7 -----------------------------------------------------------------
_JSON_OPTIONS = {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"}


def _parse_object(text: Column, columns: Sequence[str]) -> Column:
    """One JSON object as ``struct<every column string>``; null unless valid."""
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in columns], T.StructField("_bad", T.StringType())])
    parsed = F.from_json(text, schema, _JSON_OPTIONS)
    is_object = text.rlike(r"^\s*\{") & parsed["_bad"].isNull()
    return F.when(is_object, parsed)


def _object_rows(exploded: DataFrame, keep: list[Column], columns: Sequence[str]) -> DataFrame:
    parsed = exploded.select(*keep, _parse_object(F.col("_object"), columns).alias("_row")).where("_row is not null")
    return parsed.select(*keep, *[F.col("_row").getField(c).alias(c) for c in columns])


def decode_json(completions: DataFrame, profile: DatasetProfile, text: str = "text") -> DataFrame:
    """All JSON objects of each completion as raw text values, with ``row_idx``.

    A text that is a JSON array gives its objects. Any other text is read line
    by line: numbering dropped, the first ``{...}`` taken, invalid ones skipped.
    """
    whole = trim(col(text))
    elements = F.when(whole.startswith("[") & whole.endswith("]"), F.from_json(whole, "array<string>", {"allowSingleQuotes": "false"}))
    lines = F.transform(
        F.split(whole, "\n"), lambda line: F.regexp_extract(F.regexp_replace(trim(line), ONE_NUMBERING, ""), OBJECT_PATTERN, 1)
    )
    objects = F.filter(F.coalesce(elements, lines), lambda o: F.length(o) > 0)
    keep = [col(c) for c in completions.columns if c != text]
    exploded = completions.select(*keep, F.posexplode(objects).alias("row_idx", "_object"))
    return _object_rows(exploded, [*keep, F.col("row_idx")], profile.column_order)


def decode_json_single(completions: DataFrame, profile: DatasetProfile, text: str = "text") -> DataFrame:
    """Exactly one object per text, numbering and code fences stripped; ``valid`` is false for anything else."""
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(trim(col(text)), ONE_NUMBERING, ""), FENCE_START, ""), FENCE_END, "")
    keep = [col(c) for c in completions.columns if c != text]
    plain = F.regexp_replace(body, r":\s*(NaN|-?Infinity)\b", ": null")
    alone = F.json_array_length(F.concat(F.lit("["), plain, F.lit("]"))) == 1  # nothing follows the object
    parsed = completions.select(*keep, F.when(alone, _parse_object(body, profile.column_order)).alias("_row"))
    return parsed.select(*keep, F.col("_row").isNotNull().alias("valid"), *[F.col("_row").getField(c).alias(c) for c in profile.column_order])


# ---- D8, D9 -----------------------------------------------------------------
def parse_value(value: Column, dtype: str, date_format: str | None = None, strict_boolean: bool = False) -> Column:
    """Raw text to a typed value; missing words and failures are null.

    Text that is not one of the true words is false, unless ``strict_boolean``.
    """
    present = F.when(~F.lower(value).isin(*MISSING_WORDS), value)
    if dtype == "integer":
        return to_number(present).try_cast("bigint")
    if dtype == "float":
        return to_number(present)
    if dtype == "boolean":
        truth = F.lower(present).isin(*TRUE_WORDS)
        if strict_boolean:
            from tabkit.operators.encode import to_bool

            return to_bool(present, strict=False)
        return F.when(present.isNotNull(), truth)
    if dtype == "datetime":
        return render_date(date_of(F.trim(present), date_format), date_format)
    if dtype == "categorical":
        return F.when(F.length(present) > 0, present)
    return present


def date_of(value: Column, date_format: str | None = None) -> Column:
    """Eight digits first, then the column's own format, then every known format."""
    eight = parse_date(value, "%Y%m%d")
    own = [parse_date(value, date_format, True)] if date_format else []
    return F.coalesce(eight, *own, any_date(value))


def render_date(ts: Column, date_format: str | None) -> Column:
    printed = {label: pattern for label, _, pattern, _ in DATE_FORMATS}
    return F.date_format(ts, printed[date_format]) if date_format else ts.cast("timestamp_ntz")


# ---- D10 --------------------------------------------------------------------
def repair_category(rows: DataFrame, profile: DatasetProfile, columns: Sequence[str] | None = None) -> DataFrame:
    """Bring categorical values into their domain.

    A value outside the domain becomes the most frequent category that contains
    it or is contained in it (ignoring case), else the most frequent category.
    """
    names = list(columns if columns is not None else profile.names("categorical"))
    small = {n: profile.columns[n].domain for n in names if profile.columns[n].domain and len(profile.columns[n].domain) <= INLINE_REPAIR}
    out = rows.withColumns({n: _repair_inline(col(n), [v for v, _ in d]) for n, d in small.items()}) if small else rows
    for n in names:
        if n in small:
            continue
        if profile.columns[n].domain:
            entries = [(v, c) for v, c in profile.columns[n].domain]
            domain = rows.sparkSession.createDataFrame(entries, "value string, n bigint")
        elif profile.columns[n].domain is None and profile.domains is not None:
            domain = profile.domains.where(F.col("column") == n).select("value", "n")
        else:
            continue
        out = repair_by_join(out, n, domain)
    return out


def _repair_inline(c: Column, domain: Sequence[str]) -> Column:
    low = F.lower(c)
    domain = [v for v in domain if v != ""]  # an empty category is part of every text; the join knows it as little
    if not domain:
        return c
    listed = F.array(*[F.lit(v) for v in domain])
    close = F.filter(listed, lambda d: F.contains(F.lower(d), low) | F.contains(low, F.lower(d)))
    fixed = F.coalesce(F.try_element_at(close, F.lit(1)), F.lit(domain[0]))
    return F.when(c.isNull() | c.isin(*domain), c).otherwise(fixed)


def repair_by_join(rows: DataFrame, name: str, domain: DataFrame) -> DataFrame:
    """Repair against a large domain ``(value, n)`` with equi-joins only; the distinct unknown values are searched, once each."""
    domain = domain.where("value <> ''")
    order = F.struct((-F.col("n")).alias("less_often"), F.col("value"))
    top = domain.agg(F.min(order)["value"]).first()[0]
    if top is None:
        return rows
    seen = rows.select(col(name).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("_m"))
    unknown = seen.join(domain.select("value"), "value", "left_anti").select(F.lower("value").alias("text"), F.col("value").alias("miss"))
    unknown = materialize(unknown.withColumn("id", F.monotonically_increasing_id()), "unknown-values")
    # Categories that differ only in case are one text, which stands for the best of them.
    listed = domain.groupBy(F.lower("value").alias("text")).agg(F.min(order).alias("category"))
    listed = materialize(listed.withColumn("id", F.monotonically_increasing_id()), "category-texts")
    around = containments(unknown.where("text <> ''"), listed).select(F.col("inner_id").alias("miss_id"), F.col("outer_id").alias("category_id"))
    within = containments(listed, unknown).select(F.col("outer_id").alias("miss_id"), F.col("inner_id").alias("category_id"))
    found = around.unionByName(within).join(listed.select(F.col("id").alias("category_id"), "category"), "category_id")
    close = found.groupBy("miss_id").agg(F.min("category")["value"].alias("_close"))
    fixes = unknown.join(close, F.col("id") == F.col("miss_id"), "left").select(F.col("miss").alias("_miss"), F.coalesce("_close", F.lit(top)).alias("_fix"))
    fixes = materialize(fixes, "repairs")
    joined = rows.join(fixes, col(name) == F.col("_miss"), "left").withColumn(name, F.coalesce("_fix", col(name)))
    return joined.select(*[col(c) for c in rows.columns])


GRAM = 3


def containments(inner: DataFrame, outer: DataFrame, gram: int = GRAM) -> DataFrame:
    """``(inner_id, outer_id)`` where the inner ``text`` is part of the outer one; both sides are ``(id, text)``, no text is empty.

    An inverted index of the outer texts' grams (``gram`` characters; whole inner texts that are shorter). All grams of an inner text must
    occur there, else no outer text can hold it; its rarest one fetches the candidates. Those at least as long are verified on the
    texts. The index grows with the length of a text, not with its square, and holds numbers instead of texts.
    """
    size = F.least(F.length("text"), F.lit(gram))
    inner = inner.select("id", "text", size.alias("size"))
    sizes = sorted(r[0] for r in inner.select("size").distinct().collect())  # at most `gram` numbers
    inner_grams = _union_of([_grams(inner.where(F.col("size") == k), k) for k in sizes])
    outer_grams = _union_of([_grams(outer.select("id", "text").where(F.length("text") >= k), k) for k in sizes])
    if inner_grams is None or outer_grams is None:
        return inner.where("false").select(F.col("id").alias("inner_id"), F.col("id").alias("outer_id"))
    outer_grams = materialize(outer_grams, "gram-index")
    held = outer_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    known = inner_grams.join(held, "gram", "left").groupBy("id").agg(F.bool_and(F.col("texts").isNotNull()).alias("all"), F.min(F.struct("texts", "gram"))["gram"].alias("gram"), F.max("length").alias("inner_length"))
    rarest = known.where("all").select(F.col("id").alias("inner_id"), "gram", "inner_length")
    pairs = rarest.join(outer_grams.withColumnRenamed("id", "outer_id"), "gram").where(F.col("inner_length") <= F.col("length")).select("inner_id", "outer_id")
    texts = lambda df, side: df.select(F.col("id").alias(f"{side}_id"), F.col("text").alias(f"{side}_text"))
    met = pairs.join(texts(inner, "inner"), "inner_id").join(texts(outer, "outer"), "outer_id")
    return met.where(F.contains("outer_text", F.col("inner_text"))).select("inner_id", "outer_id")


def _grams(texts: DataFrame, size: int) -> DataFrame:
    """``(id, length, gram)``: the distinct runs of ``size`` characters of each text."""
    letters = texts.select("id", F.length("text").alias("length"), F.split("text", "").alias("letters"))
    letters = letters.where(F.size("letters") >= size)
    every = F.transform(F.sequence(F.lit(0), F.size("letters") - size), lambda at: F.concat(*[F.col("letters")[at + k] for k in range(size)]))
    return letters.select("id", "length", F.explode(F.array_distinct(every)).alias("gram"))


def _union_of(parts: Sequence[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


# ---- D11..D16 ---------------------------------------------------------------
def restore_labels(c: Column, true_label: str | None, false_label: str | None) -> Column:
    """Booleans back to the labels of the real table."""
    return F.when(c, F.lit(true_label or "True")).when(~c, F.lit(false_label or "False"))


def apply_types(rows: DataFrame, profile: DatasetProfile, strict_boolean: bool = False) -> DataFrame:
    """Parse every raw column to its type."""
    typed = {}
    for n, p in profile.columns.items():
        value = parse_value(col(n), p.dtype, p.date_format, strict_boolean)
        typed[n] = restore_labels(value, p.true_label, p.false_label) if p.dtype == "boolean" else value
    return rows.withColumns(typed)


def drop_incomplete(rows: DataFrame, profile: DatasetProfile) -> DataFrame:
    """Drop rows with a null where the real table has none."""
    required = [n for n, p in profile.columns.items() if not (p.missing_rate or 0) > 0]
    condition = F.lit(True)
    for n in required:
        condition = condition & col(n).isNotNull()
    return rows.where(condition)


def cap_per_prompt(rows: DataFrame, rows_per_prompt: int, keys: Sequence[str] = ("prompt_id",)) -> DataFrame:
    """The first ``rows_per_prompt`` rows of each completion."""
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy("row_idx")
    return rows.withColumn("_no", F.row_number().over(w)).where(F.col("_no") <= rows_per_prompt).drop("_no")


def assemble(rounds: Sequence[DataFrame], n_rows: int) -> DataFrame:
    """The first ``n_rows`` rows of all rounds, in order of round, prompt and row."""
    out = None
    for i, r in enumerate(rounds):
        r = r if "round" in r.columns else r.withColumn("round", F.lit(i))
        out = r if out is None else out.unionByName(r)
    return first_rows(out, n_rows)


def first_rows(df: DataFrame, n_rows: int, order: Sequence[str] = ("round", "prompt_id", "row_idx"), top_n: int = 1_000_000) -> DataFrame:
    """The first ``n_rows`` in ``order``; large ones by per-prompt counts instead of one sorted run."""
    if n_rows <= top_n:
        return df.orderBy(*order).limit(n_rows)
    group = list(order[:-1])
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_m")).withColumn("_upto", F.col("_m"))
    offsets = running_sums(counts, [], group, ["_upto"]).withColumn("_skip", F.col("_upto") - F.col("_m"))
    offsets = offsets.where(F.col("_skip") < n_rows).select(*group, "_skip")
    inner = Window.partitionBy(*group).orderBy(order[-1])
    placed = df.join(offsets, group).withColumn("_no", F.row_number().over(inner) + F.col("_skip"))
    return placed.where(F.col("_no") <= n_rows).select(*[col(c) for c in df.columns])


def decode_stats(completions: DataFrame, decoded: DataFrame, rows_per_prompt: int, by: Sequence[str] = ("round",)) -> DataFrame:
    """Texts, empty texts, errors, rows and decode rate per round."""
    keys = [col(b) for b in by]
    empty = F.coalesce(F.length("text") == 0, F.lit(True))
    texts = completions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(empty).alias("empty_texts"), F.count("error").alias("errors")
    )
    rows = decoded.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    joined = texts.join(rows, list(by), "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    rate = F.try_divide(F.col("rows").cast("double"), (F.col("texts") - F.col("empty_texts")) * rows_per_prompt)
    return joined.withColumn("decode_rate", F.coalesce(rate, F.lit(0.0)))


def _read_once(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same rows. Conditions on the typed columns stay above the generator, else Spark carries them below the parsing and parses each text
    again for every use of every column."""
    keep = [col(c) for c in raw.columns if c not in columns]
    return raw.select(*keep, F.inline(F.array(F.struct(*[col(c) for c in columns]))))


def decode(
    completions: DataFrame,
    profile: DatasetProfile,
    mode: str = "json",
    text: str = "text",
    repair: bool = True,
    strict_boolean: bool = False,
) -> DataFrame:
    """Completions to typed, repaired, complete rows (``row_idx`` counts within a completion)."""
    clean = completions.withColumn(text, strip_thinking(col(text))).where(F.length(col(text)) > 0)
    if mode == "json":
        raw = decode_json(clean, profile, text)
    elif mode == "flexible":
        raw = decode_sentence(split_rows(clean, text), profile)
    else:
        raise ValueError(f"unsupported mode {mode!r}; choose 'json' or 'flexible'")
    typed = apply_types(_read_once(raw, profile.column_order), profile, strict_boolean)
    if repair:
        typed = repair_category(typed, profile)
    return drop_incomplete(typed, profile)
