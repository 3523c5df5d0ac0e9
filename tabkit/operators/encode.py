"""Rows to text: sentences, compact codes, JSON objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.functions.columns import col, fixed, rank_key
from tabkit.operators.profile import FALSE_WORDS, TRUE_WORDS, DatasetProfile, column_abbreviations, text_of

FLOAT_DIGITS = 3
# Value-code maps up to this many entries are inlined; larger ones are joined.
INLINE_CODES = 1000


def to_bool(c: Column, strict: bool = True) -> Column:
    """Boolean meaning of a word; other text is an error, or null when not ``strict``."""
    word = F.lower(F.trim(c.cast("string")))
    known = F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))
    if not strict:
        return known
    problem = F.raise_error(F.concat(F.lit("not a boolean word: "), word)).cast("boolean")
    return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(known, problem))


def _bool_of(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType.simpleString()
    if dtype == "boolean":
        return col(name)
    if dtype == "string":
        return to_bool(col(name))
    return col(name).cast("double") != 0


def format_value(df: DataFrame, name: str, dtype: str, digits: int = FLOAT_DIGITS) -> Column:
    """A value as text, null as ``Missing``."""
    c = col(name)
    raw = text_of(c, df.schema[name].dataType)
    if dtype == "integer":
        text = c.cast("double").try_cast("bigint").cast("string")
        if df.schema[name].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
            text = c.cast("string")
    elif dtype == "float":
        text = fixed(c, digits)
    elif dtype == "boolean":
        text = F.when(_bool_of(df, name), "True").otherwise("False")
    elif dtype == "text":
        quoted = F.replace(raw, F.lit('"'), F.lit('""'))
        text = F.when(F.contains(raw, F.lit(",")), F.concat(F.lit('"'), quoted, F.lit('"'))).otherwise(quoted)
    else:
        text = raw
    return F.when(c.isNull(), "Missing").otherwise(text)


def json_piece(df: DataFrame, name: str, dtype: str, digits: int = FLOAT_DIGITS) -> Column:
    """``"name": value`` with a JSON value of the column's type."""
    c = col(name)
    if dtype == "integer":
        value = format_value(df, name, dtype)
    elif dtype == "float":
        value = fixed(c, digits, trim=True)
    elif dtype == "boolean":
        value = F.when(_bool_of(df, name), "true").otherwise("false")
    else:
        listed = F.to_json(F.array(text_of(c, df.schema[name].dataType)))
        value = F.substring(listed, F.lit(2), F.length(listed) - 2)
    label = F.lit(_json_text(name) + ": ")
    return F.concat(label, F.when(c.isNull(), "null").otherwise(value))


def _json_text(s: str) -> str:
    import json

    return json.dumps(s, ensure_ascii=False)


def permuted(items: Sequence[tuple[str, Column]], row_key: Column, seed: int, last: str | None = None) -> Column:
    """The pieces in a per-row order given by md5 of (seed, row key, column name)."""
    keyed = [F.struct(rank_key(seed, row_key, F.lit(n)).alias("k"), piece.alias("piece")) for n, piece in items if n != last]
    order = F.transform(F.array_sort(F.array(*keyed)), lambda e: e["piece"])
    tail = [piece for n, piece in items if n == last]
    return F.concat(order, F.array(*tail)) if tail else order


def _pieces(df: DataFrame, profile: DatasetProfile, mode: str, digits: int) -> list[tuple[str, Column]]:
    out = []
    for name, p in profile.columns.items():
        if mode == "json":
            out.append((name, json_piece(df, name, p.dtype, digits)))
        else:
            out.append((name, F.concat(F.lit(f"{name} is "), format_value(df, name, p.dtype, digits))))
    return out


def _ordered(
    pieces: list[tuple[str, Column]], target: str | None, permute: bool, row_key: Column | None, seed: int
) -> Column:
    if permute:
        if row_key is None:
            raise ValueError("permuted encoding needs row_key columns")
        return permuted(pieces, row_key, seed, target)
    tail = [p for n, p in pieces if n == target]
    return F.array(*[p for n, p in pieces if n != target], *tail)


def _key_column(row_key: Sequence[str] | None) -> Column | None:
    return F.concat_ws("|", *[col(k).cast("string") for k in row_key]) if row_key else None


def encode_sentence(
    df: DataFrame,
    profile: DatasetProfile,
    permute: bool = False,
    target_last: bool = False,
    row_key: Sequence[str] | None = None,
    seed: int = 42,
    digits: int = FLOAT_DIGITS,
    terminator: str = ".",
) -> Column:
    """``col is value, col is value.``"""
    target = profile.target_column if target_last else None
    pieces = _ordered(_pieces(df, profile, "sentence", digits), target, permute, _key_column(row_key), seed)
    return F.concat(F.array_join(pieces, ", "), F.lit(terminator))


def encode_target_last(df: DataFrame, profile: DatasetProfile, permute: bool = False, row_key=None, seed: int = 42, digits: int = FLOAT_DIGITS) -> Column:
    """Features first, target last, no terminator."""
    if not profile.target_column:
        raise ValueError("target-last encoding needs a target column in the profile")
    return encode_sentence(df, profile, permute, True, row_key, seed, digits, "")


def encode_label_query(df: DataFrame, profile: DatasetProfile, permute: bool = False, row_key=None, seed: int = 42, digits: int = FLOAT_DIGITS) -> Column:
    """The features, then ``target is`` left open."""
    target = profile.target_column
    if not target:
        raise ValueError("a label query needs a target column in the profile")
    features = [(n, p) for n, p in _pieces(df, profile, "sentence", digits) if n != target]
    body = _ordered(features, None, permute, _key_column(row_key), seed)
    return F.concat(F.array_join(F.concat(body, F.array(F.lit(f"{target} is"))), ", "))


def encode_json(
    df: DataFrame,
    profile: DatasetProfile,
    permute: bool = False,
    target_last: bool = False,
    row_key: Sequence[str] | None = None,
    seed: int = 42,
    digits: int = FLOAT_DIGITS,
) -> Column:
    """One JSON object per row, nulls kept."""
    target = profile.target_column if target_last else None
    pieces = _ordered(_pieces(df, profile, "json", digits), target, permute, _key_column(row_key), seed)
    return F.concat(F.lit("{"), F.array_join(pieces, ", "), F.lit("}"))


def encode_compact(
    df: DataFrame,
    profile: DatasetProfile,
    codes: DataFrame | None = None,
    digits: int = FLOAT_DIGITS,
    out: str = "text",
    use_codes: bool = True,
) -> DataFrame:
    """E5: ``A 39, E BAC`` with short column and value codes, ``M`` for null, fixed column order.

    ``codes`` is the table ``(column, value, code)``; without it the codes of
    the profile are used. Codes of a column with many values are joined (only
    that column's distinct values), the rest are looked up in a literal map.
    """
    names = column_abbreviations(profile.column_order)
    inline: dict[str, dict[str, str]] = {}
    joined: list[str] = []
    categorical = profile.names("categorical") if use_codes else []
    asked = categorical
    if codes is None:
        inline = {c: a for c in categorical if (a := profile.columns[c].abbreviations) and len(a) <= INLINE_CODES}
        asked = [c for c in categorical if c not in inline]
        codes = profile.codes
        if codes is None:
            entries = [(c, *kv) for c in asked for kv in (profile.columns[c].abbreviations or {}).items()]
            codes = df.sparkSession.createDataFrame(entries, "column string, value string, code string") if entries else None
    if codes is not None and asked:
        sizes = {r["column"]: r["count"] for r in codes.where(F.col("column").isin(*asked)).groupBy("column").count().collect()}
        small = [c for c in asked if 0 < sizes.get(c, 0) <= INLINE_CODES]
        joined = [c for c in asked if sizes.get(c, 0) > INLINE_CODES]
        if small:
            for r in codes.where(F.col("column").isin(*small)).collect():
                inline.setdefault(r["column"], {})[r["value"]] = r["code"]
    work = df
    for i, c in enumerate(joined):
        key, value = f"_value{i}", f"_code{i}"
        lookup = codes.where(F.col("column") == c).select(F.col("value").alias(key), F.col("code").alias(value))
        work = work.withColumn(key, text_of(col(c), df.schema[c].dataType)).join(lookup, key, "left")
    parts = []
    for name, p in profile.columns.items():
        raw = text_of(col(name), df.schema[name].dataType)
        if name in inline:
            entries = [F.lit(x) for kv in inline[name].items() for x in kv]
            value = F.coalesce(F.try_element_at(F.create_map(*entries), raw), F.substring(raw, 1, 3))
        elif name in joined:
            value = F.coalesce(F.col(f"_code{joined.index(name)}"), F.substring(raw, 1, 3))
        else:
            value = format_value(df, name, p.dtype, digits)
        label = names[name] if use_codes else name
        parts.append(F.concat(F.lit(label + " "), F.when(col(name).isNull(), "M").otherwise(value)))
    return work.select(*[col(c) for c in df.columns], F.array_join(F.array(*parts), ", ").alias(out))


MODES = ("fast", "flexible", "predictive", "json")


def encode(df: DataFrame, profile: DatasetProfile, mode: str = "json", out: str = "text", **options) -> DataFrame:
    """Add the encoded row as column ``out``."""
    if mode == "fast":
        return encode_compact(df, profile, out=out, **options)
    if mode == "flexible":
        return df.withColumn(out, encode_sentence(df, profile, **options))
    if mode == "predictive":
        return df.withColumn(out, encode_target_last(df, profile, **options))
    if mode == "json":
        return df.withColumn(out, encode_json(df, profile, **options))
    raise ValueError(f"unknown mode {mode!r}; choose from {MODES}")
