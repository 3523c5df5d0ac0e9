"""Column helpers shared by every operator: quoting, hashing, number parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: text accepted as a decimal number. Keeps "nan", "Infinity",
# "1.0d" and "1_000" out, which a plain cast would treat differently.
NUMERIC_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType)


def col(name: str) -> Column:
    """Reference a column whose name may hold dots, spaces or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def rank_key(seed: int | str, *parts: Column | str) -> Column:
    """Repeatable pseudo-random order: md5 of the seed and the row's key."""
    cols = [(col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *cols))


def hash_number(digest: Column) -> Column:
    """First 60 bits of an md5 hex digest as a non-negative bigint."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def to_number(c: Column) -> Column:
    """Text to double; anything that is not a plain decimal number is null."""
    return F.when(c.rlike(NUMERIC_PATTERN), F.trim(c).try_cast("double"))


def as_double(df: DataFrame, name: str) -> Column:
    """A column as double, whether stored as a number or as text."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, NUMERIC_TYPES):
        return col(name).cast("double")
    return to_number(col(name).cast("string"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null once, so no aggregate has to deal with it."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({n: F.nanvl(col(n), F.lit(None).cast(df.schema[n].dataType)) for n in floats}) if floats else df


def fixed(c: Column, digits: int, trim: bool = False) -> Column:
    """Fixed-point text, rounding the exact binary value half to even.

    ``trim`` drops trailing zeros but keeps one decimal (``23.0``, ``0.05``).
    """
    if digits == 0:
        pattern = "0"
    elif trim:
        pattern = "0.0" + "#" * (digits - 1)
    else:
        pattern = "0." + "0" * digits
    return F.call_function("format_number", c.cast("double"), F.lit(pattern))


def reject_nested(df: DataFrame, columns: Sequence[str] | None = None) -> None:
    names = columns if columns is not None else df.columns
    bad = [n for n in names if isinstance(df.schema[n].dataType, NESTED_TYPES)]
    if bad:
        raise TypeError(f"columns {bad} are nested and have no semantic type; drop them or use to_json first")


def chunked(items: Sequence, size: int = 100) -> list:
    return [items[i : i + size] for i in range(0, len(items), size)]


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join on columns of equal name in which null meets null."""
    named = right.select(*[col(k).alias(f"_r_{k}") for k in keys], *[col(c) for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & col(k).eqNullSafe(col(f"_r_{k}"))
    return left.join(named, same, how).drop(*[f"_r_{k}" for k in keys])
