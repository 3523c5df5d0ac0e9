"""Dataset inspection: size, missing values, column details, target analysis."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.functions.columns import NUMERIC_TYPES, as_double, col, numeric_columns
from tabkit.functions.quantiles import quantiles
from tabkit.operators.profile import column_facts, date_of_any, pair_correlations, ranked, value_counts

# ---- Fixed values -----------------------------------------------------------
LISTED_VALUES = 15
TOP_VALUES = 10
NOTABLE_CORRELATION = 0.5
CLASS_LIMIT = 20
IMBALANCE = 0.8
# -----------------------------------------------------------------------------


def sdtype(dtype: T.DataType) -> str:
    return "numerical" if isinstance(dtype, NUMERIC_TYPES) else "categorical"


def describe_metadata(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table, column, sdtype)`` from the schemas alone."""
    rows = [(t, f.name, sdtype(f.dataType)) for t, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "table string, column string, sdtype string")


def skewness(x: Column) -> Column:
    """Bias-corrected skewness; null below three values, 0 for a constant."""
    n = F.count(x).cast("double")
    corrected = F.skewness(x) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    return F.when(n < 3, F.lit(None).cast("double")).when(F.stddev_samp(x) == 0, F.lit(0.0)).otherwise(corrected)


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, duplicate rows, missing cells."""
    names = [col(c) for c in df.columns]
    missing = sum((c.isNull().cast("bigint") for c in names), F.lit(0).cast("bigint"))
    # One aggregate: equal rows are counted together, then the groups are added up.
    groups = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_m")).select(F.col("_m"), (missing * F.col("_m")).alias("_missing"))
    total = groups.agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("_kinds"), F.coalesce(F.sum("_missing"), F.lit(0)).alias("missing_cells"))
    pct = F.round(F.try_divide(F.col("missing_cells") * 100.0, F.col("rows") * len(names)), 2)
    return total.select(
        "rows", F.lit(len(names)).alias("columns"), (F.col("rows") - F.col("_kinds")).alias("duplicate_rows"), "missing_cells", pct.alias("missing_percent")
    )


def column_report(df: DataFrame, exact: bool = True) -> DataFrame:
    """Storage type, sdtype, distinct values, missing values; range of time columns."""
    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, sdtype(f.dataType))])
    missing_rate = F.try_divide(F.col("rows") - F.col("non_null"), F.col("rows"))
    return column_facts(df, exact=exact).select(
        "column",
        F.col("original_dtype").alias("dtype"),
        F.try_element_at(types, F.col("column")).alias("sdtype"),
        "unique_count",
        (F.col("rows") - F.col("non_null")).alias("missing_count"),
        F.round(missing_rate * 100, 2).alias("missing_percent"),
        F.col("min_ts").alias("min_date"),
        F.col("max_ts").alias("max_date"),
    )


def date_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """First and last date of columns that hold dates, also as text."""
    aggs, rows = [], []
    for i, c in enumerate(columns):
        t = date_of_any(df, c)
        aggs += [F.min(t).cast("string").alias(f"lo{i}"), F.max(t).cast("string").alias(f"hi{i}")]
        rows.append(F.struct(F.lit(c).alias("column"), F.col(f"lo{i}").alias("min_date"), F.col(f"hi{i}").alias("max_date")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def numeric_detail(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """Mean, std, min, quartiles, max and skewness, rounded."""
    names = list(columns or numeric_columns(df))
    aggs, rows = [], []
    for i, c in enumerate(names):
        x = as_double(df, c)
        stats = {"mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x), "skew": skewness(x)}
        aggs += [v.alias(f"{k}_{i}") for k, v in stats.items()]
        rows.append(F.struct(F.lit(c).alias("column"), *[F.round(F.col(f"{k}_{i}"), digits).alias(k) for k in stats]))
    basic = df.agg(*aggs).select(F.inline(F.array(*rows)))
    q = quantiles(df, names, [0.25, 0.5, 0.75])
    quart = q.select("column", *[F.round(F.col("q")[i], digits).alias(n) for i, n in enumerate(("q25", "q50", "q75"))])
    return basic.join(quart, "column").select("column", "mean", "std", "min", "q25", "q50", "q75", "max", "skew")


def value_detail(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """I4: all counts of a column with at most 15 values, else its top 10, with shares."""
    counts = value_counts(df, columns)
    totals = counts.groupBy("column").agg(F.sum("n").alias("_total"), F.count(F.lit(1)).alias("unique_count"))
    limit = F.when(F.col("unique_count") <= LISTED_VALUES, LISTED_VALUES).otherwise(TOP_VALUES)
    top = ranked(counts, LISTED_VALUES).join(totals, "column").where(F.col("rank") <= limit)
    return top.select("column", "value", "n", F.round(F.col("n") / F.col("_total"), 4).alias("share"), "rank", "unique_count")


def sample_values(df: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    """I4: a few distinct values per column, in value order."""
    flat = value_counts(df, columns).withColumn("n", F.lit(0).cast("bigint"))
    return ranked(flat, n).select("column", F.col("rank").alias("example_no"), "value")


def type_summary(df: DataFrame) -> DataFrame:
    """Number of columns per sdtype."""
    return describe_metadata(df.sparkSession, {"": df}).groupBy("sdtype").agg(F.count(F.lit(1)).alias("columns"))


def notable_correlations(df: DataFrame, limit: float = NOTABLE_CORRELATION, columns: Sequence[str] | None = None) -> DataFrame:
    """Column pairs with |r| above ``limit``."""
    pairs = pair_correlations(df, list(columns or numeric_columns(df)))
    return pairs.where(F.abs("r") > limit).select("col_a", "col_b", F.round("r", 4).alias("correlation"))


def target_classes(df: DataFrame, target: str) -> DataFrame:
    """I8: class shares, number of classes, and whether one class dominates."""
    counts = value_counts(df, [target])
    t = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"), F.max("n").alias("top")).first()
    rows = t["rows"] or 0
    return counts.select(
        F.col("column").alias("target"),
        F.col("value").alias("class"),
        F.round(F.col("n") / F.lit(max(rows, 1)), 4).alias("share"),
        F.lit(t["classes"]).cast("bigint").alias("n_classes"),
        F.lit((t["top"] or 0) > IMBALANCE * rows).alias("imbalanced"),
    )


def target_regression(df: DataFrame, target: str, digits: int = 4) -> DataFrame:
    """I8: statistics of a numeric target."""
    x = as_double(df, target)
    stats = {"mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x), "skew": skewness(x)}
    return df.agg(*[v.alias(k) for k, v in stats.items()]).select(F.lit(target).alias("target"), *[F.round(k, digits).alias(k) for k in stats])


def target_report(df: DataFrame, target: str) -> tuple[str, DataFrame]:
    """I8: the suggested task and its report; up to 20 distinct values mean classification."""
    few = df.select(col(target).alias("v")).where("v is not null").distinct().limit(CLASS_LIMIT + 1).count() <= CLASS_LIMIT
    if few or sdtype(df.schema[target].dataType) == "categorical":
        return "classification", target_classes(df, target)
    return "regression", target_regression(df, target)
