"""Real against synthetic: statistics of several datasets side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.functions.columns import NUMERIC_TYPES, as_double, col
from tabkit.functions.quantiles import quantiles
from tabkit.operators.profile import correlation_matrix, ranked, text_of, value_counts
from tabkit.session import materialize

# ---- Fixed values -----------------------------------------------------------
STATISTICS = ("mean", "std", "min", "max", "median")
HISTOGRAM_BINS = 30
WHISKER = 1.5
# -----------------------------------------------------------------------------


def common_columns(datasets: Mapping[str, DataFrame]) -> tuple[list[str], list[str]]:
    """Columns all datasets have, as (numeric everywhere, the others)."""
    frames = list(datasets.values())
    shared = [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]
    numeric = [c for c in shared if all(isinstance(f.schema[c].dataType, NUMERIC_TYPES) for f in frames)]
    return numeric, [c for c in shared if c not in numeric]


def union_datasets(datasets: Mapping[str, DataFrame]) -> tuple[DataFrame, list[str], list[str]]:
    """All datasets as one table with a ``dataset`` column, and the common columns by kind."""
    numeric, other = common_columns(datasets)
    out = None
    for name, df in datasets.items():
        cols = [as_double(df, c).alias(c) for c in numeric]
        cols += [text_of(col(c), df.schema[c].dataType).alias(c) for c in other]
        part = df.select(F.lit(name).alias("dataset"), *cols)
        out = part if out is None else out.unionByName(part)
    return out, numeric, other


def _per_column(df: DataFrame, columns: Sequence[str], stats, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """One aggregate over all columns, turned into one row per column."""
    keys = [col(b) for b in by]
    aggs, rows = [], []
    for i, c in enumerate(columns):
        values: dict[str, Column] = stats(as_double(df, c))
        aggs += [v.alias(f"{k}_{i}") for k, v in values.items()]
        rows.append(F.struct(F.lit(c).alias("column"), *[F.col(f"{k}_{i}").alias(k) for k in values]))
    return df.groupBy(*keys).agg(*aggs).select(*keys, F.inline(F.array(*rows)))


def numeric_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, std, min, max and median per dataset and column."""
    basic = _per_column(df, columns, lambda x: {"mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x)})
    median = quantiles(df, columns, [0.5], ["dataset"]).select("dataset", "column", F.col("q")[0].alias("median"))
    return basic.join(median, ["dataset", "column"])


def normalise_by_max(stats: DataFrame, names: Sequence[str], keys: Sequence[str] = ("column",)) -> DataFrame:
    """Each statistic divided by its maximum over the datasets; 0 where that is 0."""
    w = Window.partitionBy(*[col(k) for k in keys])
    scaled = {n: F.when(F.max(n).over(w) == 0, F.lit(0.0)).otherwise(F.try_divide(F.col(n).cast("double"), F.max(n).over(w))) for n in names}
    return stats.withColumns(scaled)


def categorical_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """C4: distinct values, most frequent value, its count and its percentage of all rows."""
    counts = value_counts(df, columns, ["dataset"])
    distinct = counts.groupBy("dataset", "column").agg(F.count(F.lit(1)).alias("unique_count"))
    rows = df.groupBy("dataset").agg(F.count(F.lit(1)).alias("_rows"))
    top = ranked(counts, 1, ["dataset", "column"]).select("dataset", "column", F.col("value").alias("most_frequent"), F.col("n").alias("frequency"))
    joined = distinct.join(top, ["dataset", "column"]).join(rows, "dataset")
    return joined.withColumn("percentage", F.col("frequency") * 100.0 / F.col("_rows")).drop("_rows")


def _percent_off(value: Column, reference: Column) -> Column:
    return F.when(reference == 0, F.lit(0.0)).otherwise(F.abs(value - reference) / reference * 100)


def summary(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], reference: str) -> DataFrame:
    """mean/std or distinct/mode per dataset with the difference to the reference in percent."""
    parts = []
    if numeric:
        stats = _per_column(df, numeric, lambda x: {"mean": F.avg(x), "std": F.stddev_samp(x)})
        ref = stats.where(F.col("dataset") == reference).select("column", F.col("mean").alias("_mean"), F.col("std").alias("_std"))
        parts.append(
            stats.join(ref, "column").select(
                "column", F.lit("numerical").alias("type"), "dataset", "mean", "std",
                _percent_off(F.col("mean"), F.col("_mean")).alias("mean_diff_percent"),
                _percent_off(F.col("std"), F.col("_std")).alias("std_diff_percent"),
                F.lit(None).cast("bigint").alias("unique_count"),
                F.lit(None).cast("string").alias("mode"),
                F.lit(None).cast("double").alias("unique_diff_percent"),
            )
        )
    if categorical:
        cats = categorical_stats(df, categorical)
        ref = cats.where(F.col("dataset") == reference).select("column", F.col("unique_count").alias("_unique"))
        null = F.lit(None).cast("double")
        parts.append(
            cats.join(ref, "column").select(
                "column", F.lit("categorical").alias("type"), "dataset", null.alias("mean"), null.alias("std"),
                null.alias("mean_diff_percent"), null.alias("std_diff_percent"), "unique_count", F.col("most_frequent").alias("mode"),
                _percent_off(F.col("unique_count"), F.col("_unique")).alias("unique_diff_percent"),
            )
        )
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def bin_of(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin of a value, by comparison with the edges; the last bin is closed."""
    step = (hi - lo) / bins
    guess = F.least(F.floor((x - lo) * (F.lit(float(bins)) / (hi - lo))), F.lit(bins - 1))
    below = x < lo + guess * step
    above = (guess < bins - 1) & (x >= lo + (guess + 1) * step)
    return (guess - below.cast("int") + above.cast("int")).cast("int")


def column_ranges(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Histogram range per column; a constant column spans half a unit either way."""
    ranges = _per_column(df, columns, lambda x: {"lo": F.min(x), "hi": F.max(x), "rows": F.count(x)}, by).where(F.col("rows") > 0)
    flat = F.col("lo") == F.col("hi")
    half = F.when(flat, F.lit(0.5)).otherwise(F.lit(0.0))
    return ranges.withColumns({"lo": F.col("lo") - half, "hi": F.col("hi") + half})


def long_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("dataset",)) -> DataFrame:
    wide = df.select(*[col(b) for b in by], *[as_double(df, c).alias(c) for c in columns])
    return wide.unpivot([col(b) for b in by], [col(c) for c in columns], "column", "value").where(F.col("value").isNotNull())


def histogram(df: DataFrame, columns: Sequence[str], bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Density histogram per dataset and column over its own range; empty bins included."""
    keys = ["dataset", "column"]
    ranges = materialize(column_ranges(df, columns), "ranges")
    binned = long_values(df, columns).join(ranges, keys).withColumn("bin", bin_of(F.col("value"), F.col("lo"), F.col("hi"), bins))
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    spine = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    filled = spine.join(counts, [*keys, "bin"], "left")
    step = (F.col("hi") - F.col("lo")) / bins
    n = F.coalesce("n", F.lit(0))
    return filled.select(
        *keys, "bin", (F.col("lo") + F.col("bin") * step).alias("left"), (F.col("lo") + (F.col("bin") + 1) * step).alias("right"),
        n.alias("n"), (n / (F.col("rows") * step)).alias("density"),
    )


def category_shares(df: DataFrame, columns: Sequence[str], datasets: Sequence[str]) -> DataFrame:
    """Share of each category per dataset; 0 where a dataset lacks it."""
    counts = value_counts(df, columns, ["dataset"])
    totals = counts.groupBy("column").agg(*[F.sum(F.when(F.col("dataset") == d, F.col("n"))).alias(f"_t{i}") for i, d in enumerate(datasets)])
    wide = counts.groupBy("column", "value").agg(*[F.sum(F.when(F.col("dataset") == d, F.col("n"))).alias(f"_n{i}") for i, d in enumerate(datasets)])
    share = lambda i: F.coalesce(F.try_divide(F.col(f"_n{i}").cast("double"), F.col(f"_t{i}")), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(d).alias("dataset"), share(i).alias("share")) for i, d in enumerate(datasets)])
    return wide.join(materialize(totals, "totals"), "column").select("column", "value", F.inline(rows))


def box_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers within 1.5 IQR of the box, number of outliers."""
    keys = ["dataset", "column"]
    q = quantiles(df, columns, [0.25, 0.5, 0.75], ["dataset"])
    box = q.select(*keys, *[F.col("q")[i].alias(n) for i, n in enumerate(("q25", "median", "q75"))])
    fences = materialize(box, "boxes")
    reach = WHISKER * (F.col("q75") - F.col("q25"))
    v = F.col("value")
    inside = v.between(F.col("q25") - reach, F.col("q75") + reach)
    return (
        long_values(df, columns)
        .join(fences, keys)
        .groupBy(*keys, "q25", "median", "q75")
        .agg(F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"), F.count_if(~inside).alias("outliers"))
    )


def compare_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The correlation matrix of each dataset."""
    return correlation_matrix(df, columns, ["dataset"])


def column_stats(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], real: str, synthetic: str) -> DataFrame:
    """Real and synthetic mean/std of numeric columns and shares of categories, side by side."""
    parts = []
    if numeric:
        stats = _per_column(df, numeric, lambda x: {"mean": F.avg(x), "std": F.stddev_samp(x)})
        side = lambda d, s: F.max(F.when(F.col("dataset") == d, F.col(s)))
        flat = stats.groupBy("column").agg(
            *[side(d, s).alias(f"_{s}_{i}") for i, d in enumerate((real, synthetic)) for s in ("mean", "std")]
        )
        rows = F.array(*[F.struct(F.lit(s).alias("item"), F.col(f"_{s}_0").alias("real"), F.col(f"_{s}_1").alias("synthetic")) for s in ("mean", "std")])
        parts.append(flat.select("column", F.inline(rows)))
    if categorical:
        shares = category_shares(df, categorical, [real, synthetic])
        parts.append(
            shares.groupBy("column", F.col("value").alias("item")).agg(
                F.max(F.when(F.col("dataset") == real, F.col("share"))).alias("real"),
                F.max(F.when(F.col("dataset") == synthetic, F.col("share"))).alias("synthetic"),
            )
        )
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


# ---- C11, C12 ---------------------------------------------------------------
CORRELATION_METRICS = ("Correlation_Similarity", "Pairwise_Correlation_Distance", "Contingency_Similarity")


def report_scores(reports: DataFrame, text: str = "text", report: str = "report") -> DataFrame:
    """C11: the scores of evaluation reports as rows ``(report, metric, kind, key, key2, value)``.

    ``kind`` is ``single``, ``column``, ``pair`` or ``empty``. Per-column scores
    that are themselves objects are left out; a text without ``Report`` gives nothing.
    """
    metrics = F.from_json(F.get_json_object(col(text), "$.Report"), "map<string, string>")
    per = reports.select(col(report).alias("report"), F.explode(metrics).alias("metric", "_body"))
    body = F.from_json("_body", "struct<Scores: string>")
    per = per.withColumn("_scores", F.when(F.col("_body").startswith("{"), body["Scores"]))
    items = F.when(F.col("_scores").startswith("{"), F.from_json("_scores", "map<string, string>"))
    per = per.withColumn("_items", items)
    number = F.col("_scores").try_cast("double")
    nested = F.exists(F.map_values("_items"), lambda v: F.coalesce(v.startswith("{"), F.lit(False)))
    is_pair = F.col("metric").isin(*CORRELATION_METRICS)
    kind = (
        F.when(F.col("_scores").isNull() | (F.size("_items") == 0), "empty")
        .when(is_pair, "pair")
        .when(number.isNotNull(), "single")
        .when(F.col("_items").isNotNull() & ~nested, "column")
        .when(F.col("_items").isNotNull(), "nested")
        .otherwise("empty")
    )
    per = per.withColumn("kind", kind).withColumn("_number", number).where(F.col("kind") != "nested")
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    single = F.array(entry(F.lit(None).cast("string"), F.col("_number")))
    listed = F.transform(F.map_entries("_items"), lambda e: F.struct(e["key"].alias("key"), e["value"].try_cast("double").alias("value")))
    rows = F.when(F.col("kind").isin("column", "pair") & F.col("_items").isNotNull(), listed).otherwise(single)
    flat = per.select("report", "metric", "kind", F.inline(rows))
    halves = F.split("key", "__")
    paired = (F.col("kind") == "pair") & (F.size(halves) == 2)
    return flat.select(
        "report", "metric", "kind", F.when(paired, halves[0]).otherwise(F.col("key")).alias("key"), F.when(paired, halves[1]).alias("key2"), "value"
    )


def pair_matrix(scores: DataFrame) -> DataFrame:
    """Pair scores as a symmetric matrix in long form.

    Input ``(report, metric, key, key2, value)``. Missing values count as 0; the
    diagonal and pairs without a score are 1. The output is columns squared per
    report by definition; the names of a report are bounded by its columns.
    """
    pairs = scores.where(F.col("key2").isNotNull()).select("report", "metric", "key", "key2", F.coalesce("value", F.lit(0.0)).alias("value"))
    both = pairs.select(
        "report", "metric",
        F.inline(F.array(F.struct(F.col("key").alias("col_a"), F.col("key2").alias("col_b"), F.col("value")),
                         F.struct(F.col("key2").alias("col_a"), F.col("key").alias("col_b"), F.col("value")))),
    )
    both = both.groupBy("report", "metric", "col_a", "col_b").agg(F.max("value").alias("value"))
    names = both.groupBy("report", "metric").agg(F.array_sort(F.collect_set("col_a")).alias("_names"))
    grid = names.select("report", "metric", F.explode("_names").alias("col_a"), "_names").select("report", "metric", "col_a", F.explode("_names").alias("col_b"))
    return grid.join(both, ["report", "metric", "col_a", "col_b"], "left").withColumn("value", F.coalesce("value", F.lit(1.0)))
