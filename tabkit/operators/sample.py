"""Representative rows: percentile bounds, filters, exact-size samples."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabkit.functions.columns import as_double, col, hash_number, join_null_safe, numeric_columns, rank_key
from tabkit.functions.quantiles import quantiles
from tabkit.session import materialize

# Up to this many rows a sample is a top-n of the hash order; beyond it the
# hash value of the n-th row is looked up first and the rows are filtered.
TOP_N_ROWS = 1_000_000


def select_features(df: DataFrame, wanted: Sequence[str] | None = None) -> list[str]:
    """R2: the numeric columns, or those of ``wanted`` that are numeric."""
    numeric = numeric_columns(df)
    if wanted is None:
        return numeric
    unknown = [w for w in wanted if w not in numeric]
    if unknown:
        warnings.warn(f"not numeric columns of the table: {unknown}", stacklevel=2)
    valid = [w for w in wanted if w in numeric]
    if not valid:
        warnings.warn("no valid feature; using all numeric columns", stacklevel=2)
    return valid or numeric


def bounds(df: DataFrame, features: Sequence[str], lo: float = 0.25, hi: float = 0.75, by: Sequence[str] = ()) -> DataFrame:
    """Lower and upper percentile per feature, ``(by..., column, lo, hi)``."""
    q = quantiles(df, features, [lo, hi], by)
    return q.select(*[col(b) for b in by], "column", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def _in_range(df: DataFrame, limits: dict[str, tuple[float, float]]) -> list[Column]:
    hits = []
    for name, (lo, hi) in limits.items():
        inside = F.lit(False) if lo is None else F.coalesce(as_double(df, name).between(lo, hi), F.lit(False))
        hits.append(inside)
    return hits


def _condition(hits: Sequence[Column], method: str, threshold: float) -> Column:
    n_in = sum((h.cast("int") for h in hits), F.lit(0))
    if method == "strict":
        return n_in == len(hits)
    if method == "flexible":
        return n_in >= int(len(hits) * threshold)
    if method == "individual":
        return n_in >= 1
    raise ValueError("method must be 'strict', 'flexible' or 'individual'")


def representative(
    df: DataFrame,
    method: str = "flexible",
    threshold: float = 0.8,
    features: Sequence[str] | None = None,
    lo: float = 0.25,
    hi: float = 0.75,
    fallback: bool = True,
    n: int | None = None,
    seed: int = 42,
    key: Sequence[str] | None = None,
) -> DataFrame:
    """R3..R7: rows whose features lie between two percentiles.

    ``strict`` wants every feature in range, ``flexible`` a share of them,
    ``individual`` any. An empty result falls back strict -> flexible(0.5) ->
    individual. ``n`` keeps a uniform sample of that many rows.
    """
    names = select_features(df, features)
    limits: dict[str, tuple] = {n: (None, None) for n in names}
    if names:
        limits.update({r["column"]: (r["lo"], r["hi"]) for r in bounds(df, names, lo, hi).collect()})
    hits = _in_range(df, limits)
    chain = {"strict": [("strict", threshold), ("flexible", 0.5), ("individual", 0.0)],
             "flexible": [("flexible", threshold), ("individual", 0.0)]}.get(method, [(method, threshold)])
    conditions = [_condition(hits, m, t) for m, t in chain]
    chosen = conditions[0]
    if fallback:
        # One pass counts every step of the chain; the driver picks the first that keeps rows.
        kept = df.agg(*[F.count_if(c).alias(str(i)) for i, c in enumerate(conditions)]).first()
        filled = [i for i in range(len(conditions)) if kept[i] > 0]
        if not filled:
            warnings.warn("no representative rows with any method", stacklevel=2)
        chosen = conditions[filled[0] if filled else -1]
    out = df.where(chosen)
    return out if n is None else sample_rows(out, n, seed, key)


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """Exactly ``n`` rows without replacement (all, if there are fewer), repeatable.

    Order is the md5 of seed and ``key`` (default: all columns; equal rows are
    interchangeable). Hashes are uniform, so a threshold leaves little more than ``n`` rows to be sorted; a count proves that it leaves enough.
    """
    names = list(key or df.columns)
    if n > TOP_N_ROWS:
        return sample_by_cutoff(df, n, seed, names)
    total = df.count()
    if n >= total:
        return df
    keyed = df.withColumn("_order", rank_key(seed, *names)).withColumn("_num", hash_number(F.col("_order")))
    spread = 6.0
    while True:
        share = (n + spread * n**0.5 + 16) / total
        few = keyed.where(F.col("_num") <= int(min(1.0, share) * 2.0**60))
        if share >= 1 or few.count() >= n:
            break
        spread *= 8  # many copies of few rows
    return few.orderBy("_order", *[col(k) for k in names]).limit(n).drop("_order", "_num")


def sample_by_cutoff(df: DataFrame, n: int, seed: int, names: Sequence[str]) -> DataFrame:
    """The rows with the ``n`` smallest hashes, without sorting the table.

    Hashes are uniform, so the n-th smallest lies in a narrow window; one pass
    counts the rows before it and the few distinct hashes inside it. Copies of
    one row share a hash; only the last hash may be needed in part.
    """
    total = df.count()
    if n >= total:
        return df
    keyed = df.withColumn("_order", rank_key(seed, *names)).withColumn("_num", hash_number(F.col("_order")))
    space, spread = 2.0**60, 6.0
    while True:
        half = spread * (n * (1 - n / total)) ** 0.5 + 16
        low, high = int(max(0.0, (n - half) / total) * space), int(min(1.0, (n + half) / total) * space)
        num = F.col("_num")
        before = keyed.where(num < low).count()
        inside = keyed.where((num >= low) & (num <= high)).groupBy("_order").agg(F.count("*").alias("m"))
        w = Window.orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
        cut = inside.withColumn("upto", F.sum("m").over(w) + before).where(F.col("upto") >= n).orderBy("_order").first()
        if before < n and cut is not None:
            break
        if low == 0 and high == int(space):
            raise RuntimeError("row count changed while sampling")
        spread *= 8
    sure = keyed.where(F.col("_order") < cut["_order"])
    rest = n - (cut["upto"] - cut["m"])
    last = keyed.where(F.col("_order") == cut["_order"]).limit(rest)
    return sure.unionByName(last).drop("_order", "_num")


def retained(df: DataFrame, sample: DataFrame) -> DataFrame:
    """Rows before and after, and the percentage kept."""
    both = df.select(F.lit(0).alias("kept")).unionByName(sample.select(F.lit(1).alias("kept")))
    counts = both.agg(F.count_if(F.col("kept") == 0).alias("rows_before"), F.count_if(F.col("kept") == 1).alias("rows_after"))
    return counts.withColumn("percent_kept", F.try_divide(F.col("rows_after") * 100.0, F.col("rows_before")))


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column."""
    keys = [col(b) for b in by]
    aggs, rows = [], []
    for i, c in enumerate(columns):
        x = as_double(df, c)
        stats = {"count": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x)}
        aggs += [v.alias(f"{k}_{i}") for k, v in stats.items()]
        rows.append(F.struct(F.lit(c).alias("column"), *[F.col(f"{k}_{i}").alias(k) for k in stats]))
    basic = df.groupBy(*keys).agg(*aggs).select(*keys, F.inline(F.array(*rows)))
    q = quantiles(df, columns, [0.25, 0.5, 0.75], by)
    quart = q.select(*keys, "column", *[F.col("q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))])
    return basic.join(quart, [*by, "column"]).select(*keys, "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def sample_summary(df: DataFrame, sample: DataFrame, features: Sequence[str]) -> DataFrame:
    """``describe`` of the table before and after sampling, by ``stage``."""
    cols = [col(f) for f in features]
    both = df.select(F.lit("before").alias("stage"), *cols).unionByName(sample.select(F.lit("after").alias("stage"), *cols))
    return describe(both, features, ["stage"])


def representative_by_source(
    df: DataFrame,
    source: str,
    threshold: float = 0.8,
    features: Sequence[str] | None = None,
    lo: float = 0.25,
    hi: float = 0.75,
) -> DataFrame:
    """Flexible filtering within each source, each with its own percentiles."""
    names = [f for f in select_features(df, features) if f != source]
    limits = bounds(df, names, lo, hi, [source])
    ranges = limits.groupBy(col(source)).agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("lo", "hi")))).alias("_ranges"))
    # Written once, so its real size is known: joined by broadcast when small, else by a skew-aware shuffle.
    joined = join_null_safe(df, materialize(ranges, "source-bounds"), [source])
    hits = []
    for n in names:
        r = F.try_element_at(F.col("_ranges"), F.lit(n))
        hits.append(F.coalesce(as_double(df, n).between(r["lo"], r["hi"]), F.lit(False)))
    return joined.where(_condition(hits, "flexible", threshold)).select(*[col(c) for c in df.columns])
