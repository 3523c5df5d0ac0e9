"""Exact quantiles by narrowing: histograms of ever smaller ranges, until each wanted rank is in a range of one value.

1. One pass counts the values of each column and finds the smallest and the largest.
2. Each round cuts every open range into ``CELLS`` cells and counts their rows, with the smallest and largest value of each, in one pass over the values
   inside open ranges. Partial counts per cell are all that is shuffled. Running totals over the cells of a range tell the
   cell of each wanted rank; it is the next range, shrunk to its own smallest and largest value.
3. A range of one value is the answer. All ranks of all columns and groups go through the rounds together.

Cells are even in value, or in the logarithm where a range spans orders of magnitude or holds zero, so a
round divides every range by ``CELLS`` whatever the distribution; the number of rounds is that of the digits of a double, not of the rows. Every cell keeps the order of the
values, hence the result is exact. There is one route for every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabkit.functions.columns import as_double, col
from tabkit.session import materialize

CELLS = 4096
WIDE = 16.0  # from this ratio of its ends on, a range is cut by logarithms
TINY = 2.0**-256  # of the larger end: below it, values around zero share a cell for one round


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), cells: int = CELLS) -> DataFrame:
    """Linear-interpolated quantiles as ``(by..., column, q array<double>)``, in the order of ``probs``; null for a column without values."""
    cells = max(cells, 2)  # a range cut into one cell would never get smaller
    keys = [col(f"_{i}") for i in range(len(by))] + [F.col("column")]
    names = [f"_{i}" for i in range(len(by))] + ["column"]
    wide = df.select(*[col(b).alias(f"_{i}") for i, b in enumerate(by)], *[as_double(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    long = wide.unpivot(keys[:-1], [F.col(f"c{i}") for i in range(len(columns))], "column", "value")
    value = F.col("value")
    totals = long.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)), F.ceil(place(p))) for p in probs])))
    totals = _held(totals.select(*keys, "n", "lo", "hi", F.lit(0).cast("bigint").alias("below"), wanted.alias("ranks")), by)
    state, settled = totals.where("n > 0").drop("n"), []
    while True:
        settled.append(state.where("lo <=> hi"))
        state = state.where("not lo <=> hi")
        if state.isEmpty():
            break
        state = _held(_narrow(long, state, names, cells), by)
    found = settled[0]
    for part in settled[1:]:
        found = found.unionByName(part)
    ranks = found.select(*keys, F.explode("ranks").alias("rank"), "lo")
    # A hot group has no more rows here than wanted ranks.
    values = ranks.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("at"))
    one = []
    for p in probs:
        first, last = F.floor(place(p)), F.ceil(place(p))
        a, b = F.col("at")[first], F.col("at")[last]
        one.append(F.when(first == last, a).otherwise((last - place(p)) * a + (place(p) - first) * b))
    named = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(f"c{i}"), F.lit(c))])
    out = _null_safe(totals.select(*keys, "n"), values, names, "left")
    q = F.when(F.col("n") > 0, F.array(*one))
    return out.select(*[F.col(f"_{i}").alias(b) for i, b in enumerate(by)], named[F.col("column")].alias("column"), q.alias("q"))


def _held(ranges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ranges that are not made again. Without groups there are at most two for each column and probability, which the driver holds and every task gets.

    With groups they are written, so that their size is known. Values never meet ranges by a shuffle on the column alone: all rows of a column would be one task's.
    """
    if by:
        return materialize(ranges, "quantile-ranges")
    return F.broadcast(ranges.sparkSession.createDataFrame(ranges.collect(), ranges.schema))


def _null_safe(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner", residual: Column | None = None) -> DataFrame:
    right = right.select(*[F.col(k).alias(f"r_{k}") for k in names], *[c for c in right.columns if c not in names])
    same = F.lit(True) if residual is None else residual
    for k in names:
        same = same & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    return left.join(right, same, how).drop(*[f"r_{k}" for k in names])


def _scaled(ranges: DataFrame, cells: int) -> DataFrame:
    """Ranges with what places a value in a cell: the logarithm taken off (null: even cells), the place of the low end and the distance of the ends."""
    lo, hi, large = F.col("lo"), F.col("hi"), F.greatest(F.abs("lo"), F.abs("hi"))
    least = F.when(lo > 0, lo).when(hi < 0, -hi).otherwise(F.greatest(large * TINY, F.lit(2.0**-1022)))
    out = ranges.withColumn("base", F.when(large / WIDE > least, F.ln(least)))
    start, end = _place(lo), _place(hi)
    return out.withColumn("start", start).withColumn("width", end - start)


def _place(v: Column) -> Column:
    """Never falls as the value grows: the value, or its logarithm above the base with the value's sign."""
    far = F.greatest(F.ln(F.abs(v)) - F.col("base"), F.lit(0.0))  # the logarithm of zero is null, which counts for nothing here
    return F.when(F.col("base").isNull(), v).otherwise(F.signum(v) * far)


def _narrow(long: DataFrame, state: DataFrame, names: Sequence[str], cells: int) -> DataFrame:
    """The ranges of the wanted ranks within the cells of the open ranges."""
    keys = [F.col(k) for k in names]
    ranges = _scaled(state.select(*names, "lo", "hi"), cells)
    met = _null_safe(long, ranges, names, "inner", F.col("value").between(F.col("lo"), F.col("hi")))
    cell = F.least(F.greatest(F.floor((_place(F.col("value")) - F.col("start")) / F.col("width") * cells), F.lit(0)), F.lit(cells - 1))
    counted = met.groupBy(*keys, "lo", cell.cast("int").alias("cell")).agg(F.count("*").alias("m"), F.min("value").alias("least"), F.max("value").alias("most"))
    before = Window.partitionBy(*keys, "lo").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most `cells` rows
    counted = counted.withColumn("inner_before", F.coalesce(F.sum("m").over(before), F.lit(0)))
    # one range per key and smallest value: ranges do not overlap
    wanted = state.select(*names, F.col("lo").alias("of"), "below", "ranks")
    joined = _null_safe(counted, wanted, names, "inner", F.col("lo") == F.col("of"))
    joined = joined.withColumn("start", F.col("below") + F.col("inner_before"))
    joined = joined.withColumn("held", F.filter("ranks", lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("m")))).where(F.size("held") > 0)
    return joined.select(*keys, F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("start").alias("below"), F.col("held").alias("ranks"))
