"""Running totals over sorted groups that may be too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabkit.functions.columns import col
from tabkit.session import materialize


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Replace each measure by its running total within ``group`` in the given order.

    ``order`` is unique within a group. Rows are range-partitioned, which splits
    large groups; totals run inside each partition, and the totals of the
    partitions before are added. The partitioning is written out first, so both
    steps see the same one even after a lost executor.
    """
    keys = [col(g) for g in group]
    ranged = df.repartitionByRange(*keys, *[col(o) for o in order]).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "ordered")
    totals = ranged.groupBy(*keys, "_part").agg(*[F.sum(m).alias(m) for m in measures])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_part", *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_{m}") for m in measures])
    inner = Window.partitionBy(*keys, "_part").orderBy(*[col(o) for o in order]).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({m: F.sum(m).over(inner) for m in measures})
    summed = local.join(offsets, [*group, "_part"])
    return summed.select(*[(F.col(m) + F.col(f"_{m}")).alias(m) if m in measures else col(m) for m in df.columns])
