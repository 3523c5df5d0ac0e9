"""Named quality and privacy metrics between a real and a synthetic table.

Every input is one table with a ``dataset`` column unless said otherwise; ``real``
and ``synthetic`` are the two names in it. Formulas are the usual published ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabkit.functions.columns import as_double, chunked, col, join_null_safe, nan_to_null
from tabkit.functions.ordered import running_sums
from tabkit.operators.compare import _per_column, bin_of, column_ranges, long_values
from tabkit.operators.profile import pair_correlations, text_of, value_counts
from tabkit.session import discard, materialize


def _count_of(dataset: str, n: str | Column = "n") -> Column:
    return F.coalesce(F.sum(F.when(F.col("dataset") == dataset, F.col(n) if isinstance(n, str) else n)), F.lit(0))


# ---- N1 ---------------------------------------------------------------------
def ks_from_counts(sides: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Largest distance of two distributions given as ``(keys..., value, n_real, n_syn)``."""
    sides = materialize(sides, "ks-counts")
    summed = running_sums(sides, list(keys), [value], ["n_real", "n_syn"])
    totals = sides.groupBy(*[col(k) for k in keys]).agg(F.sum("n_real").alias("t_real"), F.sum("n_syn").alias("t_syn"))
    if keys:
        # One row per key, written so that its size is known; the other side is not moved by so few keys.
        gaps = summed.join(materialize(totals, "ks-totals"), list(keys))
    else:
        t = totals.first()
        gaps = summed.withColumns({"t_real": F.lit(t["t_real"]), "t_syn": F.lit(t["t_syn"])})
    gap = F.abs(F.try_divide("n_real", "t_real") - F.try_divide("n_syn", "t_syn"))
    return gaps.groupBy(*[col(k) for k in keys]).agg(F.max(gap).alias("ks"))


def ks_statistic(df: DataFrame, columns: Sequence[str], real: str, synthetic: str) -> DataFrame:
    """Kolmogorov-Smirnov distance per numeric column; ``score`` is its complement."""
    sides = long_values(df, columns).groupBy("column", "value").agg(
        F.count_if(F.col("dataset") == real).alias("n_real"), F.count_if(F.col("dataset") == synthetic).alias("n_syn")
    )
    ks = ks_from_counts(sides, ["column"], "value")
    return ks.withColumn("score", 1 - F.col("ks"))


# ---- N2 ---------------------------------------------------------------------
def _hellinger(counts: DataFrame, real: str, synthetic: str) -> DataFrame:
    sides = counts.groupBy("column", "value").agg(_count_of(real).alias("a"), _count_of(synthetic).alias("b"))
    agg = sides.groupBy("column").agg(
        F.sum(F.sqrt(F.col("a").cast("double") * F.col("b"))).alias("both"), F.sum("a").alias("ta"), F.sum("b").alias("tb")
    )
    overlap = F.try_divide("both", F.sqrt(F.col("ta").cast("double") * F.col("tb")))
    return agg.select("column", F.sqrt(F.greatest(F.lit(0.0), 1 - overlap)).alias("hellinger"))


def hellinger(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], real: str, synthetic: str, bins: int = 30) -> DataFrame:
    """Hellinger distance over categories, or over equal bins of the shared range."""
    parts = []
    df = df.where(F.col("dataset").isin(real, synthetic))  # others must not widen the bins
    if categorical:
        parts.append(value_counts(df, categorical, ["dataset"]))
    if numeric:
        ranges = materialize(column_ranges(df, numeric, []), "ranges")
        binned = long_values(df, numeric).join(ranges, "column")
        bucket = bin_of(F.col("value"), F.col("lo"), F.col("hi"), bins).cast("string")
        parts.append(binned.groupBy("dataset", "column", bucket.alias("value")).agg(F.count(F.lit(1)).alias("n")))
    counts = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _hellinger(counts, real, synthetic)


# ---- N3, N4 -----------------------------------------------------------------
def correlation_similarity(df: DataFrame, columns: Sequence[str], real: str, synthetic: str) -> DataFrame:
    """Per pair 1 - |r_real - r_syn| / 2, and the distance |r_real - r_syn|."""
    r = pair_correlations(df, columns, ["dataset"])
    side = lambda d: F.max(F.when(F.col("dataset") == d, F.col("r")))
    pairs = r.groupBy("col_a", "col_b").agg(side(real).alias("r_real"), side(synthetic).alias("r_synthetic"))
    distance = F.abs(F.col("r_real") - F.col("r_synthetic"))
    return pairs.select("col_a", "col_b", "r_real", "r_synthetic", (1 - distance / 2).alias("similarity"), distance.alias("distance"))


def pairwise_correlation_distance(df: DataFrame, columns: Sequence[str], real: str, synthetic: str) -> DataFrame:
    """Mean |r_real - r_syn| over the pairs."""
    return correlation_similarity(df, columns, real, synthetic).agg(F.avg("distance").alias("mean_distance"), F.avg("similarity").alias("mean_similarity"))


PAIR_BLOCK = 8  # columns of a block


def contingency_similarity(df: DataFrame, columns: Sequence[str], real: str, synthetic: str) -> DataFrame:
    """1 - half the total difference of the joint shares, per pair of columns.

    Up to two blocks of columns share a scan: their combinations are counted once for both sides, and the
    counts, not the rows, are then summed per pair. More columns take one scan for every two blocks.
    """
    sides = df.where(F.col("dataset").isin(real, synthetic))
    totals = {r["dataset"]: float(r["n"]) for r in sides.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {side: F.col(side) / F.lit(totals.get(name)).cast("double") for side, name in (("a", real), ("b", synthetic))}
    blocks = chunked(list(columns), PAIR_BLOCK)
    out = None
    for first, second in combinations(blocks, 2) if len(blocks) > 1 else [(blocks[0], [])]:
        held = [*first, *second]
        # Pairs inside a block belong to the scan of the block and the next one; the last block's to its first scan.
        inner = blocks.index(second) == blocks.index(first) + 1 if second else True
        last = second == blocks[-1] and first == blocks[0]
        inside = ([first] if inner else []) + ([second] if second and last else [])
        pairs = [p for block in inside for p in combinations(block, 2)] + [(x, y) for x in first for y in second]
        if not pairs:
            continue
        place = {c: i for i, c in enumerate(held)}
        values = [F.col(f"v{i}") for i in range(len(held))]
        counts = sides.groupBy(*[text_of(col(c), df.schema[c].dataType).alias(f"v{place[c]}") for c in held]).agg(
            F.count_if(F.col("dataset") == real).alias("a"), F.count_if(F.col("dataset") == synthetic).alias("b")
        )
        cells = counts.groupingSets([[values[place[x]], values[place[y]]] for x, y in pairs], *values).agg(
            F.sum("a").alias("a"), F.sum("b").alias("b"), F.grouping_id().alias("pair")
        )
        # The id has a bit for each column that is summed over, the first column in the highest.
        names = {(1 << len(held)) - 1 - sum(1 << (len(held) - 1 - place[c]) for c in pair): pair for pair in pairs}
        named = F.create_map(*[x for k, (x, y) in names.items() for x in (F.lit(k).cast("bigint"), F.struct(F.lit(x).alias("col_a"), F.lit(y).alias("col_b")))])
        part = cells.groupBy("pair").agg((1 - F.sum(F.abs(share["a"] - share["b"])) / 2).alias("similarity"))
        part = part.select(F.element_at(named, F.col("pair").cast("bigint")).alias("p"), "similarity").select("p.*", "similarity")
        out = part if out is None else out.unionByName(part)
    return out


# ---- N5, N6 -----------------------------------------------------------------
def _side_ranges(df: DataFrame, columns: Sequence[str], real: str, synthetic: str) -> DataFrame:
    ranges = _per_column(df, columns, lambda x: {"lo": F.min(x), "hi": F.max(x)})
    side = lambda d, c: F.max(F.when(F.col("dataset") == d, F.col(c)))
    return ranges.groupBy("column").agg(
        side(real, "lo").alias("real_lo"), side(real, "hi").alias("real_hi"), side(synthetic, "lo").alias("syn_lo"), side(synthetic, "hi").alias("syn_hi")
    )


def range_coverage(df: DataFrame, columns: Sequence[str], real: str, synthetic: str) -> DataFrame:
    """1 - the share of the real range that synthetic values miss at both ends, at least 0."""
    span = F.col("real_hi") - F.col("real_lo")
    low = F.greatest(F.try_divide(F.col("syn_lo") - F.col("real_lo"), span), F.lit(0.0))
    high = F.greatest(F.try_divide(F.col("real_hi") - F.col("syn_hi"), span), F.lit(0.0))
    return _side_ranges(df, columns, real, synthetic).select("column", F.greatest(F.lit(0.0), 1 - (low + high)).alias("coverage"))


def boundary_adherence(df: DataFrame, columns: Sequence[str], real: str, synthetic: str) -> DataFrame:
    """Share of synthetic values within the real range."""
    ranges = materialize(_side_ranges(df, columns, real, synthetic).select("column", "real_lo", "real_hi"), "ranges")
    values = long_values(df, columns).where(F.col("dataset") == synthetic).join(ranges, "column")
    inside = F.col("value").between(F.col("real_lo"), F.col("real_hi"))
    return values.groupBy("column").agg(F.avg(inside.cast("double")).alias("adherence"))


# ---- N7..N9 -----------------------------------------------------------------
def key_uniqueness(df: DataFrame, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Distinct keys, rows, and their ratio."""
    keys = [col(k) for k in key]
    present = F.lit(True)
    for k in keys:
        present = present & k.isNotNull()
    counted = df.groupBy(*[col(b) for b in by], *keys).agg(F.count(F.lit(1)).alias("_m"))
    agg = counted.groupBy(*[col(b) for b in by]).agg(F.count_if(present).alias("distinct_keys"), F.sum("_m").alias("rows"))
    return agg.withColumn("uniqueness", F.try_divide(F.col("distinct_keys").cast("double"), F.col("rows")))


def referential_integrity(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Share of the child rows whose key exists in the parent.

    Children are counted per key before the join, so a key that holds a large
    part of them is one row in it.
    """
    per_key = child.groupBy(col(child_key).alias("k")).agg(F.count(F.lit(1)).alias("m"))
    parents = parent.select(col(parent_key).alias("k")).where("k is not null").distinct().withColumn("found", F.lit(True))
    joined = per_key.join(parents, "k", "left")
    return joined.agg(
        F.sum("m").alias("child_rows"), F.coalesce(F.sum(F.when(F.col("found"), F.col("m"))), F.lit(0)).alias("matched_rows")
    ).withColumn("integrity", F.try_divide(F.col("matched_rows").cast("double"), F.col("child_rows")))


def children_per_parent(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Number of parents for each number of children, ``(children, n)``; parents without any count as 0."""
    per_key = child.groupBy(col(child_key).alias("k")).agg(F.count(F.lit(1)).alias("m"))
    parents = parent.select(col(parent_key).alias("k")).where("k is not null").distinct()
    joined = parents.join(per_key, "k", "left").select(F.coalesce("m", F.lit(0)).alias("children"))
    return joined.groupBy("children").agg(F.count(F.lit(1)).alias("n"))


def cardinality_shape(real: tuple[DataFrame, str, DataFrame, str], synthetic: tuple[DataFrame, str, DataFrame, str]) -> DataFrame:
    """KS distance between the numbers of children per parent of two (child, key, parent, key)."""
    zero = F.lit(0).cast("bigint")
    a = children_per_parent(*real).select("children", F.col("n").alias("n_real"), zero.alias("n_syn"))
    b = children_per_parent(*synthetic).select("children", zero.alias("n_real"), F.col("n").alias("n_syn"))
    sides = a.unionByName(b).groupBy("children").agg(F.sum("n_real").alias("n_real"), F.sum("n_syn").alias("n_syn"))
    return ks_from_counts(sides, [], "children").withColumn("score", 1 - F.col("ks"))


# ---- N10 --------------------------------------------------------------------
LEAF_POINTS = 256
FAN = 16  # children of a node
SPLITS = 16  # cells of a column in the order of the points, with even shares of them
LISTED = 16  # most values of a category that a node lists; with more, any value may be in it
BLOCK_ROWS = 2048  # rows that walk down the tree together
BEAM = 16  # nodes of a level that the first walk follows
MET = 128  # leaves that a block meets in one task; one with more is dealt to several
TOGETHER = 16  # neighbouring blocks, at most, that meet their leaves in one task, where each leaf is sent once
TASK = 32  # meetings of a block and a leaf that a task has on average
NULL = "\0"


def closest_record_distance(
    df: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str], real: str, synthetic: str, leaf_points: int = LEAF_POINTS, fan: int = FAN
) -> DataFrame:
    """Exact distance of each synthetic row to its closest real row, ``(key, dcr)``; null where there is no real row.

    Distance is the sum of |difference| / real range over numeric columns plus the number of differing categories. Null is a value
    of its own: it equals null and differs from any other by 1, in both kinds of columns. NaN counts as null.

    Real points are sorted once, by their categories and then along a z-curve over cells with even shares of the points, and numbered. A
    node of the search tree is a run of them: ``leaf_points`` numbers in a leaf, ``fan`` children above, so every split is a quantile of the data and a
    parent's number is a child's divided. A node knows the box of each number and the values of each category.
    Synthetic rows are sorted and cut into blocks in the same way, and blocks walk down by equi-joins on the node: only summaries meet there. A first
    walk follows the ``BEAM`` nearest nodes of each level; the distances to the points of their leaves bound each row's answer. Rows are then cut
    into blocks again, those of similar bounds together, and a second walk leaves every node that is not nearer than the largest bound of the block.
    """
    df = nan_to_null(df)
    ranges = column_ranges_of(df, numeric, real)
    dims, kinds = [f"x{i}" for i in range(len(numeric))], [f"c{i}" for i in range(len(categorical))]
    scaled = [((as_double(df, c) - F.lit(lo)) / F.lit(span)).alias(d) for c, d, (lo, span) in zip(numeric, dims, ranges)]
    cats = [F.coalesce(text_of(col(c), df.schema[c].dataType), F.lit(NULL)).alias(k) for c, k in zip(categorical, kinds)]
    points = df.select("dataset", col(key).alias("key"), *scaled, *cats)
    reals = materialize(points.where(F.col("dataset") == real).select(*dims, *kinds).distinct(), "dcr-real")
    rows = materialize(points.where(F.col("dataset") == synthetic), "dcr-rows")
    # Rows with equal features have one answer; each is searched once.
    searched = materialize(rows.select(*dims, *kinds).distinct().withColumn("q", F.monotonically_increasing_id()), "dcr-searched")
    leaves, levels = _packed_tree(reals, dims, kinds, leaf_points, fan)

    blocks = _blocks(searched.withColumn("best", F.lit(float("inf"))), dims, kinds)
    discard(reals)  # steps are deleted as soon as nothing reads them
    first = _nearest(blocks, _walk(_summaries(blocks, dims, kinds), levels, dims, kinds, BEAM), leaves, dims, kinds)
    discard(blocks)
    blocks = _blocks(searched.join(first, "q").where("best > 0"), dims, kinds)
    second = _nearest(blocks, _walk(_summaries(blocks, dims, kinds), levels, dims, kinds), leaves, dims, kinds)
    discard(blocks, leaves, *levels)
    best = first.unionByName(second).groupBy("q").agg(F.min("best").alias("dcr"))
    best = searched.join(best, "q", "left").drop("q")
    return join_null_safe(rows, best, [*dims, *kinds]).select(F.col("key").alias(key), "dcr")


def _blocks(rows: DataFrame, dims: list[str], kinds: list[str]) -> DataFrame:
    """Rows with the number of their block: neighbours along the curve, those whose best so far has the same whole part together."""
    numbered, _ = _numbered(rows.withColumn("level", F.floor("best")), dims, kinds, ["level"], ["q"])
    blocks = materialize(numbered.withColumn("block", F.floor((F.col("nth") - 1) / BLOCK_ROWS)).drop("nth", "level"), "dcr-blocks")
    discard(numbered)
    return blocks


def _summaries(blocks: DataFrame, dims: list[str], kinds: list[str]) -> DataFrame:
    found = blocks.groupBy("block").agg(F.max("best").alias("bound"), *_box(dims), *_lists(kinds))
    return materialize(found.select("block", "bound", *[F.col(c).alias(f"of_{c}") for c in found.columns[2:]]), "dcr-summaries")


def _walk(blocks: DataFrame, levels: list[DataFrame], dims: list[str], kinds: list[str], beam: int | None = None) -> DataFrame:
    """``(block, node, near)``: the leaves that may hold a point nearer than a block's bound, or of these ``beam`` near ones."""
    pairs = blocks.select("block", F.lit(0).cast("bigint").alias("node"))
    for nodes in reversed(levels):
        met = pairs.join(nodes, F.col("node") == F.col("parent")).select("block", "id", *[c for c in nodes.columns if c.startswith(("lo_", "hi_", "null_", "in_"))])
        met = met.join(blocks, "block").where(_least_distance(dims, kinds) < F.col("bound"))
        met = met.select("block", F.col("id").alias("node"), _least_distance(dims, kinds).alias("near"), _unlike(dims, kinds).alias("unlike"))
        if beam:
            place = F.row_number().over(Window.partitionBy("block").orderBy("near", "unlike", "node"))
            met = met.withColumn("place", place).where(F.col("place") <= beam)
        above, pairs = pairs, materialize(met.select("block", "node", "near"), "dcr-pairs")
        if nodes is not levels[-1]:
            discard(above)  # of the topmost level, it is the blocks
    return pairs


def _least_distance(dims: Sequence[str], kinds: Sequence[str]) -> Column:
    """Of any row that may be in a block from any point that may be in a node."""
    gaps = []
    for d in dims:
        lo, hi, null = (F.col(f"{x}_{d}") for x in ("lo", "hi", "null"))
        of_lo, of_hi, of_null = (F.col(f"of_{x}_{d}") for x in ("lo", "hi", "null"))
        apart = F.greatest(lo - of_hi, of_lo - hi, F.lit(0.0))
        numbers = F.when(lo.isNull() | of_lo.isNull(), 1.0).otherwise(F.least(apart, F.when(null | of_null, 1.0)))
        gaps.append(F.when(null & of_null, 0.0).otherwise(numbers))
    gaps += [F.coalesce((~F.arrays_overlap(f"in_{k}", f"of_in_{k}")).cast("double"), F.lit(0.0)) for k in kinds]
    return sum(gaps, F.lit(0.0))


def _unlike(dims: Sequence[str], kinds: Sequence[str]) -> Column:
    """How little a block and a node cover the same ground; only an order of preference."""
    gaps = [F.coalesce(F.abs(F.col(f"{x}_{d}") - F.col(f"of_{x}_{d}")), F.lit(1.0)) for d in dims for x in ("lo", "hi")]
    gaps += [(~F.array_sort(f"in_{k}").eqNullSafe(F.array_sort(f"of_in_{k}"))).cast("double") for k in kinds]
    return sum(gaps, F.lit(0.0))


def _nearest(blocks: DataFrame, pairs: DataFrame, leaves: DataFrame, dims: list[str], kinds: list[str]) -> DataFrame:
    """``(q, best)``: the least distance of each row from the points of the leaves that its block meets, or what it had.

    The rows of a block and then its leaves, nearest first, stream through a task in the form of plain rows. A row may be answered by several tasks.
    """
    last = blocks.agg(F.max("block")).first()[0]
    together = max(1, min(TOGETHER, ((last or 0) + 1) // int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    joined = F.floor(F.col("block") / together).alias("block")  # neighbours meet much the same leaves
    pairs = pairs.groupBy(joined, "node").agg(F.min("near").alias("near"))
    blocks = blocks.withColumn("block", joined)
    share = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("block")) / (MET * together))
    walked, pairs = pairs, materialize(pairs.withColumn("part", F.pmod(F.xxhash64("node"), share)), "dcr-met")
    discard(walked)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    points = pairs.join(leaves, F.col("node") == F.col("leaf")).select("block", "part", "near", "node", none("q", "bigint"), none("best", "double"), *dims, *kinds)
    own = pairs.select("block", "part").distinct().join(blocks, "block")
    own = own.select("block", "part", F.lit(-1.0).alias("near"), F.lit(-1).cast("bigint").alias("node"), "q", "best", *dims, *kinds)
    tasks = max(1, -(-pairs.count() // TASK))
    dealt = own.unionByName(points).repartition(tasks, "block", "part").sortWithinPartitions("block", "part", "near", "node")
    found = dealt.mapInArrow(_meet(len(dims), len(kinds)), "q bigint, best double")
    best = materialize(found.groupBy("q").agg(F.min("best").alias("best")), "dcr-best")
    discard(pairs)
    return best


def _meet(n_dims: int, n_kinds: int):
    """The search of a task: rows sorted by block, part, and nearness; those with a ``q`` ask, the others are points."""

    def run(batches):
        codes: list[dict] = [{} for _ in range(n_kinds)]  # numbers of the categories that this task has seen
        asking, now = [], None  # pieces of (q, best, numbers, categories) of the current block and part
        for batch in batches:
            heads = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3)]
            change = np.flatnonzero(np.logical_or.reduce([h[1:] != h[:-1] for h in heads])) + 1
            numbers = [batch.column(6 + i).to_numpy(zero_copy_only=False) for i in range(n_dims)]  # null is NaN
            kinds = [_coded(batch.column(6 + n_dims + i), codes[i]) for i in range(n_kinds)]
            for start, end in zip([0, *change], [*change, batch.num_rows]):
                part = (heads[0][start], heads[1][start])
                if part != now:
                    yield from _answers(asking)
                    asking, now = [], part
                x, c = [v[start:end] for v in numbers], [v[start:end] for v in kinds]
                if heads[2][start] == -1:
                    asking.append((batch.column(4)[start:end].to_numpy(), batch.column(5)[start:end].to_numpy().copy(), x, c))
                else:
                    for _, best, own_x, own_c in asking:
                        _improve(best, own_x, own_c, x, c)
        yield from _answers(asking)

    return run


def _coded(values: pa.Array, codes: dict) -> np.ndarray:
    encoded = values.dictionary_encode()
    numbers = [codes.setdefault(v, len(codes)) for v in encoded.dictionary.to_pylist()]
    return np.array(numbers, np.int32)[encoded.indices.to_numpy()]


def _answers(asking: list):
    for q, best, _, _ in asking:
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best)], ["q", "best"])


def _improve(best: np.ndarray, own_x: list, own_c: list, x: list, c: list) -> None:
    """``best`` of each row becomes its distance from the nearest of the points, where that is less. Categories are compared first; most pairs end there."""
    near = np.zeros(len(best))
    for a, b in zip(own_x, x):
        known = b[~np.isnan(b)]
        some_null = len(known) < len(b)
        gap = np.maximum(np.maximum(known.min() - a, a - known.max()), 0.0) if len(known) else np.ones(len(a))
        near += np.where(np.isnan(a), 0.0 if some_null else 1.0, np.minimum(gap, 1.0) if some_null else gap)
    for a, b in zip(own_c, c):
        held = np.zeros(max(a.max(), b.max()) + 1, bool)
        held[b] = True
        near += ~held[a]
    rows = np.flatnonzero(near < best)
    if not len(rows):
        return
    limit = best[rows]
    differ = np.zeros((len(rows), len((x + c)[0]) if x or c else 1), np.int16)
    for a, b in zip(own_c, c):
        differ += a[rows][:, None] != b
    close = differ < limit[:, None]
    if 4 * np.count_nonzero(close) > close.size:  # whole rows are cheaper than single pairs
        less = differ.astype(float)
        for a, b in zip(own_x, x):
            less += _gap(a[rows][:, None], b)
        best[rows] = np.minimum(limit, less.min(axis=1))
        return
    i, j = np.nonzero(close)
    less = differ[i, j].astype(float)
    for a, b in zip(own_x, x):
        less += _gap(a[rows[i]], b[j])
        keep = less < limit[i]
        i, j, less = i[keep], j[keep], less[keep]
    if len(i):
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        best[rows[i[starts]]] = np.minimum.reduceat(less, starts)


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = np.abs(a - b)
    return np.where(np.isnan(gap), np.isnan(a) != np.isnan(b), gap) if np.isnan(a).any() or np.isnan(b).any() else gap


def _box(dims: Sequence[str]) -> list[Column]:
    return [x for d in dims for x in (F.min(d).alias(f"lo_{d}"), F.max(d).alias(f"hi_{d}"), F.bool_or(F.col(d).isNull()).alias(f"null_{d}"))]


def _listed(values: Column) -> Column:
    return F.when(F.size(values) <= LISTED, values)


def _lists(kinds: Sequence[str]) -> list[Column]:
    return [_listed(F.collect_set(k)).alias(f"in_{k}") for k in kinds]


def _numbered(points: DataFrame, dims: list[str], kinds: list[str], before: Sequence[str] = (), after: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """The points with their place ``nth`` in the order of ``before``, the categories, the curve and ``after``, and how many they are."""
    asked = [F.percentile_approx(d, [i / SPLITS for i in range(1, SPLITS)], 10_000).alias(d) for d in dims] + [F.approx_count_distinct(k).alias(k) for k in kinds]
    about = points.agg(F.count(F.lit(1)).alias("n"), *asked).first()
    bits = (SPLITS - 1).bit_length()
    cells = []
    for d in dims:
        above = [(F.col(d) >= F.lit(x)).cast("int") for x in sorted(set(about[d] or []))]
        cells.append(F.coalesce(sum(above, F.lit(0)), F.lit(0)))
    curve = [F.shiftright(c, b).bitwiseAND(1).cast("string") for b in range(bits - 1, -1, -1) for c in cells]
    order = F.concat(*[x for k in sorted(kinds, key=lambda k: about[k]) for x in (F.col(k), F.lit("\1"))], F.lit("\2"), *curve)
    placed = points.withColumns({"at": order, "nth": F.lit(1).cast("bigint")})
    return running_sums(placed, [], [*before, "at", *dims, *kinds, *after], ["nth"]).drop("at"), about["n"]


def _packed_tree(reals: DataFrame, dims: list[str], kinds: list[str], leaf_points: int, fan: int) -> tuple[DataFrame, list[DataFrame]]:
    """The points with the number of their leaf, and the levels of nodes from the leaves up: id, parent, boxes, categories."""
    placed, n = _numbered(reals, dims, kinds)
    leaves = materialize(placed.withColumn("leaf", F.floor((F.col("nth") - 1) / leaf_points)).drop("nth"), "dcr-leaves")
    discard(placed)
    nodes = leaves.groupBy("leaf").agg(*_box(dims), *_lists(kinds))
    nodes = nodes.withColumnRenamed("leaf", "id").withColumn("parent", F.floor(F.col("id") / fan))
    levels, count = [materialize(nodes, "dcr-nodes")], -(-n // leaf_points)
    while count > fan:
        inner = levels[-1]
        box = [x for d in dims for x in (F.min(f"lo_{d}").alias(f"lo_{d}"), F.max(f"hi_{d}").alias(f"hi_{d}"), F.bool_or(f"null_{d}").alias(f"null_{d}"))]
        # At most `fan` lists of at most LISTED values meet; one that is too long stands for any value.
        union = [F.when(F.bool_and(F.col(f"in_{k}").isNotNull()), _listed(F.array_distinct(F.flatten(F.collect_list(f"in_{k}"))))).alias(f"in_{k}") for k in kinds]
        nodes = inner.groupBy("parent").agg(*box, *union)
        nodes = nodes.withColumnRenamed("parent", "id").withColumn("parent", F.floor(F.col("id") / fan))
        levels.append(materialize(nodes, "dcr-nodes"))
        count = -(-count // fan)
    levels[-1] = levels[-1].withColumn("parent", F.lit(0).cast("bigint"))
    return leaves, levels


def column_ranges_of(df: DataFrame, columns: Sequence[str], dataset: str) -> list[tuple[float, float]]:
    """(min, range) per column of one dataset; a constant column counts as range 1."""
    if not columns:
        return []
    row = df.where(F.col("dataset") == dataset).agg(*[x for c in columns for x in (F.min(as_double(df, c)), F.max(as_double(df, c)))]).first()
    out = []
    for i in range(len(columns)):
        lo, hi = row[2 * i], row[2 * i + 1]
        out.append((0.0, 1.0) if lo is None else (lo, (hi - lo) or 1.0))
    return out


# ---- N11, N12 ---------------------------------------------------------------
PMSE_ROUNDS = 300
PMSE_TOLERANCE = 1e-9


def cap_disclosure(df: DataFrame, key_columns: Sequence[str], sensitive: str, real: str, synthetic: str) -> DataFrame:
    """For real rows with known key columns, the share of synthetic rows with the same keys that give away the sensitive value.

    Both sides are counted per key before they meet. Real rows whose keys no
    synthetic row has are reported but not part of the mean.
    """
    keys = [f"k{i}" for i in range(len(key_columns))]
    base = df.select("dataset", *[col(c).cast("string").alias(k) for c, k in zip(key_columns, keys)], col(sensitive).cast("string").alias("s"))
    cells = base.groupBy(*keys, "s").agg(
        F.count_if(F.col("dataset") == real).alias("n_real"), F.count_if(F.col("dataset") == synthetic).alias("n_syn")
    )
    known = cells.groupBy(*keys).agg(
        F.sum("n_syn").alias("t_syn"), F.sum("n_real").alias("t_real"), F.sum(F.col("n_real") * F.col("n_syn").cast("double")).alias("hits")
    )
    matched = F.col("t_syn") > 0
    return known.agg(
        F.sum("t_real").alias("real_rows"),
        F.coalesce(F.sum(F.when(matched, F.col("t_real"))), F.lit(0)).alias("matched_rows"),
        F.try_divide(F.sum(F.when(matched, F.col("hits") / F.col("t_syn"))), F.sum(F.when(matched, F.col("t_real")))).alias("cap"),
    )


def pmse(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], real: str, synthetic: str) -> DataFrame:
    """Mean squared distance of a logistic model's synthetic probability from the synthetic share.

    Every category is a sparse feature of its own. The driver holds them as it holds the model's coefficients, one for
    each. The model has no penalty and is fitted to its optimum, so with one category the probability is that category's synthetic share.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    both = df.where(F.col("dataset").isin(real, synthetic))
    work = both.select(
        (F.col("dataset") == synthetic).cast("double").alias("label"),
        *[F.coalesce(as_double(df, c), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(numeric)],
        *[F.coalesce(col(c).cast("string"), F.lit("none")).alias(f"c{i}") for i, c in enumerate(categorical)],
        F.lit(0.0).alias("nothing"),
    )
    names, inputs, stages = [f"c{i}" for i in range(len(categorical))], [*[f"x{i}" for i in range(len(numeric))], "nothing"], []
    if categorical:
        indexer = StringIndexer(inputCols=names, outputCols=[f"{c}_no" for c in names]).fit(work)
        work = indexer.transform(work)
        # A column of one category tells nothing; one category of each other column stands in the intercept, so the optimum is unique.
        names = [c for c, labels in zip(names, indexer.labelsArray) if len(labels) > 1]
    if names:
        stages.append(OneHotEncoder(inputCols=[f"{c}_no" for c in names], outputCols=[f"{c}_hot" for c in names], dropLast=True))
        inputs += [f"{c}_hot" for c in names]
    stages += [VectorAssembler(inputCols=inputs, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=False)]
    prepared = materialize(Pipeline(stages=stages).fit(work).transform(work).select("label", "features"), "pmse-vectors")
    scored = LogisticRegression(maxIter=PMSE_ROUNDS, tol=PMSE_TOLERANCE).fit(prepared).transform(prepared)
    p = vector_to_array("probability")[1]
    share = prepared.agg(F.avg("label")).first()[0]
    return scored.agg(F.avg((p - F.lit(share)) * (p - F.lit(share))).alias("pmse"), F.lit(share).alias("synthetic_share"), F.count(F.lit(1)).alias("rows"))
