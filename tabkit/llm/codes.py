"""Product codes of vectors: exact whole-number k-means of vector parts over Hilbert-sorted blocks.

1. Components become floor(scale * x). Vectors are sorted by their place on a Hilbert curve (BITS bits a component over the range of the
   table) over range partitions; equal vectors are told apart by a row number, so copies spread. Neighbours are packed into flat blocks of ``block_rows`` vectors
   with the smallest and largest value (box) and the sum of each component. This is the only shuffle of vectors, and is written out.
2. In each round a task compares the boxes of its blocks with the entries of each part's codebook: an entry nearer to no point of the box
   than the farthest point is to another entry is out, the rest are the block's shortlist. One left: the block's sum and count are
   the answer, its vectors are not read. Else a product of the block with the shortlist, in doubles where all terms stay below 2**53 (exact), in 64-bit numbers beyond.
3. A task gives one row of sums per used entry; partial sums meet in Spark. To the driver go at most parts * entries rows a round.

The codebooks are bounded by entries * components numbers and travel with the function. Rounds read written blocks, so a lost
executor costs its tasks only. Sums are exact below 2**38 vectors.

Null vectors and such with null or non-finite components take no part. Rows with a null key take part (last among the first entries), repeated
keys and rows each count; the first entries are the smallest rows by (key, vector). With fewer rows than entries there are fewer entries.
Shorter vectors are read as followed by zeros up to the longest, which is filled up to a multiple of ``parts``. Components of LIMIT or more after scaling raise an error, as squared distances would
pass 64 bits. An empty table has no rows and empty codebooks. Further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.llm.common import lists, name, stage

LIMIT = 1 << 24
BITS = 4
BLOCK_ROWS = 128
_EXACT = 2.0**53


def whole_numbers(vectors: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """key, label, v (array of long) of the rows that take part."""
    rows = vectors.select(name(key).alias("key"), name(label).alias("label"), name(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    too_large = F.raise_error(F.lit(f"a component of {LIMIT} or more after scaling has no exact squared distance in 64 bits"))
    return rows.withColumn("v", F.transform("v", lambda x: F.when(F.abs(x) < F.lit(LIMIT / scale), F.floor(x * F.lit(float(scale)))).otherwise(too_large.cast("long")).cast("long")))


def _ranges(rows: DataFrame) -> list:
    """position, smallest and largest component, ascending by position; one row per task and position is shuffled."""

    def run(batches):
        low, high = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            values, at = _flat(batch.column(0))
            wide = int(at.max(initial=-1)) + 1
            if wide > len(low):
                low = np.concatenate([low, np.full(wide - len(low), np.iinfo(np.int64).max)])
                high = np.concatenate([high, np.full(wide - len(high), np.iinfo(np.int64).min)])
            np.minimum.at(low, at, values)
            np.maximum.at(high, at, values)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low)), pa.int32()), pa.array(low), pa.array(high)], ["at", "low", "high"])

    found = rows.select("v").mapInArrow(run, "at int, low long, high long")
    return found.groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("at").collect()


def _flat(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All components in one array, and the position of each in its vector."""
    length = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    return values, np.arange(len(values)) - np.repeat(np.cumsum(length) - length, length)


def matrix(vectors: pa.ListArray, dim: int) -> np.ndarray:
    """One row per vector, filled up with zeros."""
    length = np.diff(vectors.offsets.to_numpy())
    values, at = _flat(vectors)
    out = np.zeros((len(vectors), dim), np.int64)
    out[np.repeat(np.arange(len(vectors)), length), at] = values
    return out


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (rows of numbers below 2**bits) on the Hilbert curve, as rows of bytes that sort like the curve.

    The axes are turned into the transposed place by undoing the curve's reflections and exchanges from the highest bit down, then its Gray code.
    """
    x = cells.astype(np.uint32)
    dim = x.shape[1]
    for bit in range(bits - 1, 0, -1):
        low = np.uint32((1 << bit) - 1)
        for i in range(dim):
            flip = (x[:, i] >> np.uint32(bit)) & np.uint32(1)
            x[:, 0] ^= low * flip
            swap = (x[:, 0] ^ x[:, i]) & low * (np.uint32(1) - flip)
            x[:, 0] ^= swap
            x[:, i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=1)
    turn = np.zeros(len(x), np.uint32)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.uint32((1 << bit) - 1) * ((x[:, -1] >> np.uint32(bit)) & np.uint32(1))
    x ^= turn[:, None]
    planes = (x[:, None, :] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)[None, :, None]) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8).reshape(len(x), -1), axis=1)


def _sorted(rows: DataFrame, low: np.ndarray, high: np.ndarray, dim: int) -> DataFrame:
    def run(batches):
        span = np.maximum(high - low + 1, 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.clip((matrix(batch.column(2), dim) - low) * (1 << BITS) // span, 0, (1 << BITS) - 1)
            place = hilbert(cells, BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p.tobytes() for p in place], pa.binary())], [*batch.schema.names, "place"])

    schema = T.StructType([*rows.schema.fields, T.StructField("place", T.BinaryType())])
    placed = stage(rows.mapInArrow(run, schema).withColumn("tie", F.monotonically_increasing_id()), "curve")
    return placed.repartitionByRange("place", "tie").sortWithinPartitions("place", "tie").select("key", "label", "v")


def _blocks(rows: DataFrame, dim: int, block_rows: int) -> DataFrame:
    """Sorted rows to blocks: keys, labels, the numbers of all vectors, box and sums."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField("keys", T.ArrayType(kinds["key"])), T.StructField("labels", T.ArrayType(kinds["label"]))] + [T.StructField(c, T.BinaryType()) for c in ("body", "low", "high", "total")])

    def pack(table):
        body = matrix(table.column(2), dim)
        starts = np.arange(0, len(body), block_rows)
        sizes = np.diff(np.append(starts, len(body)))
        made = [np.minimum.reduceat(body, starts), np.maximum.reduceat(body, starts), np.add.reduceat(body, starts)]
        parts = [body[a : a + n].astype(np.int32).tobytes() for a, n in zip(starts, sizes, strict=True)]
        return pa.RecordBatch.from_arrays([lists(sizes, table.column(0)), lists(sizes, table.column(1)), pa.array(parts, pa.binary()), *(pa.array([r.tobytes() for r in m], pa.binary()) for m in made)], schema.names)

    def run(batches):
        waiting = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= 32 * block_rows:
                yield pack(_whole(waiting))
                waiting = []
        if any(b.num_rows for b in waiting):
            yield pack(_whole(waiting))

    return rows.mapInArrow(run, schema)


def _whole(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches([b for b in batches if b.num_rows]).combine_chunks().to_batches()[0]


class _Parts:
    """The codebooks of all parts, cut for the kernels."""

    def __init__(self, books: np.ndarray):
        self.books = books  # part, entry, position
        self.squares = (books * books).sum(2)

    def shortlists(self, part: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each box which entries may be nearest to one of its points, equally near ones included."""
        entries = self.books[part]
        out = np.empty((len(low), len(entries)), bool)
        step = max(1, (1 << 18) // max(1, entries.size))
        for a in range(0, len(low), step):
            under, over = low[a : a + step, None] - entries, entries - high[a : a + step, None]
            near = np.maximum(np.maximum(under, over), 0)
            far = np.maximum(np.abs(under), np.abs(over))
            out[a : a + step] = (near * near).sum(2) <= (far * far).sum(2).min(1)[:, None]
        return out

    def nearest(self, part: int, points: np.ndarray, short: np.ndarray) -> np.ndarray:
        """Index of each point's nearest entry among ``short`` (ascending), the lowest of equally near ones."""
        entries, squares = self.books[part][short], self.squares[part][short]
        bound = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
        if 4 * bound * bound * max(1, points.shape[1]) < _EXACT:
            return short[np.argmin(squares - 2.0 * (points.astype(np.float64) @ entries.T.astype(np.float64)), axis=1)]
        best, found = np.full(len(points), np.iinfo(np.int64).max), np.zeros(len(points), np.int64)
        for k, e in zip(short.tolist(), entries, strict=True):
            distance = ((points - e) ** 2).sum(1)
            nearer = distance < best
            best, found = np.where(nearer, distance, best), np.where(nearer, k, found)
        return found


def _read(batch: pa.RecordBatch, dim: int):
    """Numbers of rows, boxes and sums of a batch of blocks."""
    sizes = np.diff(batch.column("keys").offsets.to_numpy())
    low, high, total = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64).reshape(-1, dim) for c in ("low", "high", "total"))
    return sizes, low, high, total


def _round(blocks: DataFrame, books: np.ndarray) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and sum of the points nearest to each entry that has any."""
    n_parts, n_entries, width = books.shape
    dim = n_parts * width

    def run(batches):
        parts = _Parts(books)
        count, sums = np.zeros((n_parts, n_entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, low, high, total = _read(batch, dim)
            for p in range(n_parts):
                at = slice(p * width, (p + 1) * width)
                short = parts.shortlists(p, low[:, at], high[:, at])
                one = short.sum(1) == 1
                only = np.argmax(short, axis=1)[one]
                np.add.at(count[p], only, sizes[one])
                np.add.at(sums[p], only, total[one, at])
                for k in np.flatnonzero(~one).tolist():
                    points = np.frombuffer(batch.column("body")[k].as_buffer(), np.int32).reshape(-1, dim)[:, at].astype(np.int64)
                    found = parts.nearest(p, points, np.flatnonzero(short[k]))
                    count[p] += np.bincount(found, minlength=n_entries)
                    np.add.at(sums[p], found, points)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), lists(np.full(len(part), width), pa.array(sums[part, entry].reshape(-1)))], ["part", "entry", "n", "total"])

    made = blocks.mapInArrow(run, "part int, entry int, n long, total array<long>")
    summed = made.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"))
    return {(r["part"], r["entry"]): (r["n"], r["total"]) for r in summed.collect()}


def _assign(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """key, label, code, error of each vector."""
    n_parts, _, width = books.shape
    dim = n_parts * width
    key, label = (blocks.schema[c].dataType.elementType for c in ("keys", "labels"))
    schema = T.StructType([T.StructField("key", key), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    digits = np.array([f"{k:02x}" for k in range(256)])

    def run(batches):
        parts = _Parts(books)
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, low, high, _ = _read(batch, dim)
            points = np.frombuffer(b"".join(batch.column("body").to_pylist()), np.int32).reshape(-1, dim).astype(np.int64)
            first = np.cumsum(sizes) - sizes
            code, error = np.full(len(points), "", f"U{2 * n_parts}"), np.zeros(len(points), np.int64)
            for p in range(n_parts):
                own = points[:, p * width : (p + 1) * width]
                short = parts.shortlists(p, low[:, p * width : (p + 1) * width], high[:, p * width : (p + 1) * width])
                found = np.empty(len(points), np.int64)
                for k, (a, n) in enumerate(zip(first, sizes, strict=True)):
                    left = np.flatnonzero(short[k])
                    found[a : a + n] = left[0] if len(left) == 1 else parts.nearest(p, own[a : a + n], left)
                error += ((own - books[p][found]) ** 2).sum(1)
                code = np.char.add(code, digits[found])
            yield pa.RecordBatch.from_arrays([batch.column("keys").flatten(), batch.column("labels").flatten(), pa.array(code.tolist(), pa.string()), pa.array(error)], schema.names)

    return blocks.select("keys", "labels", "body", "low", "high", "total").mapInArrow(run, schema)


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, np.ndarray]:
    """(key, label, code: two hex digits per part, error: squared distance to the decoded vector), and the codebooks as numbers by part, entry, position."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    rows = whole_numbers(vectors, key, vector, label, scale)
    found = _ranges(rows)
    dim = -(-max(1, len(found)) // parts) * parts
    low, high = (np.array([r[c] for r in found] + [0] * (dim - len(found)), np.int64) for c in ("low", "high"))
    blocks = stage(_blocks(_sorted(rows, low, high, dim), dim, block_rows), "blocks")
    first = rows.orderBy(F.col("key").asc_nulls_last(), "v").limit(entries).collect()
    start = np.zeros((len(first), dim), np.int64)
    for k, r in enumerate(first):
        start[k, : len(r["v"])] = r["v"]
    books = np.ascontiguousarray(start.reshape(len(first), parts, dim // parts).transpose(1, 0, 2))
    if len(first):
        for _ in range(rounds):
            for (p, e), (n, total) in _round(blocks, books).items():
                books[p, e] = [t // n for t in total]
        return _assign(blocks, books), books
    return rows.select("key", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books


def codebooks_hash(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def decode(codes: DataFrame, books: np.ndarray, scale: int = 1024, code: str = "code", into: str = "vector") -> DataFrame:
    """``codes`` with the vector that each code stands for, as doubles."""
    n_parts, n_entries, _ = books.shape
    entry = lambda p: F.conv(F.substring(name(code), 2 * p + 1, 2), 16, 10).cast("int")
    held = [F.array(*[F.array(*[F.lit(x / scale) for x in e]) for e in books[p].tolist()]) for p in range(n_parts)]
    return codes.withColumn(into, F.concat(*[F.element_at(held[p], entry(p) + 1) for p in range(n_parts)]) if n_entries else F.array().cast("array<double>"))


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with the error summed over rows of the same label, nulls together."""
    codes = stage(codes, "codes")
    totals = stage(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    return codes.join(totals, F.col("label").eqNullSafe(F.col("of"))).drop("of")
