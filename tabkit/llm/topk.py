"""Exact top-k by inner product: tiles of queries times shards of rows, partial selection per tile, tree of merges.

Components become whole numbers floor(scale * x). Rows are packed into shards (a matrix of the narrowest whole numbers, and its ids) where they
lie, queries into tiles likewise. Shards are dealt to groups and tiles to parts; both are copied to the cells of that grid and meet there after a
shuffle, never by a broadcast: tiles are a share of the table, and their copies more. The grid is the one with the fewest bytes to copy. A cell keeps the
best k of each query over its shards; these lists are merged a few groups at a time until one list per query is left, so no task sees more than ``FAN`` lists of a tile.

Products are exact: floats while every sum stays below 2**24, doubles below 2**53, 64-bit whole numbers beyond. Ties go to the smaller id.
Vectors that are null, hold null, non-finite components or such beyond 62 bits after scaling, or have a null id take no part.
Vectors meet only vectors of their own length. A query's own id is no candidate; if a query id is repeated, the smallest
vector counts as the query. Repeated candidates each count. A query without candidates has no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.llm.common import name, shuffle_width, stage

SHARD_BYTES = 4 << 20  # a shard's matrix
TILE = 512  # queries in a tile
FAN = 16  # lists merged at once
CELL_SHARDS, CELL_TILES = 8, 128  # that a cell of the grid has on average, at most
RUN = 64  # scores of which the best bounds a row's k best
NONE = np.iinfo(np.int64).min + 1  # can be negated

_BLOCK = "dim int, block long, ids binary, body binary"


def _pack(rows: DataFrame, scale: int, most_rows) -> DataFrame:
    """(id, vector) rows to blocks of whole-number matrices, ids ascending, without a shuffle."""

    def run(batches):
        from pyspark import TaskContext

        waiting: dict[int, list] = {}
        made = TaskContext.get().partitionId() << 32

        def emit(dim, parts):
            nonlocal made
            ids, body = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(ids, kind="stable")
            size = most_rows(dim)
            for a in range(0, len(order), size):
                o = order[a : a + size]
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([made], pa.int64()), pa.array([ids[o].tobytes()], pa.binary()), pa.array([_narrow(body[o]).tobytes()], pa.binary())], ["dim", "block", "ids", "body"])
                made += 1

        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), batch.column(1)
            length = np.diff(vectors.offsets.to_numpy())
            values = vectors.flatten().to_numpy()
            first = np.concatenate([[0], np.cumsum(length)])
            for dim in np.unique(length).tolist():
                rows_of = np.flatnonzero(length == dim)
                body = np.floor(values[first[rows_of][:, None] + np.arange(dim)] * scale)
                ok = (np.isfinite(body) & (np.abs(body) < 2.0**62)).all(1)
                waiting.setdefault(dim, []).append((ids[rows_of][ok], body[ok].astype(np.int64)))
                if sum(len(p[0]) for p in waiting[dim]) >= most_rows(dim):
                    yield from emit(dim, waiting.pop(dim))
        for dim, parts in waiting.items():
            yield from emit(dim, parts)

    return rows.mapInArrow(run, _BLOCK)


def _narrow(body: np.ndarray) -> np.ndarray:
    lo, hi = int(body.min(initial=0)), int(body.max(initial=0))
    return body.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k best (score, id), best first; ids ascend along the columns."""
    if scores.shape[1] > k:
        n_rows, n_runs = len(scores), scores.shape[1] // RUN
        if n_runs >= k:  # the k-th best run has a score no better than the k-th best score
            runs = scores[:, : n_runs * RUN].reshape(n_rows, n_runs, RUN).max(2)
            row, column = np.nonzero(scores >= np.partition(runs, n_runs - k, axis=1)[:, n_runs - k][:, None])
            if len(row) <= scores.size // RUN:
                found = scores[row, column]
                order = np.lexsort((column, -found, row))
                first = np.searchsorted(row, np.arange(n_rows))
                take = order[(first[:, None] + np.arange(k)).reshape(-1)]
                return found[take].reshape(n_rows, k), ids[column[take]].reshape(n_rows, k)
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k:].min(1)[:, None]
        above = scores > least
        level = scores == least
        take = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(1)[:, None]))
        column = np.nonzero(take)[1].reshape(len(scores), k)
        scores, ids = np.take_along_axis(scores, column, 1), ids[column]
    else:
        ids = np.broadcast_to(ids, scores.shape)
    order = np.argsort(-scores, axis=1, kind="stable")  # columns are in id order, hence ties too
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _product(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact scores: no sum of a row's products passes the product of the lengths of its vectors."""
    widest = max(float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (queries, rows))
    bound = float(np.prod([np.sqrt(np.square(x.astype(np.float64)).sum(1).max(initial=0)) for x in (queries, rows)])) * 1.001
    for kind, most in ((np.float32, 2.0**24), (np.float64, 2.0**53)):
        if max(bound, widest) < most:
            return queries.astype(kind) @ rows.astype(kind).T
    return queries.astype(np.int64) @ rows.astype(np.int64).T


def _matrix(ids: bytes, body: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(body, f"i{len(body) // (len(ids) * dim) if dim else 8}").reshape(len(ids), dim)


def _search(k: int):
    def search(shards: pa.Table, tiles: pa.Table) -> pa.Table:
        shards = [(r["grp"], *_matrix(r["ids"], r["body"], r["dim"])) for r in shards.to_pylist()] if tiles.num_rows else []
        out = []
        for row in tiles.to_pylist() if shards else []:
            query, left = _matrix(row["ids"], row["body"], row["dim"])
            kept = []
            for _, ids, right in shards:
                scores = _product(left, right)
                lo, hi = np.searchsorted(ids, query, "left"), np.searchsorted(ids, query, "right")
                for q in np.flatnonzero(hi > lo):
                    scores[q, lo[q] : hi[q]] = NONE if scores.dtype == np.int64 else -np.inf
                best, who = _best(scores, ids, k)
                del scores
                kept = [_better([*kept, (_whole(best), who)], k)]
            out.append((row["block"], shards[0][0], query.tobytes(), *(x.tobytes() for x in kept[0])))
        return pa.table([pa.array(x, t) for x, t in zip(list(zip(*out)) or [[]] * 5, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["tile", "slot", "queries", "scores", "ids"])

    return search


def _whole(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == np.int64:
        return scores
    out = np.full(scores.shape, NONE)
    some = scores > -np.inf
    out[some] = scores[some].astype(np.int64)
    return out


def _better(lists: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k best (score, id) of several lists."""
    scores, ids = (np.concatenate(x, axis=1) for x in zip(*lists, strict=True))
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


_LISTS = "tile long, slot long, queries binary, scores binary, ids binary"


def _merge(k: int):
    def merge(table: pa.Table) -> pa.Table:
        parts = table.to_pylist()
        n = len(parts[0]["queries"]) // 8
        scores, ids = _better([tuple(np.frombuffer(p[c], np.int64).reshape(n, -1) for c in ("scores", "ids")) for p in parts], k)
        return pa.table([pa.array([parts[0][c]], pa.int64()) for c in ("tile", "slot")] + [pa.array([x], pa.binary()) for x in (parts[0]["queries"], scores.tobytes(), ids.tobytes())], names=["tile", "slot", "queries", "scores", "ids"])

    return merge


def _grid(n_shards: int, shard_size: int, n_tiles: int, tile_size: int, tasks: int) -> tuple[int, int]:
    """(groups of shards, parts of tiles): about ``tasks`` cells or as many as bounded cells take, with the fewest bytes to copy."""
    n_shards, n_tiles = max(1, n_shards), max(1, n_tiles)
    least = -(-n_shards // CELL_SHARDS), -(-n_tiles // CELL_TILES)
    grids = ((min(n_shards, max(least[0], -(-tasks // parts))), parts) for parts in range(least[1], n_tiles + 1))
    return min(grids, key=lambda g: (2 * g[0] * g[1] < min(tasks, n_shards * n_tiles), g[1] * shard_size + g[0] * tile_size))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024, tile: int = TILE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of ``queries`` its k best among ``vectors``, its own id left out."""

    def usable(df):
        df = df.select(name(key).cast("long").alias("id"), name(vector).cast("array<double>").alias("v"))
        return df.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))

    shards = stage(_pack(usable(vectors), scale, lambda dim: max(1, shard_bytes // 8 // max(1, dim))), "shards")
    own = usable(queries).groupBy("id").agg(F.min("v").alias("v"))
    tiles = stage(_pack(own.coalesce(max(1, shuffle_width(vectors) // 4)), scale, lambda dim: tile), "tiles")
    size = lambda blocks: blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("ids") * F.col("dim")), F.lit(0))).first()
    groups, parts = _grid(*size(shards), *size(tiles), shuffle_width(vectors))
    place = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shards = shards.select("dim", "ids", "body", place(groups).alias("grp"), copies(parts).alias("part"))
    tiles = tiles.select("dim", "block", "ids", "body", copies(groups).alias("grp"), place(parts).alias("part"))
    lists = shards.groupBy("grp", "part", "dim").cogroup(tiles.groupBy("grp", "part", "dim")).applyInArrow(_search(k), _LISTS)
    slots = math.ceil(groups / FAN)
    lists = lists.withColumn("slot", F.floor(F.col("slot") / FAN))
    while True:  # at most FAN lists of a tile meet; as many rounds as the number of groups asks for
        lists = lists.groupBy("tile", "slot").applyInArrow(_merge(k), _LISTS)
        if slots == 1:
            break
        slots = math.ceil(slots / FAN)
        lists = lists.withColumn("slot", F.floor(F.col("slot") / FAN))

    def rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                query = np.frombuffer(row["queries"], np.int64)
                scores, ids = (np.frombuffer(row[c], np.int64).reshape(len(query), -1) for c in ("scores", "ids"))
                q, place = np.nonzero(scores != NONE)
                yield pa.RecordBatch.from_arrays([pa.array(query[q]), pa.array(place + 1, pa.int32()), pa.array(ids[q, place]), pa.array(scores[q, place])], ["query_id", "rank", "vec_id", "score"])

    return lists.mapInArrow(rows, "query_id long, rank int, vec_id long, score long")
