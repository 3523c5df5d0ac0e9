"""How tiles and shards of op4_topk meet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabkit.llm import topk


def vectors(spark, n=900, dim=6):
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(i, [float(x) for x in rng.integers(-3, 4, dim) / 4]) for i in range(n)], "vec_id long, embedding array<float>")


def test_copies_of_the_queries_are_never_gathered_on_the_driver(spark):
    """Spark knows the files of the tiles, not how often they are copied, and broadcast the copies."""
    df = vectors(spark)
    found = topk.top_k(df, df, tile=50, shard_bytes=48 * 20)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    x = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()]) * 1024
    scores = np.floor(x).astype(np.int64) @ np.floor(x).astype(np.int64).T
    np.fill_diagonal(scores, -(2**62))
    want = {q: [(int(v), int(scores[q, v])) for v in np.lexsort((np.arange(len(x)), -scores[q]))[:10]] for q in range(len(x))}
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == want


@pytest.mark.parametrize("high", [3, 2000])
def test_best_is_the_same_by_runs(high):
    rng = np.random.default_rng(7)
    scores = rng.integers(0, high, (20, 3000)).astype(np.float32)
    scores[0] = -np.inf
    ids = np.arange(3000) * 3
    best, who = topk._best(scores.copy(), ids, 10)
    for q in range(1, 20):
        order = np.lexsort((ids, -scores[q]))[:10]
        assert best[q].tolist() == scores[q, order].tolist() and who[q].tolist() == ids[order].tolist()
    assert (topk._whole(best)[0] == topk.NONE).all()


def test_grid_keeps_cells_and_copies_bounded():
    assert topk._grid(11, 100, 2, 1, 12) == (11, 1)
    groups, parts = topk._grid(440, 100, 70, 1, 600)
    assert groups * parts >= 600 and parts * 100 + groups <= 520
    groups, parts = topk._grid(10_000, 100, 10_000, 100, 12)  # all vectors are queries and tasks are few
    assert -(-10_000 // groups) <= topk.CELL_SHARDS and -(-10_000 // parts) <= topk.CELL_TILES
    assert topk._grid(0, 0, 0, 0, 8) == (1, 1)


def test_matrices_take_few_bytes_and_stay_exact():
    for body in (np.array([[1, -128]]), np.array([[200, -1]]), np.array([[2**20, 7]]), np.array([[2**40, -(2**61)]])):
        assert (topk._matrix(np.arange(1).tobytes(), topk._narrow(body).tobytes(), 2)[1] == body).all()
    for size in (2**11, 2**20, 2**30):
        q, v = np.array([[size, 3]]), np.array([[size, 1], [-1, size]])
        assert (topk._product(q, v).astype(np.int64) == q @ v.T).all()
