"""Product codes of vectors against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from tabkit.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, key string, code string, error int, place string, tie int, part int"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """rows of (id, vector, label) -> codes, errors in the order of the kept rows, codebooks."""
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * float(x)) for x in v], label))
    dim = -(-max([1, *(len(v) for _, v, _ in kept)]) // parts) * parts
    width = dim // parts
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fill = lambda v: v + [0] * (dim - len(v))
    books = [[fill(r[1])[p * width : (p + 1) * width] for r in order[:entries]] for p in range(parts)]
    points = [fill(r[1]) for r in kept]

    def nearest(p, v):
        own = v[p * width : (p + 1) * width]
        d = [sum((a - b) ** 2 for a, b in zip(own, e, strict=True)) for e in books[p]]
        k = d.index(min(d))
        return k, d[k]

    for _ in range(rounds):
        for p in range(parts):
            met = {}
            for v in points:
                met.setdefault(nearest(p, v)[0], []).append(v[p * width : (p + 1) * width])
            for k, own in met.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for (i, _, label), v in zip(kept, points, strict=True):
        found = [nearest(p, v) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found)))
    return out, books


def some_rows(n=150, dim=8, seed=1, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(dim)] for _ in range(5)]
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f32([c + rng.gauss(0, spread / 5) for c in rng.choice(centres)]), rng.choice([None, 0, 1])) for i in range(n)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(40)]  # one very common vector
    rows += [rows[3], rows[3], (None, rows[5][1], None), (3, rows[9][1], 0)]  # repeated rows and ids, no id
    rows += [(2000, None, 1), (2001, [*rows[0][1][:-1], None], 1), (2002, [*rows[0][1][:-1], math.nan], 1), (2003, [*rows[0][1][:-1], -math.inf], 1), (2004, [], 1), (2005, rows[0][1][:3], 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "c", 5, "p", 6, 7) for r in rows], SCHEMA).repartition(5, "vec_id")


@pytest.mark.parametrize("entries, block_rows, spread", [(256, 128, 1.0), (12, 7, 1.0), (12, 16, 2500.0)])
def test_codes_match_brute_force(spark, entries, block_rows, spread):
    rows = some_rows(spread=spread)
    want, books = brute(rows, entries=entries)
    made, got = codes.compress(frame(spark, rows), entries=entries, block_rows=block_rows)
    assert got.tolist() == books
    have = [(r["key"], r["label"], r["code"], r["error"]) for r in made.collect()]
    plain = lambda rs: sorted(rs, key=str)
    assert plain(have) == plain(want)
    text = ",".join(str(x) for p in books for e in p for x in e)
    assert codes.codebooks_hash(got) == hashlib.sha256(text.encode()).hexdigest()
    totals = {}
    for _, label, _, error in want:
        totals[label] = totals.get(label, 0) + error
    summed = codes.with_label_error(made).collect()
    assert len(summed) == len(want) and all(r["label_error"] == totals[r["label"]] for r in summed)


def test_codes_decode_to_their_entries(spark):
    rows = some_rows(60)
    made, books = codes.compress(frame(spark, rows), entries=10)
    for r in codes.decode(made, books).collect():
        want = [x / 1024 for p in range(4) for x in books[p][int(r["code"][2 * p : 2 * p + 2], 16)].tolist()]
        assert r["vector"] == want


def test_codes_of_empty_and_extreme_tables(spark):
    made, books = codes.compress(frame(spark, []))
    assert made.collect() == [] and books.shape[1] == 0
    assert codes.with_label_error(made).collect() == []
    assert codes.codebooks_hash(books) == hashlib.sha256(b"").hexdigest()
    only_bad, _ = codes.compress(frame(spark, [(1, None, 1), (2, [math.nan], 2)]))
    assert only_bad.count() == 0
    with pytest.raises(Exception, match="no exact squared distance"):
        codes.compress(frame(spark, [(1, [1e9, 0.0], 1)]))
    textual, _ = codes.compress(spark.createDataFrame([("b", [1.0, 2.0, 3.0, 4.0], "x"), ("a", [1.0, 2.0, 3.0, 5.0], None)], "id string, v array<double>, kind string"), "id", "v", "kind")
    assert sorted((r["key"], r["code"], r["error"]) for r in textual.collect()) == [("a", "00000000", 0), ("b", "00000001", 0)]


def test_hilbert_curve_visits_neighbours():
    for dim, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dim, indexing="ij"), -1).reshape(-1, dim)
        place = [bytes(p) for p in codes.hilbert(cells, bits)]
        assert len(set(place)) == len(cells)
        walk = cells[np.array(sorted(range(len(cells)), key=place.__getitem__))]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_shortlists_hold_the_nearest_entries():
    rng = np.random.RandomState(3)
    books = rng.randint(-50, 50, (1, 40, 4)).astype(np.int64)
    parts = codes._Parts(books)
    smaller = 0
    for _ in range(50):
        points = rng.randint(-60, 60, 4) + rng.randint(-5, 6, (20, 4))
        short = np.flatnonzero(parts.shortlists(0, points.min(0)[None], points.max(0)[None])[0])
        distance = ((points[:, None] - books[0]) ** 2).sum(2)
        assert (parts.nearest(0, points, short) == distance.argmin(1)).all()
        assert (parts.nearest(0, points * (1 << 20), np.arange(40)) == ((points[:, None] * (1 << 20) - books[0]) ** 2).sum(2).argmin(1)).all()
        smaller += len(short) < 40
    assert smaller > 40


def test_codes_need_one_shuffle_of_vectors(spark):
    rows = codes.whole_numbers(frame(spark, some_rows(20)), "vec_id", "embedding", "label", 1024)
    plan = codes._sorted(rows, np.zeros(8, np.int64), np.ones(8, np.int64), 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan
