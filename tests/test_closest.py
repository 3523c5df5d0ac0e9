"""What the search for the closest record writes."""

import os

import numpy as np
import pytest

from tabkit import session
from tabkit.operators import metrics as N


def test_neighbouring_blocks_meet_their_leaves_together_and_steps_are_deleted(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(2)
    rows = [(i, "real" if i % 2 else "synthetic", *map(float, rng.uniform(0, 1, 3)), str(rng.integers(0, 4))) for i in range(1600)]
    df = spark.createDataFrame(rows, "id int, dataset string, x double, y double, z double, c string")
    met, steps = [], []

    def counted(step, name="step"):
        out = session.materialize(step, name)
        steps.append((name, os.path.dirname(out.inputFiles()[0]).removeprefix("file://")))
        if name in ("dcr-pairs", "dcr-met"):
            met.append((name, out.select("block").distinct().count(), out.count()))
        return out

    monkeypatch.setattr(N, "materialize", counted)
    got = {r["id"]: r["dcr"] for r in N.closest_record_distance(df, "id", ["x", "y", "z"], ["c"], "real", "synthetic", 8, 4).collect()}
    real = [r for r in rows if r[1] == "real"]
    x, c = np.array([r[2:5] for r in real]), np.array([r[5] for r in real])
    span = x.max(0) - x.min(0)
    for r in rows:
        if r[1] == "synthetic":
            assert got[r[0]] == pytest.approx((np.abs(x - r[2:5]) / span).sum(1).__add__(c != r[5]).min(), abs=1e-9)
    walked = [m for a, m in zip(met, met[1:]) if a[0] == "dcr-pairs" and m[0] == "dcr-met"]
    before = [a for a, m in zip(met, met[1:]) if a[0] == "dcr-pairs" and m[0] == "dcr-met"]
    assert len(walked) == 2 and walked[0][1] * 4 <= before[0][1] and walked[1][2] < before[1][2]
    left = {name for name, path in steps if os.path.exists(path)}
    assert left <= {"dcr-rows", "dcr-searched", "dcr-best", "dcr-summaries"}


def test_only_steps_are_deleted(spark, tmp_path):
    own = str(tmp_path / "own")
    spark.range(5).write.parquet(own)
    step = session.materialize(spark.read.parquet(own), "some")
    folder = os.path.dirname(step.inputFiles()[0]).removeprefix("file://")
    session.discard(spark.read.parquet(own), step)
    assert spark.read.parquet(own).count() == 5 and not os.path.exists(folder)
