"""Batches of a generation run: asked a few at once, each from its own files."""

import os
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor

import pytest

from tabkit.plans import generate as G
from tabkit.plans.ledger import Ledger
from tabkit.plans.queries_generate import echo_model
from tabkit.sources.tables import read_table

OPTIONS = {"k_shot": 4, "rows_per_prompt": 2, "prompts_per_batch": 10, "first_prompts": 10, "representative_threshold": None, "correlations": False, "seed": 3}


@pytest.mark.parametrize("bound", [None, 2])
def test_batches_are_asked_a_few_at_once_from_their_own_files(spark, data, monkeypatch, bound):
    train = read_table(spark, f"{data}/customer.parquet")
    lock, now, most, plans = threading.Lock(), [0], [0], []

    def step(self, name, make, by=None, keep=Ledger.step):
        if not name.endswith("-texts"):
            return keep(self, name, make, by)
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        try:
            return keep(self, name, make, by)
        finally:
            with lock:
                now[0] -= 1

    def complete(prompts, *args, keep_as=G.complete, **kwargs):
        plans.append(prompts._jdf.queryExecution().executedPlan().toString())
        return keep_as(prompts, *args, **kwargs)

    monkeypatch.setattr(Ledger, "step", step)
    monkeypatch.setattr(G, "complete", complete)
    rows, _ = G.generate(train, echo_model("c_custkey"), 100, ["c_custkey"], max_concurrency=bound, **OPTIONS)
    assert rows.count() == 100 and len(plans) > 5
    assert all("batch" in p.split("PartitionFilters: [")[1].split("]")[0] for p in plans)
    assert most[0] == 1 if bound else 1 < most[0] <= G.UNDER_WAY


def test_a_failing_batch_ends_the_run_and_no_other_begins(spark):
    begun = []

    def work(k):
        begun.append(k)
        if k == 1:
            raise KeyError(k)

    with pytest.raises(KeyError):
        G._all(spark, work, 100, 1)
    assert begun[:2] == [0, 1] and len(begun) < 100


def test_steps_made_at_once_are_all_noted(spark):
    ledger = Ledger(spark, uuid.uuid4().hex, {"a": 1})
    with ThreadPoolExecutor(8) as threads:
        list(threads.map(lambda k: ledger.step(f"step-{k}", lambda: spark.range(k)), range(24)))
    again = Ledger(spark, os.path.basename(ledger.folder), {"a": 1})
    assert {k: again.rows(f"step-{k}") for k in range(24)} == {k: k for k in range(24)}
    parted = again.step("parted", lambda: spark.range(9).selectExpr("id", "id % 3 AS batch"), by="batch")
    assert parted.where("batch = 1").select("id").orderBy("id").collect() == [(1,), (4,), (7,)] and again.rows("parted") == 9
