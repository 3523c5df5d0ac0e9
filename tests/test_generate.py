"""Generation runs that are cut off and go on, and the steps they note."""

import collections
import os
import uuid

import pytest

from tabkit.plans.generate import generate
from tabkit.plans.ledger import Ledger
from tabkit.plans.queries_generate import echo_model
from tabkit.sources.tables import read_table


def logged(folder):
    """The echoing model, which notes every prompt it is asked."""
    echo = echo_model("c_custkey")
    path = str(folder)

    def model(prompts, max_tokens):
        import hashlib
        import uuid

        with open(f"{path}/{uuid.uuid4().hex}", "w") as f:
            f.writelines(hashlib.md5(p.encode()).hexdigest() + "\n" for p in prompts)
        return echo(prompts, max_tokens)

    return model


def calls(folder):
    return collections.Counter(line for name in os.listdir(folder) for line in open(f"{folder}/{name}").read().split())


OPTIONS = {"k_shot": 6, "rows_per_prompt": 3, "prompts_per_batch": 15, "first_prompts": 10, "representative_threshold": None, "correlations": False, "seed": 3}


class Lost(Exception):
    pass


@pytest.mark.parametrize("lost_after", [4])
def test_a_run_that_was_cut_off_goes_on(spark, data, tmp_path, monkeypatch, lost_after):
    train = read_table(spark, f"{data}/customer.parquet")
    whole, part = tmp_path / "whole", tmp_path / "part"
    whole.mkdir()
    part.mkdir()
    want, _ = generate(train, logged(whole), 150, ["c_custkey"], **OPTIONS)
    want = want.collect()
    once = calls(whole)
    assert len(want) == 150 and set(once.values()) == {1}

    run_id = uuid.uuid4().hex
    noted = []

    def note(self, step, path, schema, keep=Ledger._note):
        if len(noted) == lost_after:
            raise Lost  # the table is written, its note is not
        noted.append(step)
        keep(self, step, path, schema)

    with monkeypatch.context() as m:
        m.setattr(Ledger, "_note", note)
        with pytest.raises(Lost):
            generate(train, logged(part), 150, ["c_custkey"], run_id=run_id, **OPTIONS)
    before = calls(part)
    got, _ = generate(train, logged(part), 150, ["c_custkey"], run_id=run_id, **OPTIONS)
    assert got.collect() == want
    after = calls(part)
    assert after.keys() == once.keys()
    twice = [p for p, n in after.items() if n > 1]
    assert len(twice) <= OPTIONS["prompts_per_batch"] and set(twice) <= before.keys()  # the batch that was under way, at most
    answered = sum(s.endswith("-texts") for s in noted)
    assert sum(before.values()) - len(twice) == sum([10, 15, 15, 15, 15][:answered])

    third, _ = generate(train, logged(part), 150, ["c_custkey"], run_id=run_id, **OPTIONS)
    assert third.collect() == want and calls(part) == after  # a finished run asks nothing
    with pytest.raises(ValueError, match="other settings"):
        generate(train, logged(part), 151, ["c_custkey"], run_id=run_id, **OPTIONS)


def test_rounds_do_not_grow_with_the_rows(spark, data, tmp_path):
    train = read_table(spark, f"{data}/customer.parquet")
    for n_rows in (1200,):
        run_id = uuid.uuid4().hex
        rows, _ = generate(train, echo_model("c_custkey"), n_rows, ["c_custkey"], run_id=run_id, **{**OPTIONS, "prompts_per_batch": 1000})
        assert rows.count() == n_rows
        settings = Ledger(spark, uuid.uuid4().hex)
        notes = spark.read.parquet(os.path.join(os.path.dirname(settings.folder), run_id, "notes")).collect()
        assert len({r["step"].split("-")[1] for r in notes if r["step"].startswith("round")}) <= 3


def test_ledger_reads_whole_steps_only(spark):
    ledger = Ledger(spark, uuid.uuid4().hex, {"a": 1})
    made = []

    def make():
        made.append(1)
        return spark.range(7).selectExpr("id", "id % 2 AS odd")

    assert ledger.step("one", make).count() == 7 and not ledger.has("two")
    again = Ledger(spark, os.path.basename(ledger.folder), {"a": 1})
    assert again.step("one", make).columns == ["id", "odd"] and again.rows("one") == 7 and len(made) == 1
    assert again.step("none", lambda: spark.range(0)).count() == 0 and again.rows("none") == 0
    with pytest.raises(ValueError):
        Ledger(spark, os.path.basename(ledger.folder), {"a": 2})
    with pytest.raises(ValueError):
        Ledger(spark, "../elsewhere")
