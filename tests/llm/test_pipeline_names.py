"""Stages give back the user's columns whatever their names, and cut planted passages of 51 to 70 words."""

import random

import pytest
from pyspark.sql import functions as F

from tabkit.llm import decontaminate, suffixdedup, toxicity

NAMES = ["body", "doc", "kept", "removed", "text_hash", "n_bytes", "score", "predicted", "evidence", "n_words", "items", "hit_runs", "spans", "carried", "place", "row", "node", "root", "id", "label"]


def words(rng, n, size=10**6):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def named(spark):
    rng = random.Random(7)
    shared = words(rng, 120)
    texts = [words(rng, 100) + " " + shared + " " + words(rng, 30) for _ in range(3)] + [words(rng, 80) for _ in range(20)] + [None, ""]
    rows = [(k, t, "en", "s", 1, *[f"{c}{k}" for c in NAMES]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in NAMES))


@pytest.mark.parametrize("number", range(4))
def test_stages_keep_columns_of_any_name(spark, data, named, number):
    import corpus_pipeline as c

    label, function = c.STAGES[number]
    left = function(spark, named, data)
    assert left.columns == named.columns, label
    given = {r["doc_id"]: r for r in named.collect()}
    got = left.collect()
    assert len(got) == len({r["doc_id"] for r in got}) > 15
    for r in got:
        assert all(r[n] == given[r["doc_id"]][n] for n in [*NAMES, "lang", "source"])
        assert number == 2 or r["text"] == given[r["doc_id"]]["text"]
    if number == 2:
        assert sum(len(r["text"] or "") < len(given[r["doc_id"]]["text"] or "") for r in got) == 3


def test_passages_of_51_to_70_words_are_cut(spark, data):
    import corpus_pipeline as c

    rng = random.Random(11)
    letters = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 9)))
    prose = lambda n: " ".join(letters() for _ in range(n))
    passages = [prose(51 + k % 20) for k in range(60)]
    assert min(len(p) for p in passages) > c.REPEAT + 7
    texts = [f"{prose(80)} {p} {prose(60)}" for p in passages for _ in range(2)] + [prose(150) for _ in range(100)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in c.cut_repeats(spark, docs, data).collect()}
    for k, t in enumerate(texts):
        if k < 120:
            assert passages[k // 2] not in got[k]["text"]
            assert len(t) - len(got[k]["text"]) >= len(passages[k // 2])
            assert len(t) - len(got[k]["text"]) <= len(passages[k // 2]) + 4  # and nothing but the passage with what happens to equal around it
        else:
            assert got[k]["text"] == t
        assert got[k]["n_chars"] == len(got[k]["text"])


def test_toxicity_with_textual_keys(spark):
    rng = random.Random(2)
    rows = [(f"d{k}", words(rng, 30, 200) + (" vile vile awful" if k % 4 == 0 else "")) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{k}", int(k % 4 == 0)) for k in range(200)], "doc_id string, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert all(r["predicted"] == int("vile" in r["text"]) for r in scored)
    assert any(e["doc_id"].startswith("d") for r in scored for e in r["evidence"])
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).where("score > 0").count() == 0


def test_operators_keep_other_columns(named, spark):
    cut = suffixdedup.remove_repeats(named, keep=["doc_id", "body", "doc", "spans", "carried"])
    assert cut.columns == ["doc_id", "body", "doc", "spans", "carried", "n_bytes", "removed", "kept"]
    assert cut.where(F.size("removed") > 0).count() == 3
    benchmark = spark.createDataFrame([("a", "no such words")], "item_id string, text string")
    assert decontaminate.find_items(named, benchmark).where(F.size("items") > 0).count() == 0
