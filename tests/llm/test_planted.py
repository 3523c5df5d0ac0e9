"""Planted passages of 51 to 100 words, by the routes of large tables, against brute force."""

import random

import pytest
from test_llm import plain, repeats

from tabkit.llm import suffixdedup
from tabkit.llm.queries import QUERIES


@pytest.mark.parametrize("hot", [suffixdedup.HOT, 20])
def test_planted_passages_by_the_shuffled_route(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixdedup, "SPANS_BROADCAST", 0)
    monkeypatch.setattr(suffixdedup, "BLOCK", 20_000)
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("etaoinshrdlu" * 4 + "äß😀") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randint(51, 100)) for _ in range(80)]
    common = prose(90)
    texts = [f"{prose(60)} {p} {prose(40)}" for p in passages for _ in range(2)] + [f"{prose(30)} {common} {prose(30)}" for _ in range(60)] + [prose(200) for _ in range(40)]
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string").repartition(6)
    rows = suffixdedup.remove_repeats(docs, hot=hot).collect()
    want = list(repeats([plain(r["text"]) for r in rows], suffixdedup.LENGTH))
    assert [(r["n_bytes"], sum(x["end"] - x["start"] for x in r["removed"]), len(r["removed"]), bytes(r["kept"])) for r in rows] == want
    kept = {r["doc_id"]: bytes(r["kept"]).decode("utf-8", "ignore") for r in rows}
    long = [k for k, p in enumerate(passages) if len(p.encode()) >= suffixdedup.LENGTH]
    assert 20 < len(long) < 70
    assert all(passages[k] not in kept[2 * k + i] for k in long for i in (0, 1))  # every passage of 400 bytes is cut
    # A shorter one goes only where equal bytes around it fill it up.
    assert all(passages[k] in kept[2 * k] for k, p in enumerate(passages) if len(p.encode()) < suffixdedup.LENGTH - 8)
    assert all(common not in kept[160 + k] for k in range(60)) and all(kept[220 + k] == texts[220 + k] for k in range(40))


@pytest.mark.parametrize("hot", [suffixdedup.HOT, 20])
@pytest.mark.parametrize("length,mark", [(400, 256), (320, 230), (140, 96), (400, 400)])
def test_shorter_repeats_are_marked_in_the_same_pass(spark, monkeypatch, hot, length, mark):
    monkeypatch.setattr(suffixdedup, "SPANS_BROADCAST", 0)
    monkeypatch.setattr(suffixdedup, "BLOCK", 20_000)
    rng = random.Random(length + mark)
    prose = lambda n: "".join(rng.choice("abcdefgh" * 9 + "äß😀 ") for _ in range(n))
    shared = [prose(rng.randint(mark // 2, length + 60)) for _ in range(60)]
    parts = [prose(rng.choice([mark // 3, mark, length // 2])) for _ in range(9)]
    texts = [prose(rng.randint(0, 300)) + p + prose(rng.randint(0, 300)) for p in shared for _ in range(rng.randint(1, 3))]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(40)] + [shared[0], shared[0], shared[1] + shared[2], "", None]
    docs = spark.createDataFrame([(i % 90, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    rows = suffixdedup.remove_repeats(docs, hot=hot, length=length, mark=mark).collect()
    bodies = [plain(r["text"]) for r in rows]
    covered = lambda runs: sum(x["end"] - x["start"] for x in runs)
    got = [(r["n_bytes"], covered(r["removed"]), len(r["removed"]), bytes(r["kept"])) for r in rows]
    assert got == list(repeats(bodies, length))
    marked = [(r["n_bytes"], covered(r["repeated"]), len(r["repeated"])) for r in rows]
    assert marked == [w[:3] for w in repeats(bodies, mark)] and sum(m[1] for m in marked) > 0


def test_op2_shows_passages_of_over_50_words(spark, tmp_path):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(4, 7))) for _ in range(n))
    passages = [prose(rng.randint(51, 58)) for _ in range(40)]
    texts = [f"{prose(60)} {p} {prose(40)}" for p in passages for _ in range(2)] + [prose(170) for _ in range(60)]
    spark.createDataFrame(enumerate(texts), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in QUERIES["op2_suffixdedup"].run(spark, str(tmp_path)).collect()}
    assert all(256 <= len(p) < 400 <= len(texts[0]) for p in passages)
    assert all(rows[k]["n_repeated"] >= len(passages[k // 2]) and rows[k]["n_removed"] == 0 for k in range(80))
    assert all(rows[k]["n_repeated"] == 0 for k in range(80, 140))
