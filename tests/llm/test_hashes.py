"""Words that polynomial hashes confuse, and probabilities that are probabilities."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabkit.llm import decontaminate, lmscore, nearjoin, packing, toxicity
from tabkit.llm import queries as Q
from tabkit.llm.text import WHITE, split


def twins(n=1024):
    """A Thue-Morse word and its complement: polynomials modulo a power of two agree on them."""
    word = b"a"
    while len(word) < n:
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    return word.decode(), word.translate(bytes.maketrans(b"ab", b"ba")).decode()


def test_long_words_have_hashes_of_their_own():
    a, b = twins()
    words = [a, b, a[:64], b[:64], a.upper(), "x" * 33, "x" * 32]
    h = split(pa.array([w.encode() for w in words], pa.large_binary()), WHITE).hash
    assert len({*h.tolist()}) == 6 and h[0] == h[4]


def test_operators_tell_such_words_apart(spark):
    a, b = twins()
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a} one"), (4, None)], "doc_id long, text string")
    # 1
    model = lmscore.train(docs.where("doc_id = 1"))
    known = {r["doc_id"]: r["n_known"] for r in lmscore.score(docs, model, keep=["doc_id"]).collect()}
    assert known == {1: 2, 2: 1, 3: 2, 4: 1}
    # 5
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(Q.tokenizer_path())
    for r in packing.pack(docs.where("doc_id < 3"), Q.tokenizer_path()).collect():
        ids = [*tokenizer.encode([a, b][r["doc_id"] - 1], add_special_tokens=False).ids, 1][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    # 8
    assert {r["doc_id"]: r["component_id"] for r in nearjoin.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    # 9
    items = spark.createDataFrame([("i", a)], "item_id string, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.contamination(docs, items, keep=["doc_id"]).collect()} == {1: 1, 2: 0, 3: 1, 4: 0}
    # 3
    _, feature, _, _ = toxicity.features(pa.array([a.encode()], pa.large_binary()))
    _, other, _, _ = toxicity.features(pa.array([b.encode()], pa.large_binary()))
    assert set(feature.tolist()) != set(other.tolist())


def exact_levels(counts):
    """Levels without wrong memberships, by order and hash."""
    return lambda order, h: np.array([lmscore.level_of(np.array([counts[order].get(int(x), 0)]))[0] if counts[order].get(int(x)) else 0 for x in h])


def test_probabilities_sum_up_to_one_at_most():
    texts = ["h w"] * 1400 + [" ".join(f"v{k}" for k in range(12))] * 1000 + ["h x h y"] * 3 + ["w h"] * 7
    flat, first = lmscore.tokens(pa.array([t.encode() for t in texts], pa.large_binary()))
    _, both = lmscore.pairs(flat, first)
    counts = {1: dict(zip(*(x.tolist() for x in np.unique(flat, return_counts=True)))), 2: dict(zip(*(x.tolist() for x in np.unique(both, return_counts=True))))}
    total = len(flat) + len(counts[1]) + 1.0
    level = exact_levels(counts)
    vocabulary = ["h", "w", "x", "y", *[f"v{k}" for k in range(12)], "unseen"]
    for history in ("h", "v3", "w", "unseen"):
        scores = [lmscore.text_scores(*lmscore.tokens(pa.array([t.encode()], pa.large_binary())), level, total)[0] for t in [history, *[f"{history} {w}" for w in vocabulary]]]
        assert all(s < 0 for s in scores)
        start, ends = 0.0, []
        for w in [None, *vocabulary]:  # the term of w after the history, by taking the other terms off
            t = history if w is None else f"{history} {w}"
            f, o = lmscore.tokens(pa.array([t.encode()], pa.large_binary()))
            one = np.log10(1.0)
            for k in range(1, 2):
                h, pair = lmscore.pairs(f, o)
                p = (lmscore.least_of(level(1, f[k : k + 1])) + 1) / total
                before = lmscore.most_of(level(1, h[k : k + 1]))
                one = ((np.minimum(lmscore.least_of(level(2, pair[k : k + 1])), before) + lmscore.M * p) / (before + lmscore.M))[0]
            ends.append(one)
            start += one
        assert 0 < start <= 1 + 1e-12 and all(0 < x <= 1 for x in ends)


def test_scores_are_log_probabilities(spark):
    rows = [(k, "h w") for k in range(1400)] + [(2000 + k, " ".join(f"v{i}" for i in range(12))) for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lmscore.train(docs)
    asked = spark.createDataFrame([(1, " ".join(["h w"] * 40)), (2, "h w"), (3, ""), (4, "w h"), (5, "new words here")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in lmscore.score(asked, model, keep=["doc_id"]).collect()}
    assert all(s < 0 for s in score.values()) and score[1] < score[2] and score[4] < score[2]


def test_levels_hold_their_counts():
    counts = np.arange(1, 5000)
    level = lmscore.level_of(counts)
    assert (lmscore.least_of(level) <= counts).all() and (counts <= lmscore.most_of(level)).all()
    assert all(lmscore.most_of(a) + 1 == lmscore.least_of(b) for a, b in itertools.pairwise(sorted({*level.tolist()})) if lmscore.least_of(a) <= lmscore.most_of(a))
    assert lmscore.least_of(np.array([0]))[0] == lmscore.most_of(np.array([0]))[0] == 0
    assert pytest.approx(1.5) == lmscore.BASE
