"""Line labelling and base counts against plain Python, exhaustive search and held-out labels."""

import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tabkit.llm import quality
from tabkit.llm.common import remainder

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id string, text string, kept string, content array<int>, hash long, n_words string, codes int, label int"


def counts(text):
    text = text or ""
    words = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def odd_texts():
    rng = random.Random(4)
    words = lambda n, size: " ".join(f"w{rng.randrange(size)}" for _ in range(n))
    flip = bytes.maketrans(b"ab", b"ba")
    odd = b"a"
    while len(odd) < 1024:
        odd += odd.translate(flip)
    pair = (odd.decode(), odd.translate(flip).decode())  # two words that weak hashes confuse
    base = words(30, 10**6)
    texts = [None, "", " \t\n\n", "é", "a\na\na", "a\r\na\n a", "x y " * 4, "x y " * 3 + "x", base, base + "\n" + base, words(400, 3), "ÄÖ ü x\x85y | # <b>", "\n" * 5000, "w\n" * 3000]
    texts += [" ".join([pair[0], "1 2 3 4 5 6 7", pair[1], "1 2 3 4 5 6 7"]), pair[0] + "\n" + pair[1], words(60_000, 10**5), "z" * 5000, base]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) + rng.choice(["", "\n", "\n\n"]) for _ in range(150)]
    return texts


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(f"d{i}" if i % 9 else None, t, "k", [1], 2, "n", 3, 4) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, SCHEMA)


def some_field(seed=0, attract=1):
    rng = np.random.RandomState(seed)
    return quality.Field(rng.randint(-9, 10, len(quality.FEATURES) * quality.RANGES), rng.randint(-12, 13, (2, 2)) * attract, rng.randint(-3, 4, 2))


def test_base_counts_match_plain_counts(odd):
    judged = quality.judge(odd.withColumn("again", F.col("text")), some_field(), keep=["again"]).collect()
    assert len(judged) == odd.count()
    for r in judged:
        want = counts(r["again"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["content_share"] >= 0.5)
        whole = (r["again"] or "").encode()
        lines = {line for line in whole.split(b"\n")}
        parts = [whole[s["start"] : s["end"]] for s in r["content"]]
        assert all(p in lines and WORDS.search(p.decode()) for p in parts)
        chars = sum(len(w) for p in parts for w in WORDS.findall(p.decode()))
        assert r["content_share"] == chars / max(1, want[1])


def test_content_text(odd):
    judged = quality.judge(odd, quality.untrained(), keep=["text"])
    for r in quality.content_text(judged, into="cut").collect():
        assert r["cut"] == "\n".join(line for line in (r["text"] or "").split("\n") if WORDS.search(line))


def test_clashing_names_and_empty_tables(spark, odd):
    judged = quality.judge(odd, some_field())
    assert judged.count() == odd.count() and dict(judged.dtypes)["kept"] == "boolean" and "hash" in judged.columns
    assert quality.judge(odd.limit(0), some_field()).count() == 0
    labels = spark.createDataFrame([("d1", 1), ("d2", 0), ("d2", 1), (None, 0), ("d3", 7), ("d4", None)], "doc_id string, quality int")
    assert (quality.fit(odd.limit(0), labels).emit == 0).all()
    assert (quality.fit(odd, labels.where("doc_id = 'd1'")).emit == 0).all()
    assert len(quality.fit(odd, labels).emit) == len(quality.FEATURES) * quality.RANGES


@pytest.mark.parametrize("block", [1 << 17, 3, 1])
@pytest.mark.parametrize("attract", [1, -1])
def test_viterbi_finds_the_best_labelling(monkeypatch, block, attract):
    monkeypatch.setattr(quality, "BLOCK", block)
    rng = np.random.RandomState(block + attract)
    for seed in range(20):
        field = some_field(seed, attract)
        sizes = rng.randint(0, 8, 6)
        first = np.concatenate([[0], np.cumsum(sizes)])
        codes = np.stack([rng.randint(0, quality.RANGES, first[-1]) + k * quality.RANGES for k in range(len(quality.FEATURES))], 1)
        states = quality.viterbi(field, codes, first)
        for a, b in itertools.pairwise(first):
            emit = field.emit[codes[a:b]].sum(1)
            value = lambda s: field.start[s[0]] + sum(e for e, x in zip(emit, s, strict=True) if x) + sum(field.step[x, y] for x, y in itertools.pairwise(s))  # noqa: B023, E731
            if b > a:
                assert value(states[a:b].tolist()) == max(value(s) for s in itertools.product((0, 1), repeat=b - a))


def test_pieces_do_not_change_the_verdict():
    texts = [t or "" for t in odd_texts()]
    field = some_field(5)
    together = quality.lines_of(pa.array([t.encode() for t in texts], pa.large_binary()))
    states = quality.viterbi(field, together.codes, together.first)
    for k, t in enumerate(texts):
        own = quality.lines_of(pa.array([t.encode()], pa.large_binary()))
        part = slice(together.first[k], together.first[k + 1])
        assert (own.codes == together.codes[part]).all()
        assert (quality.viterbi(field, own.codes, own.first) == states[part]).all()


def test_gradient_of_the_likelihood():
    rng = np.random.RandomState(1)
    codes = np.stack([rng.randint(0, quality.RANGES, (5, 6)) + k * quality.RANGES for k in range(len(quality.FEATURES))], 2)
    held = np.arange(6) < rng.randint(1, 7, 5)[:, None]
    labels = rng.randint(0, 2, (5, 6)) * held
    weights = [rng.randn(len(quality.FEATURES) * quality.RANGES) * 0.3, rng.randn(2, 2), rng.randn(2)]
    value, *gradient = quality.log_likelihood(*weights, codes, held, labels)
    exact = 0.0
    for c, h, y in zip(codes, held, labels, strict=True):
        n = h.sum()
        score = lambda s: weights[2][s[0]] + sum(weights[0][c[t]].sum() * s[t] for t in range(n)) + sum(weights[1][a, b] for a, b in itertools.pairwise(s))  # noqa: B023, E731
        exact += score(y[:n]) - np.log(sum(np.exp(score(s)) for s in itertools.product((0, 1), repeat=n)))
    assert np.isclose(value, exact)
    for w, g in zip(weights, gradient, strict=True):
        for at in list(np.ndindex(w.shape))[::5]:
            w[at] += 1e-5
            up = quality.log_likelihood(*weights, codes, held, labels)[0]
            w[at] -= 2e-5
            down = quality.log_likelihood(*weights, codes, held, labels)[0]
            w[at] += 1e-5
            assert np.isclose((up - down) / 2e-5, g[at], atol=1e-4)


def test_held_out_labels(spark):
    """Learned from half of the labelled texts, judged on the other half: bad texts go, good ones stay."""
    folder = DATA.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    half = remainder("doc_id", 2) == 0
    judged = quality.judge(docs, quality.fit(docs, labels.where(half)), keep=["doc_id"]).join(labels.where(~half), "doc_id")
    seen = collections.Counter((r["quality"], r["kept"]) for r in judged.where("not base_failed").collect())
    assert seen[0, False] >= 5 and seen[0, False] >= 0.9 * (seen[0, False] + seen[0, True])
    assert seen[1, True] >= 0.99 * (seen[1, False] + seen[1, True])
    extreme = quality.judge(docs, quality.untrained(), keep=["doc_id"]).where("not base_failed and not kept")
    assert extreme.count() == 0
