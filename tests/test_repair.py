"""Category repair over an inverted index of grams."""

import random

import pytest

from tabkit.operators import decode as D


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, text string")


@pytest.mark.parametrize("gram", [1, 2, 3, 5])
def test_containments_match_all_pairs(spark, gram):
    rng = random.Random(gram)
    word = lambda a, b: "".join(rng.choice("abä 😀") for _ in range(rng.randint(a, b)))
    inner, outer = [word(1, 6) for _ in range(80)] + ["aaaa", "q"], [word(1, 30) for _ in range(80)] + ["aaa"]
    got = {tuple(r) for r in D.containments(texts(spark, inner), texts(spark, outer), gram).collect()}
    assert got == {(i, k) for i, s in enumerate(inner) for k, t in enumerate(outer) if s in t}
    assert D.containments(texts(spark, inner).limit(0), texts(spark, outer)).collect() == []
    assert D.containments(texts(spark, inner), texts(spark, outer).limit(0)).collect() == []


def test_repair_of_long_and_odd_values(spark):
    """A value of 20,000 characters, empty values and categories, equal but for case, ties by value."""
    rng = random.Random(9)
    long = "".join(rng.choice("abcdef ") for _ in range(20_000))
    domain = [("Needle", 5), ("needle", 5), ("NEEDLES", 4), ("", 50), ("ab", 3), ("rare xyz", 1), ("top", 9)]
    values = [long, long + "needle", "", None, "nEEdle", "xyz", "qqqq", "top", "Ab", "the NEEDLES", "  "]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    got = {r["i"]: r["v"] for r in D.repair_by_join(rows, "v", spark.createDataFrame(domain, "value string, n long")).collect()}
    order = sorted((v for v, _ in domain if v), key=lambda v: (-dict(domain)[v], v))
    low = str.lower
    for i, v in enumerate(values):
        want = v if v is None or v in order else next((c for c in order if low(v) in low(c) or low(c) in low(v)), order[0])
        assert got[i] == want, v


def test_index_holds_numbers_and_grows_with_the_length(spark):
    long = texts(spark, ["ab" * 5000, "x" * 5000 + "y"])
    grams = D._grams(long, 3)
    assert grams.columns == ["id", "length", "gram"]
    assert sorted((r["id"], r["gram"]) for r in grams.collect()) == [(0, "aba"), (0, "bab"), (1, "xxx"), (1, "xxy")]
