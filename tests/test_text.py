"""Encoders and decoders: hand-made cases and round trips."""

import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabkit.operators import decode as D
from tabkit.operators import encode as E
from tabkit.operators.profile import ColumnProfile, DatasetProfile, profile
from tabkit.plans.queries_text import simple_profile

TYPES = {"age": "integer", "workclass": "categorical", "income": "categorical"}


def adult():
    p = simple_profile(TYPES)
    p.columns["workclass"].domain = [("Private", 9), ("Local-gov", 5), ("Private-x", 2)]
    p.columns["income"].domain = [("<=50K", 9), (">50K", 5)]
    for c in p.columns.values():
        c.missing_rate = 0.0
    return p


def decoded(spark, texts, mode, prof=None, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "prompt_id bigint, text string")
    prof = prof or adult()
    out = D.decode(df, prof, mode, **options).orderBy("prompt_id", "row_idx").collect()
    return [tuple(r[c] for c in prof.column_order) for r in out]


ROW = '{"age": 35, "workclass": "Private", "income": "<=50K"}'
WANT = (35, "Private", "<=50K")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f"1. {ROW}\n2. {ROW}", [WANT, WANT]),
        (f'[{ROW}, 5, "s", null, {{"age": "x", "workclass": "Private", "income": "<=50K"}}]', [WANT]),
        (f"[{ROW}, ", [WANT]),
        ('[{"age": 35,', []),
        (f"```json\n{ROW}\n```", [WANT]),
        (f"here you go: {ROW} thanks", [WANT]),
        ('{"age": 35, "workclass": "a}b", "income": "<=50K"}', [WANT]),
        ('{"age": 35, "workclass": {"x": "Local-gov"}, "income": "<=50K"}', [(35, "Local-gov", "<=50K")]),
        ('{"age": 35, "age": 36, "workclass": "Private", "income": "<=50K"}', [(36, "Private", "<=50K")]),
        ('{"Age": 35, "workclass": "Private", "income": "<=50K"}', []),
        ('{"age": 3.9e1, "workclass": "priv", "income": ">50k"}', [(39, "Private", ">50K")]),
        ('{"age": "1_000", "workclass": "Private", "income": "<=50K"}', []),
        ('{"age": null, "workclass": "Private", "income": "<=50K"}', []),
        (f"<think>\n1. {ROW}\n</think>\n{ROW}", [WANT]),
        ("{'age': 35}", []),
        ("5", []),
        ("", []),
    ],
)
def test_json(spark, text, want):
    assert decoded(spark, [text], "json") == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<think>\nplan\n</think>\n1. age is 35, workclass is Private, income is <=50K.", [WANT]),
        ("1. 1. age is 35, workclass is Private, income is <=50K", [WANT]),
        ("1. 1. age is 35, workclass is Private", []),
        ("1. AGE is 35, Workclass is Private, income is <=50K\nnot a row\n2. age is 36, income is >50K, workclass is local", [WANT, (36, "Local-gov", ">50K")]),
        ("age is NaN, workclass is none, income is <=50K", []),
        ("age is 3.9, workclass is priv, income is zzz", [(3, "Private", "<=50K")]),
        ("age is 1_000, workclass is zzz, income is <=50K", []),
        ("age is 35, age is none, workclass is Private, income is <=50K", [WANT]),
        ("colour is red, age is 35, workclass is Private, income is <=50K", [WANT]),
    ],
)
def test_sentences(spark, text, want):
    assert decoded(spark, [text], "flexible") == want


def test_comma_in_a_value(spark):
    prof = simple_profile({"city": "text", "age": "integer"})
    for c in prof.columns.values():
        c.missing_rate = 0.0
    got = decoded(spark, ["1. city is Hong Kong, China, age is 35\n2. city is X, age here, age is 36"], "flexible", prof)
    assert got == [("Hong Kong, China", 35), ("X, age here", 36)]


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        decoded(spark, ["x"], "fast")


def test_booleans(spark):
    prof = simple_profile({"b": "boolean"})
    p = prof.columns["b"]
    p.missing_rate, p.true_label, p.false_label = 0.0, "Y", "N"
    texts = ['{"b": true}', '{"b": "no"}', '{"b": "maybe"}', '{"b": "none"}']
    assert decoded(spark, texts, "json", prof) == [("Y",), ("N",), ("N",)]
    assert decoded(spark, texts, "json", prof, strict_boolean=True) == [("Y",), ("N",)]


def test_nullable_columns_keep_nulls(spark):
    prof = adult()
    prof.columns["workclass"].missing_rate = 0.36
    assert decoded(spark, ['{"age": 35, "income": "<=50K"}'], "json", prof) == [(35, None, "<=50K")]


def test_repair_routes_agree(spark):
    domain = [("Private", 9), ("Local-gov", 5), ("State-gov", 5), ("ab", 4), ("a", 3)]
    values = ["private", "gov", "GOV", "xxLocal-govyy", "zzz", "Private", "b", "aq", None, "a"]
    prof = simple_profile({"c": "categorical"})
    prof.columns["c"].domain = domain
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    inline = [r["c"] for r in D.repair_category(rows, prof).orderBy("i").collect()]
    table = spark.createDataFrame(domain, "value string, n bigint")
    joined = [r["c"] for r in D.repair_by_join(rows, "c", table).orderBy("i").collect()]

    def plain(v):
        if v is None or v in dict(domain):
            return v
        return next((d for d, _ in domain if d.lower() in v.lower() or v.lower() in d.lower()), domain[0][0])

    assert inline == joined == [plain(v) for v in values]


def test_formatting(spark):
    df = spark.sql("""SELECT CAST(NULL AS string) AS s, 0.125D AS f, 10000000.0D AS g, 2.9D AS i, 'say "hi", you' AS t, 'a"b' AS u, 'Yes' AS b, true AS n""")
    types = {"s": "categorical", "f": "float", "g": "float", "i": "integer", "t": "text", "u": "text", "b": "boolean", "n": "boolean"}
    prof = simple_profile(types)
    text = E.encode(df, prof, "flexible", digits=2).first()["text"]
    assert text == 's is Missing, f is 0.12, g is 10000000.00, i is 2, t is "say ""hi"", you", u is a""b, b is True, n is True.'
    js = E.encode(df, prof, "json").first()["text"]
    assert js == '{"s": null, "f": 0.125, "g": 10000000.0, "i": 2, "t": "say \\"hi\\", you", "u": "a\\"b", "b": true, "n": true}'
    with pytest.raises(ValueError):
        E.encode(df, prof, "other")
    with pytest.raises(ValueError):
        E.encode(df, prof, "predictive")
    bad = spark.sql("SELECT 'maybe' AS b")
    with pytest.raises(Exception, match="not a boolean word"):
        E.encode(bad, simple_profile({"b": "boolean"}), "json").collect()


def test_compact(spark):
    df = spark.createDataFrame([(39, "Bachelors", None), (40, "Other", 1.5)], "age int, edu string, earn double")
    prof = simple_profile({"age": "integer", "edu": "categorical", "earn": "float"})
    codes = spark.createDataFrame([("edu", "Bachelors", "BAC")], "column string, value string, code string")
    want = ["A 39, E BAC, EA M", "A 40, E Oth, EA 1.500"]
    assert [r["text"] for r in E.encode_compact(df, prof, codes).orderBy("age").collect()] == want
    limit, E.INLINE_CODES = E.INLINE_CODES, 0
    try:
        assert [r["text"] for r in E.encode_compact(df, prof, codes).orderBy("age").collect()] == want
    finally:
        E.INLINE_CODES = limit


def test_permutation_keeps_the_clauses(spark):
    df = spark.range(50).selectExpr("id AS a", "id * 2 AS b", "id * 3 AS c", "id * 4 AS d").repartition(5)
    prof = simple_profile(dict.fromkeys("abcd", "integer"), "b")
    plain = {r["a"]: r["text"] for r in E.encode(df, prof, "flexible").collect()}
    mixed = {r["a"]: r["text"] for r in E.encode(df, prof, "flexible", permute=True, row_key=["a"]).collect()}
    last = {r["a"]: r["text"] for r in E.encode(df, prof, "predictive", permute=True, row_key=["a"]).collect()}
    split = lambda t: t.rstrip(".").split(", ")
    assert all(sorted(split(mixed[a])) == sorted(split(plain[a])) for a in plain)
    assert len({tuple(x.split()[0] for x in split(t)) for t in mixed.values()}) > 5
    assert all(t.endswith(f"b is {2 * a}") for a, t in last.items())


word = st.text(string.ascii_letters + string.digits + " éß-/{}[]:'\"\\\n\t", min_size=1, max_size=12).map(lambda s: "w" + s + "w")
plain_word = st.text(string.ascii_letters + string.digits + " -/", max_size=10).map(lambda s: "w" + s + "w")


def rows_of(text):
    return st.lists(st.tuples(st.integers(-(2**53), 2**53), st.decimals(-9999, 9999, places=3).map(float), text, st.booleans()), min_size=5, max_size=30)


def round_trip(spark, rows, mode):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, n bigint, x double, t string, b boolean")
    prof = simple_profile({"id": "integer", "n": "integer", "x": "float", "t": "text", "b": "boolean"})
    for c in prof.columns.values():
        c.missing_rate = 0.0
    texts = E.encode(df, prof, mode).select(F.col("id").alias("prompt_id"), "text")
    back = D.decode(texts, prof, mode).orderBy("id").collect()
    assert [(r["n"], r["x"], r["t"], r["b"]) for r in back] == [(n, x, t, str(b)) for n, x, t, b in rows]


@settings(max_examples=5, deadline=None)
@given(rows=rows_of(word))
def test_json_round_trip(spark, rows):
    round_trip(spark, rows, "json")


@settings(max_examples=5, deadline=None)
@given(rows=rows_of(plain_word))
def test_sentence_round_trip(spark, rows):
    round_trip(spark, rows, "flexible")


def test_strange_column_names(spark):
    df = spark.createDataFrame([(1, "x", 2.5)], ["a.b", "c d (e)", "f`g"])
    prof = profile(df, overrides={"c d (e)": "text"})
    for mode in ("json", "flexible"):
        texts = E.encode(df, prof, mode).select(F.lit(1).cast("bigint").alias("prompt_id"), "text")
        row = D.decode(texts, prof, mode).first()
        assert (row["a.b"], row["c d (e)"], row["f`g"]) == (1, "x", 2.5)


def test_complete_retries_and_records_errors(spark, tmp_path):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "prompt_id bigint, prompt string")
    mark = str(tmp_path / "tried")

    def fn(batch):
        import os

        if "p3" in batch:
            raise ConnectionError("503")
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise TimeoutError("once")
        return [p.upper() for p in batch]

    got = {r["prompt_id"]: r for r in D.complete(prompts, fn, batch_size=4, wait_seconds=0, max_concurrency=2).collect()}
    assert len(got) == 10 and got[3]["text"] == "" and got[3]["error"] == "503"
    assert all(got[i]["text"] == f"P{i}" and got[i]["error"] is None for i in range(10) if i != 3)
