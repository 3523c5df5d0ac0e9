"""Inputs that once gave wrong or missing rows."""

from pyspark.sql import functions as F

from tabkit.functions.quantiles import quantiles
from tabkit.operators import decode as D
from tabkit.operators import encode as E
from tabkit.operators import profile as P
from tabkit.operators.metrics import hellinger
from tabkit.operators.ml import split
from tabkit.operators.profile import ColumnProfile, DatasetProfile
from tabkit.operators.prompt import draw_shots
from tabkit.operators.sample import representative_by_source
from tabkit.sources.tables import load_profile, read_table, save_profile, write_table


def test_quantiles_keep_every_group_and_column(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, None), (None, 5.0, None), ("b", None, 1.0)], "g string, x double, y double")
    rows = lambda small: {(r["g"], r["column"]): r["q"] for r in quantiles(df, ["x", "y"], [0.25, 0.5], ["g"], small).collect()}
    assert rows(0) == rows(100) and len(rows(0)) == 6
    assert {r["column"]: r["q"] for r in quantiles(df.drop("y").withColumn("y", F.lit(None).cast("double")), ["x", "y"], [0.5], (), 0).collect()} == {"x": [2.0], "y": None}


def test_split_numbers_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(1 if i < 12 else None, i) for i in range(20)], "k int, v int")
    got = split(df, ["k"], 8, 4)
    assert (got.where("is_train").count(), got.where("not is_train").count()) == (8, 4)


def test_hellinger_ignores_other_datasets(spark):
    rows = [("real", float(i)) for i in range(10)] + [("synthetic", float(i % 5)) for i in range(10)]
    schema = "dataset string, x double"
    alone = hellinger(spark.createDataFrame(rows, schema), ["x"], [], "real", "synthetic").collect()
    assert alone == hellinger(spark.createDataFrame([*rows, ("other", 1e9)], schema), ["x"], [], "real", "synthetic").collect()


def test_null_strata_and_sources_are_kept(spark):
    pool = spark.createDataFrame([(i, None if i % 2 else "a", float(i)) for i in range(40)], "id int, s string, x double")
    prompts = spark.range(3).withColumnRenamed("id", "prompt_id")
    drawn = draw_shots(pool, prompts, ["id"], 8, strata=["s"])
    assert {r["prompt_id"]: r["count"] for r in drawn.groupBy("prompt_id").count().collect()} == {0: 8, 1: 8, 2: 8}
    assert representative_by_source(pool, "s").where("s is null").count() > 0


def profile_of(name, **more):
    return DatasetProfile(1, {name: ColumnProfile(0, name, **more)})


def test_json_of_any_depth_and_nothing_behind(spark):
    prof = profile_of("a", dtype="text", original_dtype="string")
    df = spark.createDataFrame([(0, '1. {"a": {"b": {"c": {"d": 1}}}} thanks'), (1, '[{"a": 1}] done'), (2, '[{"a": 1}, {"a": 2}]')], "prompt_id long, text string")
    got = [(r["prompt_id"], r["row_idx"], r["a"]) for r in D.decode_json(df, prof).orderBy("prompt_id", "row_idx").collect()]
    assert got == [(0, 0, '{"b":{"c":{"d":1}}}'), (1, 0, "1"), (2, 0, "1"), (2, 1, "2")]
    single = spark.createDataFrame([('{"a": 1}',), ('{"a": 1} thanks',), ('{"a": 1}{"a": 2}',), ('{"a": 1} }',), ('```json\n{"a": NaN}\n```',)], "text string")
    assert [r["valid"] for r in D.decode_json_single(single, prof).collect()] == [True, False, False, False, True]


def test_both_repair_routes_agree_on_empty_categories(spark):
    domain = ["Private", "", "Public"]
    rows = spark.createDataFrame([("priv",), ("zzz",), ("Public",), (None,)], "a string")
    inline = [r[0] for r in rows.select(D._repair_inline(F.col("a"), domain)).collect()]
    table = spark.createDataFrame([(v, 3 - i) for i, v in enumerate(domain)], "value string, n long")
    joined = [r[0] for r in D.repair_by_join(rows, "a", table).collect()]
    assert sorted(map(str, inline)) == sorted(map(str, joined)) == ["None", "Private", "Private", "Public"]


def test_csv_line_breaks_and_missing_words(spark, tmp_path):
    df = spark.createDataFrame([(1, 'two\nlines, "quoted"', "3"), (2, "x", "NA"), (3, "N/A", "5")], "id int, t string, n string")
    write_table(df, str(tmp_path / "t.csv"))
    got = read_table(spark, str(tmp_path / "t.csv"))
    assert dict(got.dtypes)["n"] == "bigint"
    assert sorted(map(tuple, got.collect())) == [(1, 'two\nlines, "quoted"', 3), (2, "x", None), (3, None, 5)]


def test_results_do_not_depend_on_the_inline_domain(spark, tmp_path, monkeypatch):
    values = [f"value {i:04d}" for i in range(1500)]
    rows = [(v, "" if k % 2 else None, "yes" if k % 3 else "no") for k, v in enumerate(values + values[:700])]
    df = spark.createDataFrame(rows, "c string, e string, b string")
    seen = []
    for limit in (0, 10**9, P.INLINE_DOMAIN):
        monkeypatch.setattr(P, "INLINE_DOMAIN", limit)
        prof = P.profile(df, overrides={"c": "categorical", "e": "categorical"}, exact=False, top_k=1200, abbreviate=True)
        save_profile(prof, spark, str(tmp_path / str(limit)))
        texts = []
        for q in (prof, load_profile(spark, str(tmp_path / str(limit)))):
            assert P.json_schema(q)["properties"]["c"]["enum"] == values[:700] + values[700:]
            texts.append(sorted(r["text"] for r in E.encode_compact(df, q).collect()))
        lost = spark.createDataFrame([(v, "x", None) for v in [*values, "VALUE 0003!", None]], "c string, e string, b string")
        repaired = sorted(map(str, (r["c"] for r in D.repair_category(lost, prof).collect())))
        assert repaired == sorted([*values, "value 0003", "None"])
        top, b = prof.columns["c"].top_k, prof.columns["b"]
        assert texts[0] == texts[1] and len(set(texts[0])) == 1500 and len(top) == 1200 and top[0] == ("value 0000", 2)
        seen.append((texts[0], top, b.true_label, b.false_label, P.json_schema(prof)))
    assert seen[0] == seen[1] == seen[2] and seen[0][2:4] == ("yes", "no")


def test_dates_of_every_shape_are_kept(spark):
    shapes = {
        "%Y-%m-%dT%H:%M:%S%z": ["2021-03-05T10:30:00Z", "2021-03-05T12:30:00+02:00", "2021-03-05T12:30:00+0200"],
        "%Y-%m-%d %H:%M": ["2021-03-05 10:30"],
        "%Y-%m-%dT%H:%M": ["2021-03-05T10:30"],
        "%Y-%m-%dT%H:%M:%S": ["2021-03-05T10:30:00"],
        "%Y-%m-%dT%H:%M:%S.%f%z": ["2021-03-05T10:30:00.000Z", "2021-03-05T10:30:00.000000Z"],
        "%Y-%m-%d %H:%M:%S.%f": ["2021-03-05 10:30:00.0"],
        "%Y/%m/%d": ["2021/03/05"],
        "%B %d, %Y": ["March 5, 2021"],
        "%d.%m.%Y": ["05.03.2021"],
    }
    names = [f"c{i}" for i in range(len(shapes))]
    most = max(map(len, shapes.values()))
    df = spark.createDataFrame([[v[k % len(v)] for v in shapes.values()] for k in range(most)], ", ".join(f"{c} string" for c in names))
    got = {r["column"]: (r["date_format"], r["min_ts"]) for r in P.datetime_profile(df, names).collect()}
    assert got == {c: (f, "2021-03-05T10:30:00" if "%H" in f else "2021-03-05T00:00:00") for c, f in zip(names, shapes, strict=True)}
    parsed = df.select(*[D.date_of(F.col(c)).isNotNull().alias(c) for c in names]).collect()
    assert all(all(r) for r in parsed)


def test_columns_of_unparsed_dates_stay_text_and_keep_their_rows(spark):
    rows = [(f"2021-03-0{k}T10:30:00Z", f"2021-03-0{k} at noon", f"2021-03-0{k}" if k > 1 else "2021-03-05 at noon") for k in range(1, 7)]
    prof = P.profile(spark.createDataFrame(rows, "t string, u string, w string"))
    assert prof.names("datetime") == ["t"] and prof.columns["t"].max_ts == "2021-03-06T10:30:00"
    texts = spark.createDataFrame([('{"t": "%s", "u": "%s", "w": "%s"}' % r,) for r in rows], "text string")
    assert sorted((r["t"], r["u"], r["w"]) for r in D.decode(texts, prof).collect()) == sorted(rows)
