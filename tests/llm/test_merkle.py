"""Merkle manifests against trees made in plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tabkit.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp int, place int, node string, row string, depth int, name string"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][k : k + arity])) for k in range(0, len(out[-1]), arity)])
    return out


def siblings(tree, at, arity):
    out = []
    for nodes in tree[:-1]:
        run = at - at % arity
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + arity])))
        at //= arity
    return out


def brute(rows, arity=3):
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)) for r in rows if r["source"] == s))
        trees[s] = (own, levels([x[2] for x in own], arity))
    over = levels([trees[s][1][-1][0] for s in sources], arity)
    out = []
    for k, s in enumerate(sources):
        own, tree = trees[s]
        for at, (known, doc_id, node) in enumerate(own):
            out.append((doc_id if known else None, node, tree[-1][0], over[-1][0], siblings(tree, at, arity) + siblings(over, k, arity)))
    return out


def odd_rows(n=300, seed=2):
    rng = random.Random(seed)
    names = ["hot", "Ä", "z", "", None, "one", "ñ\n", *(f"s{k}" for k in range(9))]
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.4 else rng.choice(names[:5] + names[6:])
        rows.append((i, rng.choice([None, "", "é\nb\n", "plain text", "x\n" * 50]), rng.choice(["en", None, ""]), source, rng.choice([None, 3]), 1, 2, "n", "r", 3, "m"))
    rows += [rows[4]] * 30 + [(None, None, None, None, None, None, None, None, None, None, None)] * 2 + [(5000, "alone", "en", "one", 5, 1, 2, "n", "r", 3, "m")]
    rows += [(7, "another text with a known id", "de", rows[7][3], 1, 1, 2, "n", "r", 3, "m")]
    return rows


def proved(frame, **options):
    made = merkle.prove(merkle.manifest(frame, FIELDS, "source", "doc_id", **options))
    return made, sorted(((r["row"]["order"], r["leaf"], r["subroot"], r["root"], [(s["before"], s["after"]) for s in r["steps"]]) for r in made.collect()), key=str)


@pytest.mark.parametrize("arity, every", [(3, 4), (3, 1), (2, 3), (5, 2)])
def test_trees_and_proofs_match_plain_trees(spark, arity, every):
    frame = spark.createDataFrame(odd_rows(), SCHEMA).repartition(7, "lang")
    made, got = proved(frame, arity=arity, every=every)
    want = sorted(brute([r.asDict() for r in frame.collect()], arity), key=str)
    assert got == want
    folded = made.select((merkle.fold(F.col("leaf"), F.col("steps")) == F.col("root")).alias("same"), merkle.fold(F.reverse("leaf"), F.col("steps")).alias("other"), "root", merkle.proof_hash(F.col("steps")).alias("hash"), "steps").collect()
    assert all(r["same"] and r["other"] != r["root"] for r in folded)
    assert all(r["hash"] == digest("".join(s["before"] + s["after"] for s in r["steps"])) for r in folded)


def test_only_every_few_levels_are_stored(spark):
    frame = spark.createDataFrame([(i, "t", "en", "s", 1, 1, 1, "n", "r", 1, "m") for i in range(200)], SCHEMA)  # 5 levels
    made = merkle.manifest(frame, FIELDS, "source", "doc_id", every=2)
    assert [t.count() for t in made.tree.levels] == [200, 23, 3, 1]
    assert made.tree.tops.count() == 1


@pytest.mark.parametrize("rows", [0, 1])
def test_trees_of_none_and_one(spark, rows):
    frame = spark.createDataFrame([(1, "t", None, None, 1, 1, 1, "n", "r", 1, "m")] * rows, SCHEMA)
    _, got = proved(frame)
    assert got == brute([r.asDict() for r in frame.collect()] if rows else [])
    assert not rows or (got[0][4] == [] and got[0][1] == got[0][2] == got[0][3])


def test_tampered_rows_fold_to_another_root(spark):
    rows = odd_rows(60)
    frame = spark.createDataFrame(rows, SCHEMA)
    shown = merkle.leaf_of([F.replace("text", F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in FIELDS])
    made = merkle.prove(merkle.manifest(frame, FIELDS, "source", "doc_id", keep={"shown": shown, "text": F.col("text")}))
    for r in made.withColumn("folded", merkle.fold(F.col("row.shown"), F.col("steps"))).collect():
        assert (r["folded"] == r["root"]) == ("\n" not in (r["row"]["text"] or ""))
