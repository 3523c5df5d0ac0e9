"""Operators of tabkit.llm against brute force, round trips and held-out rows, on small tables with odd rows."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabkit.llm import chat, decontaminate, language, lmscore, nearjoin, packing, suffixdedup, topk, toxicity, warc
from tabkit.llm import queries as Q
from tabkit.llm.common import remainder
from tabkit.llm.text import ALNUM, SEGMENT, WHITE, split

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash long, n_words long, score double"


def words(rng, n, stem="w", size=40):
    return " ".join(f"{stem}{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls, blanks, copies, near copies, a very long text, a shared passage, repeated rows and clashing columns."""
    rng = random.Random(3)
    base = [words(rng, 120, size=10**6) for _ in range(6)]
    passage = words(rng, 90, "p", 10**6)
    texts = [None, "", " \t\n", "é", "one two three", "one two  THREE", *base, *base[:3]]
    for b in base[:4]:
        w = b.split()
        w[60] = "changed"
        texts.append(" ".join(w))
        texts.append(b + " more words at the end")
    texts += [words(rng, 30, size=10**6) + " " + passage + " " + words(rng, 30, size=10**6) for _ in range(4)]
    texts += ["ab " * 700, "ab " * 300, "ÄÖÜ" * 400, words(rng, 20_000), "x" * 3000]
    rows = [(i, t, ["en", None, "de"][i % 3], None if i % 4 else "s", None, 1, 2, 0.5) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, base[5], None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain(text):
    return (text or "").encode()


def by_text(df, column="text"):
    return [(r[column], r) for r in df.collect()]


# words


def test_words_match_plain_split():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB \t\n\x0b\x1cé.9") for _ in range(rng.randrange(60))) for _ in range(300)] + ["", "y" * (SEGMENT + 10), "a " * (SEGMENT // 2 + 5)]
    for kind, rule in ((WHITE, lambda t: t.encode().lower().split()), (ALNUM, lambda t: "".join(c if c.isascii() and c.isalnum() or c > "\x7f" else " " for c in t.lower() if True).split(" "))):
        got = split(pa.array([t.encode() for t in texts], pa.large_binary()), kind)
        seen = {}
        for k, t in enumerate(texts):
            want = [w for w in rule(t) if w]
            have = got.hash[got.first[k] : got.first[k + 1]].tolist()
            assert len(want) == len(have)
            for w, h in zip(want, have, strict=True):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


# 1


def test_lm_scores(odd, empty):
    docs = odd.where("doc_id is not null").withColumn("held_out", remainder("doc_id", 7) == 2)
    out = []
    for bound, head in ((lmscore.FILTER_BYTES, lmscore.HEAD_WORDS), (0, 20)):
        model = lmscore.train(docs.where("not held_out"), filter_bytes=bound, head_words=head)
        out.append(sorted(lmscore.score(docs, model, keep=["doc_id", "text", "held_out"]).collect(), key=lambda r: (r["doc_id"], r["text"] or "")))
    counts = collections.Counter(w for r in out[0] if not r["held_out"] for w in [*plain(r["text"]).lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    for a, b in zip(*out, strict=True):
        toks = [*plain(a["text"]).lower().split(), None]
        assert (a["n_tokens"], a["n_known"], a["train_tokens"]) == (len(toks), sum(t in counts for t in toks), n)
        assert a["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in toks))
        assert a["base_score"] == pytest.approx(b["base_score"]) and a["score"] == pytest.approx(b["score"]) and a["n_known"] == b["n_known"]
    assert lmscore.score(odd, lmscore.train(empty)).count() == odd.count()
    assert lmscore.score(empty, lmscore.train(odd)).count() == 0


def test_filter_levels():
    rng = np.random.RandomState(0)
    h = np.unique(rng.randint(0, 1 << 62, 5000).astype(np.uint64))
    c = rng.randint(1, 1000, len(h))
    known = lmscore.Filter(1, np.zeros((3, 128)))
    body = lmscore.build_segment(h, c)
    known.body = np.empty(len(body), np.uint8)
    known.put(1, 0, 0, body)
    got = known.levels(1, h)
    assert (got >= lmscore.level_of(c)).all() and (got == lmscore.level_of(c)).mean() > 0.95
    other = np.setdiff1d(np.sort(rng.randint(0, 1 << 62, 5000).astype(np.uint64)), h)
    assert (known.levels(1, other) == 0).mean() > 0.95


# 2


def repeats(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        hit = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i] += 1
                hit[i + length] -= 1
        hit = np.cumsum(hit)[: len(t)] > 0
        yield len(t), int(hit.sum()), int((hit & ~np.concatenate([[False], hit[:-1]])).sum()) if len(t) else 0, bytes(np.frombuffer(t, np.uint8)[~hit])


@pytest.mark.parametrize("length,hot", [(400, 20_000), (100, 20_000), (400, 0)])
def test_repeats(odd, length, hot):
    rows = suffixdedup.remove_repeats(odd, length=length, hot=hot).collect()
    want = list(repeats([plain(r["text"]) for r in rows], length))
    got = [(r["n_bytes"], sum(x["end"] - x["start"] for x in r["removed"]), len(r["removed"]), bytes(r["kept"])) for r in rows]
    assert got == want and sum(w[1] for w in want) > 0
    assert len(rows) == odd.count() and rows[0]["n_words"] == 2


def test_repeats_of_random_pieces(spark):
    rng = random.Random(5)
    parts = ["".join(rng.choice("ab") for _ in range(rng.choice([90, 150, 260]))) for _ in range(12)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    rows = suffixdedup.remove_repeats(spark.createDataFrame(enumerate(texts), "doc_id long, text string"), length=320).collect()
    got = [(r["n_bytes"], sum(x["end"] - x["start"] for x in r["removed"]), len(r["removed"]), bytes(r["kept"])) for r in rows]
    assert got == list(repeats([plain(r["text"]) for r in rows], 320))


def test_cuts_inside_characters(spark):
    rng = random.Random(13)
    shared = "".join(rng.choice("áéíóú") for _ in range(260))  # all begin with the same byte
    texts = ["ä" + shared + "ä", "ö" + shared + "ñ", "alone"]
    rows = suffixdedup.clean(spark.createDataFrame(enumerate(texts), "doc_id long, text string")).orderBy("doc_id").collect()
    want = [kept.decode("utf-8", "ignore") for *_, kept in repeats([t.encode() for t in texts], 400)]
    assert [r["text"] for r in rows] == want and want[0] != texts[0]


def test_covers_and_cleaning(odd, empty):
    for v, cover in suffixdedup.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))
    assert suffixdedup.clean(empty).count() == 0
    assert suffixdedup.clean(odd).columns == odd.columns


# 3


def test_nearest_examples_are_exact():
    rng = random.Random(2)
    texts = [words(rng, rng.randrange(0, 12), "toxicword", 15) for _ in range(400)]
    column = pa.array([t.encode() for t in texts], pa.large_binary())
    text, feature, stem, _ = toxicity.features(column)
    vocabulary = np.unique(feature)
    index = toxicity.Index(vocabulary, np.unique(stem), np.linspace(1, 2, len(vocabulary)))
    index.fill(np.arange(200), np.arange(200) % 2, np.ones(2), column.slice(0, 200))
    doc, at, weight = index.vectors(column)
    dense = np.zeros((400, len(vocabulary)))
    dense[doc, at] = weight
    for k in range(200, 400):
        mine = doc == k
        got, sim = index.nearest(at[mine], weight[mine], 7)
        cosine = np.round(dense[:200] @ dense[k], 9)
        want = [i for i in np.lexsort((np.arange(200), -cosine)) if cosine[i] > 0][:7]
        assert np.allclose(sim, cosine[want]) and set(np.flatnonzero(cosine > cosine[want[-1]] if want else [])) <= set(got)


def test_toxicity_held_out(spark, empty):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        bad = i % 9 == 0
        w = words(rng, 60, size=500).split()
        if bad:
            w[::7] = [rng.choice(["insultx", "slurry", "uglyword"]) for _ in w[::7]]
        rows.append((i, " ".join(w), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, b, 0) for i, _, b in rows if i % 2] + [(None, 1, 1), (7, None, None)], "doc_id long, toxic int, text int")
    scorer = toxicity.fit(docs, labels.where(remainder("doc_id", 5) != 0))
    got = {r["doc_id"]: r for r in toxicity.score(docs, scorer).collect()}
    assert all(got[i]["predicted"] == b for i, _, b in rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[0]["evidence"] and got[0]["evidence"][0]["label"] == 1
    assert toxicity.score(empty, scorer).count() == 0
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}


def test_shares_never_fall():
    assert toxicity.monotone(np.array([3.0, 1, 2]), np.array([4.0, 4, 4])).tolist() == [0.5, 0.5, 0.5]


# 4


@pytest.mark.parametrize("tile,shard", [(512, 4 << 20), (2, 256)])
def test_top_k(spark, tile, shard):
    rng = random.Random(6)
    rows = [(i, [rng.choice([0.5, -0.25, 1.125, 3.0]) for _ in range(4)], 1) for i in range(120)]
    rows += [(200, None, 0), (201, [1.0, None, 0.0, 0.0], 0), (202, [float("nan"), 0.0, 0.0, 0.0], 0), (203, [float("inf"), 0.0, 0.0, 0.0], 0), (300, [1.0, 2.0], 0), (301, [3.0, 1.0], 0), (None, [1.0] * 4, 0), (5, rows[5][1], 0), (400, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, df.where("vec_id % 50 = 0"), tile=tile, shard_bytes=shard).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in ok:
        if q % 50 == 0:
            want = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))[:10]
            assert got.pop(q, []) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert not got
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_large_components_stay_exact():
    q = np.array([[2**40, 3]], np.int64)
    assert topk._product(q, np.array([[2**20, 1]], np.int64))[0, 0] == 2**60 + 3


# 5


def test_fill_is_closest():
    rng = random.Random(8)
    for _ in range(200):
        counts = collections.Counter(rng.randrange(1, 40) for _ in range(rng.randrange(0, 9)))
        space = rng.randrange(0, 90)
        used = packing.fill(dict(counts), space)
        items = list(counts.elements())
        best = max((s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= space), default=0)
        assert sum(used.elements()) == best and all(used[x] <= counts[x] for x in used)


def test_packing(odd, empty):
    from tokenizers import Tokenizer

    path = Q.tokenizer_path()
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    extra = docs.sparkSession.createDataFrame([(900, "a<|startoftext|>B<|endoftext|> it's É ab12"), (901, "ab" * 5000)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(extra)
    tok = Tokenizer.from_file(path)
    ids = {r["doc_id"]: np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4") for r in docs.collect()}
    rows = packing.pack(docs, path, window=256, group_documents=10).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for table in (*pieces.values(), *sequences.values()):
        at = 0
        for start, length in sorted(table):
            assert start == at
            at += length
    assert all(sum(x[1] for x in s) <= 256 for s in sequences.values())
    assert packing.pack(empty, path).count() == 0


# 6


def test_chat_round_trip(spark):
    odd_texts = ["", None, "\\", "<|", "<\\|", "<|im_end|>\n", "a\\<|b", "é\n<", "|x", "<\\-"]
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "sys<|tem\n", None, "a\\"]), rng.choice(odd_texts)) for c in range(40) for t in range(rng.randrange(1, 7))]
    rows += [(None, 0, "assistant", "x"), (3, None, "user", "first"), (3, 1, "user", "tie"), (3, 1, "user", "tie")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, example int")
    examples = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.read_back(examples).collect()}
    groups = collections.defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == groups.keys()
    shown = collections.defaultdict(list)
    for e in examples.orderBy("example").collect():
        shown[e["conv_id"]].append(e)
    for c, turns in groups.items():
        turns = [(r, x) for *_, r, x in sorted(turns)]
        spoken = "".join(f"{r}\n{x}\n" for r, x in turns)
        loss = "".join(x for r, x in turns if r == "assistant")
        want = (len(turns), hashlib.sha256(spoken.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[c])[1:5] == want
        assert sum(len(e["loss"]) for e in shown[c]) == sum(r == "assistant" for r, _ in turns)
        assert all(b["formatted"].startswith(a["formatted"]) for a, b in itertools.pairwise(shown[c])) and got[c]["formatted_chars"] == sum(len(e["formatted"]) for e in shown[c])
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


# 7


def test_warc_round_trip(spark):
    long = "é" * 200_000
    rows = [(1, "http://a/ b\r\n", "x" * 100), (2, None, "x" * 100), (3, "u", "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""), (7, "u", long), (8, "u", long), (None, "u", long), (9, "u", "WARC/1.1\r\n\r\n" * 20), (1, "again", "x" * 100)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    path = warc.archive_path(spark)
    warc.write_archives(df, path)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows) and all(r["problem"] is None for r in got)
    ident = lambda x: int(x.rpartition(":")[2] or -1) if x else None
    table = sorted((ident(r["record_id"]), r["warc_type"], ident(r["refers_to"]), r["payload_bytes"], r["payload_digest"]) for r in got)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    to = {2: 1, 8: 7, -1: 7}
    want = sorted(((i if i is not None else -1), "revisit" if (i or -1) in to else "response", to.get(i if i is not None else -1), len((h or "").encode()), sha(h)) for i, _, h in rows)
    assert table == want
    assert {bytes(r["payload"]).decode() for r in got if r["payload"] is not None} == {h or "" for _, _, h in rows}
    empty = warc.archive_path(spark)
    warc.write_archives(df.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_warc_reader_reports_damage():
    good = warc.record_bytes("urn:a", "u", "2024-01-01T00:00:00Z", b"body" * 50, hashlib.sha256(b"body" * 50).hexdigest(), None)
    assert [r["problem"] for r in warc.records(warc._member(good) * 2)] == [None, None]
    assert "digest" in next(warc.records(warc._member(good.replace(b"bodybody", b"bodyBODY"))))["problem"]
    assert "content length" in next(warc.records(warc._member(good[:-1])))["problem"]
    assert "unreadable" in next(warc.records(warc._member(good)[:-9]))["problem"]
    assert "unreadable" in list(warc.records(warc._member(good) + b"rubbish"))[1]["problem"]
    assert "unreadable" in next(warc.records(warc._member(good[:-60])))["problem"]


# 8


def groups_by_pairs(rows):
    sets = []
    for _, t in rows:
        w = plain(t).lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, len(sets[k]), i if not sets[k] else least.get(root(k))) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("settings", [{}, {"LEAST_FREQUENT": 2, "LOCAL": 1}, {"ACTIVE_BROADCAST": 0, "HELD": 50}])
def test_near_copies(odd, spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(nearjoin, k, v)
    rng = random.Random(7)
    more = []
    for g in range(3):
        base = words(rng, 60, f"g{g}x", 10**6).split()
        for k in range(25):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(60)] = f"z{rng.randrange(10**6)}"
            more.append((1000 + 100 * g + k, " ".join(w)))
    df = odd.select("doc_id", "text", "hash", "n_words").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for chunk in (nearjoin.CHUNK, 300):
        got = [tuple(r) for r in nearjoin.near_duplicates(df, chunk=chunk).collect()]
        assert sorted(got, key=key) == sorted(groups_by_pairs(rows), key=key)


def test_near_copies_of_nothing(empty):
    assert nearjoin.near_duplicates(empty).count() == 0


# 9


@pytest.mark.parametrize("shard", [decontaminate.SHARD_BYTES, 300])
def test_contamination(spark, odd, empty, shard):
    rng = random.Random(11)
    items = [(i, words(rng, n, "q", 30)) for i, n in enumerate([15, 12, 10, 9, 3, 1, 40, 25])]
    items += [(7, "extra item with the same id as another one in this table"), (20, items[0][1]), (None, "short"), (21, None), (22, "..."), (10, "É9 É9")]
    texts = [words(rng, 5, "q", 30) + "," + (t or "").upper() + "!" + words(rng, 5, "q", 30) for _, t in items] + [words(rng, 300, "q", 30), "É9 é9. É9"]
    docs = odd.unionByName(spark.createDataFrame([(5000 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"), allowMissingColumns=True)
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = decontaminate.contamination(docs, bench, shard_bytes=shard).collect()
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    cut = lambda t: [w for w in "".join(c if c.isascii() and c.isalnum() or c > "\x7f" else " " for c in fold(t)).split(" ") if w]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add("" if i is None else str(i))
    assert len(got) == docs.count()
    for r in got:
        w, hit, found = cut(r["text"]), set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= ids
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) == (len(w), len(hit), len(found), sorted(found), bool(hit))
    assert decontaminate.contamination(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(docs, bench.limit(0)).collect())


# 10


def test_language(spark, empty):
    rng = random.Random(12)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "zh": "天地玄黄宇宙洪荒日月盈昃"}
    rows = [(i, " ".join("".join(rng.choices(letters[x], k=5)) for _ in range(30)), x) for i in range(300) for x in [list(letters)[i % 3]]]
    rows += [(900, None, "aa"), (901, "12 34 .", "bb"), (902, "", None), (903, "aéb" * 40000, None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    known, prototypes = language.learn(docs.where(remainder("doc_id", 4) != 2))
    assert known == ["aa", "bb", "zh"] and np.allclose((prototypes**2).sum(1), 1)
    got = {r["doc_id"]: r for r in language.predict(docs, known, prototypes).collect()}
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[900]["score"] == 0
    assert np.mean([got[i]["lang_pred"] == x for i, _, x in rows[:300]]) > 0.97 and all(0 <= r["score"] <= 1 for r in got.values())
    assert language.predict(empty, known, prototypes).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs, *language.learn(docs.limit(0))).collect()} == {"und"}


def test_bundling_equals_adding_bound_letters():
    text = "Abcé d2f"
    got = language.vectors(pa.array([text.encode()], pa.large_binary()), 128)[0]
    want = np.zeros(128)
    for word in ("abcé", "d", "f"):
        codes = [0, *map(ord, word), 0]
        v = language.letter_vectors(np.array(codes), 128)
        for k in range(1, len(codes) - 1):
            want += np.roll(v[k - 1], 2) * np.roll(v[k], 1) * v[k + 1]
    assert (got == want).all()


# all queries, and the run over documents


def test_queries_against_sql(spark, data):
    from oracle import compare, connect

    con = connect(data)
    checked = [n for n, q in Q.QUERIES.items() if q.sql and compare(q.run(spark, data), con, q.sql) is None]
    assert checked == [n for n, q in Q.QUERIES.items() if q.sql] and len(checked) == 6


def test_pipeline(spark, data):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = docs
    for label, function in c.STAGES:
        after = c.stage(function(spark, before, data), "test")
        if label != "packing":
            assert after.columns == docs.columns and 0 < after.count() <= before.count()
        before = after
    assert {r["doc_id"] for r in before.select("doc_id").distinct().collect()} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert before.agg(F.sum("length")).first()[0] > 0


def test_pipeline_with_repeated_and_null_ids(spark, data):
    """Near copies and repeats against brute force by rows: one row of each group stays, and keeps its text."""
    import corpus_pipeline as c

    rng = random.Random(23)
    base = [words(rng, 120, size=10**6) for _ in range(5)]
    near = lambda t: t + " and more"
    rows = [(1, base[0]), (1, base[0]), (1, base[0])]  # repeated rows
    rows += [(None, base[1]), (None, base[1]), (None, near(base[1]))]  # copies without id
    rows += [(3, base[2]), (7, near(base[2])), (7, base[3])]  # a repeated id, one of its rows a near copy
    rows += [(None, base[4]), (9, near(base[4]))]  # an id comes before none
    rows += [(5, None), (5, ""), (None, None), (8, "one two"), (8, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumn("n_chars", F.lit(0).cast("long"))
    left = c.drop_near_copies(spark, docs, data)
    member = [m for _, _, m in groups_by_pairs([(k, t) for k, (_, t) in enumerate(rows)])]
    least = {}
    for k, (m, (i, _)) in enumerate(zip(member, rows, strict=True)):
        least[m] = min(least.get(m, (True, math.inf, k)), (i is None, i or 0, k))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    got = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=key)
    assert left.columns == docs.columns
    assert got == sorted((rows[k] for _, _, k in least.values()), key=key)
    assert [t for i, t in got if i == 7] == [base[3]] and sum(t is not None for i, t in got if i is None) == 1
    cut = sorted(((r["doc_id"], r["text"]) for r in c.cut_repeats(spark, c.stage(left, "test"), data).collect()), key=key)
    kept = [bytes(x[3]).decode() if t is not None else None for x, (_, t) in zip(repeats([plain(t) for _, t in got], 400), got, strict=True)]
    assert cut == sorted(zip([i for i, _ in got], kept, strict=True), key=key) and sum(len(t or "") > 400 for _, t in cut) == 5
