"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fit, on a bounded sample of labelled rows (``train_rows``, half of it per label, drawn by a hash of the key): features are words and the
first ``HEADS`` bytes of longer words, and again as features of their own where they
occur ``OFTEN`` or ``DENSE``. Those that go with label 1 (likelihood ratio of ``RATIO`` or more, and ``PURE`` of the texts that hold them labelled 1; at most
``n_features``) make the vocabulary. ``examples`` of the sample are kept as TF-IDF vectors in an inverted index; the rest of the sample calibrates.

Search: examples lie in blocks of ``BLOCK``; for each feature the index knows its largest weight per block. A text's blocks are taken in the order of their
bounds until no block can hold a nearer example, so the ``k`` nearest are exact; ties go to the smaller id. Their similarities vote, weighted
to undo the sampling; the vote is mapped to the observed share of label 1 by a monotone table learned on the rest of the sample. The
neighbours are the evidence.

Null, empty and unknown texts have no neighbour: their score is the observed share among such texts. Without labelled rows every score is 0.
Rows without label or key teach nothing; if a key is labelled several times, 1 wins. Repeated rows are scored one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.llm.common import DOUBLE, FIELD, INT, LONG, annotate, lists, name, scan
from tabkit.llm.text import ALNUM, groups, mix, split

TRAIN_ROWS = 20_000
EXAMPLES = 4_000
FEATURES = 4_096
RATIO = 30.0
PURE = 0.75  # share of label 1 among all labelled texts with the feature
HEADS = (4, 5, 6, 7)
OFTEN = (2, 4, 8)  # occurrences
DENSE = (0.005, 0.01, 0.02)  # occurrences per word, of features that occur more than once
BLOCK = 64
NEAREST = 15
BINS = 20
_UNITS = 1 << 20

def evidence_type(key: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([FIELD("doc_id", key), FIELD("similarity", DOUBLE), FIELD("label", INT)]))


def features(column: pa.Array, stems: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, feature), the word or head it comes from (only ``stems``, if given) and how often; in order of text and feature."""
    words = split(column, ALNUM, HEADS)
    size = np.diff(words.first)
    text_of = np.repeat(np.arange(len(column)), size)
    key = lambda h, k: mix(h ^ np.uint64(0x5851F42D4C957F2D + k))
    found = []
    for k, feature in zip((0, *HEADS), (words.hash, *words.heads), strict=True):
        longer = np.flatnonzero(words.end - words.start > k)
        text, feature = text_of[longer], key(feature[longer], k)
        order = np.lexsort((feature, text)) if stems is None else np.flatnonzero(np.isin(feature, stems))
        text, feature = text[order], feature[order]
        if stems is not None:
            order = np.lexsort((feature, text))
            text, feature = text[order], feature[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (feature[1:] != feature[:-1])
        at = np.flatnonzero(new)
        text, feature, tf = text[at], feature[at], np.diff(np.concatenate([at, [len(text)]]))
        found.append((text, feature, feature, tf))
        levels = [(tf >= n, n) for n in OFTEN] + [((tf > 1) & (tf >= share * size[text]), 100 + i) for i, share in enumerate(DENSE)]
        found += [(text[some], key(feature[some], 100 + k), feature[some], tf[some]) for some, k in levels]
    text, feature, stem, tf = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((feature, text))
    return text[order], feature[order], stem[order], tf[order]


class Index:
    """Examples with unit vectors in blocks; per feature its postings and its largest weight in each block."""

    def __init__(self, vocabulary: np.ndarray, stems: np.ndarray, idf: np.ndarray):
        self.vocabulary, self.stems, self.idf = vocabulary, stems, idf

    def vectors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature number, weight) of unit vectors."""
        if not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        text, feature, _, tf = features(column, self.stems)
        at = np.minimum(np.searchsorted(self.vocabulary, feature), len(self.vocabulary) - 1)
        ok = self.vocabulary[at] == feature
        text, at, tf = text[ok], at[ok], tf[ok]
        weight = (1 + np.log(tf)) * self.idf[at]
        norm = np.sqrt(np.bincount(text, weight * weight, minlength=len(column)))
        return text, at, weight / norm[text]

    def fill(self, ids: pa.Array, labels: np.ndarray, votes: np.ndarray, column: pa.Array) -> Index:
        """Take the examples, whose ids must ascend."""
        self.ids, self.labels, self.votes = ids, labels, votes
        doc, feature, weight = self.vectors(column)
        order = np.lexsort((doc, feature))
        self.doc, feature, self.weight = doc[order], feature[order], weight[order]
        self.blocks = -(-len(ids) // BLOCK)
        cell = feature * max(1, self.blocks) + self.doc // BLOCK
        self.first = np.searchsorted(cell, np.arange(len(self.vocabulary) * max(1, self.blocks) + 1))
        self.top = np.zeros((len(self.vocabulary), max(1, self.blocks)))
        np.maximum.at(self.top.reshape(-1), cell, self.weight)
        return self

    def nearest(self, feature: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and similarities of the ``k`` nearest examples with any similarity."""
        bound = weight @ self.top[feature]
        best_doc, best = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(best) == k and bound[b] < best[-1] - 1e-12):
                break
            sums = np.zeros(BLOCK)
            for f, w in zip(feature.tolist(), weight.tolist(), strict=True):
                if self.top[f, b]:
                    part = slice(self.first[f * self.blocks + b], self.first[f * self.blocks + b + 1])
                    sums[self.doc[part] - b * BLOCK] += w * self.weight[part]
            some = np.flatnonzero(sums > 0)
            doc, sim = np.concatenate([best_doc, some + b * BLOCK]), np.concatenate([best, np.round(sums[some], 12)])
            order = np.lexsort((doc, -sim))[:k]
            best_doc, best = doc[order], sim[order]
        return best_doc, best

    def votes_for(self, column: pa.Array, k: int = NEAREST):
        """Per text the vote (-1 without neighbour) and its neighbours."""
        text, feature, weight = self.vectors(column)
        vote, found = np.full(len(column), -1.0), [(np.zeros(0, np.int64), np.zeros(0))] * len(column)
        bounds = groups(text)
        for a, b in zip(bounds, bounds[1:], strict=False):
            doc, sim = self.nearest(feature[a:b], weight[a:b], k)
            if len(doc):
                found[text[a]] = doc, sim
                w = sim * self.votes[self.labels[doc]]
                vote[text[a]] = (w * self.labels[doc]).sum() / w.sum()
        return vote, found


def _bin(vote: np.ndarray) -> np.ndarray:
    return np.where(vote < 0, 0, 1 + np.minimum((vote * BINS).astype(np.int64), BINS - 1))


def monotone(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Shares per bin that never fall: neighbouring bins that would fall are pooled."""
    pools: list[list[float]] = []
    for one, all_ in zip(ones, total, strict=True):
        pools.append([one, all_, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] > pools[-1][0] * pools[-2][1]:
            one, all_, n = pools.pop()
            pools[-1] = [pools[-1][0] + one, pools[-1][1] + all_, pools[-1][2] + n]
    return np.concatenate([np.full(int(n), one / all_) for one, all_, n in pools])


class Scorer:
    def __init__(self, index: Index, shares: np.ndarray, key: T.DataType):
        self.index, self.shares, self.key = index, shares, key


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", train_rows: int = TRAIN_ROWS, examples: int = EXAMPLES, n_features: int = FEATURES) -> Scorer | None:
    """Learn from the labelled rows given; ``labels`` has key and label."""
    known = labels.select(name(key).cast(docs.schema[key].dataType).alias("id"), name(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    numbers = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not numbers:
        return None
    share = {x: min(1.0, train_rows / 2 / numbers.get(x, 1)) for x in (0, 1)}
    kept = {x: min(0.7, examples / 2 / max(1.0, share[x] * numbers.get(x, 1))) for x in (0, 1)}
    draw = F.pmod(F.xxhash64("id"), F.lit(_UNITS)) / _UNITS
    limit = lambda part: F.when(F.col("label") == 1, part[1]).otherwise(part[0])
    both = {x: share[x] * kept[x] for x in (0, 1)}
    sample = known.where(draw < limit(share)).withColumn("example", draw < limit(both))
    # bounded by train_rows, hence broadcast
    train = docs.select(name(key).alias("id"), name(text).alias("body")).join(F.broadcast(sample), "id")

    def make():
        held: list = []

        def merged():
            f, stem, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(f, kind="stable")
            f, stem, n = f[order], stem[order], n[order]
            at = groups(f)[:-1]
            return f[at], stem[at], np.add.reduceat(n, at, axis=0)

        def take(column, part):
            doc, feature, stem, _ = features(column)
            label = np.asarray(part.column(0).to_numpy(zero_copy_only=False))[doc]
            if len(feature):
                held.append((feature, stem, np.stack([label == 0, label == 1], 1).astype(np.int64)))
                held[:] = [merged()]
            return ()

        def finish():
            if held:
                f, stem, n = held[0]
                yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(stem.view(np.int64)), pa.array(n[:, 0]), pa.array(n[:, 1])], ["feature", "stem", "n0", "n1"])

        return take, finish

    seen = scan(train, "body", "feature long, stem long, n0 long, n1 long", make, ["label"]).groupBy("feature", "stem").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    t0, t1 = (float(max(1, round(share[x] * numbers.get(x, 0)))) for x in (0, 1))
    n, df = t0 + t1, F.col("n0") + F.col("n1")
    part = F.col("n1") / df  # likelihood ratio of the share among its holders against the share in the sample
    term = lambda p, base: F.when(p > 0, p * F.log(p / F.lit(base))).otherwise(0.0)
    ratio = 2 * df * (term(part, t1 / n) + term(1 - part, t0 / n))
    mostly = F.col("n1") / share[1] >= PURE * (F.col("n1") / share[1] + F.col("n0") / share[0])
    rows = seen.where(mostly).withColumn("ratio", ratio).where(F.col("ratio") >= RATIO).orderBy(F.desc("ratio"), "feature").limit(n_features).collect()
    stems = np.unique(np.array([r["stem"] & 0xFFFFFFFFFFFFFFFF for r in rows], np.uint64))
    rows = sorted((np.uint64(r["feature"] & 0xFFFFFFFFFFFFFFFF), r["n0"] / share[0] + r["n1"] / share[1]) for r in rows)
    everything = sum(numbers.values())
    index = Index(np.array([r[0] for r in rows], np.uint64), stems, np.log1p(everything / np.array([max(1.0, r[1]) for r in rows])))
    shown = train.where("example").select("id", "label", F.col("body").cast("string").cast("binary").alias("body")).dropDuplicates(["id"]).toArrow().sort_by("id")
    index.fill(shown.column("id").combine_chunks(), shown.column("label").to_numpy(), np.array([1 / max(both[x], 1e-9) for x in (0, 1)]), shown.column("body").combine_chunks().cast(pa.large_binary()))
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def calibrate():
        total = np.zeros((2, BINS + 1), np.int64)

        def take(column, part):
            vote, _ = sent.value.votes_for(column)
            np.add.at(total, (part.column(0).to_numpy(), _bin(vote)), 1)
            return ()

        def finish():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], BINS + 1)), pa.array(np.tile(np.arange(BINS + 1), 2)), pa.array(total.reshape(-1))], ["label", "bin", "n"])

        return take, finish

    rest = scan(train.where("not example"), "body", "label long, bin long, n long", calibrate, ["label"]).groupBy("label", "bin").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, BINS + 1))
    for r in rest:
        counts[r["label"], r["bin"]] = r["n"] / max(share[r["label"]], 1e-9)
    middle = np.concatenate([[numbers.get(1, 0) / everything], (np.arange(BINS) + 0.5) / BINS])
    ones, total = counts[1] + middle, counts.sum(0) + 1  # each bin starts with one text at its own vote
    return Scorer(index, np.concatenate([[ones[0] / total[0]], monotone(ones[1:], total[1:])]), docs.schema[key].dataType)


def score(docs: DataFrame, scorer: Scorer | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with score, predicted (score of 0.5 or more) and evidence (the nearest examples)."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def make():
        def work(column, part):
            known = sent.value
            if known is None:
                vote, found, scores = None, [(np.zeros(0, np.int64), np.zeros(0))] * len(column), np.zeros(len(column))
            else:
                vote, found = known.index.votes_for(column)
                scores = known.shares[_bin(vote)]
            doc, sim = (np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in (0, 1))
            doc = doc.astype(np.int64)
            ids, labels = (known.index.ids.take(pa.array(doc)), known.index.labels[doc]) if known else (pa.array(doc), doc)
            evidence = pa.StructArray.from_arrays([ids, pa.array(sim, pa.float64()), pa.array(labels, pa.int32())], ["doc_id", "similarity", "label"])
            return [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), lists(np.array([len(f[0]) for f in found], np.int64), evidence)]

        return work

    return annotate(docs, text, [FIELD("score", DOUBLE), FIELD("predicted", INT), FIELD("evidence", evidence_type(scorer.key if scorer else LONG))], make, keep)
