"""Language-model scoring with a log-frequency Bloom filter.

Counting: tokens (words and one end per text) and their pairs are counted where they lie, dealt to hash ranges as packed arrays, and merged
per range. A count c is quantised to level 1 + floor(log(c) / log(BASE)); the filter holds the events (n-gram, 1) .. (n-gram,
level). Each hash range has its own segment with ``BITS`` bits per event, so the filter grows with the corpus and its error
rate does not.

Scoring: an n-gram's level is found by repeated membership probes (1, 2, .. until one fails). A word or pair counts as the least of its level, a
history as the most of its own, so the probabilities that follow a history sum up to 1 at most: P(w) = (c(w) + 1) / (N + V + 1) and
P(w | h) = (min(c(h w), c(h)) + M P(w)) / (c(h) + M). A wrong membership (about 2 in 100 unseen pairs) can add to that sum, but no
probability passes 1. The history of a text's first token is the end.

The filter is broadcast while it has at most ``filter_bytes``; beyond that the distinct n-grams of each block of texts are sent to
the segments and their levels sent back, with equal results. Exact counts for the base score: words with counts above a limit chosen so that at most
``head_words`` lie above are broadcast, the counts of all others are joined.

Null and empty texts have one token, the end. Without training rows N and V are 0 and every probability is 1. Repeated rows count, and are
scored, each on its own. Counts are by 64-bit hash of the word.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.llm.common import BINARY, DOUBLE, FIELD, INT, LONG, annotate, lists, name, release, scan, shuffle_width, stage
from tabkit.llm.text import WHITE, chain, dealt, groups, mix, raw, split

BASE = 1.5
BITS = 8
PROBES = 5
M = 50.0
FILTER_BYTES = 192 << 20
HEAD_WORDS = 1 << 20
BLOCK_BYTES = 8 << 20  # of text, whose n-grams ask together
FLUSH = 3 << 20  # distinct n-grams held by a counting task
END = np.uint64(0x454E445F454E445F)  # stands for the end token; no word hashes to it but by chance
_LEVELS = 128


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, the end after each, and the n + 1 offsets."""
    words = split(column, WHITE)
    out = np.insert(words.hash, words.first[1:], END)
    return out, words.first + np.arange(len(words.first))


def pairs(flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The history of each token and the hash of both."""
    history = np.empty_like(flat)
    history[1:] = flat[:-1]
    history[first[:-1]] = END
    return history, chain(history, flat)


def pack(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte by byte: the high bytes are zero and shrink where Spark compresses."""
    return np.diff(hashes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, np.uint8).reshape(8, -1).T.copy().view("<u8").reshape(-1), dtype=np.uint64)


def level_of(count: np.ndarray) -> np.ndarray:
    limits = np.ceil(BASE ** np.arange(_LEVELS - 1))  # least count of each level, whole
    return np.searchsorted(limits, count, "right").clip(1, _LEVELS - 1)


def _places(hashes: np.ndarray, level: np.ndarray, bits: np.ndarray):
    x = mix(hashes + level.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    low, step = x >> np.uint64(32), (x & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    for k in range(PROBES):
        yield (low + np.uint64(k) * step) % bits


def build_segment(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    level = level_of(counts)
    bits = max(64, -(-int(level.sum()) * BITS // 64) * 64)
    filled = np.zeros(bits, bool)
    part = np.cumsum(level) >> 20
    for a, b in zip(groups(part), groups(part)[1:], strict=False):
        n = level[a:b]
        event = np.repeat(hashes[a:b], n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
        for at in _places(event, nth, np.uint64(bits)):
            filled[at] = True
    return np.packbits(filled, bitorder="little").tobytes()


class Filter:
    """Segments of one or both orders, and the mean counts of their levels."""

    def __init__(self, width: int, means: np.ndarray):
        self.width, self.means = width, means
        self.body = np.zeros(0, np.uint8)
        self.first, self.bits = np.zeros((3, width), np.int64), np.zeros((3, width), np.uint64)

    def put(self, order: int, p: int, at: int, segment: bytes) -> None:
        self.body[at : at + len(segment)] = np.frombuffer(segment, np.uint8)
        self.first[order, p], self.bits[order, p] = at, len(segment) * 8

    def levels(self, order: int, hashes: np.ndarray) -> np.ndarray:
        """Of sorted distinct hashes."""
        bounds = dealt(hashes, self.width)
        p = np.repeat(np.arange(self.width), np.diff(bounds))
        level = np.zeros(len(hashes), np.int64)
        alive = np.flatnonzero(self.bits[order, p] > 0)
        while len(alive):
            inside = np.arange(len(alive))
            bits, first = self.bits[order, p[alive]], self.first[order, p[alive]]
            for at in _places(hashes[alive], level[alive] + 1, bits):
                at = at[inside].astype(np.int64)
                inside = inside[(self.body[first[inside] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1]
            alive = alive[inside]
            level[alive] += 1
            alive = alive[level[alive] < _LEVELS - 1]
        return level


def count(docs: DataFrame, text: str, width: int) -> DataFrame:
    """(ord, p, hashes, counts): arrays, the hashes packed, ``p`` the hash range; every n-gram of a range may occur in several rows."""

    def make():
        held: dict[int, list] = {1: [], 2: []}

        def flush(order):
            parts, held[order] = held[order], []
            if not parts:
                return
            h, c = _merge(parts)
            bounds = dealt(h, width)
            some = np.flatnonzero(np.diff(bounds))
            yield pa.RecordBatch.from_arrays(
                [pa.array([order] * len(some), pa.int32()), pa.array(some, pa.int32())] + [pa.array([form(x[bounds[p] : bounds[p + 1]]) for p in some], pa.binary()) for form, x in ((pack, h), (bytes, c.astype(np.uint32)))],
                ["ord", "p", "hashes", "counts"],
            )

        def take(column, part):
            flat, first = tokens(column)
            for order, h in ((1, flat), (2, pairs(flat, first)[1])):
                held[order].append(np.unique(h, return_counts=True))
                if sum(len(x[0]) for x in held[order]) > FLUSH:
                    held[order] = [_merge(held[order])]
                    if len(held[order][0][0]) > FLUSH // 2:
                        yield from flush(order)

        def finish():
            yield from flush(1)
            yield from flush(2)

        return take, finish

    return scan(docs, text, "ord int, p int, hashes binary, counts binary", make)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order].astype(np.int64)
    bounds = groups(h)
    return (h[bounds[:-1]], np.add.reduceat(c, bounds[:-1])) if len(h) else (h, c)


_SEGMENT = T.StructType([FIELD("ord", INT), FIELD("p", INT), FIELD("segment", BINARY), FIELD("hashes", BINARY), FIELD("counts", BINARY), FIELD("numbers", T.ArrayType(LONG)), FIELD("sums", T.ArrayType(LONG))])


def build(counted: DataFrame, width: int) -> DataFrame:
    """One row per order and range: filter segment, per level how many n-grams and their counts' sum, and for words the exact counts."""

    def run(batches):
        key, parts = None, []

        def done():
            h, c = _merge(parts)
            level = level_of(c)
            stats = [np.bincount(level, w, _LEVELS).astype(np.int64) for w in (np.ones(len(c)), c)]
            words = key[0] == 1
            row = [[key[0]], [key[1]], [build_segment(h, c)], [h.tobytes() if words else None], [c.tobytes() if words else None], [stats[0].tolist()], [stats[1].tolist()]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], _SEGMENT.names)

        for batch in batches:
            for row in batch.to_pylist():
                if (row["ord"], row["p"]) != key:
                    if parts:
                        yield done()
                    key, parts = (row["ord"], row["p"]), []
                parts.append((unpack(row["hashes"]), np.frombuffer(row["counts"], np.uint32)))
                if sum(len(x[0]) for x in parts) > FLUSH:
                    parts = [_merge(parts)]
        if parts:
            yield done()

    return counted.repartition(width, "ord", "p").sortWithinPartitions("ord", "p").mapInArrow(run, _SEGMENT)


class Model:
    """The trained model: the staged segments and what the driver knows about them."""

    def __init__(self, segments: DataFrame, width: int, filter_bytes: int, head_words: int):
        self.segments, self.width, self.filter_bytes = segments, width, filter_bytes
        rows = segments.groupBy("ord").agg(
            F.sum(F.octet_length("segment")).alias("size"), *(F.sum(F.element_at(c, k + 1)).alias(f"{c}{k}") for c in ("numbers", "sums") for k in range(_LEVELS))
        ).collect()
        stats = np.zeros((3, 2, _LEVELS))
        self.size = 0
        for r in rows:
            stats[r["ord"]] = [[r[f"{c}{k}"] for k in range(_LEVELS)] for c in ("numbers", "sums")]
            self.size += r["size"]
        self.vocabulary, self.train_tokens = int(stats[1, 0].sum()), int(stats[1, 1].sum())
        self.means = np.divide(stats[:, 1], stats[:, 0], out=np.zeros_like(stats[:, 0]), where=stats[:, 0] > 0)
        above = np.cumsum(stats[1, 0][::-1])[::-1]  # words on a level or above
        level = int(np.flatnonzero(above <= head_words)[0])
        self.head_count = int(np.ceil(BASE ** (level - 1))) if level else 1  # words with that count or more are broadcast

    @property
    def total(self) -> float:
        return float(self.train_tokens + self.vocabulary + 1)

    def word_counts(self, frequent: bool) -> DataFrame:
        least = self.head_count

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    h, c = np.frombuffer(row["hashes"], np.int64), np.frombuffer(row["counts"], np.int64)
                    some = c >= least if frequent else c < least
                    yield pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(c[some])], ["word", "n"])

        return self.segments.where("ord = 1").select("hashes", "counts").mapInArrow(run, "word long, n long")

    def collect_filter(self) -> Filter:
        """The whole filter, read one part at a time into one array; its size has been checked."""
        known, at = Filter(self.width, self.means), 0
        known.body = np.empty(self.size, np.uint8)
        for row in self.segments.select("ord", "p", "segment").toLocalIterator():
            known.put(row["ord"], row["p"], at, row["segment"])
            at += len(row["segment"])
        return known


def train(docs: DataFrame, text: str = "text", filter_bytes: int = FILTER_BYTES, head_words: int = HEAD_WORDS) -> Model:
    width = shuffle_width(docs, 2)
    return Model(stage(build(count(docs, text, width), width), "lm"), width, filter_bytes, head_words)


def least_of(level: np.ndarray) -> np.ndarray:
    """The smallest count on a level; 0 is the level of what was never seen."""
    return np.where(level > 0, np.ceil(BASE ** (np.maximum(level, 1) - 1.0)), 0.0)


def most_of(level: np.ndarray) -> np.ndarray:
    """The largest count on a level."""
    return np.where(level > 0, np.ceil(BASE ** np.asarray(level, float)) - 1, 0.0)


def text_scores(flat: np.ndarray, first: np.ndarray, lookup, total: float) -> np.ndarray:
    """log10 probability of each text. ``lookup(order, sorted distinct hashes)`` gives levels."""
    history, both = pairs(flat, first)
    words, at = np.unique(np.concatenate([flat, [END]]), return_inverse=True)
    single = lookup(1, words)
    pair, which = np.unique(both, return_inverse=True)
    p = (least_of(single)[at.reshape(-1)[:-1]] + 1) / total
    before = most_of(single)[np.searchsorted(words, history)]
    joint = np.minimum(least_of(lookup(2, pair))[which.reshape(-1)], before)
    return np.add.reduceat(np.log10((joint + M * p) / (before + M)), first[:-1]) if len(first) > 1 else np.zeros(0)


_MADE = [FIELD("n_tokens", LONG), FIELD("score", DOUBLE), FIELD("known", LONG), FIELD("logs", DOUBLE), FIELD("rest", T.ArrayType(LONG))]


def _made(flat, first, scores, head) -> list[pa.Array]:
    """The columns ``_MADE``: ``rest`` holds the tokens that are not in the head."""
    words, counts = head
    at = np.minimum(np.searchsorted(words, flat), max(0, len(words) - 1))
    found = words[at] == flat if len(words) else np.zeros(len(flat), bool)
    logs = np.where(found, np.log10(counts[at] + 1.0) if len(words) else 0.0, 0.0)
    n = np.diff(first)
    sums = (lambda x: np.add.reduceat(x, first[:-1])) if len(n) else (lambda x: np.zeros(0, x.dtype))
    known = sums(found.astype(np.int64))
    return [pa.array(n), pa.array(scores), pa.array(known), pa.array(sums(logs)), lists(n - known, pa.array(flat[~found].view(np.int64)))]


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {"n_tokens", "n_known", "train_tokens", "base_score", "score", "known", "logs", "rest"}]
    rows = model.word_counts(True).toArrow()
    head = rows.column("word").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(head[0])
    head = spark.sparkContext.broadcast((head[0][order], head[1][order]))
    total = model.total
    if model.size <= model.filter_bytes:
        sent = spark.sparkContext.broadcast(model.collect_filter())

        def make():
            def work(column, part):
                flat, first = tokens(column)
                return _made(flat, first, text_scores(flat, first, sent.value.levels, total), head.value)

            return work

        scored = annotate(docs, text, _MADE, make, keep)
    else:
        scored = _routed(docs, model, text, keep, head)
    scored = stage(scored.withColumn("__row", F.monotonically_increasing_id()), "lmscore")
    rest = scored.select("__row", F.explode("rest").alias("word")).groupBy("__row", "word").agg(F.count("*").alias("k"))
    rest = rest.join(model.word_counts(False), "word").groupBy("__row").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("more"))
    out = scored.join(rest, "__row", "left")
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(total)))
    made = [F.col("n_tokens"), (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"), logs.alias("base_score"), F.col("score")]
    return out.select(*[name(c) for c in keep], *made)


def _routed(docs: DataFrame, model: Model, text: str, keep: list[str], head) -> DataFrame:
    """For filters beyond the broadcast bound: blocks of texts send their distinct n-grams to the segments and get the levels.

    A block travels as compressed texts, which are split again where its tokens are needed; a segment answers all blocks at once.
    """
    width, means, total = model.width, model.means, model.total
    carried = T.StructType([docs.schema[c] for c in keep])

    def make():
        from pyspark import TaskContext

        made, held = [TaskContext.get().partitionId() << 32], []

        def emit():
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as writer:
                for part in held:
                    writer.write_batch(part)
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array([made[0]]), pa.array([sink.getvalue()], pa.binary())], ["block", "body"])
            made[0] += 1

        def take(column, part):
            held.append(pa.RecordBatch.from_arrays([*part.columns[:-1], column], [str(i) for i in range(part.num_columns)]))
            if sum(len(raw(p.column(p.num_columns - 1))[0]) for p in held) >= BLOCK_BYTES:
                yield from emit()

        def finish():
            if held:
                yield from emit()

        return take, finish

    blocks = stage(scan(docs, text, "block long, body binary", make, keep), "lmblocks")

    def read(body):
        """The kept columns of a block, its tokens and their offsets."""
        parts = [b for b in pa.ipc.open_stream(body) if b.num_rows]
        split_up = [tokens(b.column(b.num_columns - 1)) for b in parts]
        first, at = [np.zeros(1, np.int64)], 0
        for flat, f in split_up:
            first.append(f[1:] + at)
            at += len(flat)
        return pa.Table.from_batches(parts).select(range(len(keep))), np.concatenate([flat for flat, _ in split_up]), np.concatenate(first)

    def distinct(flat, first, order):
        return np.unique(np.concatenate([flat, [END]]) if order == 1 else pairs(flat, first)[1])

    def ask(batches):
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, flat, first = read(body.as_buffer())
                for order in (1, 2):
                    h = distinct(flat, first, order)
                    bounds = dealt(h, width)
                    some = np.flatnonzero(np.diff(bounds))
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int64()), pa.array([order] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array([pack(h[bounds[p] : bounds[p + 1]]) for p in some], pa.binary())], ["block", "ord", "p", "hashes"])
        release()

    asked = blocks.mapInArrow(ask, "block long, ord int, p int, hashes binary")

    def answer(asked: pa.Table, segments: pa.Table) -> pa.Table:
        known = Filter(width, means)
        for row in segments.to_pylist():  # one segment
            known.body = np.empty(len(row["segment"]), np.uint8)
            known.put(row["ord"], row["p"], 0, row["segment"])
        if not asked.num_rows:
            return asked.select(["block", "ord", "p"]).append_column("levels", pa.array([], pa.binary()))
        parts = [unpack(h.as_buffer()) for h in asked.column("hashes")]
        every, at = np.unique(np.concatenate(parts), return_inverse=True)
        levels = known.levels(asked.column("ord")[0].as_py(), every).astype(np.uint8)[at.reshape(-1)]
        ends = np.cumsum([len(x) for x in parts])
        return asked.select(["block", "ord", "p"]).append_column("levels", pa.array([levels[b - len(x) : b].tobytes() for x, b in zip(parts, ends, strict=True)], pa.binary()))

    answered = asked.groupBy("ord", "p").cogroup(model.segments.select("ord", "p", "segment").groupBy("ord", "p")).applyInArrow(answer, "block long, ord int, p int, levels binary")
    schema = T.StructType(carried.fields + _MADE)

    def finish(blocks: pa.Table, levels: pa.Table) -> pa.Table:
        kept, flat, first = read(blocks.column("body")[0].as_buffer())
        by_order = {1: [], 2: []}
        for r in levels.sort_by([("ord", "ascending"), ("p", "ascending")]).to_pylist():
            by_order[r["ord"]].append(np.frombuffer(r["levels"], np.uint8))
        scores = text_scores(flat, first, lambda order, h: np.concatenate(by_order[order]).astype(np.int64), total)
        return pa.table([*kept.columns, *_made(flat, first, scores, head.value)], names=schema.names)

    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(finish, schema)
