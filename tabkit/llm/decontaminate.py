"""Benchmark passages in documents: a prefix-filtered join of item windows with whole texts.

Every window of ``window`` consecutive item words (a shorter item is one window) is a set of words that must all occur,
so its prefix is one word: the rarest by the words' counts over all documents. A document's words are met with
these prefix words only. The prefix word's place in the window then fixes where the window would start (positional bound), the
window must end inside the document (length bound), and the remaining candidates are verified word by word.

Item windows reach the workers in shards of bounded size; a larger benchmark has more shards, which one job goes
through one after the other for each piece of documents. No text is shuffled.

Null or wordless texts have no words and are never hit; null or wordless items have no window. Equal windows of several items are
one window with several items; a repeated item_id counts once; a null item_id is the empty text. Repeated documents are scored one by one.
A column of ``docs`` named like a result column is replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.llm.common import FIELD, LONG, STRING, annotate, lists, name, scan, texts
from tabkit.llm.text import ALNUM, groups, split

SHARD_BYTES = 8 << 20  # item text per shard; its windows take about ten times as much on each worker
EXPAND = 1 << 20  # candidates looked at together

RESULT = [
    FIELD("n_words", LONG),
    FIELD("hit_runs", T.ArrayType(T.StructType([FIELD("first", LONG), FIELD("last", LONG)]))),
    FIELD("items", T.ArrayType(STRING)),
]


class Windows:
    """The windows of a shard of items, as positions in its vocabulary."""

    def __init__(self, ids: list[str], column: pa.Array, window: int):
        order = sorted(range(len(ids)), key=lambda i: ids[i].encode("utf-8", "surrogatepass"))
        self.items, owner = np.unique(np.array([ids[i].encode("utf-8", "surrogatepass") for i in order], object), return_inverse=True) if ids else (np.array([], object), np.zeros(0, int))
        words = split(column.take(pa.array(order, pa.int64())), ALNUM)
        self.vocabulary, codes = np.unique(words.hash, return_inverse=True)
        n = np.diff(words.first)
        size = np.minimum(n, window)
        count = np.where(n > 0, n - size + 1, 0)
        item = np.repeat(np.arange(len(n)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(words.first[:-1], count)
        table = np.full((len(at), window), -1, np.int64)
        for k in range(window):
            inside = k < size[item]
            table[inside, k] = codes[at[inside] + k]
        self.words, which = np.unique(table, axis=0, return_inverse=True) if len(table) else (table, np.zeros(0, int))
        which = which.reshape(-1)
        self.size = (self.words >= 0).sum(1)
        pair = np.unique(which.astype(np.int64) * max(1, len(self.items)) + owner[item]) if len(which) else np.zeros(0, np.int64)
        self.pair_window, self.pair_item = np.divmod(pair, max(1, len(self.items)))
        self.pair_first = np.searchsorted(self.pair_window, np.arange(len(self.words) + 1))

    def order_by(self, counts: np.ndarray) -> None:
        """Fix each window's prefix word, the rarest in the documents; ties go to the first in the window."""
        seen = np.where(self.words >= 0, counts[self.words], np.iinfo(np.int64).max)
        self.place = seen.argmin(1) if len(seen) else np.zeros(0, np.int64)
        prefix = self.words[np.arange(len(self.words)), self.place]
        self.by_prefix = np.argsort(prefix, kind="stable")
        self.prefix_first = np.searchsorted(prefix[self.by_prefix], np.arange(len(self.vocabulary) + 1))

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def find(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences (word position, window) in texts whose words are ``hashes[first[i]:first[i + 1]]``."""
        codes = self.codes(hashes)
        place = np.flatnonzero(codes >= 0)
        many = self.prefix_first[codes[place] + 1] - self.prefix_first[codes[place]]
        place, many = place[many > 0], many[many > 0]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        part = np.cumsum(many) // EXPAND
        for a, b in zip(groups(part), groups(part)[1:], strict=False):
            p, m = place[a:b], many[a:b]
            nth = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            window = self.by_prefix[np.repeat(self.prefix_first[codes[p]], m) + nth]
            p = np.repeat(p, m)
            start = p - self.place[window]
            text = np.searchsorted(first, p, "right") - 1
            ok = (start >= first[text]) & (start + self.size[window] <= first[text + 1])
            start, window = start[ok], window[ok]
            for k in range(self.words.shape[1]):
                want = self.words[window, k]
                ok = (want < 0) | (codes[np.minimum(start + k, len(codes) - 1)] == want)
                start, window = start[ok], window[ok]
            found.append((start, window))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _shards(benchmark: DataFrame, item: str, item_text: str, window: int, shard_bytes: int) -> list[Windows]:
    items = benchmark.select(F.coalesce(name(item).cast("string"), F.lit("")).alias("item"), name(item_text).cast("string").cast("binary").alias("body"))
    total = items.agg(F.sum(F.octet_length("body") + F.octet_length("item") + 64)).first()[0] or 0
    n = max(1, math.ceil(total / shard_bytes))
    made = []
    for k in range(n):  # a few shards of a bounded size, one at a time
        part = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(n)) == k).toArrow()
        made.append(Windows(part.column("item").to_pylist(), part.column("body").combine_chunks().cast(pa.large_binary()), window))
    return [w for w in made if len(w.words)]


def _count(docs: DataFrame, text: str, windows: Windows) -> np.ndarray:
    """How often each word of the shard occurs in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(windows.vocabulary)

    def make():
        vocabulary = sent.value
        total = np.zeros(len(vocabulary), np.int64)

        def take(column, part):
            h = split(column, ALNUM).hash
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            total[:] += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
            return ()

        def finish():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["word", "n"])

        return take, finish

    counts = np.zeros(len(windows.vocabulary), np.int64)
    rows = scan(docs, text, "word long, n long", make).groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    counts[rows.column("word").to_numpy()] = rows.column("n").to_numpy()
    return counts


def _merge(spans: list[dict], more: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted([(s["first"], s["last"]) for s in spans] + more):
        if out and a <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], b)
        else:
            out.append({"first": a, "last": b})
    return out


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, keep: list[str] | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with n_words, hit_runs (runs of hit words, first and last index, from 0) and items (ids found, sorted as text)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {f.name for f in RESULT}]
    shards = _shards(benchmark, item, item_text, window, shard_bytes)
    out, carried = docs, keep
    for k, windows in enumerate(shards or [Windows([], pa.array([], pa.large_binary()), window)]):
        windows.order_by(_count(docs, text, windows) if shards else np.zeros(0, np.int64))
        sent = docs.sparkSession.sparkContext.broadcast(windows)
        last = k == max(1, len(shards)) - 1
        hold = carried if last or text in carried else [*carried, text]
        out = _step(out, text, sent, [*hold, *([f.name for f in RESULT] if k else [])], first=k == 0)
        carried = hold
    return out.select(*[name(c) for c in keep], *[f.name for f in RESULT])


def _step(docs: DataFrame, text: str, sent, keep: list[str], first: bool) -> DataFrame:
    """Look for one shard; after the first, results so far come in as columns under other names."""
    if not first:
        docs = docs.withColumnsRenamed({"hit_runs": "__runs", "items": "__items"})
        keep = ["__runs" if c == "hit_runs" else "__items" if c == "items" else c for c in keep]

    def make():
        windows: Windows = sent.value

        def work(column, part):
            words = split(column, ALNUM)
            start, window = windows.find(words.hash, words.first)
            owner = np.searchsorted(words.first, start, "right") - 1
            change = np.zeros(len(words.hash) + 1, np.int64)
            np.add.at(change, start, 1)
            np.add.at(change, start + windows.size[window], -1)
            hit = np.cumsum(change[:-1]) > 0
            text_of = np.repeat(np.arange(len(column)), np.diff(words.first))
            opens = hit.copy()
            opens[1:] &= ~hit[:-1] | (text_of[1:] != text_of[:-1])
            closes = hit.copy()
            closes[:-1] &= ~hit[1:] | (text_of[1:] != text_of[:-1])
            a, b = np.flatnonzero(opens), np.flatnonzero(closes)
            run_text = text_of[a]
            base = words.first[run_text]
            pair = np.unique(owner * max(1, len(windows.words)) + window)
            doc, w = np.divmod(pair, max(1, len(windows.words)))
            many = windows.pair_first[w + 1] - windows.pair_first[w]
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            item = windows.pair_item[np.repeat(windows.pair_first[w], many) + nth]
            both = np.unique(np.repeat(doc, many) * max(1, len(windows.items)) + item)
            doc, item = np.divmod(both, max(1, len(windows.items)))
            runs = pa.StructArray.from_arrays([pa.array(a - base, pa.int64()), pa.array(b - base, pa.int64())], ["first", "last"])
            runs = lists(np.bincount(run_text, minlength=len(column)), runs)
            items = lists(np.bincount(doc, minlength=len(column)), texts([windows.items[i].decode("utf-8", "surrogatepass") for i in item]))
            if not first:
                before = [part.column(part.schema.get_field_index(c)).to_pylist() for c in ("__runs", "__items")]
                runs = pa.array([_merge(x or [], [(s["first"], s["last"]) for s in y]) for x, y in zip(before[0], runs.to_pylist(), strict=True)], runs.type)
                items = pa.array([sorted({*(x or []), *y}, key=lambda s: s.encode()) for x, y in zip(before[1], items.to_pylist(), strict=True)], items.type)
            return [pa.array(np.diff(words.first), pa.int64()), runs, items]

        return work

    return annotate(docs, text, RESULT, make, keep).drop("__runs", "__items")


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``find_items`` with n_hit (hit words), n_items and contaminated (n_hit > 0)."""
    found = find_items(docs, benchmark, **options)
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"] + 1)
    return found.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long"), "contaminated": F.size("hit_runs") > 0})
