"""Packing of tokenised documents into fixed windows by minimum bin slack.

Documents are tokenised where they lie; no text is shuffled. Each is cut at multiples of the window: whole windows are
sequences of their own, and the remaining lengths are packed. Documents are dealt to groups of a bounded expected size by a hash of
their row; within a group the multiset of remaining lengths is packed window by window: the longest length seeds the window, a bitset dynamic
programme over subset sums of the other lengths finds the sum closest to the space left, and backtracking gives
how many of each length make it up. A combination is used as often as the counts allow before the next is sought. Only the last
windows of a group can have slack.

Every row is a document of its own, repeated keys included; null and empty texts consist of the end id alone.
"""

from __future__ import annotations

import math
import os
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.llm.common import FIELD, LONG, annotate, lists, name, stage
from tabkit.llm.text import WHITE_RAW, split

GROUP_DOCUMENTS = 16384  # expected documents per packing group
CACHE_WORDS = 1 << 20  # words whose ids a worker remembers


class Encoder:
    """Token ids of texts, for a tokenizer that never joins across ASCII white space: each word is encoded once and looked up after."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized and not (t.lstrip or t.rstrip or t.single_word)]
        self.mark, self.mark_id = special[0] if special else (None, None)
        self._clear()

    def _clear(self) -> None:
        """The cache: sorted word hashes, each with the place of its ids; arrays, as a dictionary of so many words takes ten times the room."""
        self.hashes, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _encode(self, words: list[str]):
        """Ids of each word; many at a time, with a special token between them, which ids of words without it cannot hold."""
        if self.mark is None:
            yield from (e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False))
            return
        plain = [w if self.mark not in w else "" for w in words]
        for a in range(0, len(plain), 64 * 256):
            joined = [self.mark.join(plain[k : k + 64]) for k in range(a, min(a + 64 * 256, len(plain)), 64)]
            for k, e in enumerate(self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
                ids = e.ids
                low = 0
                for w in words[a + 64 * k : a + 64 * (k + 1)]:
                    try:
                        high = ids.index(self.mark_id, low)
                    except ValueError:
                        high = len(ids)
                    yield ids[low:high] if self.mark not in w else self.tokenizer.encode(w, add_special_tokens=False).ids
                    low = high + 1

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the n + 1 offsets of the texts."""
        words = split(column, WHITE_RAW)
        distinct, at, which = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE_WORDS:
            self._clear()
        place = np.searchsorted(self.hashes, distinct)
        known = np.append(self.hashes, np.uint64(0))[place] == distinct
        known &= place < len(self.hashes)
        new = np.flatnonzero(~known)
        if len(new):
            data = words.data.tobytes()
            spans = zip(words.start[at[new]].tolist(), words.end[at[new]].tolist(), strict=True)
            sizes, ids = array("q"), array("I")
            for one in self._encode([data[a:b].decode("utf-8", "replace") for a, b in spans]):
                sizes.append(len(one))
                ids.extend(one)
            self.hashes = np.insert(self.hashes, place[new], distinct[new])
            self.entry = np.insert(self.entry, place[new], len(self.first) - 1 + np.arange(len(new)))
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes, dtype=np.int64)])
            self.ids = np.concatenate([self.ids, np.array(ids, np.uint32)])
        first = self.first
        entry = self.entry[np.searchsorted(self.hashes, distinct)][which.reshape(-1)]
        size = first[entry + 1] - first[entry]
        sums = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(first[entry] - sums[:-1], size) + np.arange(sums[-1])]
        return flat, sums[words.first]


def tokenise(docs: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None, window: int = 2048, end_id: int = 1) -> DataFrame:
    """``docs`` with n_tokens (end id included) and crcs: crc32 of the ids (little-endian, 32 bits) of each cut piece."""

    def make():
        encoder = Encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()

        def work(column, part):
            ids, offsets = encoder.encode(column)
            body = ids.astype("<u4").tobytes()
            n = np.diff(offsets) + 1
            pieces = -(-n // window)
            crcs = np.zeros(pieces.sum(), np.int64)
            k = 0
            for a, size in zip(offsets[:-1].tolist(), n.tolist(), strict=True):
                for at in range(0, size, window):
                    to = min(at + window, size)
                    crc = zlib.crc32(body[4 * (a + at) : 4 * (a + min(to, size - 1))])
                    crcs[k] = zlib.crc32(end, crc) if to == size else crc
                    k += 1
            return [pa.array(n, pa.int64()), lists(pieces, pa.array(crcs))]

        return work

    return annotate(docs, text, [FIELD("n_tokens", LONG), FIELD("crcs", T.ArrayType(LONG))], make, keep)


def fill(counts: dict[int, int], space: int) -> Counter:
    """The multiset out of ``counts`` whose sum is closest below or at ``space``: subset sums as bits, longest lengths first."""
    limit = (1 << (space + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x, c in counts.items() if c and x <= space), reverse=True):
        left, copies = min(counts[length], space // length), 1
        while left and not reach >> space & 1:
            take = min(copies, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & limit
            left -= take
            copies *= 2
        if reach >> space & 1:
            break
    target, used = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> target & 1:
            used[length] += take
            target -= length * take
    return used


def windows(counts: dict[int, int], window: int):
    """Pack a multiset of lengths: yields (lengths of a window, how often)."""
    counts = {x: c for x, c in counts.items() if c}
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        used = fill(counts, window - seed)
        counts[seed] += 1
        used[seed] += 1
        times = min(counts[x] // c for x, c in used.items())
        yield sorted(used.elements(), reverse=True), times
        for x, c in used.items():
            counts[x] -= c * times
            if not counts[x]:
                del counts[x]


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = 2048, end_id: int = 1, group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = tokenise(docs.select(name(key), name(text)), tokenizer, text, [key], window, end_id)
    cut = stage(cut.withColumn("row", F.monotonically_increasing_id()), "packing")  # the number must not change if a task runs again
    groups = max(1, math.ceil(cut.count() / group_documents))
    key_field = cut.schema[0]
    schema = T.StructType([key_field, *(FIELD(x, LONG) for x in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])

    def pack_group(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        group = table.column("grp")[0].as_py()
        n = table.column("n_tokens").to_numpy()
        crcs = table.column("crcs").combine_chunks()
        values, first = crcs.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc_lengths(crcs))])
        whole, rest = n // window, n % window
        doc = np.repeat(np.arange(len(n)), whole)  # whole windows
        nth = np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)
        rows = [(doc, nth * window, np.full(len(doc), window), values[first[doc] + nth], np.arange(len(doc)), np.zeros(len(doc), np.int64))]
        waiting = {int(x): np.flatnonzero(rest == x)[::-1].tolist() for x in np.unique(rest) if x}
        sequence, placed = len(doc), []
        for lengths, times in windows({x: len(w) for x, w in waiting.items()}, window):
            for _ in range(times):
                at = 0
                for x in lengths:
                    placed.append((waiting[x].pop(), sequence, at))
                    at += x
                sequence += 1
        if placed:
            doc, seq, at = np.array(placed, np.int64).T
            rows.append((doc, whole[doc] * window, rest[doc], values[first[doc + 1] - 1], seq, at))
        doc, start, length, crc, seq, at = (np.concatenate(x) for x in zip(*rows, strict=True))
        made = [start, length, crc, n[doc], seq + (int(group) << 40), at]
        keys = table.column(0).combine_chunks().take(pa.array(doc))
        return pa.table([keys, *(pa.array(x, pa.int64()) for x in made)], names=schema.names)

    cut = cut.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return cut.groupBy("grp").applyInArrow(pack_group, schema)


def pc_lengths(column: pa.ListArray) -> np.ndarray:
    return np.diff(column.offsets.to_numpy())
