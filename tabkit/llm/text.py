"""Words of whole texts as arrays: splits and hashes an Arrow column of UTF-8 bytes without a Python loop over words.

A text column reaches the workers as binary. Words are maximal runs of bytes outside a separator set. A word's hash is a
64-bit polynomial over a fixed random table, mixed at the end, or, of a word longer than ``SHORT`` bytes, a hash of its bytes (long
words can be built on which such polynomials agree); it depends on the word alone, so counts by hash can be
made anywhere and met in a shuffle. Bytes are worked through in segments, so memory per task does not grow with the text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SEGMENT = 1 << 20
SHORT = 32  # bytes of a word
_BASE = 0x9E3779B97F4A7C1B  # odd, 3 modulo 8
_INVERSE = pow(_BASE, -1, 1 << 64)


class Separators(NamedTuple):
    folded: np.ndarray  # byte -> byte, upper case folded where wanted
    space: np.ndarray  # byte -> separator


def separators(space: np.ndarray, fold: bool) -> Separators:
    folded = np.arange(256, dtype=np.uint8)
    if fold:
        folded[65:91] += 32
    return Separators(folded, space)


_white = np.zeros(256, bool)
_white[[0x20, *range(0x09, 0x0E)]] = True
_not_word = np.ones(256, bool)
_not_word[0x30:0x3A] = _not_word[0x61:0x7B] = _not_word[0x80:] = False
_not_word_folded = _not_word.copy()
_not_word_folded[65:91] = False  # upper case is folded before the split

WHITE = separators(_white, True)  # words [^\x20\x09-\x0D]+ after lower-casing A-Z
WHITE_RAW = separators(_white, False)  # the same without lower-casing
ALNUM = separators(_not_word_folded, True)  # words of digits, letters and non-ASCII characters, after lower-casing A-Z

_table = np.random.RandomState(20240229).randint(0, 1 << 32, (2, 256), dtype=np.uint64)
_table = (_table[0] << np.uint64(32)) | _table[1]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    made = []
    for base in (_BASE, _INVERSE):
        p = np.full(max(n, SEGMENT + 1), base, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p, out=p))
    if n <= 2 * SEGMENT:  # workers live on; larger tables are not kept
        _powers[:] = made
    return made[0], made[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(*columns: np.ndarray) -> np.ndarray:
    """Hash of a sequence of hashes, elementwise."""
    h = columns[0]
    for c in columns[1:]:
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + c + np.uint64(0x2545F4914F6CDD1D))
    return h


class Words(NamedTuple):
    hash: np.ndarray  # uint64 per word
    heads: list[np.ndarray]  # hashes of the word's first bytes, for each length asked for (at most SHORT)
    start: np.ndarray  # byte offsets into data
    end: np.ndarray
    first: np.ndarray  # per text, the index of its first word; one more at the end
    data: np.ndarray


def as_bytes(column: pa.Array | pa.ChunkedArray) -> pa.BinaryArray:
    """One contiguous binary array; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    return column.cast(pa.large_binary()).fill_null(b"")


def raw(array: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array and the n + 1 offsets of the texts."""
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8) if len(array) else np.zeros(1, np.int64)
    buffer = array.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(data: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> list[int]:
    """Segment ends that split no word: at a text's start or behind a separator."""
    n, cuts = len(data), [0]
    while cuts[-1] < n:
        pos = cuts[-1]
        end = min(pos + SEGMENT, n)
        if end < n:
            best = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            gaps = np.flatnonzero(space[data[max(pos, end - 4096) : end]])
            best = max(best, max(pos, end - 4096) + int(gaps[-1]) + 1 if len(gaps) else 0)
            while best <= pos and end < n:  # a very long word: on to its end
                ahead = min(end + SEGMENT, n)
                gaps = np.flatnonzero(space[data[end:ahead]])
                nxt = int(offsets[min(np.searchsorted(offsets, end, "left"), len(offsets) - 1)])
                stops = [x for x in ((end + int(gaps[0]) + 1) if len(gaps) else n + 1, nxt) if end <= x <= ahead and x > pos]
                best, end = (min(stops), end) if stops else (0, ahead)
            end = best if best > pos else n
        cuts.append(end)
    return cuts


def split(column: pa.Array | pa.ChunkedArray, kind: Separators, head_bytes: tuple[int, ...] = ()) -> Words:
    data, offsets = raw(as_bytes(column))
    hashes, heads, starts, ends = [], [[] for _ in head_bytes], [], []
    cuts = _cuts(data, offsets, kind.space)
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = data[a:b]
        word = ~kind.space[part]
        text_start = np.zeros(b - a + 1, bool)
        inside = offsets[np.searchsorted(offsets, a, "left") : np.searchsorted(offsets, b, "right")]
        text_start[inside - a] = True
        before = np.empty(b - a, bool)
        before[0] = False
        before[1:] = word[:-1]
        s = np.flatnonzero(word & ~(before & ~text_start[:-1]))
        after = np.zeros(b - a, bool)
        after[:-1] = word[1:]
        e = np.flatnonzero(word & ~(after & ~text_start[1:])) + 1
        power, inverse = _power_tables(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_table[kind.folded[part]] * power[: b - a], out=sums[1:])
        found = mix((sums[e] - sums[s]) * inverse[s])
        for k in np.flatnonzero(e - s > SHORT).tolist():
            found[k] = xxhash.xxh3_64_intdigest(kind.folded[part[s[k] : e[k]]].tobytes())
        hashes.append(found)
        for parts, size in zip(heads, head_bytes, strict=True):
            parts.append(mix((sums[np.minimum(e, s + size)] - sums[s]) * inverse[s]))
        starts.append(s + a)
        ends.append(e + a)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = join(starts, np.int64)
    return Words(join(hashes, np.uint64), [join(x, np.uint64) for x in heads], start, join(ends, np.int64), np.searchsorted(start, offsets, "left"), data)


def groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the length at the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


def dealt(hashes: np.ndarray, width: int) -> np.ndarray:
    """Bounds of the hash ranges in a sorted array."""
    edges = np.array([(p << 64) // width for p in range(1, width)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges, "left"), [len(hashes)]])


def slices(batch: pa.RecordBatch, column: str, most: int = 2 * SEGMENT):
    """A batch in pieces of rows whose texts have about ``most`` bytes together, so that arrays per byte stay small."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0))
    part = np.cumsum(sizes) // most
    bounds = groups(part)
    for a, b in zip(bounds, bounds[1:], strict=False):
        yield batch.slice(int(a), int(b - a))
