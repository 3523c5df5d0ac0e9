"""Quality rules: the lines of a text are labelled content or boilerplate by a linear-chain conditional random field; the content share decides.

1. Each line with a word has FEATURES, numbers cut into ranges: its words, their length and repetition, symbols, capitals, digits, its last character, whether it
   equals an earlier line. They come from the text alone.
2. The field is fitted on at most WINDOWS runs of at most WINDOW lines of labelled texts (at most LABELLED texts a label, by hash of the key). Only texts are labelled, so
   first a model of single lines learns from the label of their text; lines it contradicts strongly (a clean line behind a bad text) change sides; then the
   whole field learns emissions, transitions and start by the gradient of the log-likelihood (forward and backward sums). It has under 100 weights, rounded to whole numbers.
3. Each text's best labelling is found by Viterbi over all its lines, as a scan: steps are 2 x 2 matrices under (max, +), multiplied for all lines of
   a piece in log n passes; the backward pass composes the step functions alike. Whole numbers make it exact for every way of cutting; ties are content.
4. A text is kept if at least SHARE of its word characters are in content lines and the base rules hold.

One scan of the texts, no shuffle; the model travels with the function. Line and window equality is by the bytes and words themselves, not by hashes.

Null is the empty text; texts without words fail the base rules. Labels other than 0 and 1 and null keys teach nothing; a text with both labels counts as 0. Without labelled
texts of both kinds all lines are content. Repeated rows are judged alike. Kept columns with the name of a result column are replaced; other extra columns are not read.
Memory is that of a piece: some 40 bytes for each byte of up to 4 MB of texts, or of one longer text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.llm.common import BOOLEAN, DOUBLE, FIELD, LONG, STRING, annotate, lists, name, scan
from tabkit.llm.text import WHITE_RAW, as_bytes, groups, raw, split

SHARE = 0.5  # of the word characters
MIN_WORDS = 20
WINDOW_WORDS = 8
LABELLED = 4000  # labelled texts of each label to learn from
WINDOWS = 8000  # runs of lines to learn from
WINDOW = 32  # lines in a run
ROUNDS = 120  # steps of the gradient
SCALE = 1 << 16  # of the rounded weights
BLOCK = 1 << 17  # lines in a scan

SYMBOLS = b"#*$%&|<>"
FEATURES = {  # upper ends of the ranges of each feature
    "words": [1, 2, 4, 8, 16, 32],
    "word length": [2, 3, 4, 6, 8, 12],
    "symbols a word": [0, 0.05, 0.2, 0.5, 1],
    "exclamations a word": [0, 0.05, 0.2, 0.5, 1],
    "capitals a letter": [0, 0.05, 0.15, 0.4, 0.8],
    "digits a character": [0, 0.02, 0.1, 0.3, 0.6],
    "other marks a word": [0, 0.1, 0.3, 0.6, 1],
    "words at their first place": [0.2, 0.4, 0.6, 0.8, 0.95],
    "last character": [0, 1, 2, 3],  # letter, digit, full stop, comma, other
    "equals an earlier line": [0],
}
RANGES = 8
_MARKS = b"@_/\\=:;{}[]()+~^\"'"


def _mask(chars) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _MARK, _EXCLAIM, _DIGIT = _mask(SYMBOLS), _mask(_MARKS), _mask(b"!?"), _mask(range(48, 58))
_CAPITAL, _LETTER = _mask(range(65, 91)), _mask([*range(65, 91), *range(97, 123), *range(128, 256)])
_STARTS = ~_mask(range(128, 192))  # bytes that begin a character
_LAST = np.full(256, 4, np.int64)
_LAST[_LETTER], _LAST[_DIGIT], _LAST[ord(".")], _LAST[ord(",")] = 0, 1, 2, 3


class Lines(NamedTuple):
    """Lines with a word, in order, and counts per text."""

    start: np.ndarray  # byte offsets
    end: np.ndarray
    first: np.ndarray  # per text, the index of its first line; one more at the end
    chars: np.ndarray  # code points in the words of a line
    codes: np.ndarray  # line, feature: index of a weight
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    data: np.ndarray


def _between(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[end] - total[start]


def _word_numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    lengths = end - start
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    kept = ~WHITE_RAW.space[data]
    array = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])])
    return array.dictionary_encode().indices.to_numpy().astype(np.int64)


def _repeated_words(numbers: np.ndarray, first: np.ndarray, window: int = WINDOW_WORDS) -> np.ndarray:
    """Per word whether a window of words that its text holds twice covers it. ``window`` is a power of two; windows are numbered by doubling."""
    n = len(numbers)
    covered = np.zeros(n + 1, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    size, ids = 1, numbers
    while size < window and len(ids) > size:
        ids = np.unique(ids[:-size] * (n + 1) + ids[size:], return_inverse=True)[1]
        size *= 2
    if size < window or not len(ids):
        return covered[:n] > 0
    at = np.flatnonzero(text[: len(ids)] == text[window - 1 : window - 1 + len(ids)])
    key = ids[at] * len(first) + text[at]
    order = np.argsort(key, kind="stable")
    bounds = groups(key[order])
    often = np.repeat(np.diff(bounds) > 1, np.diff(bounds))
    hits = at[order[often]]
    np.add.at(covered, hits, 1)
    np.add.at(covered, np.minimum(hits + window, n), -1)
    return np.cumsum(covered)[:n] > 0


def lines_of(texts: pa.Array) -> Lines:
    column = as_bytes(texts)
    data, offsets = raw(column)
    words = split(column, WHITE_RAW)
    n_texts = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    start, end = np.sort(np.concatenate([offsets[:-1], breaks + 1])), np.sort(np.concatenate([breaks, offsets[1:]]))
    text = np.repeat(np.arange(n_texts), np.diff(np.searchsorted(breaks, offsets, "left")) + 1)
    word_text = np.repeat(np.arange(n_texts), np.diff(words.first))
    word_line = np.searchsorted(breaks, words.start, "left") + word_text
    in_line = np.bincount(word_line, minlength=len(start))
    full = np.flatnonzero(in_line)
    start, end, text, n_in = start[full], end[full], text[full], in_line[full]
    first_word = np.cumsum(n_in) - n_in

    numbers = _word_numbers(data, words.start, words.end)
    line_of_word = np.repeat(np.arange(len(full)), n_in)
    order = np.lexsort((numbers, line_of_word))
    new = np.ones(len(numbers), bool)
    new[1:] = (numbers[order][1:] != numbers[order][:-1]) | (line_of_word[order][1:] != line_of_word[order][:-1])
    distinct = np.bincount(line_of_word[order][new], minlength=len(full))

    earlier = np.zeros(len(full), bool)
    whole = data.tobytes()
    at, seen = -1, set()
    for k, (t, a, b) in enumerate(zip(text.tolist(), start.tolist(), end.tolist(), strict=True)):
        if t != at:
            at, seen = t, set()
        line = whole[a:b]
        earlier[k] = line in seen
        seen.add(line)

    space = WHITE_RAW.space[data]
    begins = _STARTS[data] & ~space
    chars = _between(begins, start, end)
    letters = _between(_LETTER[data] & begins, start, end)
    symbols = _SYMBOL[data]
    last = words.end[first_word + n_in - 1] - 1 if len(full) else np.zeros(0, np.int64)
    over = lambda a, b: a / np.maximum(b, 1)
    values = [
        n_in, over(chars, n_in), over(_between(symbols, start, end), n_in), over(_between(_EXCLAIM[data], start, end), n_in), over(_between(_CAPITAL[data], start, end), letters),
        over(_between(_DIGIT[data], start, end), chars), over(_between(_MARK[data], start, end), n_in), over(distinct, n_in), _LAST[data[last]], earlier,
    ]
    codes = np.empty((len(full), len(FEATURES)), np.int64)
    for k, (value, edges) in enumerate(zip(values, FEATURES.values(), strict=True)):
        codes[:, k] = k * RANGES + np.searchsorted(edges, value, "left")

    first = np.searchsorted(text, np.arange(n_texts + 1), "left")
    per_text = lambda flags, at: np.concatenate([[0], np.cumsum(flags)])[at[1:]] - np.concatenate([[0], np.cumsum(flags)])[at[:-1]]
    repeated = _repeated_words(numbers, words.first)
    return Lines(
        start, end, first, chars, codes, np.diff(words.first), per_text(chars, first), _between(symbols, offsets[:-1], offsets[1:]),
        per_text(earlier, first), per_text(repeated, words.first), data,
    )


class Field(NamedTuple):
    """Weights as whole numbers: of content against boilerplate per feature range, of steps (from, to), of the start. State 1 is content."""

    emit: np.ndarray
    step: np.ndarray
    start: np.ndarray


def untrained() -> Field:
    return Field(np.zeros(len(FEATURES) * RANGES, np.int64), np.zeros((2, 2), np.int64), np.zeros(2, np.int64))


def viterbi(field: Field, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best states of the lines; ``first`` has the starts of the sequences and the number of lines."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    emit = np.zeros((n, 2), np.int64)
    emit[:, 1] = field.emit[codes].sum(1)
    begins, ends = np.zeros(n, bool), np.zeros(n, bool)
    filled = np.flatnonzero(np.diff(first))
    begins[first[filled]], ends[first[filled + 1] - 1] = True, True
    back = np.empty((n, 2), np.int8)  # the state before, for each state
    best = np.empty(n, np.int8)
    carried = np.zeros(2, np.int64)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        made = np.where(begins[a:b, None, None], field.start[None, None, :], field.step[None]) + emit[a:b, None, :]
        gap = 1
        while gap < b - a:  # products of up to 2 * gap steps
            left, right = made[:-gap], made[gap:]
            made = np.concatenate([made[:gap], np.maximum(left[:, :, :1] + right[:, :1, :], left[:, :, 1:] + right[:, 1:, :])])
            gap *= 2
        score = (carried[None, :, None] + made).max(1)
        before = np.concatenate([carried[None], score[:-1]])
        back[a:b] = before[:, 1, None] + field.step[1] >= before[:, 0, None] + field.step[0]
        best[a:b] = score[:, 1] >= score[:, 0]
        carried = score[-1] - score[-1].max()
    states = np.empty(n, np.int64)
    following = 0
    for a in range((n - 1) // BLOCK * BLOCK, -1, -BLOCK):
        b = min(n, a + BLOCK)
        image = np.empty((b - a, 2), np.int8)  # state of a line by that of the line behind the block
        image[:-1] = back[a + 1 : b]
        image[-1] = back[b] if b < n else 0
        image[ends[a:b]] = best[a:b][ends[a:b], None]
        gap = 1
        while gap < b - a:
            image = np.concatenate([np.take_along_axis(image[:-gap], image[gap:].astype(np.int64), 1), image[-gap:]])
            gap *= 2
        states[a:b] = image[:, following]
        following = int(states[a])
    return states


def log_likelihood(emit: np.ndarray, step: np.ndarray, start: np.ndarray, codes: np.ndarray, held: np.ndarray, labels: np.ndarray):
    """Sum of log p(labels) over padded sequences and its gradient by emit, step, start. ``held`` marks the places that are lines."""
    n, wide = held.shape
    score = np.zeros((n, wide, 2))
    score[:, :, 1] = emit[codes].sum(2) * held
    ahead, behind = np.empty((n, wide, 2)), np.zeros((n, wide, 2))
    ahead[:, 0] = start + score[:, 0]
    for t in range(1, wide):
        new = np.logaddexp(ahead[:, t - 1, 0, None] + step[0], ahead[:, t - 1, 1, None] + step[1]) + score[:, t]
        ahead[:, t] = np.where(held[:, t, None], new, ahead[:, t - 1])
    for t in range(wide - 2, -1, -1):
        on = behind[:, t + 1] + score[:, t + 1]
        behind[:, t] = np.where(held[:, t + 1, None], np.logaddexp(step[None, :, 0] + on[:, 0, None], step[None, :, 1] + on[:, 1, None]), 0.0)
    whole = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    content = np.exp(ahead[:, :, 1] + behind[:, :, 1] - whole[:, None])
    rest = (labels - content) * held
    g_emit = np.bincount(codes.reshape(-1), np.repeat(rest.reshape(-1), codes.shape[2]), len(emit))
    pair = held[:, 1:]
    expected = np.exp(ahead[:, :-1, :, None] + step + (score + behind)[:, 1:, None, :] - whole[:, None, None, None]) * pair[:, :, None, None]
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:, :-1][pair], labels[:, 1:][pair]), 1)
    g_start = np.bincount(labels[:, 0], minlength=2) - np.array([(1 - content[:, 0]).sum(), content[:, 0].sum()])
    given = (np.take_along_axis(score, labels[:, :, None], 2)[:, :, 0] * held).sum(1) + start[labels[:, 0]]
    given = given + (step[labels[:, :-1], labels[:, 1:]] * pair).sum(1)
    return (given - whole).sum(), g_emit, seen - expected.sum((0, 1)), g_start


def _climb(codes, held, labels, chained: bool, rounds: int = ROUNDS, ridge: float = 1.0):
    """Weights near the maximum of the penalised likelihood, by steps scaled with the gradient's own moments."""
    weights = [np.zeros(len(FEATURES) * RANGES), np.zeros((2, 2)), np.zeros(2)]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for k in range(1, rounds + 1):
        _, *gradient = log_likelihood(*weights, codes, held, labels)
        for i, g in enumerate(gradient):
            if i == 1 and not chained:
                continue
            g = (g - ridge * weights[i]) / len(codes)
            mean[i], square[i] = 0.9 * mean[i] + 0.1 * g, 0.99 * square[i] + 0.01 * g * g
            weights[i] = weights[i] + 0.2 * (mean[i] / (1 - 0.9**k)) / (np.sqrt(square[i] / (1 - 0.99**k)) + 1e-6)
    return weights


def learn(windows: list[tuple[bytes, int]]) -> Field:
    """The field from runs of lines (feature codes, one byte each) and the labels of their texts."""
    if len({label for _, label in windows}) < 2:
        return untrained()
    wide = max(len(c) for c, _ in windows) // len(FEATURES)
    codes = np.zeros((len(windows), wide, len(FEATURES)), np.int64)
    held = np.zeros((len(windows), wide), bool)
    labels = np.zeros((len(windows), wide), np.int64)
    for k, (c, label) in enumerate(windows):
        own = np.frombuffer(c, np.uint8).reshape(-1, len(FEATURES))
        codes[k, : len(own)], held[k, : len(own)], labels[k, : len(own)] = own, True, label
    emit, _, start = _climb(codes, held, labels, chained=False)
    lean = emit[codes].sum(2)
    labels = np.where(held & (lean > 2.0), 1, np.where(held & (lean < -2.0), 0, labels))
    emit, step, start = _climb(codes, held, labels, chained=True)
    whole = lambda w: np.rint(w * SCALE).astype(np.int64)
    return Field(whole(emit), whole(step), whole(start))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", labelled: int = LABELLED, windows: int = WINDOWS) -> Field:
    """The field from labelled texts (1: good, 0: bad). At most ``labelled`` keys a label and ``windows`` runs of lines, in order of their hashes."""
    known = labels.select(name(key).alias("key"), name(label).cast("int").alias("label")).where("key is not null and label in (0, 1)")
    known = known.groupBy("key").agg(F.min("label").alias("label"))
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("key"), "key").limit(labelled)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select(name(key).alias("key"), name(text).alias("text")).join(F.broadcast(picked), "key")
    rows = rows.select(F.xxhash64("key").alias("hash"), "label", "text")

    def make():
        def take(texts, part):
            lines = lines_of(texts)
            out = []
            for k, (h, value) in enumerate(zip(part.column("hash").to_pylist(), part.column("label").to_pylist(), strict=True)):
                for number, a in enumerate(range(lines.first[k], lines.first[k + 1], WINDOW)):
                    out.append((h, number, value, lines.codes[a : min(a + WINDOW, lines.first[k + 1])].astype(np.uint8).tobytes()))
            if out:
                h, number, value, codes = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(number, pa.int64()), pa.array(value, pa.int32()), pa.array(codes, pa.binary())], ["hash", "number", "label", "codes"])

        return take, lambda: iter(())

    found = scan(rows, "text", "hash long, number long, label int, codes binary", make, keep=["hash", "label"])
    found = found.orderBy(F.xxhash64("hash", "number"), "codes", "label").limit(windows).collect()
    return learn([(bytes(r["codes"]), r["label"]) for r in found])


def judge(docs: DataFrame, field: Field, text: str = "text", keep: list[str] | None = None, share: float = SHARE) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share and the
    byte spans of its content lines ``content`` (start, end)."""

    def make():
        def work(texts, part):
            lines = lines_of(texts)
            content = viterbi(field, lines.codes, lines.first) == 1
            total = np.concatenate([[0], np.cumsum(lines.chars * content)])
            good = total[lines.first[1:]] - total[lines.first[:-1]]
            failed = (lines.n_words < MIN_WORDS) | (100 * lines.n_repeat_words > 30 * lines.n_words)
            part_good = good / np.maximum(lines.word_chars, 1)
            kept = ~failed & (part_good >= share)
            inside = np.concatenate([[0], np.cumsum(content)])
            spans = pa.StructArray.from_arrays([pa.array(_from_text(lines, lines.start)[content], pa.int64()), pa.array(_from_text(lines, lines.end)[content], pa.int64())], ["start", "end"])
            longs = [pa.array(x, pa.int64()) for x in (lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words)]
            return [*longs, pa.array(failed), pa.array(kept), pa.array(part_good), lists(inside[lines.first[1:]] - inside[lines.first[:-1]], spans)]

        offsets = None

        def _from_text(lines, places):
            return places - np.repeat(offsets[:-1], np.diff(lines.first))

        def with_offsets(texts, part):
            nonlocal offsets
            offsets = raw(as_bytes(texts))[1]
            return work(texts, part)

        return with_offsets

    from pyspark.sql import types as T

    fields = [FIELD(c, LONG) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [FIELD("base_failed", BOOLEAN), FIELD("kept", BOOLEAN), FIELD("content_share", DOUBLE)]
    fields.append(FIELD("content", T.ArrayType(T.StructType([FIELD("start", LONG), FIELD("end", LONG)]))))
    return annotate(docs, text, fields, make, keep)


def content_text(judged: DataFrame, text: str = "text", into: str = "text") -> DataFrame:
    """The texts of judged rows cut to their content lines, each ended by a line break but the last."""
    whole = F.coalesce(name(text).cast("string"), F.lit("")).cast("binary")
    part = F.transform("content", lambda s: F.decode(F.substr(whole, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), "UTF-8"))
    return judged.withColumn(into, F.array_join(part, "\n"))
