"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point. A letter trigram binds the letters' vectors, each permuted
by its place (rotation), by multiplication; a text bundles its trigrams by addition; a language's prototype bundles the texts
learned for it, each with the same weight. A text gets the language whose prototype has the largest cosine with it.

Words are padded with a blank on both sides; every character that is no letter ends a word. Trigrams are counted first, so a
text's vector is one row of a matrix product of counts and trigram vectors.

Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing was learned. Ties go to the first
language in text order. Texts without letters and rows without language teach nothing. Repeated rows count as often as they occur.
The score is the cosine, 0 where negative.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.llm.common import DOUBLE, FIELD, STRING, annotate, name, scan
from tabkit.llm.text import mix, raw

DIMENSIONS = 1024
MAX_LANGUAGES = 16384  # prototypes are 8 kB each; every learned label is one language
_SCALE = 1 << 20  # learned vectors are summed as whole numbers, hence the same in any order
_LETTERS = 0x40000  # no letters lie above
_CELLS = 1 << 22  # counts held in a matrix at a time

_fold: np.ndarray | None = None


def letters() -> np.ndarray:
    """Code point to lower-case letter, 0 if it is none."""
    global _fold
    if _fold is None:
        _fold = np.fromiter((ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(_LETTERS)), np.uint32, _LETTERS)
    return _fold


def letter_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    bits = mix(codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, dimensions // 64 + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1342543DE82EF95))
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def vectors(column: pa.Array, dimensions: int) -> np.ndarray:
    """One vector per text; all zero for a text without letters."""
    data, offsets = raw(column)
    body = data.tobytes()
    plain = [body[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    points = np.frombuffer(("\n" + "\n".join(plain) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(plain)), np.fromiter(map(len, plain), np.int64, len(plain)) + 1)
    text = np.concatenate([[0], text])
    stream = np.where(points < _LETTERS, letters()[np.minimum(points, _LETTERS - 1)], 0)
    keep = stream > 0
    keep[1:] |= stream[:-1] > 0  # of blanks, only the first after a letter
    keep[:-1] |= stream[1:] > 0  # and the one before a letter
    stream, text = stream[keep], text[keep]
    out = np.zeros((len(plain), dimensions), np.float32)
    middle = np.flatnonzero(stream[1:-1] > 0) + 1 if len(stream) > 2 else np.zeros(0, np.int64)
    if not len(middle):
        return out
    alphabet, coded = np.unique(stream, return_inverse=True) if len(stream) < 4096 else _compact(stream)
    size = len(alphabet)
    gram = (coded[middle - 1].astype(np.int64) * size + coded[middle]) * size + coded[middle + 1]
    if size**3 <= 1 << 23:
        seen = np.flatnonzero(np.bincount(gram, minlength=1))
        number = np.zeros(seen[-1] + 1, np.int64)
        number[seen] = np.arange(len(seen))
        gram = number[gram]
    else:
        seen, gram = np.unique(gram, return_inverse=True)
    owner = text[middle]
    letter = letter_vectors(alphabet, dimensions)
    rotated = np.roll(letter, 1, axis=1), np.roll(letter, 2, axis=1)
    block = 4096
    step = max(1, _CELLS // min(len(seen), block))
    for low in range(0, len(plain), step):  # some texts at a time
        a, b = np.searchsorted(owner, [low, low + step])
        high = min(low + step, len(plain))
        for g in range(0, len(seen), block):  # and some trigrams
            part = seen[g : g + block]
            bound = rotated[1][part // size // size] * rotated[0][part // size % size] * letter[part % size]
            here = slice(a, b) if len(seen) <= block else np.flatnonzero((gram[a:b] >= g) & (gram[a:b] < g + block)) + a
            counts = np.bincount((owner[here] - low) * len(part) + gram[here] - g, minlength=(high - low) * len(part))
            out[low:high] += counts.reshape(high - low, len(part)).astype(np.float32) @ bound.astype(np.float32)
    return out


def _compact(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen = np.flatnonzero(np.bincount(stream, minlength=1))
    number = np.zeros(seen[-1] + 1, np.int32)
    number[seen] = np.arange(len(seen))
    return seen, number[stream]


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    norm = np.sqrt((rows * rows).sum(1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in text order, and their prototypes of length 1."""
    known = docs.select(name(lang).cast("string").alias("lang"), name(text).alias("body")).where(F.col("lang").isNotNull())

    def make():
        sums: dict[str, np.ndarray] = {}

        def take(column, part):
            rows = np.rint(unit(vectors(column, dimensions)) * _SCALE).astype(np.int64)
            langs, which = np.unique(np.array(part.column(0).to_pylist(), object), return_inverse=True)
            for k, one in enumerate(langs):
                sums[one] = sums.get(one, 0) + rows[which == k].sum(0)
            return ()

        def finish():
            for one, total in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([one] * dimensions, pa.string()), pa.array(np.arange(dimensions), pa.int32()), pa.array(total, pa.int64())], ["lang", "place", "total"])

        return take, finish

    totals = scan(known, "body", "lang string, place int, total long", make, ["lang"]).groupBy("lang", "place").agg(F.sum("total").alias("total"))
    totals = totals.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "total"))).alias("v")).select("lang", F.col("v.total").alias("v"))
    rows = [r for r in totals.limit(MAX_LANGUAGES + 1).collect() if any(r["v"])]
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    rows.sort(key=lambda r: r["lang"].encode())
    return [r["lang"] for r in rows], unit(np.array([r["v"] for r in rows], np.float64).reshape(len(rows), dimensions))


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast((languages, prototypes))

    def make():
        langs, known = sent.value

        def work(column, part):
            rows = unit(vectors(column, known.shape[1]))
            some = rows.any(1) & bool(langs)
            cosine = rows @ known.T if langs else np.zeros((len(rows), 1))
            best = cosine.argmax(1)
            score = np.clip(cosine[np.arange(len(rows)), best], 0, 1)
            return [pa.array([langs[b] if s else "und" for b, s in zip(best, some, strict=True)], pa.string()), pa.array(np.where(some, score, 0.0))]

        return work

    return annotate(docs, text, [FIELD("lang_pred", STRING), FIELD("score", DOUBLE)], make, keep)
