"""Repeated byte strings across and within texts, by blockwise suffix sorting with a difference cover.

Looked for: bytes covered by a string of ``length`` bytes that also starts anywhere else. Only the first ``length`` bytes of a suffix matter, so:

1. Buckets: a suffix belongs to the smallest hash among the strings of WORD bytes in its first ``length`` bytes (the leftmost, if equal), which equal
   strings share. Neighbouring suffixes of a bucket form a piece of text. Only a piece's bucket, hash and place are shuffled.
2. Equal pieces repeat as a whole. A bucket with one distinct piece is done. The distinct pieces of the other buckets are fetched, once each.
3. Buckets are sorted one after the other, some at a time up to ``BLOCK`` bytes of text. Ranks of the suffixes on a difference cover (period
   V, residues COVER) are computed first: by their first V + 1 bytes, then by doubling, to 8 V + 1 bytes. Every other suffix has a cover
   suffix less than V bytes on, so the sort compares few bytes and resolves longer ties by ranks. Pieces
   are laid out with their bucket word at a multiple of V, so that suffixes that can tie have the same way to the cover.
4. A bucket with more than ``hot`` distinct pieces is not gathered: its suffixes are counted by hash, with partial sums.

Repeats of several lengths are found in one pass: buckets are those of the shortest, pieces reach as far as the longest, and only suffixes
that repeat by one length are compared by the next.

Memory is that of a block, whatever the size of the corpus. Bytes between pieces compare by 64-bit hashes of up to 64 bytes.

Null is the empty text. Texts shorter than ``length`` are kept whole. Matches never cross texts; rows with equal key and text are told
apart by nothing and repeat each other. ``clean`` writes the remaining bytes as text and drops what a cut leaves of a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tabkit.llm.common import BINARY, FIELD, LONG, STRING, lists, name, release, shuffle_width, size_of, stage
from tabkit.llm.text import SEGMENT, _power_tables, _table, chain, groups, mix, raw, slices

LENGTH = 400
WORD = 32  # shorter ones are common to texts that share nothing else
HOT = 5_000
BLOCK = 1 << 20
LEAST = 96  # the shortest length the difference covers allow
SPANS_BROADCAST = 32 << 20  # bytes of a staged table that may be broadcast
# Perfect difference covers; every residue is a difference of two members.
COVERS = {31: (0, 1, 3, 8, 12, 18), 21: (0, 1, 4, 14, 16), 7: (0, 1, 3)}


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_table[data] * _power_tables(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    return mix((sums[start + size] - sums[start]) * _power_tables(len(sums))[1][start])


def _words(data: np.ndarray, order: str) -> np.ndarray:
    """The 8-byte word at each place; the end is padded with zeros."""
    padded = np.concatenate([data, np.zeros(7, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(order + "u8").reshape(-1)


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours."""
    n = len(x)
    if n < width:
        return x[:0]
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    table = full.reshape(blocks, width)
    before = np.minimum.accumulate(table, axis=1).reshape(-1)
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def cut_pieces(data: np.ndarray, offsets: np.ndarray, length: int, reach: int):
    """(text, start in text, suffixes, bytes, place of the bucket word in the piece, bucket, piece hash) of all pieces: ``reach`` bytes of each suffix, as far as the text goes."""
    found = []
    a = 0
    n = len(data)
    while a < n:
        b = min(a + SEGMENT, n)
        part = data[a:b]
        stop = b - a - reach + 1 if b < n else b - a  # the last suffixes of a segment are the next one's
        sums = _sums(part)
        key = _hash(sums, np.arange(max(0, len(part) - WORD + 1)), WORD)
        low = (key & ~np.uint64(SEGMENT - 1)) | np.arange(len(key), dtype=np.uint64)
        least = _window_min(low, length - WORD + 1)
        start = np.arange(min(len(least), stop))
        text = np.searchsorted(offsets, start + a, "right") - 1
        ok = start + a + length <= offsets[text + 1]
        start, text = start[ok], text[ok]
        if len(start):
            at = (least[start] & np.uint64(SEGMENT - 1)).astype(np.int64)
            new = np.ones(len(start), bool)
            new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1) | (text[1:] != text[:-1])
            first = np.flatnonzero(new)
            count = np.diff(np.concatenate([first, [len(start)]]))
            s = start[first]
            end = np.minimum(s + count + reach - 1, offsets[text[first] + 1] - a)
            whole = part.tobytes()
            piece = np.fromiter((xxhash.xxh3_64_intdigest(whole[x:y]) for x, y in zip(s.tolist(), end.tolist(), strict=True)), np.uint64, len(s))
            found.append((text[first], s + a - offsets[text[first]], count, end - s, at[first] - s, key[at[first]], piece))
        if b == n:
            break
        a = b - reach + 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))


def repeated(pieces: list[bytes], counts: np.ndarray, at: np.ndarray, bucket: np.ndarray, lengths: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length, ascending: (piece, suffix) of all suffixes whose first bytes, so many, occur in another piece of the same bucket."""
    period = max(v for v in COVERS if 8 * v + 1 + v + 32 <= lengths[0])
    cover = np.array(COVERS[period])
    base, end = np.zeros(len(pieces), np.int64), 0
    for k, piece in enumerate(pieces):
        base[k] = end + (-(end + at[k])) % period
        end = base[k] + len(piece)
    data = np.zeros(-(-end // period) * period + 9 * period + 64, np.uint8)
    for k, piece in enumerate(pieces):
        data[base[k] : base[k] + len(piece)] = np.frombuffer(piece, np.uint8)
    # ranks of the cover: first period + 1 bytes, then doubling
    cycles = len(data) // period
    place = (np.arange(cycles)[:, None] * period + cover).reshape(-1)
    words = _words(data, ">")
    keys = [words[np.minimum(place + 8 * k, len(words) - 1)] for k in range(-(-(period + 1) // 8))]
    keys[-1] = keys[-1] >> np.uint64(8 * (-(period + 1) % 8))  # no byte beyond
    rank = _ranks(keys)
    for k in range(3):
        ahead = len(cover) << k
        rank = _ranks([rank, np.concatenate([rank[ahead:], np.zeros(ahead, rank.dtype)])])
    span = 8 * period + 1
    # all suffixes of the block
    piece = np.repeat(np.arange(len(pieces)), counts)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = base[piece] + nth
    ahead = np.array([min((c - r) % period for c in cover) for r in range(period)])[start % period]
    number = np.zeros(period, np.int64)
    number[cover] = np.arange(len(cover))
    here = start + ahead
    row = here // period * len(cover) + number[here % period]
    sums = _sums(data)
    size = np.array([len(x) for x in pieces], np.int64)
    chosen, same = np.arange(len(start)), chain(bucket[piece], (start % period).astype(np.uint64), _hash(sums, start, 32))
    done, found = -7, []
    for length in lengths:
        fits = nth[chosen] + length <= size[piece[chosen]]
        chosen, same = chosen[fits], same[fits]
        last = (length - span - period + 1) // period
        head = chain(same, _hash(sums, start[chosen] + length - 64, 64))
        ranks = [rank[row[chosen] + len(cover) * step] for step in sorted({*range(done + 7, last, 7), last})]
        order = np.lexsort([*ranks[::-1], head])
        equal = head[order][1:] == head[order][:-1]
        for r in ranks:
            equal &= r[order][1:] == r[order][:-1]
        again = np.zeros(len(order), bool)
        again[1:] |= equal
        again[:-1] |= equal
        same = np.zeros(len(order), np.uint64)
        same[order[1:]] = np.cumsum(~equal)
        hit = np.sort(order[again])
        chosen, same, done = chosen[hit], same[hit], last
        found.append((piece[chosen], nth[chosen]))
    return found


def _ranks(keys: list[np.ndarray]) -> np.ndarray:
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _runs(piece: np.ndarray, nth: np.ndarray):
    """(piece, first, count) of runs of neighbouring suffixes."""
    new = np.ones(len(piece), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (nth[1:] != nth[:-1] + 1)
    first = np.flatnonzero(new)
    return piece[first], nth[first], np.diff(np.concatenate([first, [len(piece)]]))


def _source(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(name(text).cast("string"), F.lit(""))
    return docs.select(name(key).alias("doc"), F.xxhash64(body).alias("text_hash"), body.cast("binary").alias("body"))


def _schema(docs: DataFrame, rest: str) -> T.StructType:
    """doc (with the type of its key), text_hash and more."""
    return T.StructType([FIELD("doc", docs.schema["doc"].dataType), *T.StructType.fromDDL("text_hash long, " + rest).fields])


def spans(docs: DataFrame, key: str, text: str, lengths: list[int], hot: int = HOT) -> DataFrame:
    """(doc, text_hash, length, start, suffixes): for each length, ascending, runs of suffixes whose first bytes, so many, start elsewhere too. Runs may overlap."""
    source = _source(docs, key, text)
    width = shuffle_width(docs, 2)
    least, reach = lengths[0], lengths[-1]

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "body"):
                data, offsets = raw(part.column(2).cast(pa.large_binary()))
                doc, start, count, size, at, bucket, piece = cut_pieces(data, offsets, least, reach)
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(start), *(pa.array(x.astype(np.int32)) for x in (count, size, at)), pa.array(bucket.view(np.int64)), pa.array(piece.view(np.int64))],
                    ["doc", "text_hash", "start", "suffixes", "size", "at", "bucket", "piece"],
                )

    pieces = stage(source.where(F.octet_length("body") >= least).mapInArrow(cut, _schema(source, "start long, suffixes int, size int, at int, bucket long, piece long")), "pieces")
    distinct = pieces.groupBy("bucket", "piece").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "text_hash", "start", "suffixes", "size", "at")).alias("one"))
    distinct = stage(_open(distinct), "distinct")
    # Of a repeated piece, the suffixes with enough bytes.
    runs = F.explode(F.array(*[F.struct(F.lit(n).alias("length"), F.least("suffixes", F.col("size") - n + 1).cast("long").alias("n")) for n in lengths]))
    whole = pieces.join(distinct.where("copies > 1").select("bucket", "piece"), ["bucket", "piece"], "left_semi").select("doc", "text_hash", "start", runs.alias("run"))
    whole = whole.where("run.n > 0").select("doc", "text_hash", "run.length", "start", F.col("run.n").alias("suffixes"))
    rivals = distinct.where("rivals > 1").select("bucket", "copies", "rivals", "one.*")
    wanted = rivals.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("bucket", "copies", "rivals", "start", "suffixes", "size", "at")).alias("wanted"))
    fetched = _meet(source, stage(wanted, "wanted"))

    def fetch(batches):
        for batch in batches:
            for k, row in enumerate(batch.to_pylist()):
                w = row["wanted"]
                columns = [[row["text_hash"]] * len(w)] + [[x[c] for x in w] for c in ("start", "suffixes", "at", "bucket", "copies", "rivals")]
                columns.append([row["body"][x["start"] : x["start"] + x["size"]] for x in w])
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                doc = batch.column(0).take(pa.array([k] * len(w), pa.int64()))
                yield pa.RecordBatch.from_arrays([doc, *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], schema.names)

    schema = _schema(source, "start long, suffixes int, at int, bucket long, copies long, rivals long, body binary")
    fetched = fetched.select("doc", "text_hash", "body", "wanted").mapInArrow(fetch, schema)
    if rivals.where(F.col("rivals") > hot).limit(1).count():
        fetched = stage(fetched, "fetched")  # read twice
        return whole.union(_sorted(fetched.where(F.col("rivals") <= hot), lengths, width)).union(_counted(fetched.where(F.col("rivals") > hot), lengths, width))
    return whole.union(_sorted(fetched, lengths, width))


def _open(distinct: DataFrame) -> DataFrame:
    """Pieces that occur several times or have other pieces in their bucket; rivals: how many distinct ones it holds."""
    held = distinct.groupBy("bucket").agg(F.count("*").alias("rivals")).where("rivals > 1")
    return distinct.join(held, "bucket", "left").withColumn("rivals", F.coalesce("rivals", F.lit(1))).where("copies > 1 or rivals > 1")


def _meet(source: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """Texts with what is known of them, by key and text; broadcast if that is small by measure, else shuffled."""
    other = other.withColumnsRenamed({"doc": "__doc", "text_hash": "__hash"})
    same = F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("text_hash") == F.col("__hash"))
    return source.join(F.broadcast(other) if size_of(other) <= SPANS_BROADCAST else other, same, how).drop("__doc", "__hash")


def _sorted(fetched: DataFrame, lengths: list[int], width: int) -> DataFrame:
    kind = to_arrow_type(fetched.schema["doc"].dataType)

    def run(batches):
        held, size = [], 0

        def sort(rows):
            counts, at = (np.array([r[c] for r in rows], np.int64) for c in ("suffixes", "at"))
            bucket = np.array([r["bucket"] for r in rows], np.int64).view(np.uint64)
            whole = np.array([r["copies"] > 1 for r in rows], bool)  # found as such
            made = []
            for length, (piece, nth) in zip(lengths, repeated([r["body"] for r in rows], counts, at, bucket, lengths), strict=True):
                mine = ~whole[piece]
                piece, first, count = _runs(piece[mine], nth[mine])
                chosen = [rows[p] for p in piece]
                start = np.array([r["start"] for r in chosen], np.int64) + first
                columns = [pa.array([r["doc"] for r in chosen], kind), pa.array([r["text_hash"] for r in chosen], pa.int64()), pa.array([length] * len(chosen), pa.int32()), pa.array(start), pa.array(count.astype(np.int64))]
                made.append(pa.RecordBatch.from_arrays(columns, ["doc", "text_hash", "length", "start", "suffixes"]))
            return made

        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["bucket"], row["doc"], row["text_hash"], row["start"]) == tuple(held[-1][c] for c in ("bucket", "doc", "text_hash", "start")):
                    continue  # from a repeated row
                if size > BLOCK and row["bucket"] != held[-1]["bucket"]:
                    yield from sort(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["body"])
        if held:
            yield from sort(held)
        held = []
        release()

    return fetched.repartition(width, "bucket").sortWithinPartitions("bucket", "doc", "text_hash", "start").mapInArrow(run, _schema(fetched, "length int, start long, suffixes long"))


def _counted(fetched: DataFrame, lengths: list[int], width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "body"):
                data, offsets = raw(part.column("body").cast(pa.large_binary()))
                sums = _sums(data)
                first, suffixes = (np.asarray(part.column(c)) for c in ("start", "suffixes"))
                for length in lengths:
                    counts = np.clip(np.diff(offsets) - length + 1, 0, suffixes)
                    piece = np.repeat(np.arange(len(counts)), counts)
                    nth = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
                    place = offsets[piece] + nth
                    halves = [_hash(sums, place, length // 2), _hash(sums, place + length // 2, length - length // 2)]
                    take = pa.array(piece)
                    columns = [part.column("doc").take(take), part.column("text_hash").take(take), pa.array(np.full(len(piece), length, np.int32)), pa.array(first[piece] + nth)]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array(h.view(np.int64)) for h in halves), part.column("copies").take(take)], ["doc", "text_hash", "length", "start", "h1", "h2", "copies"])

    place = ["bucket", "doc", "text_hash", "start"]
    rows = fetched.repartition(width, *place).dropDuplicates(place).select("doc", "text_hash", "start", "suffixes", "copies", "body").mapInArrow(run, _schema(fetched, "length int, start long, h1 long, h2 long, copies long"))
    rows = stage(rows, "counted")  # read twice
    same = ["length", "h1", "h2"]
    again = rows.groupBy(same).agg(F.sum("copies").alias("k")).where("k > 1").select(same)
    return rows.where("copies = 1").join(again, same, "left_semi").select("doc", "text_hash", "length", "start", F.lit(1).cast("long").alias("suffixes"))


RUNS = T.ArrayType(T.StructType([FIELD("start", LONG), FIELD("end", LONG)]))
REMOVED = [FIELD("n_bytes", LONG), FIELD("removed", RUNS), FIELD("kept", BINARY)]
REPEATED = FIELD("repeated", RUNS)


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT, form: str = "bytes", keep: list[str] | None = None, mark: int | None = None
) -> DataFrame:
    """``docs`` with n_bytes, removed (maximal runs, byte offsets) and kept (what is left, by ``form``: ``bytes``, ``digest`` (SHA-256 in lower hex) or ``text``, without what a cut leaves of a character).

    With ``mark``, a length of at most ``length``, also repeated: the runs covered by strings of ``mark`` bytes that start elsewhere too, whether removed or not.
    """
    if not LEAST <= (length if mark is None else mark) <= length:
        raise ValueError(f"strings of fewer than {LEAST} bytes are not looked for, and none longer than {length} is marked")
    fields = [*REMOVED, *([] if mark is None else [REPEATED])]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {f.name for f in fields}]
    carried = F.struct(*[name(c) for c in keep], F.lit(True).alias("__some"))
    cut = _cut(docs, carried, key, text, length, hot, form, mark)
    return cut.select(*[F.col("carried")[c].alias(c) for c in keep], *[f.name for f in fields])


def _merge(batches):
    """Maximal runs of covered bytes of each text and length, from its spans by length and start."""
    for batch in batches:
        spans = batch.column(2)
        length, start, suffixes = (np.asarray(c).astype(np.int64) for c in spans.flatten().flatten())
        row = np.repeat(np.arange(len(spans)), np.asarray(spans.value_lengths()))
        other = np.zeros(len(row), bool)
        other[1:] = (row[1:] != row[:-1]) | (length[1:] != length[:-1])
        shift = np.cumsum(other) << 34  # beyond any text
        end = np.maximum.accumulate(start + suffixes - 1 + length + shift)
        new = np.ones(len(row), bool)
        new[1:] = start[1:] + shift[1:] > end[:-1]
        first = np.flatnonzero(new)
        end = end[np.append(first[1:], len(row))[: len(first)] - 1] - shift[first]
        runs = pa.StructArray.from_arrays([pa.array(length[first].astype(np.int32)), pa.array(start[first]), pa.array(end)], ["length", "start", "end"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(np.bincount(row[first], minlength=len(spans)), runs)], ["doc", "text_hash", "runs"])


def _cut(docs: DataFrame, carried: Column, key: str, text: str, length: int, hot: int, form: str, mark: int | None = None) -> DataFrame:
    """carried, n_bytes, removed, kept and, with ``mark``, repeated; user's columns travel inside ``carried``, so that their names cannot clash."""
    found = spans(docs, key, text, sorted({length, mark or length}), hot)
    found = found.distinct().groupBy("doc", "text_hash").agg(F.array_sort(F.collect_list(F.struct("length", "start", "suffixes"))).alias("spans"))
    found = stage(found.mapInArrow(_merge, _schema(found, "runs array<struct<length: int, start: long, end: long>>")), "runs")
    body = F.coalesce(name(text).cast("string"), F.lit(""))
    source = docs.select(carried.alias("carried"), name(key).alias("doc"), F.xxhash64(body).alias("text_hash"), body.cast("binary").alias("body"))
    met = _meet(source, found, "left").select("carried", "body", "runs")
    fields = [FIELD("n_bytes", LONG), REMOVED[1], FIELD("kept", BINARY if form == "bytes" else STRING), *([] if mark is None else [REPEATED])]
    schema = T.StructType([met.schema["carried"], *fields])
    n_keep = 1

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, removed, kept, repeats = [], [], [], []
            for k in range(batch.num_rows):
                data = batch.column(n_keep)[k].as_py()
                known = batch.column(n_keep + 1)[k].as_py() or []
                runs = [{"start": r["start"], "end": r["end"]} for r in known if r["length"] == length]
                edges = [0, *(x for r in runs for x in (r["start"], r["end"])), len(data)]
                left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if runs else data
                sizes.append(len(data))
                removed.append(runs)
                kept.append(hashlib.sha256(left).hexdigest() if form == "digest" else left.decode("utf-8", "ignore") if form == "text" else left)
                if mark is not None:
                    repeats.append([{"start": r["start"], "end": r["end"]} for r in known if r["length"] == mark])
            made = [pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary() if form == "bytes" else pa.string())]
            made += [] if mark is None else [pa.array(repeats, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *made], schema.names)

    return met.mapInArrow(run, schema)


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``docs`` with the repeated strings removed from the text; same columns, whatever their names."""
    if length < LEAST:
        raise ValueError(f"strings of fewer than {LEAST} bytes are not looked for")
    cut = _cut(docs, F.struct(*[name(c) for c in docs.columns]), key, text, length, hot, "text")
    carried = lambda c: F.col("carried")[c]
    plain = F.when(F.size("removed") > 0, F.col("kept")).otherwise(carried(text))
    return cut.select(*[(plain if c == text else carried(c)).alias(c) for c in docs.columns])
