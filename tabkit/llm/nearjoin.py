"""Exact Jaccard join of word-shingle sets by adaptive multi-match prefixes; its groups, without pairs of copies.

A set of n shingles that is to share a fraction t with another shares at least need = ceil(t n) of them. So, in any common order, the first
n - need + l shingles of two similar sets (their l-prefixes) share at least l; with l differing, at least the smaller one.

1. Each text becomes its set and a key of the set; equal sets are one node from here on, whatever the number of copies.
2. Very frequent shingles are found first (at most ``FREQUENT``, by a bound on their count): they come last in every order and are
   never dealt out, as their counts are known. Prefixes in hash order, l in proportion to n, meet in hash ranges. A set whose prefix shares fewer shingles than any
   partner would need is similar to no other: it is done.
3. Among the sets left, shingles are counted and ordered by rarity. Each set chooses its own l: a longer prefix meets more posting
   entries, but the candidates that reach l of them are fewer; the estimate of both costs decides.
4. Sets that share a prefix shingle fall into one candidate group (components of a star per shingle). A group's sets are
   joined in one task; groups beyond ``CHUNK`` shingles are split, and every two parts meet in a task of their own.
5. There, candidates with enough shared prefix shingles and fitting size are verified on whole sets, unless they are already linked.
   The links make the components.

Null texts and texts without words have the empty set and are linked with nothing. Rows with equal keys are texts of their
own; the group's id is the smallest key in it, a null key counts for none. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.llm.common import FIELD, LONG, annotate, name, scan, shuffle_width, stage
from tabkit.llm.graph import components
from tabkit.llm.text import WHITE, chain, dealt, groups, mix, split

N = 5
PERCENT = 75
SHARE = 12  # the first prefixes ask for one shared shingle in that many
FREQUENT = 1 << 20  # most shingles in the list of frequent ones, which is broadcast (16 bytes each)
LEAST_FREQUENT = 1000
LOCAL = 4  # occurrences within a task that make a shingle a candidate for the list
HELD = 1 << 20  # shingles held by a task before they are passed on
CHUNK = 1 << 20  # shingles of sets that are joined in one task
ACTIVE_BROADCAST = 1 << 21  # set keys (8 bytes each) that may be broadcast
VERIFY = 1 / 16  # cost of a verification per shingle, in posting entries


def shingle_sets(column: pa.Array, n: int = N) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of fewer than n words, the whole sequence is the only one."""
    words = split(column, WHITE)
    h, size = words.hash, np.diff(words.first)
    full = chain(*(h[k : len(h) - n + 1 + k] for k in range(n))) if len(h) >= n else np.zeros(0, np.uint64)
    out = []
    for a, m in zip(words.first[:-1].tolist(), size.tolist(), strict=True):
        if m >= n:
            out.append(np.unique(full[a : a + m - n + 1]))
        elif m:
            out.append(mix(chain(*(h[a + k : a + k + 1] for k in range(m))) ^ np.uint64(m)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(tokens: np.ndarray) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes()))


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def _first_l(n: np.ndarray, percent: int) -> np.ndarray:
    return np.maximum(1, np.minimum(-(-n // SHARE), needed(needed(n, percent), percent)))


class _Dealer:
    """Collects (shingle, set key, set size, extra) and passes them on as packed arrays by hash range of the shingle."""

    names = ["p", "tokens", "refs", "sizes", "extras"]
    schema = "p int, tokens binary, refs binary, sizes binary, extras binary"

    def __init__(self, width: int):
        self.width, self.held, self.n = width, [], 0

    def add(self, tokens: np.ndarray, ref: np.uint64, size: int, extra=0):
        self.held.append((tokens, np.full(len(tokens), ref, np.uint64), np.full(len(tokens), size, np.uint32), np.zeros(len(tokens), np.uint32) + np.uint32(extra)))
        self.n += len(tokens)
        if self.n > HELD:
            yield from self.flush()

    def flush(self):
        if self.n:
            columns = [np.concatenate(x) for x in zip(*self.held, strict=True)]
            self.held, self.n = [], 0
            order = np.argsort(columns[0], kind="stable")
            columns = [c[order] for c in columns]
            bounds = dealt(columns[0], self.width)
            some = np.flatnonzero(np.diff(bounds))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32())] + [pa.array([c[bounds[p] : bounds[p + 1]].tobytes() for p in some], pa.binary()) for c in columns], self.names)


def _unpack(table: pa.Table) -> list[np.ndarray]:
    kinds = (np.uint64, np.uint64, np.uint32, np.uint32)
    return [np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()]) for c, kind in zip(_Dealer.names[1:], kinds, strict=True)]


def _met(tokens: np.ndarray, refs: np.ndarray, size: np.ndarray):
    """Distinct (shingle, set key) of a hash range, sorted by shingle, where at least two sets have the shingle; with sizes and counts."""
    order = np.argsort(tokens, kind="stable")
    tokens = tokens[order]
    again = np.zeros(len(tokens), bool)
    same = tokens[1:] == tokens[:-1]
    again[1:] |= same
    again[:-1] |= same
    tokens, order = tokens[again], order[again]
    refs, size = refs[order], size[order]
    order = np.lexsort((refs, tokens))
    tokens, refs, size = tokens[order], refs[order], size[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (refs[1:] != refs[:-1])
    tokens, refs, size = tokens[new], refs[new], size[new]
    bounds = groups(tokens)
    df = np.repeat(np.diff(bounds), np.diff(bounds)) if len(tokens) else np.zeros(0, np.int64)
    return tokens[df > 1], refs[df > 1], size[df > 1], df[df > 1]


def _per_range(dealt_rows: DataFrame, work, schema: str) -> DataFrame:
    return dealt_rows.groupBy("p").applyInArrow(work, schema)


class _Seen:
    """Set keys a task has met; copies beyond a bounded memory are merely worked on again."""

    def __init__(self):
        self.keys: set[int] = set()

    def again(self, ref) -> bool:
        if ref in self.keys:
            return True
        if len(self.keys) < 1 << 18:
            self.keys.add(ref)
        return False


def _frequent(docs: DataFrame, text: str, n: int, total: int):
    """Broadcast (shingles, counts) of the frequent shingles. As their counts sum up to ``total`` at most, there are at most ``FREQUENT``."""

    def make():
        seen, held = _Seen(), []

        def flush():
            h, c = np.unique(np.concatenate(held or [np.zeros(0, np.uint64)]), return_counts=True)
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(h[c >= LOCAL].view(np.int64)), pa.array(c[c >= LOCAL])], ["token", "k"])

        def take(column, part):
            held.extend(x for x in shingle_sets(column, n) if len(x) and not seen.again(set_key(x)))
            if sum(map(len, held)) > HELD:
                yield from flush()

        return take, flush

    least = max(LEAST_FREQUENT, -(-total // FREQUENT))
    rows = scan(docs, text, "token long, k long", make).groupBy("token").agg(F.sum("k").alias("k")).where(F.col("k") >= least).toArrow()
    tokens, counts = rows.column("token").to_numpy().view(np.uint64), rows.column("k").to_numpy()
    order = np.argsort(tokens)
    return docs.sparkSession.sparkContext.broadcast((tokens[order], counts[order]))


def _places(known: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Places of the tokens in a sorted list, -1 where they are not."""
    if not len(known):
        return np.full(len(tokens), -1)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    return np.where(known[at] == tokens, at, -1)


def _active(docs: DataFrame, text: str, n: int, percent: int, width: int, frequent) -> DataFrame:
    """Keys of the sets that may have a similar set."""

    def make():
        dealer, seen = _Dealer(width), _Seen()

        def take(column, part):
            for tokens in shingle_sets(column, n):
                if not len(tokens):
                    continue
                ref = set_key(tokens)
                if seen.again(ref):
                    continue
                m = len(tokens)
                length = m - needed(m, percent) + int(_first_l(np.array(m), percent))
                rare = tokens[_places(frequent.value[0], tokens) < 0]
                yield from dealer.add(rare[:length], ref, m)
                if length > len(rare):  # the prefix goes into the frequent ones, which others have for certain
                    yield from dealer.add(mix(np.array([ref])), ref, m, length - len(rare))

        return take, dealer.flush

    def meet(table: pa.Table) -> pa.Table:
        tokens, refs, size, extra = _unpack(table)
        told = extra > 0
        _, met, met_size, _ = _met(tokens[~told], refs[~told], size[~told])
        refs, size = np.concatenate([met, refs[told]]), np.concatenate([met_size, size[told]]).astype(np.int64)
        shared = np.concatenate([np.ones(len(met), np.int64), extra[told].astype(np.int64)])
        order = np.argsort(refs, kind="stable")
        at = groups(refs[order])[:-1]
        shared = np.add.reduceat(shared[order], at) if len(at) else shared
        return pa.table([pa.array(refs[order][at].view(np.int64)), pa.array(size[order][at]), pa.array(shared)], names=["ref", "n", "shared"])

    met = _per_range(scan(docs, text, _Dealer.schema, make), meet, "ref long, n long, shared long")
    n_col, ceil = F.col("n"), lambda c: F.ceil(c * percent / 100)
    smallest = ceil(n_col)  # the smallest partner, which asks for the fewest
    least = F.greatest(F.lit(1), F.least(F.ceil(smallest / SHARE), ceil(ceil(smallest))))
    return met.groupBy("ref").agg(F.max("n").alias("n"), F.sum("shared").alias("shared")).where(F.col("shared") >= least).select("ref")


def _sets(docs: DataFrame, text: str, n: int, active: DataFrame) -> DataFrame:
    """(ref, tokens) of the active sets; a set may come more than once."""
    known = None
    if active.count() <= ACTIVE_BROADCAST:
        known = docs.sparkSession.sparkContext.broadcast(np.sort(active.toArrow().column("ref").to_numpy()))

    def make():
        seen = _Seen()

        def take(column, part):
            refs, bodies = [], []
            for tokens in shingle_sets(column, n):
                if len(tokens):
                    ref = int(set_key(tokens).astype(np.int64))
                    if seen.again(ref):
                        continue
                    if known is not None:
                        at = np.searchsorted(known.value, ref)
                        if at == len(known.value) or known.value[at] != ref:
                            continue
                    refs.append(ref)
                    bodies.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(refs, pa.int64()), pa.array(bodies, pa.binary())], ["ref", "tokens"])

        return take, lambda: ()

    sets = scan(docs, text, "ref long, tokens binary", make)
    return sets if known is not None else sets.join(active, "ref", "left_semi")


def choose(df: np.ndarray, n: int, percent: int) -> tuple[int, int]:
    """(l, how many of the shared shingles, rarest first, are in the prefix) of the least estimated cost; ``df`` ascends and leaves out the n - len(df) shingles of this set alone."""
    need = int(needed(np.array(n), percent))
    alone = n - len(df)
    entries = np.concatenate([[0], np.cumsum(df - 1)])
    best, most = None, max(1, min(-(-n // 4), int(needed(np.array(need), percent))))
    step = 1
    while step <= most:
        inside = max(0, min(len(df), n - need + step - alone))
        cost = entries[inside] * (1 + n * VERIFY / step)
        if best is None or cost < best[0]:
            best = cost, step, inside
        if step == 1 and not inside:
            break
        step *= 2
    return best[1], best[2]


def _index(sets: DataFrame, percent: int, width: int, frequent) -> DataFrame:
    """(ref, n, l, prefix): each set's chosen l and the shared shingles of its prefix; sets without any are left out."""

    def deal(batches):
        dealer = _Dealer(width)
        for batch in batches:
            for row in batch.to_pylist():
                tokens = np.frombuffer(row["tokens"], np.uint64)
                yield from dealer.add(tokens[_places(frequent.value[0], tokens) < 0], np.int64(row["ref"]).astype(np.uint64), len(tokens))
        yield from dealer.flush()

    def to_sets(refs, tokens, size, df) -> pa.Table:
        to = ((mix(refs) >> np.uint64(32)) * np.uint64(width)) >> np.uint64(32)
        order = np.argsort(to, kind="stable")
        at = groups(to[order])
        columns = [c[order] for c in (refs, tokens, size.astype(np.uint32), df.astype(np.uint32))]
        rows = [[c[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)] for c in columns]
        return pa.table([pa.array(to[order][at[:-1]].astype(np.int32)), *(pa.array(r, pa.binary()) for r in rows)], names=["q", "refs", "tokens", "sizes", "dfs"])

    def meet(table: pa.Table) -> pa.Table:
        tokens, refs, size, df = _met(*_unpack(table)[:3])
        return to_sets(refs, tokens, size, df)

    def tell(batches):
        """The frequent shingles of each set, straight to the set."""
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                tokens = np.frombuffer(row["tokens"], np.uint64)
                at = _places(frequent.value[0], tokens)
                some = at >= 0
                found.append((np.full(some.sum(), np.int64(row["ref"]).astype(np.uint64), np.uint64), tokens[some], np.full(some.sum(), len(tokens)), frequent.value[1][at[some]]))
            if found:
                yield from to_sets(*(np.concatenate(x) for x in zip(*found, strict=True))).to_batches()

    def select(table: pa.Table) -> pa.Table:
        refs, tokens = (np.concatenate([np.frombuffer(x, np.uint64) for x in table.column(c).to_pylist()]) for c in ("refs", "tokens"))
        sizes, dfs = (np.concatenate([np.frombuffer(x, np.uint32) for x in table.column(c).to_pylist()]).astype(np.int64) for c in ("sizes", "dfs"))
        order = np.lexsort((tokens, dfs, refs))
        refs, tokens, sizes, dfs = refs[order], tokens[order], sizes[order], dfs[order]
        new = np.ones(len(refs), bool)  # a set may have been told twice
        new[1:] = (refs[1:] != refs[:-1]) | (tokens[1:] != tokens[:-1])
        refs, tokens, sizes, dfs = refs[new], tokens[new], sizes[new], dfs[new]
        at = groups(refs)
        out = []
        for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
            step, inside = choose(dfs[a:b], int(sizes[a]), percent)
            if inside:
                out.append((int(refs[a].astype(np.int64)), int(sizes[a]), step, tokens[a : a + inside].view(np.int64).tolist()))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())))], names=["ref", "n", "l", "prefix"])

    packed = "q int, refs binary, tokens binary, sizes binary, dfs binary"
    met = _per_range(sets.mapInArrow(deal, _Dealer.schema), meet, packed)
    return met.union(sets.mapInArrow(tell, packed)).groupBy("q").applyInArrow(select, "ref long, n long, l int, prefix array<long>")


def join_sets(refs: list[int], n: np.ndarray, l: np.ndarray, prefix: list[np.ndarray], tokens: list[np.ndarray], side: np.ndarray, cross: bool, percent: int) -> list[tuple[int, int]]:
    """Links that connect what is similar: a pair is verified only if nothing has linked it yet. ``cross``: only pairs of different sides."""
    parent = list(range(len(refs)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order = np.lexsort((np.array(refs), n))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    flat = np.concatenate([np.zeros(0, np.int64), *prefix])
    owner = np.repeat(np.arange(len(refs)), [len(p) for p in prefix])
    by = np.lexsort((rank[owner], flat))
    flat, owner = flat[by], owner[by]
    links = []
    for x in order.tolist():
        lo, hi = np.searchsorted(flat, prefix[x], "left"), np.searchsorted(flat, prefix[x], "right")
        hi = np.minimum(hi, lo + [np.searchsorted(rank[owner[a:b]], rank[x]) for a, b in zip(lo, hi, strict=True)])
        count = hi - lo
        if not count.sum():
            continue
        near = owner[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        hits = np.bincount(near, minlength=len(refs))
        some = np.flatnonzero(hits)
        ok = (hits[some] >= np.minimum(l[some], l[x])) & (100 * n[some] >= percent * n[x])
        if cross:
            ok &= side[some] != side[x]
        some = some[ok]
        for y in some[np.argsort(-hits[some], kind="stable")].tolist():
            a, b = root(x), root(y)
            if a == b:
                continue
            both = np.concatenate([tokens[x], tokens[y]])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            if 100 * shared >= percent * (len(both) - shared):
                parent[a] = b
                links.append((refs[x], refs[y]))
    return links


def _links(index: DataFrame, sets: DataFrame, percent: int, chunk: int) -> DataFrame:
    entries = index.select("ref", F.explode("prefix").alias("token"))
    hubs = entries.groupBy("token").agg(F.min("ref").alias("hub"), F.count("*").alias("k")).where("k > 1").select("token", "hub")
    found = components(entries.join(hubs, "token").select(F.col("ref").alias("a"), F.col("hub").alias("b")))
    member = index.join(found, F.col("ref") == F.col("node")).drop("node")
    size = member.groupBy("root").agg(F.sum("n").alias("total"))
    member = member.join(size, "root").withColumn("parts", F.ceil(F.col("total") / chunk).cast("int")).drop("total")
    member = member.withColumn("part", F.pmod(F.xxhash64("ref"), F.col("parts")).cast("int"))
    both = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("part", k).alias("i"), F.greatest("part", k).alias("j")))
    member = member.join(sets.dropDuplicates(["ref"]), "ref").withColumn("task", F.explode(both))

    def work(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]["task"]
        prefix = [np.array(x, np.int64) for x in table.column("prefix").to_pylist()]
        tokens = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        number = lambda c: table.column(c).to_numpy().astype(np.int64)
        links = join_sets(table.column("ref").to_pylist(), number("n"), number("l"), prefix, tokens, number("part"), first["i"] != first["j"], percent)
        return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return member.groupBy("root", "task").applyInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """key, n_shingles, component_id (smallest key that similar texts lead to, itself included)."""
    width = shuffle_width(docs, 2)

    def make():
        def work(column, part):
            sets = shingle_sets(column, n)
            refs = [int(set_key(s).astype(np.int64)) if len(s) else None for s in sets]
            return [pa.array([len(s) for s in sets], pa.int64()), pa.array(refs, pa.int64())]

        return work

    nodes = stage(annotate(docs, text, [FIELD("n_shingles", LONG), FIELD("__ref", LONG)], make, [key]), "nodes")
    total = nodes.agg(F.sum("n_shingles")).first()[0] or 0
    frequent = _frequent(docs, text, n, total)
    active = stage(_active(docs, text, n, percent, width, frequent), "active")
    sets = stage(_sets(docs, text, n, active), "sets")
    index = stage(_index(sets, percent, width, frequent), "index")
    found = stage(components(_links(index, sets, percent, chunk)), "found")
    nodes = nodes.join(found.withColumnRenamed("node", "__ref"), "__ref", "left").withColumn("root", F.coalesce("root", "__ref"))
    least = nodes.where("root is not null").groupBy("root").agg(F.min(name(key)).alias("component_id"))
    return nodes.join(least, "root", "left").select(name(key), "n_shingles", F.when(F.col("n_shingles") == 0, name(key)).otherwise(F.col("component_id")).alias("component_id"))
