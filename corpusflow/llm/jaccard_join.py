"""N-gram Jaccard join: T-occurrence search with DivideSkip.

Two texts link when 100 * |intersection| >= percent * |union| of their shingle sets, which asks for
T = ceil(percent * (|x| + |y|) / (100 + percent)) common shingles.

1. Texts with one set form a class; from here on a class is one node, named by its smallest doc_id.
2. Shingles that many texts share are marked in bit filters of fixed size, one for each step of
   frequency. The filters only order shingles (rare first), so their false hits cost time, never links.
3. A set's first |x| - ceil(percent |x| / 100) + 1 shingles are posted to inverted lists: linked
   sets meet in one list at least. Lists of up to ``short_list`` entries give candidate pairs after
   bounds on length, position and shared lists; a longer list gives only pairs with its first two.
4. Each set has a bitmap of about as many bits as half its shingles, which holds the parity of the
   shingles that fall on a bit. Two bitmaps differ in no more bits than the sets do in shingles, so
   pairs whose bitmaps differ too much go, without loss, before any text is shuffled.
5. For each query set, lists over its candidates are searched: the longest lists are put aside, the
   short ones merged through a heap (by counting, where they are many), what occurs often enough
   there is looked up in the long ones by binary search, and entries that reach T are links.
6. A long list whose entries are still in several components is searched in full: every entry outside
   its main component against all entries of like size, in pairs of blocks, so no list meets in one
   task. Blocks hold bitmaps; only entries whose bitmap is near another's there are searched by text.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import connected_components
from ..plans.scratch import Scratch
from .textstream import chunks, mix, shingle_sets

FILTER_BITS = 1 << 23
#: Numbers of texts from which a shingle is marked in the filter of that step.
COMMON_FROM = (8, 64, 512, 4096)


def needed(x: int, y: int, percent: int) -> int:
    """Common shingles that sets of x and y need."""
    return -(-percent * (x + y) // (100 + percent))


def divide_skip(n: int, lists: dict[int, list[int]], sizes: list[int], percent: int) -> list[tuple[int, int]]:
    """Entries whose overlap with a query set of n shingles reaches their T, as (entry, overlap).

    ``lists``: ascending entry numbers by shingle of the query; ``sizes``: set size by entry. With the L
    longest lists aside, an entry that reaches T is in T - L short lists at least.
    """
    held = sorted(lists.values(), key=len)
    if not held:
        return []
    least = min(needed(n, s, percent) for s in sizes)
    aside = min(least - 1, len(held) // 2)
    short, long = held[: len(held) - aside], held[len(held) - aside :]
    found, last, count = [], -1, 0

    def settle(entry: int, count: int) -> None:
        goal = needed(n, sizes[entry], percent)
        if count + len(long) < goal:
            return
        for k, x in enumerate(long):
            at = bisect_left(x, entry)
            count += at < len(x) and x[at] == entry
            if count + len(long) - k - 1 < goal:
                return
        if count >= goal:
            found.append((entry, count))

    for entry in heapq.merge(*short):
        if entry != last:
            if last >= 0:
                settle(last, count)
            last, count = entry, 0
        count += 1
    if last >= 0:
        settle(last, count)
    return found


class Roots:
    """Union-find over component labels."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def of(self, x: int) -> int:
        while self.up.get(x, x) != x:
            x = self.up[x] = self.up.get(self.up[x], self.up[x])
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.of(x), self.of(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


class Block:
    """Inverted lists over a block of entry sets, as one array sorted by shingle and entry."""

    #: List entries up to which lists are merged through a heap; more are merged by counting.
    HEAP = 4096

    def __init__(self, entries: list[np.ndarray]):
        self.size = np.array([len(e) for e in entries], np.int64)
        tokens = np.concatenate(entries)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], np.repeat(np.arange(len(entries)), self.size)[order]

    def search(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Entries that link with the query set."""
        lo, hi = np.searchsorted(self.tokens, query, "left"), np.searchsorted(self.tokens, query, "right")
        full = hi > lo
        lo, hi = lo[full], hi[full]
        if not len(lo):
            return np.zeros(0, np.int64)
        length = hi - lo
        if length.sum() <= self.HEAP:
            lists = {k: self.owner[x:y].tolist() for k, (x, y) in enumerate(zip(lo, hi, strict=True))}
            return np.array([k for k, _ in divide_skip(len(query), lists, self.size.tolist(), percent)], np.int64)
        goal = -(-percent * (len(query) + self.size) // (100 + percent))
        aside = min(int(goal.min()) - 1, len(lo) // 2)
        order = np.argsort(length, kind="stable")
        short, long = order[: len(order) - aside], order[len(order) - aside :]
        n = length[short]
        at = np.arange(n.sum()) + np.repeat(lo[short] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        count = np.bincount(self.owner[at], minlength=len(self.size))
        found = np.flatnonzero(count + aside >= goal)
        for left, k in zip(range(aside - 1, -1, -1), long, strict=True):
            if not len(found):
                break
            x = self.owner[lo[k] : hi[k]]
            place = np.minimum(np.searchsorted(x, found), len(x) - 1)
            count[found] += x[place] == found
            found = found[count[found] + left >= goal[found]]
        return found[count[found] >= goal[found]]


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for a, b, texts in chunks(batch.column("text").to_pylist()):
        yield a, b, shingle_sets(texts, width)


def _repeated(width: int, block: int = 2_000_000):
    """Shingles found in two texts or more of a block of texts, with their number there."""

    def run(batches):
        held, size = [], 0

        def flush():
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n > 1
            return pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(n[keep])], ["token", "n"])

        for batch in batches:
            for _, _, sets in _sets(batch, width):
                held += sets
                size += sum(map(len, sets))
                if size > block:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _probe(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tokens & np.uint64(FILTER_BITS - 1), (tokens >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)


def common_filters(docs: DataFrame, width: int) -> np.ndarray:
    """Bits of the shingles that so many texts are seen to share, by step of ``COMMON_FROM``; ``FILTER_BITS`` bits each whatever the input."""
    seen = docs.select("text").mapInArrow(_repeated(width), "token long, n long")
    common = seen.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_FROM[0])
    at = F.explode(F.array(F.col("token"), F.shiftrightunsigned("token", 32))).alias("at")
    step = sum((F.col("n") >= n).cast("int") for n in COMMON_FROM) - 1
    bit = common.select(F.explode(F.sequence(F.lit(0), step)).alias("step"), "token").select("step", at)
    return _bits_of(bit.select("step", F.col("at").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("at")), len(COMMON_FROM))


def parity_map(tokens: np.ndarray) -> bytes:
    """Parities of a set's shingles over a power of two of bits, from half as many as shingles up."""
    bits = 64
    while 2 * bits < len(tokens):
        bits *= 2
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def _folded(maps: np.ndarray, size: int) -> np.ndarray:
    """Rows of bitmaps brought to ``size`` words by the exclusive or of their halves."""
    while maps.shape[-1] > size:
        half = maps.shape[-1] // 2
        maps = maps[..., :half] ^ maps[..., half:]
    return maps


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which bitmaps differ, of equal or of different sizes."""
    size = min(x.shape[-1], y.shape[-1])
    return np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum(axis=-1, dtype=np.int64)


def _may_link(x: np.ndarray, y: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes x and y that differ in ``apart`` shingles or more can link."""
    return apart <= x + y + 2 * (-percent * (x + y) // (100 + percent))


def _described(width: int, percent: int, filters: np.ndarray):
    def step(tokens: np.ndarray) -> np.ndarray:
        places = _probe(tokens)
        return sum(np.logical_and(*[(bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0 for at in places]).astype(np.int8) for bits in filters)

    def run(batches):
        for batch in batches:
            for a, b, sets in _sets(batch, width):
                offsets, parts, sizes, names, maps = [0], [], [], [], []
                steps = step(np.concatenate(sets)) if sets else None
                at = 0
                for s in sets:
                    n = len(s)
                    first = s[np.argsort(steps[at : at + n], kind="stable")[: n - -(-percent * n // 100) + 1]] if n else s
                    at += n
                    parts.append(first)
                    offsets.append(offsets[-1] + len(first))
                    sizes.append(n)
                    names.append(np.array([s.sum(), np.bitwise_xor.reduce(mix(s)) + np.uint64(n)], np.uint64).tobytes() if n else None)
                    maps.append(parity_map(s) if n else None)
                values = pa.array(np.concatenate(parts).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(maps, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)],
                    ["doc_id", "n", "class", "map", "first"],
                )

    return run


def _candidates(percent: int, short_list: int):
    """Rows (token, rep, n, pos) sorted by token, pos -> pairs (0, a, b, room) and entries of long lists (1, token, rep, 0).

    room: the most shingles that the pair can share from this one on; -1 for pairs of a long list with its
    first two entries, which have the fewest rarer shingles and stand in for its middle.
    """

    def run(batches):
        carry = None  # rows of the open list, or its first two rows once it is long
        long_of = None

        def out(kind, a, b, room):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(room)], ["kind", "a", "b", "room"])

        def long_rows(token, leads, reps, sizes):
            for rep, size in leads:
                ok = (100 * np.minimum(size, sizes) >= percent * np.maximum(size, sizes)) & (reps != rep)
                yield out(0, np.minimum(rep, reps[ok]), np.maximum(rep, reps[ok]), np.full(int(ok.sum()), -1))
            yield out(1, np.full(len(reps), token), reps, np.zeros(len(reps), np.int64))

        def short_rows(t, r, size, pos):
            a, b, room = ([np.zeros(0, np.int64)] for _ in range(3))
            for d in range(1, short_list):
                x = np.flatnonzero(t[d:] == t[:-d])
                if not len(x):
                    break
                y = x + d
                least, most = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
                ok = 100 * least >= percent * most
                room.append(np.minimum(size[x] - pos[x], size[y] - pos[y])[ok])
                a.append(np.minimum(r[x[ok]], r[y[ok]]))
                b.append(np.maximum(r[x[ok]], r[y[ok]]))
            yield out(0, np.concatenate(a), np.concatenate(b), np.concatenate(room))

        for batch in batches:
            t, r, size, pos = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("token", "rep", "n", "pos"))
            if carry is not None:
                t, r, size, pos = (np.concatenate(x) for x in zip(carry, (t, r, size, pos), strict=True))
                carry = None
            if long_of is not None and len(t):  # rows of a list already known as long
                k = int(np.argmax(t != long_of[0])) if (t != long_of[0]).any() else len(t)
                if k:
                    yield from long_rows(*long_of, r[:k], size[:k])
                t, r, size, pos = t[k:], r[k:], size[k:], pos[k:]
                if len(t):
                    long_of = None
            if not len(t):
                continue
            starts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            length = np.diff(np.concatenate((starts, [len(t)])))
            closed = int(starts[-1])
            keep = np.repeat((length > 1) & (length <= short_list), length)
            keep[closed:] = False
            yield from short_rows(t[keep], r[keep], size[keep], pos[keep])
            for s, e in zip(starts[length > short_list], (starts + length)[length > short_list], strict=True):
                leads = [(r[s + k], size[s + k]) for k in (0, 1)]
                yield from long_rows(t[s], leads, r[s:e], size[s:e])
                if s == closed:
                    long_of = (t[s], leads)
            if long_of is None:
                carry = (t[closed:], r[closed:], size[closed:], pos[closed:])
        if carry is not None:
            yield from short_rows(*carry)

    return run


def _links(width: int, percent: int, block: int = 128):
    """Rows (job, role, id, label, text) sorted by job, role: role 0 are queries, role 1 entries -> links (a, b).

    Entries of the query's own component are left out, also when it grows within the job: what is
    emitted is enough for the components and never more than a job's rows.
    """

    def run(batches):
        job, queries, entries, roots = None, [], [], Roots()

        def flush():
            a, b = [], []
            if queries and entries:
                held = Block([s for *_, s in entries])
                labels = np.array([roots.of(x) for _, x, _ in entries])
                for q, label, tokens in queries:
                    for k in held.search(tokens, percent) if (labels != roots.of(label)).any() else ():
                        if roots.join(label, entries[k][1]):
                            a.append(q)
                            b.append(entries[k][0])
            entries.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            jobs, roles, ids, labels = (batch.column(k).to_pylist() for k in ("job", "role", "id", "label"))
            for a, _b, sets in _sets(batch, width):
                for k, s in enumerate(sets, a):
                    if jobs[k] != job:
                        yield flush()
                        job, queries, roots = jobs[k], [], Roots()
                    if not len(s):
                        continue
                    (entries if roles[k] else queries).append((ids[k], labels[k], s))
                    if len(entries) >= block:
                        yield flush()
        yield flush()

    return run


def _among(bits: np.ndarray):
    """Rows of (doc_id, text) whose id the bit filter has."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            at = mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)) & np.uint64(FILTER_BITS - 1)
            hit = (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
            yield batch.filter(pa.array(hit & ids.is_valid().to_numpy(zero_copy_only=False)))

    return run


def _bits_of(positions: DataFrame, steps: int = 1) -> np.ndarray:
    """Rows (step, at) of bit positions -> a filter of ``FILTER_BITS`` bits for each step, whatever the number of rows."""
    words = positions.groupBy("step", F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask"))
    bits = np.zeros((steps, FILTER_BITS // 64), np.uint64)
    for r in words.collect():
        bits[r["step"], r["word"]] = np.uint64(r["mask"] & 0xFFFFFFFFFFFFFFFF)
    return bits


def _id_positions(batches):
    for batch in batches:
        at = np.unique(mix(batch.column("id").to_numpy().astype(np.uint64)) & np.uint64(FILTER_BITS - 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at), np.int32)), pa.array(at.astype(np.int64))], ["step", "at"])


def jaccard_components(spark: SparkSession, docs: DataFrame, width: int = 4, percent: int = 85, short_list: int = 24, block: int = 512) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    A component is named by its smallest doc_id. A null or wordless text has no shingles and is its
    own component. Rows that share a doc_id are one node; a row without a doc_id takes its class's
    smallest id, or null. Repeated rows are returned as often as they come, other columns are ignored,
    an empty table gives an empty result.
    Components are exact, links are not listed: a pair is verified no further once its ends are known to be in
    one component, so what is found spans the components and gives neither all links nor a row's number of links.
    """
    work = Scratch(spark, "jaccard")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    filters = common_filters(texts, width)
    each = work.save(texts.mapInArrow(_described(width, percent, filters), "doc_id long, n long, class binary, map binary, first array<long>"), "described")
    classes = each.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("map").alias("map"), F.first("first").alias("first"))
    classes = work.save(classes, "classes")
    posted = classes.where("rep is not null").select("rep", F.col("n").cast("int").alias("n"), F.posexplode("first").alias("pos", "token"))
    met = posted.repartition("token").sortWithinPartitions("token", "pos", "rep").mapInArrow(_candidates(percent, short_list), "kind int, a long, b long, room long")
    met = work.save(met.groupBy("kind", "a", "b").agg(F.count_if(F.col("room") >= 0).alias("shared"), F.max("room").alias("room")), "met")
    entries = met.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("id"))
    # Written, so that joins on it shuffle anew and AQE may split an id with very many pairs.
    sets = work.save(_sizes(classes, entries), "sets")
    pairs = work.save(_possible(met.where("kind = 0"), sets, percent), "pairs")
    # Only texts that are candidates are shuffled from here on; the filter lets few others pass.
    among = lambda rows, ids: rows.mapInArrow(_among(_bits_of(ids.mapInArrow(_id_positions, "step int, at long"))[0]), "doc_id long, text string")
    near = among(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    links = work.save(_verified(near, _pair_jobs(pairs), width, percent), "links")
    labels = connected_components(spark, links)
    more = work.save(_open_lists(work, entries, sets, labels, percent, block), "open")
    if not more.isEmpty():
        links = links.union(work.save(_verified(among(texts, more.select("id")), more, width, percent), "more"))
        labels = connected_components(spark, links)
    smallest = classes.join(labels, classes.rep == labels.id, "left").select("class", F.coalesce("label", "rep").alias("component"))
    # The second key stops the join from reusing the aggregate's layout, so AQE may split a class with very many rows.
    tag = F.substring("class", 1, 4)
    rows = each.select("doc_id", F.col("n").alias("n_shingles"), "class", tag.alias("tag"))
    out = rows.join(smallest.select("class", tag.alias("tag"), "component"), ["class", "tag"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _sizes(classes: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, n, long, map): size, number of long lists and bitmap of each node's set.

    A node with several sets (a repeated doc_id) has the null bitmap, as no bound on one set holds for it.
    """
    long = entries.groupBy("id").agg(F.count(F.lit(1)).alias("long"))
    sets = classes.where("rep is not null").groupBy(F.col("rep").alias("id")).agg(F.max("n").alias("n"), F.max("map").alias("map"), F.count(F.lit(1)).alias("sets"))
    return sets.join(long, "id", "left").select("id", "n", F.coalesce("long", F.lit(0)).alias("long"), F.when(F.col("sets") == 1, F.col("map")).alias("map"))


def _maps(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all bitmaps, first byte, number of 8-byte words) of a column; nulls have none."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    words = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
    return words, ends[:-1].astype(np.int64), size.astype(np.int64) // 8


def _near_maps(percent: int):
    """Pairs whose bitmaps let them link; one without a bitmap stays."""

    def run(batches):
        for batch in batches:
            (x, x0, xn), (y, y0, yn) = _maps(batch.column("map_a")), _maps(batch.column("map_b"))
            n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            keep = (xn == 0) | (yn == 0)
            for key in set(zip(xn[~keep].tolist(), yn[~keep].tolist(), strict=True)):
                at = np.flatnonzero((xn == key[0]) & (yn == key[1]))
                for k in range(0, len(at), 1024):
                    own = at[k : k + 1024]
                    of = lambda data, first, size: data[(first[own][:, None] + np.arange(8 * size))].view(np.uint64)  # noqa: B023, E731
                    keep[own] = _may_link(n[own], m[own], _apart(of(x, x0, key[0]), of(y, y0, key[1])), percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _possible(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose lists and bitmaps leave room for T common shingles.

    From the first shingle that two linked sets share, T have to follow; and beyond the prefix that ends
    first lie at most ceil(percent * n / 100) - 1 of the larger set's shingles, so the prefixes share what
    T exceeds that by. Shared short lists are counted; of long ones each set's number is an upper bound.
    """
    side = lambda k: sets.select(F.col("id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "long")], F.col("map").isNull().alias(f"several_{k}"))
    rows = met.join(side("a"), "a").join(side("b"), "b")
    goal = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    beyond = F.ceil(percent * F.greatest("n_a", "n_b") / 100) - 1
    enough = F.col("shared") + F.least("long_a", "long_b") >= goal - beyond
    room = (F.col("room") >= goal) | (F.least("long_a", "long_b") > 0)
    rows = rows.where("a <> b").where(F.col("several_a") | F.col("several_b") | (enough & room)).select("a", "b")
    map_of = lambda k: sets.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("map").alias(f"map_{k}"))
    return rows.join(map_of("a"), "a").join(map_of("b"), "b").mapInArrow(_near_maps(percent), "a long, b long")


def _pair_jobs(pairs: DataFrame, per_job: int = 256) -> DataFrame:
    """Candidates of one query as jobs of about ``per_job`` entries: (job, role, id)."""
    count = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    cut = F.expr(f"pmod(xxhash64(b), cast(ceil(n / {per_job}) as long))")
    jobs = pairs.join(count, "a").select("a", "b", cut.alias("cut"))
    name = F.concat_ws("/", "a", "cut").alias("job")
    heads = jobs.select("a", "cut").distinct().select(name, F.lit(0).alias("role"), F.col("a").alias("id"), F.col("a").alias("label"))
    return heads.union(jobs.select(name, F.lit(1).alias("role"), F.col("b").alias("id"), F.col("b").alias("label")))


def _near_rows(percent: int):
    """Rows (job, role, id, label, n, map) sorted by job, role -> (job, role, id, label) of those with a row of the other role in their job that may link and is of another component.

    A job's rows are held, its pairs are not: what comes out is at most what went in.
    """

    def run(batches):
        job, queries, entries = None, [], []

        def flush():
            out = []
            groups: dict[int, list] = {}
            for e in entries:
                groups.setdefault(len(e[4] or b""), []).append(e)
            marked: dict[int, np.ndarray] = {}
            held = {}
            for size, rows in groups.items():
                maps = np.frombuffer(b"".join(e[4] for e in rows), np.uint64).reshape(len(rows), -1) if size else None
                held[size] = (rows, np.array([e[3] for e in rows]), np.array([e[2] for e in rows]), maps)
                marked[size] = np.zeros(len(rows), bool)
            for q in queries:
                own, hit = np.frombuffer(q[4], np.uint64) if q[4] else None, False
                for size, (_, n, label, maps) in held.items():
                    ok = label != q[2]
                    if own is not None and size:
                        ok &= 100 * np.minimum(n, q[3]) >= percent * np.maximum(n, q[3])
                        at = np.flatnonzero(ok)
                        ok[at] = _may_link(n[at], q[3], _apart(maps[at], own), percent)
                    marked[size] |= ok
                    hit |= bool(ok.any())
                if hit:
                    out.append((job, 0, q[1], q[2]))
            for size, (rows, *_) in held.items():
                out += [(job, 1, e[1], e[2]) for e, k in zip(rows, marked[size].tolist(), strict=True) if k]
            queries.clear(), entries.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["job", "role", "id", "label"])

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("job", "role", "id", "label", "n", "map")], strict=True):
                if row[0] != job:
                    yield flush()
                    job = row[0]
                (entries if row[1] else queries).append((None, row[2], row[3], row[4], row[5]))
        yield flush()

    return run


def _open_lists(work: Scratch, entries: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, block: int) -> DataFrame:
    """Jobs (job, role, id, label) that search long lists whose entries are not yet in one component, in pairs of blocks.

    Linked sets are of like size, so a query meets entries of its own and of the neighbouring bands of size only.
    """
    named = entries.join(labels, "id", "left").select("token", "id", F.coalesce("label", "id").alias("label"))
    parts = named.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
    lists = parts.groupBy("token").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label")).alias("main")).where("labels > 1").select("token", F.col("main.label").alias("main"))
    # A node with several sets takes part in all bands.
    band = F.floor(F.log(F.col("n")) / F.lit(1.0001 * float(np.log(100 / percent)))).cast("int")
    sized = sets.select("id", "n", F.when(F.col("map").isNotNull(), band).alias("band"), "map")
    rows = named.join(lists, "token").join(sized, "id")
    bands = rows.where("band is not null").select("token", "band").distinct()
    anywhere = rows.where("band is null").drop("band").join(bands, "token", "left").withColumn("band", F.coalesce("band", F.lit(0)))
    rows = work.save(rows.where("band is not null").unionByName(anywhere.select(rows.columns)), "rows")
    targets = rows.select("token", "band", "id", "label", "n", "map")
    queries = rows.where("label <> main").select("token", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "id", "label", "n", "map")
    count = lambda df, name: df.groupBy("token", "band").agg(F.expr(f"cast(ceil(count(1) / {block}) as int)").alias(name))
    # Written, a row a list and band, so that the joins on it shuffle anew and AQE may split a list with very many entries.
    blocks = work.save(count(targets, "entry_blocks").join(count(queries, "query_blocks"), ["token", "band"]), "blocks")
    own = ["token", "band", "id", "label", "n", "map"]
    queries = queries.join(blocks, ["token", "band"]).select(*own, F.expr("pmod(xxhash64(id), query_blocks)").alias("q"), F.explode(F.expr("sequence(0, entry_blocks - 1)")).alias("e"))
    targets = targets.join(blocks, ["token", "band"]).select(*own, F.expr("pmod(xxhash64(id, 1), entry_blocks)").alias("e"), F.explode(F.expr("sequence(0, query_blocks - 1)")).alias("q"))
    job = lambda df, role: df.select(F.concat_ws("/", "token", "band", "q", "e").alias("job"), F.lit(role).alias("role"), "id", "label", "n", "map")
    dealt = job(queries, 0).union(job(targets, 1)).repartition("job").sortWithinPartitions("job", "role", "id")
    return dealt.mapInArrow(_near_rows(percent), "job string, role int, id long, label long")


def _verified(texts: DataFrame, jobs: DataFrame, width: int, percent: int) -> DataFrame:
    rows = jobs.join(texts.withColumnRenamed("doc_id", "id"), "id").select("job", "role", "id", "label", "text")
    return rows.repartition("job").sortWithinPartitions("job", "role", "id").mapInArrow(_links(width, percent), "a long, b long")
