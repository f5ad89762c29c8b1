"""Periodic run detection: string synchronising sets at dyadic scales propose periods, exact comparison settles them.

For a scale t the set holds the places whose fragment of t words has the least hash among the t + 1 fragments
from it on, or shares that least hash with the last of them; fragments with a period of at most t / 4 have no say.
Whether a place is in depends on the 2 t words from it on alone. A run of period q in [t, 2 t) and at least
4 q words holds two such places, q apart, with the same 2 t words; equal neighbours in the order of
contexts therefore propose every such period. What a scale leaves out, regions of periods of at most t / 4, are runs
that smaller scales have found; the periods below the least scale are found by comparing each word with those before it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textstream

#: The least scale; smaller periods are found by direct comparison.
LEAST_SCALE = 8
#: A run is at least so many periods long, and so many words.
PERIODS, LEAST_WORDS = 4, 6
#: Words of a collapsed text that are put together at a time.
PIECE_WORDS = 1 << 16
_FRAGMENT = np.uint64(0xD6E8FEB86659FD93)
_EXCLUDED = np.uint64(0xFFFFFFFFFFFFFFFF)
SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def planted_period(doc_id: int | None, n: int) -> tuple[int, int]:
    """(first word, period) of the repetition that a document of ``n`` words is given, (n, 1) if none: one in ten by the hash of its id, none without an id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return n, 1
    a = h // 10 % n
    return a, 1 + (n - a) // (3 + h // 10 % 8)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the given lengths, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width] for each i that has so many."""
    n = len(x) - width + 1
    padded = np.concatenate((x, np.full(-len(x) % width, _EXCLUDED))).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _stretched(w: np.ndarray, lo: np.ndarray, hi: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """[a, b) that should have period d, compared word by word and stretched within [lo, hi): (start, end, whether it has that period)."""
    n = len(a)
    left, right = np.maximum(a - 2 * d, lo), np.minimum(b + 2 * d, hi)
    start, end, good = a.copy(), b.copy(), np.ones(n, bool)
    todo = np.arange(n)
    while len(todo):
        length = right[todo] - d[todo] - left[todo]
        at = _spread(left[todo], length)
        differ = np.flatnonzero(w[at] != w[at + np.repeat(d[todo], length)])
        who, place = np.repeat(todo, length)[differ], at[differ]
        good[who[(place >= a[who]) & (place < b[who] - d[who])]] = False
        start[todo], end[todo] = left[todo], right[todo]
        before, after = place < a[who], place >= b[who] - d[who]
        np.maximum.at(start, who[before], place[before] + 1)
        np.minimum.at(end, who[after], place[after] + d[who[after]])
        # One that met no difference on a side goes on there, twice as far.
        open_l, open_r = good & (start == left) & (left > lo), good & (end == right) & (right < hi)
        todo = np.flatnonzero(open_l | open_r)
        reach = np.maximum(right - left, d)
        left, right = np.where(open_l, np.maximum(left - reach, lo), left), np.where(open_r, np.minimum(right + reach, hi), right)
    return start, end, good


def _least_periods(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs once each, with the smallest of the periods that were found for a stretch, by start and period."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (np.diff(start) != 0) | (np.diff(end) != 0)
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _small(w: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Runs of periods below the least scale."""
    found = []
    for q in range(1, LEAST_SCALE):
        if len(w) <= q:
            break
        same = w[q:] == w[:-q]
        cut = bounds[1:-1]
        for k in range(q):  # words of two texts are never compared
            inside = cut[(cut - 1 - k >= 0) & (cut - 1 - k < len(same))]
            same[inside - 1 - k] = False
        edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).view(np.int8)))
        a, b = edge[0::2], edge[1::2] + q
        long_enough = b - a >= PERIODS * q
        found.append(np.stack([a[long_enough], b[long_enough], np.full(long_enough.sum(), q)]))
    return found


def runs_of(w: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of at least four periods in texts given one after the other as word hashes: (start, end, period), by start, then period.

    Places are those of the whole array; no run leaves its text. Words are compared by their 64-bit hashes.
    """
    bounds = np.concatenate(([0], np.cumsum(counts)))
    found = _small(w, bounds)
    # Texts that a scale is too large for leave the array.
    words, at, own, scale = w, np.arange(len(w)), np.repeat(np.arange(len(counts)), counts), LEAST_SCALE
    h, width = w, 1
    while True:
        keep = counts[own] >= PERIODS * scale
        if not keep.any():
            break
        if not keep.all():
            # Fragments that would reach into another text are never used, so hashes stay as they are.
            words, at, own, h = words[keep], at[keep], own[keep], h[keep]
        while width < scale:
            h = _joined(h, width)
            width *= 2
        context = _joined(h, width)
        hi = bounds[own + 1] - at + np.arange(len(at))  # past the last word of the place's text, in this array
        place = np.arange(len(at))
        ids = h.copy()
        ids[place + scale > hi] = _EXCLUDED
        if found:
            a, b, q = np.concatenate(found, axis=1)
            tight = (q <= scale // 4) & (b - a >= scale)
            slot = np.searchsorted(at, a[tight])  # a text is here with all its words, or with none
            here = (slot < len(at)) & (at[np.minimum(slot, len(at) - 1)] == a[tight])
            marks = np.zeros(len(at) + 1, np.int32)
            np.add.at(marks, slot[here], 1)
            np.add.at(marks, slot[here] + (b - a)[tight][here] - scale + 1, -1)
            ids[np.cumsum(marks[:-1]) > 0] = _EXCLUDED
        if len(at) > scale:
            least = _window_min(ids, scale + 1)
            chosen = np.flatnonzero((least != _EXCLUDED) & ((ids[: len(least)] == least) | (ids[scale : scale + len(least)] == least)))
            chosen = chosen[chosen + 2 * scale <= hi[chosen]]
            found += _proposed(words, own, hi, chosen, context, scale, at)
        scale *= 2
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _least_periods(*np.concatenate(found, axis=1))


def _joined(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of fragments of twice the width; those that the array has no room for are left as noise and never used."""
    later = np.concatenate((h[width:], np.zeros(min(width, len(h)), np.uint64)))
    return textstream.mix(h * _FRAGMENT + (later ^ (later >> np.uint64(29))) + np.uint64(width))


def _proposed(words: np.ndarray, own: np.ndarray, hi: np.ndarray, chosen: np.ndarray, context: np.ndarray, scale: int, at: np.ndarray) -> list[np.ndarray]:
    """Runs of the periods that chosen places with equal contexts, next to each other in that order, propose."""
    order = chosen[np.argsort(context[chosen], kind="stable")]
    a, d = order[:-1], np.diff(order)
    pair = (context[order[1:]] == context[a]) & (d >= scale) & (d < 2 * scale) & (own[order[1:]] == own[a])
    a, d = a[pair], d[pair]
    if not len(a):
        return []
    # Proposals of one period whose stretches overlap by a period are one stretch.
    by = np.lexsort((a, d))
    a, d = a[by], d[by]
    new = np.ones(len(a), bool)
    new[1:] = (np.diff(d) != 0) | (np.diff(a) > 2 * scale) | (own[a[1:]] != own[a[:-1]])
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(a) - 1]))
    first, d, b = a[new], d[new], a[last] + d[new] + 2 * scale
    lo = np.searchsorted(own, own[first])
    start, end, good = _stretched(words, lo, hi[first], first, b, d)
    good &= end - start >= PERIODS * d
    return [np.stack([at[start[good]], at[start[good]] + (end - start)[good], d[good]])]


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """The words that no run holds after its first period."""
    gone = np.zeros(n + 1, np.int32)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return np.flatnonzero(np.cumsum(gone[:-1]) == 0)


def _pieces(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
    """The words of these places joined by spaces, in pieces of bounded size."""
    for at in range(0, len(starts), PIECE_WORDS):
        first, past = starts[at : at + PIECE_WORDS], ends[at : at + PIECE_WORDS]
        length = past - first + 1
        out = buffer[_spread(first, length)]
        out[np.cumsum(length) - 1] = 32  # the byte after a word becomes the space
        yield out.tobytes() if at + PIECE_WORDS < len(starts) else out[:-1].tobytes()


def _texts(ids: list[int | None] | None, texts: list[bytes]) -> Iterator[tuple]:
    """For each text its row: number of runs, the longest, two digests, the runs and the collapsed text in pieces."""
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ~textstream.SPACE[buffer])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    hashes, counts = textstream.word_hashes(texts, lower=False)
    past = np.cumsum(counts)
    source = np.arange(len(hashes))
    for k, n in enumerate(counts.tolist()) if ids is not None else ():
        a, p = planted_period(ids[k], n)
        if a < n:
            source[past[k] - n + a : past[k]] = past[k] - n + a + np.arange(n - a) % p
    begin, end, period = runs_of(hashes[source], counts)
    cut = np.searchsorted(begin, np.concatenate(([0], past)))
    for k, n in enumerate(counts.tolist()):
        own, zero = slice(cut[k], cut[k + 1]), past[k] - n
        runs = [r for r in zip((begin[own] - zero).tolist(), (end[own] - begin[own]).tolist(), period[own].tolist()) if r[1] >= LEAST_WORDS]
        place = source[zero + _kept(n, runs)]
        yield runs, _pieces(buffer, starts[place], ends[place])


def _row(runs: list[tuple[int, int, int]], pieces: Iterator[bytes], lists: bool) -> tuple:
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None, None, None, None)
    listed, digest, text = "".join(f"{s},{n},{p}\n" for s, n, p in runs), hashlib.sha256(), []
    for piece in pieces:
        digest.update(piece)
        if lists:
            text.append(piece)
    row = (len(runs), *head, hashlib.sha256(listed.encode()).hexdigest(), digest.hexdigest())
    return (*row, [{"start": s, "length": n, "period": p} for s, n, p in runs], b"".join(text).decode("utf-8", "surrogatepass")) if lists else row


def periodic_runs(docs: DataFrame, planted: bool = False, lists: bool = False) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, any others) but the text and those named like a result, then n_runs, the longest run and two digests, a row per row.

    A run is a stretch of words (``[^\\x20\\x09-\\x0D]+``) with smallest period q and at least max(6, 4 q) words that no
    neighbour extends. start, length, period, exponent_milli are those of the longest run (ties: smallest start, then
    period), null without runs. runs_sha256 is the digest of ``start,length,period`` and a line feed for each run by
    start, then period; collapsed_sha256 that of the words that no run holds after its first period, joined by spaces.
    ``planted``: one document in ten repeats part of its words, as ``planted_period`` says. ``lists``: two more columns,
    the runs and the collapsed text. Null texts and those without words have no runs and an empty collapsed text; a null
    id is never planted; repeated rows come back alike. Texts are the unit of work: a task holds about 1 MB of them at
    a time, or one that is longer.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")] + (["runs", "collapsed"] if lists else [])
    rest = [c for c in docs.columns if c not in ("text", *names)]
    kept = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text"))
    carried = [f"c{i}" for i in range(len(rest))]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + ([pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])), pa.string()] if lists else [])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(len(rest)).to_pylist(), []
            for first, last, texts in textstream.chunks(batch.column(len(rest) + 1).to_pylist()):
                out += [_row(runs, pieces, lists) for runs, pieces in _texts(ids[first:last] if planted else None, texts)]
            if out:
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]], [*carried, *names])

    schema = ", ".join([*[f"{c} {kept.schema[c].dataType.simpleString()}" for c in carried], SCHEMA, *(["runs array<struct<start:long,length:long,period:long>>, collapsed string"] if lists else [])])
    return kept.mapInArrow(found, schema).select(*[F.col(c).alias(r) for c, r in zip(carried, rest)], *names)


#: crc32 of a text of ASCII characters, in SQL: the table of 256 entries from its rule, then a fold over characters.
_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"


def crc32_ctes() -> str:
    """Common table expressions of which ``crc_table`` holds the 256 entries as one list ``t``."""
    rows = "c0 AS (SELECT unnest(range(256)) AS i, unnest(range(256)) AS v)"
    for k in range(8):
        rows += f", c{k + 1} AS (SELECT i, CAST({_STEP.format('v')} AS BIGINT) AS v FROM c{k})"
    return rows + ", crc_table AS (SELECT list(v ORDER BY i) AS t FROM c8)"


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of ``text``, where ``t`` is the list of ``crc_table``."""
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda z: CAST(ascii(z) AS BIGINT))), lambda x, y: xor(x >> 8, t[CAST(xor(x, y) & 255 AS INT) + 1])), 4294967295)"


SQL = rf"""
WITH {crc32_ctes()}, d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o, {crc32_sql('CAST(doc_id AS VARCHAR)')} AS h FROM documents, crc_table
), e AS (
  SELECT doc_id, o, len(o) AS n, h, CASE WHEN h % 10 = 0 AND len(o) > 0 THEN h // 10 % len(o) END AS a FROM d
), f AS (
  SELECT *, CASE WHEN a IS NOT NULL THEN 1 + (n - a) // (3 + h // 10 % 8) END AS p FROM e
), w AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN o ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN o[i + 1] ELSE o[a + (i - a) % p + 1] END) END AS w FROM f
), t AS (
  SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS x FROM w
), same AS (
  SELECT l.doc_id, r.i - l.i AS q, l.i FROM t l JOIN t r ON l.doc_id = r.doc_id AND l.x = r.x AND r.i > l.i AND r.i - l.i <= l.n // 4
), stretch AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM same) GROUP BY doc_id, q, g HAVING count(*) >= 3 * q
), run AS (
  SELECT doc_id, s, len, min(q) AS q FROM stretch GROUP BY ALL HAVING len >= greatest(6, 4 * min(q))
), per AS (
  SELECT doc_id, count(*) AS n_runs, arg_min({{'s': s, 'len': len, 'q': q}}, {{'l': -len, 's': s, 'q': q}}) AS b,
    sha256(string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256
  FROM run GROUP BY doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(s + q, s + len)) AS i FROM run) GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.len AS length, b.q AS period, 1000 * b.len // b.q AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w.w ELSE list_transform(list_filter(range(n), lambda i: NOT list_contains(gone, i)), lambda i: w.w[i + 1]) END, ' ')) AS collapsed_sha256
FROM w LEFT JOIN per ON w.doc_id = per.doc_id LEFT JOIN gone ON w.doc_id = gone.doc_id
"""
