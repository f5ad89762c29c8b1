"""The best passages of many queries over one term index: each passage is tokenised once, cut to the terms that are asked for, scored against all queries in its task, and only the best of each task are shuffled."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions import lexicon
from ..functions import text as T
from ..plans.scratch import Scratch
from .retrieval import DIGITS, term_counts, top_k

#: Rows (query, term) that go to all tasks, at most; more queries are answered in several passes over the index.
QUERY_ROWS = 1_000_000
#: Cells of a block of scores, passages times queries.
CELLS = 1 << 22
#: Terms whose numbers of passages go to all tasks, at most: those that most passages have. Only the others are shuffled for lengths of vectors.
COMMON_TERMS = 1 << 19


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _counted(keys: int, stop: tuple[str, ...]):
    """Batches (keys, w: token arrays) to (keys, len, terms, tf): each passage's distinct terms but for ``stop`` with their counts, in order of first code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            tokens = b.column(keys)
            coded = tokens.flatten().dictionary_encode()
            n = max(1, len(coded.dictionary))
            row, code = np.repeat(np.arange(b.num_rows), _sizes(tokens)), coded.indices.to_numpy(zero_copy_only=False)
            held = ~pc.is_in(coded.dictionary, value_set=pa.array(stop, pa.string())).to_numpy(zero_copy_only=False).astype(bool)[code]
            row, code = row[held], code[held]
            size = np.bincount(row, minlength=b.num_rows)
            pairs, tf = np.unique(row * n + code, return_counts=True)
            offsets = pa.array(np.searchsorted(pairs, np.arange(b.num_rows + 1) * n).astype(np.int32))
            terms = pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(pairs % n)))
            columns = [*b.columns[:keys], pa.array(size), terms, pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[:keys], "len", "terms", "tf"])

    return run


def _in_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (terms) to (term, n): in how many passages of a batch a term is."""
    for b in batches:
        coded = b.column(0).flatten().dictionary_encode()
        n = np.bincount(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), minlength=len(coded.dictionary))
        yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n)], ["term", "n"])


def _cut(keys: int, asked: pa.Array | None, common: pa.Array, idf: np.ndarray | None):
    """Batches (keys, len, terms, tf) to the same with asked terms only (None: all); with ``idf`` of the common terms also the sum of their squared weights, and the rare terms with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, tf = b.column(keys + 1), b.column(keys + 2).flatten().to_numpy(zero_copy_only=False)
            coded = terms.flatten().dictionary_encode()
            row, code = np.repeat(np.arange(b.num_rows), _sizes(terms)), coded.indices.to_numpy(zero_copy_only=False)

            def some(held: np.ndarray) -> list[pa.ListArray]:
                offsets = pa.array(np.searchsorted(row[held], np.arange(b.num_rows + 1)).astype(np.int32))
                return [pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(code[held]))), pa.ListArray.from_arrays(offsets, pa.array(tf[held]))]

            wanted = np.ones(len(code), bool) if asked is None else pc.is_in(coded.dictionary, value_set=asked).to_numpy(zero_copy_only=False).astype(bool)[code]
            columns, names = [*b.columns[: keys + 1], *some(wanted)], [*b.schema.names[:keys], "len", "terms", "tf"]
            if idf is not None:
                at = pc.index_in(coded.dictionary, value_set=common).fill_null(-1).to_numpy(zero_copy_only=False)[code]
                squares = np.bincount(row, (np.append(idf, 0.0)[at] * tf) ** 2, b.num_rows)
                columns, names = [*columns, pa.array(squares), *some(at < 0)], [*names, "squares", "rare", "rare_tf"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


@dataclass
class Index:
    """A saved table (keys, len, terms, tf), a row per passage, with its sizes; document frequencies are counted once, when they are needed."""

    spark: SparkSession
    rows: DataFrame
    keys: list[str]
    n: int
    mean_len: float
    work: Scratch
    _df: list[DataFrame] = field(default_factory=list)
    _common: list[tuple[pa.Table, int | None]] = field(default_factory=list)
    _asked: list[tuple] = field(default_factory=list)

    @classmethod
    def of(cls, passages: DataFrame, keys: list[str], tokens: Column | None = None) -> Index:
        """Of ``passages`` (keys, text); tokens are content words unless an array column is given. Null texts are passages without terms."""
        spark, work = passages.sparkSession, Scratch(passages.sparkSession, "index")
        # A batch's distinct words are fewer than its words: stop words leave there, not in a pattern that tries them at each word.
        stop = lexicon.STOP_WORDS if tokens is None else ()
        w = F.coalesce(tokens if tokens is not None else T.content_words(F.col("text"), []), F.array().cast("array<string>"))
        given = passages.select(*keys, w.alias("w"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[: len(keys)])
        rows = work.save(given.mapInArrow(_counted(len(keys), tuple(stop)), f"{schema}, len long, terms array<string>, tf array<int>"), "rows")
        n, mean = rows.agg(F.count(F.lit(1)), F.coalesce(F.avg("len"), F.lit(0.0))).first()
        return cls(spark, rows, keys, n, mean, work)

    def frequencies(self) -> DataFrame:
        """(term, df)."""
        if not self._df:
            seen = self.rows.select("terms").mapInArrow(_in_passages, "term string, n long")
            self._df.append(self.work.save(seen.groupBy("term").agg(F.sum("n").alias("df")), "df"))
        return self._df[0]

    def common(self) -> tuple[pa.Table, DataFrame | None]:
        """((term, df) of the terms that most passages have, ``COMMON_TERMS`` at most, and a table of all others, None if there are none). They are told apart by steps of df, eight to a doubling."""
        df, step = self.frequencies(), F.floor(F.log2("df") * 8)
        if not self._common:
            least, total, split = 1 << 20, 0, None
            for s, n in sorted(map(tuple, df.groupBy(step.alias("s")).agg(F.count(F.lit(1))).collect()), reverse=True):
                total += n
                if total > COMMON_TERMS:
                    split = least
                    break
                least = s
            self._common.append((df.where(step >= least).select("term", "df").toArrow(), split))
        table, split = self._common[0]
        return table, None if split is None else df.where(step < split)

    def cut(self, queries: DataFrame, query: str, norms: bool) -> tuple[DataFrame, DataFrame]:
        """(rows cut to the terms that queries have, those without any left out, counts (query, term, tf) of the queries). ``norms``: rows also tell squares, rare and rare_tf. Kept for the next call with the same table of queries."""
        for given, name, normed, found in self._asked:
            if given is queries and name == query and (normed or not norms):
                return found
        no = len(self._asked)
        q = self.work.save(term_counts(queries, [query], T.content_words(F.col("text"))), f"q{no}")
        terms = q.select("term").distinct()
        asked = terms.toArrow().column(0).combine_chunks() if q.count() <= QUERY_ROWS else None
        common, idf = pa.array([], pa.string()), None
        if norms:
            table = self.common()[0]
            common, idf = table.column("term").combine_chunks(), np.log((1 + self.n) / (1 + table.column("df").to_numpy())) + 1
        schema = f"{_schema(self.rows, self.keys)}, len long, terms array<string>, tf array<int>" + (", squares double, rare array<string>, rare_tf array<int>" if norms else "")
        rows = self.rows.mapInArrow(_cut(len(self.keys), asked, common, idf), schema).where(F.size("terms") > 0)
        found = self.work.save(rows, f"cut{no}"), q
        self._asked.append((queries, query, norms, found))
        return found


def bm25_parts(index: Index, queries: DataFrame, query: str, k1: float = 1.5, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(impacts (keys, terms, x), weights (query, term, v)) whose products, summed over shared terms, are BM25 scores. A term that repeats in a query counts each time."""
    rows, q = index.cut(queries, query, False)
    base = k1 * (1 - b + b * F.col("len") / F.lit(index.mean_len or 1.0))
    impacts = rows.select(*index.keys, "terms", F.transform("tf", lambda t: t * (k1 + 1) / (t + base)).alias("x"))
    idf = F.log((F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    return impacts, q.join(index.frequencies(), "term").select(query, "term", (F.col("tf") * idf).alias("v"))


def tfidf_parts(index: Index, queries: DataFrame, query: str) -> tuple[DataFrame, DataFrame]:
    """(impacts, weights) as ``bm25_parts`` gives them, for cosines of TF-IDF vectors with smoothed idf: the squared idf of a shared term stands with the query, so a passage needs only its counts and its norm.

    Common terms' part of a norm is summed where the passage lies; only rare terms are shuffled to meet their idf.
    """
    rows, q = index.cut(queries, query, True)
    idf = (F.log((1 + F.lit(index.n)) / (1 + F.col("df"))) + 1).alias("idf")
    squares, others = F.col("squares"), index.common()[1]
    if others is not None:
        each = rows.select(*index.keys, F.explode(F.arrays_zip("rare", "rare_tf")).alias("t")).select(*index.keys, F.col("t.rare").alias("term"), F.col("t.rare_tf").alias("tf"))
        more = each.join(others.select("term", idf), "term").groupBy(*index.keys).agg(F.sum((F.col("tf") * F.col("idf")) ** 2).alias("more"))
        rows, squares = rows.select(*index.keys, "terms", "tf", "squares").join(more, index.keys, "left"), squares + F.coalesce("more", F.lit(0.0))
    impacts = Scratch(index.spark, "unit").save(rows.select(*index.keys, "terms", F.transform("tf", lambda t: t / F.sqrt(squares)).alias("x")), "rows")
    q = q.join(index.frequencies().select("term", idf), "term").withColumn("raw", F.col("tf") * F.col("idf"))
    unit = F.col("raw") / F.sqrt(F.sum(F.col("raw") ** 2).over(Window.partitionBy(query)))
    return impacts, q.select(query, "term", (unit * F.col("idf")).alias("v"))


@dataclass
class _Asked:
    """Queries of one pass as arrays: names, and for each term its (query, weight) pairs in a row of ``starts``."""

    names: list
    terms: pa.Array
    starts: np.ndarray
    query: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, rows: list) -> _Asked:
        names = sorted({r[0] for r in rows})
        number = {x: i for i, x in enumerate(names)}
        rows = sorted(rows, key=lambda r: r[1])
        terms = sorted({r[1] for r in rows})
        code = {t: i for i, t in enumerate(terms)}
        counts = np.bincount([code[r[1]] for r in rows], minlength=len(terms))
        return cls(names, pa.array(terms, pa.string()), np.concatenate(([0], np.cumsum(counts))), np.array([number[r[0]] for r in rows], np.int64), np.array([r[2] for r in rows], float))

    def scores(self, terms: pa.ListArray, x: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, scores of rows by queries) of blocks of passages; 0 where no term is shared."""
        size = _sizes(terms)
        code = pc.index_in(terms.flatten(), value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False)
        value, row = x.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size)
        known = code >= 0
        code, value, row = code[known], value[known], row[known]
        block = max(1, CELLS // max(1, len(self.names)))
        for first in range(0, len(size), block):
            a, b = np.searchsorted(row, [first, first + block])
            c = code[a:b]
            n = self.starts[c + 1] - self.starts[c]
            at = np.repeat(self.starts[c] - np.cumsum(n) + n, n) + np.arange(n.sum())
            cell = np.repeat(row[a:b] - first, n) * len(self.names) + self.query[at]
            rows = min(block, len(size) - first)
            yield first, np.bincount(cell, np.repeat(value[a:b], n) * self.weight[at], rows * len(self.names)).reshape(rows, len(self.names))


def _passes(weights: DataFrame, query: str) -> list[_Asked]:
    """The queries, cut into passes of a bounded number of rows each; a query is never cut."""
    work = Scratch(weights.sparkSession, "asked")
    weights = work.save(weights.select(query, "term", "v"), "weights")
    n = -(-weights.count() // QUERY_ROWS)
    if n <= 1:
        return [_Asked.of([tuple(r) for r in weights.collect()])]
    part = F.pmod(F.xxhash64(query), F.lit(2 * n))
    return [_Asked.of(rows) for k in range(2 * n) if (rows := [tuple(r) for r in weights.where(part == k).collect()])]


def _arrow(df: DataFrame, columns: list[str]) -> list[pa.DataType]:
    return [to_arrow_type(df.schema[c].dataType) for c in columns]


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def _found(asked: _Asked, keys: list[str], query: str, k: int, kind: pa.DataType):
    """The k best of a batch for each query, ties by keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = pc.sort_indices(pa.Table.from_batches([b]).select(keys), sort_keys=[(c, "ascending") for c in keys])
            b = b.take(order)
            for first, scores in asked.scores(b.column(len(keys)), b.column(len(keys) + 1)):
                shared, scores = scores > 0, np.round(scores, DIGITS)
                last = max(0, len(scores) - k)
                may = shared & (scores >= np.partition(np.where(shared, scores, -np.inf), last, axis=0)[last])
                rows, which = np.nonzero(may)
                order = np.lexsort((rows, -scores[rows, which], which))
                rows, which = rows[order], which[order]
                keep = np.arange(len(which)) - np.searchsorted(which, which) < k
                rows, which = rows[keep], which[keep]
                at = pa.array(first + rows)
                yield pa.RecordBatch.from_arrays([pa.array(asked.names, kind).take(pa.array(which)), *[b.column(i).take(at) for i in range(len(keys))], pa.array(scores[rows, which])], [query, *keys, "score"])

    return run


def _schema(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def best_passages(parts: tuple[DataFrame, DataFrame], keys: list[str], query: str, k: int) -> DataFrame:
    """(query, keys, score, rank): the k best passages of each query among those that share a term, scores rounded to six digits, ties by keys.

    Passages are scored where they lie, in blocks of passages by queries, and a task hands on its k best of a block. Queries are
    collected, a bounded number of rows at a time; ties are settled by keys, so results are alike at any partitioning. Keys must not be null.
    """
    impacts, weights = parts
    found = None
    for asked in _passes(weights, query):
        part = impacts.mapInArrow(_found(asked, keys, query, k, _arrow(weights, [query])[0]), f"{_schema(weights, [query])}, {_schema(impacts, keys)}, score double")
        found = part if found is None else found.unionByName(part)
    return top_k(found, [query], k, keys)


def _placed(asked: _Asked, keys: list[str], query: str, goals: dict, kinds: list[pa.DataType]):
    """For each goal (query, score, keys of a passage), how many passages of a batch rank before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(asked.names)}
        wanted = [(number[q], np.array([score for score, _ in gs]), [name for _, name in gs]) for q, gs in goals.items() if q in number]
        counts = [np.zeros(len(names), np.int64) for _, _, names in wanted]
        for b in batches:
            order = pc.sort_indices(pa.Table.from_batches([b]).select(keys), sort_keys=[(c, "ascending") for c in keys])
            b = b.take(order)
            names = list(zip(*[b.column(i).to_pylist() for i in range(len(keys))]))
            for first, scores in asked.scores(b.column(len(keys)), b.column(len(keys) + 1)):
                for (q, score, sought), count in zip(wanted, counts):
                    rows = np.flatnonzero(scores[:, q] > 0)
                    values = np.round(scores[rows, q], DIGITS)
                    order = np.argsort(values, kind="stable")
                    left, right = (np.searchsorted(values, score, side, order) for side in ("left", "right"))
                    count += len(values) - right
                    for w in np.flatnonzero(left < right).tolist():  # rows of one score are in order of keys
                        count[w] += np.searchsorted(rows[order[left[w] : right[w]]], bisect_left(names, sought[w], first, first + len(scores)) - first)
        if wanted:
            rows = [(asked.names[q], *name, int(c)) for (q, _, sought), count in zip(wanted, counts) for name, c in zip(sought, count)]
            yield _batch(rows, [*kinds, pa.int64()], [query, *keys, "before"])

    return run


def _scored(asked: _Asked, keys: list[str], query: str, goals: dict, kinds: list[pa.DataType]):
    """The scores of given passages, where they share a term with the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(asked.names)}
        wanted: dict[tuple, list[int]] = {}
        for q, names in goals.items():
            for name in names if q in number else ():
                wanted.setdefault(name, []).append(number[q])
        for b in batches:
            names = list(zip(*[b.column(i).to_pylist() for i in range(len(keys))]))
            held = [i for i, name in enumerate(names) if name in wanted]
            if not held:
                continue
            b = b.take(pa.array(held))
            rows = []
            for first, scores in asked.scores(b.column(len(keys)), b.column(len(keys) + 1)):
                for i in range(len(scores)):
                    name = names[held[first + i]]
                    rows += [(asked.names[q], *name, float(np.round(scores[i, q], DIGITS))) for q in wanted[name] if scores[i, q] > 0]
            if rows:
                yield _batch(rows, [*kinds, pa.float64()], [query, *keys, "score"])

    return run


def ranks_of(parts: tuple[DataFrame, DataFrame], keys: list[str], query: str, passages: DataFrame) -> DataFrame:
    """(query, keys, rank): the exact rank, among all passages that share a term with the query, of each of ``passages`` (query, keys) that does.

    Nothing is sorted: one pass over the index scores the given passages, another counts what ranks before them. ``passages`` is collected; callers bound it by what they ask.
    """
    impacts, weights = parts
    asked_rows: dict = {}
    for r in passages.select(query, *keys).distinct().collect():
        asked_rows.setdefault(r[0], []).append(tuple(r)[1:])
    schema, kinds = f"{_schema(weights, [query])}, {_schema(impacts, keys)}", [*_arrow(weights, [query]), *_arrow(impacts, keys)]
    out = None
    for asked in _passes(weights, query):
        scored = impacts.mapInArrow(_scored(asked, keys, query, asked_rows, kinds), f"{schema}, score double").collect()
        goals: dict = {}
        for r in scored:
            goals.setdefault(r[0], []).append((r[-1], tuple(r)[1:-1]))
        part = impacts.mapInArrow(_placed(asked, keys, query, goals, kinds), f"{schema}, before long").groupBy(query, *keys).agg((F.sum("before") + 1).alias("rank"))
        out = part if out is None else out.unionByName(part)
    return out


def fused(first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame], keys: list[str], query: str, most: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two searches: the ``most`` largest sums of 1 / (k + rank) for each query, ties by the first rank, then keys, with rank from 1.

    Only ``depth`` = k + 2 * most places of either list are looked at: a passage in neither has at most 2 / (k + depth + 1), less than
    the 1 / (k + most) that the first ``most`` of a list have. For one that stands in a single list, the exact
    rank in the other matters only if its bound reaches the ``most``-th largest sum that is certain; those few are counted, not sorted.
    """
    work = Scratch(first[0].sparkSession, "fused")
    depth = k + 2 * most
    lists = [work.save(best_passages(p, keys, query, depth).select(query, *keys, F.col("rank").cast("long").alias(f"r{i}")), f"list{i}") for i, p in enumerate((first, second))]
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    seen = work.save(lists[0].join(lists[1], [query, *keys], "full"), "seen")
    certain = seen.withColumn("sure", part("r0") + part("r1"))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("sure")))
    least = certain.withColumn("n", place).where(F.col("n") == most).select(query, F.col("sure").alias("least"))
    open_ = certain.join(least, query, "left").where("r0 is null or r1 is null").where(F.col("sure") + 1.0 / (k + depth + 1) >= F.coalesce("least", F.lit(0.0)))
    open_ = work.save(open_.select(query, *keys, F.col("r0").isNull().alias("lacks_first")), "open")
    ranks = [ranks_of(p, keys, query, open_.where(F.col("lacks_first") == (i == 0))).withColumnRenamed("rank", f"x{i}") for i, p in enumerate((first, second))]
    full = seen.join(ranks[0], [query, *keys], "left").join(ranks[1], [query, *keys], "left")
    full = full.withColumns({f"r{i}": F.coalesce(f"r{i}", f"x{i}") for i in (0, 1)}).withColumn("score", F.round(part("r0") + part("r1"), 9))
    w = Window.partitionBy(query).orderBy(F.desc("score"), F.asc_nulls_last("r0"), *keys)
    return full.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(query, *keys, "score", "rank")
