"""Chunk and summary alignment, second-pass pairs, case tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

#: Tokens of the documents that a task looks at together.
TOKENS = 1 << 20


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _tokens(lists: pa.Array) -> np.ndarray:
    """Tokens in each row's arrays."""
    inner = np.concatenate(([0], np.cumsum(pc.list_value_length(lists.flatten()).to_numpy(zero_copy_only=False))))
    outer = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
    return np.diff(inner[outer.astype(np.int64)]).astype(np.int64)


def _compared(measure: str):
    """Batches of (parts, sentences), token arrays by document, to each part's similarities to the document's sentences."""

    def some(parts: pa.Array, sents: pa.Array) -> pa.Array:
        sides = [x.flatten() for x in (parts, sents)]
        sizes = [pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (parts, sents)]
        doc = [np.repeat(np.arange(len(n)), n) for n in sizes]
        coded = pa.concat_arrays([x.flatten() for x in sides]).dictionary_encode()
        code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
        owner = [np.repeat(np.arange(len(x)), pc.list_value_length(x).to_numpy(zero_copy_only=False)) for x in sides]
        at = len(owner[0])
        # A term is a word of one document; cells are terms of a part or a sentence, with their counts.
        terms, term = np.unique(np.concatenate((doc[0][owner[0]], doc[1][owner[1]])) * words + code, return_inverse=True)
        cells = [np.unique(o * max(1, len(terms)) + t, return_counts=True) for o, t in ((owner[0], term[:at]), (owner[1], term[at:]))]
        (prow, pcol, pw), (srow, scol, sw) = ((c // max(1, len(terms)), c % max(1, len(terms)), n.astype(np.float64)) for c, n in cells)
        if measure == "share":
            pw, sw = np.ones(len(pw)), np.ones(len(sw))
        else:
            pw = pw / np.sqrt(np.bincount(prow, pw * pw, len(sides[0])))[prow]
            sw = sw / np.sqrt(np.bincount(srow, sw * sw, len(sides[1])))[srow]
        first = np.cumsum(sizes[0]) - sizes[0]
        number = np.arange(len(sides[0])) - first[doc[0]]
        ends = np.concatenate(([0], np.cumsum(sizes[1][doc[0]])))
        total, both = np.zeros(ends[-1]), np.zeros(ends[-1], bool)
        by_number = np.argsort(number[prow], kind="stable")
        cuts = np.searchsorted(number[prow][by_number], np.arange(int(sizes[0].max(initial=0)) + 1))
        weight, live = np.zeros(len(terms)), np.arange(len(sides[1]))
        place = live - (np.cumsum(sizes[1]) - sizes[1])[doc[1]]
        distinct = np.maximum(np.bincount(srow, minlength=len(sides[1])), 1)
        # One part of each document at a time; documents without so many are left behind, so work grows with parts times sentences.
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            mine = by_number[a:b]
            weight[pcol[mine]] = pw[mine]
            inside = sizes[0][doc[1][srow]] > k
            srow, scol, sw = srow[inside], scol[inside], sw[inside]
            live = live[sizes[0][doc[1][live]] > k]
            at = ends[first[doc[1][live]] + k] + place[live]
            local = np.searchsorted(live, srow)
            total[at] = np.bincount(local, sw * weight[scol], len(live))
            both[at] = np.bincount(local, weight[scol] > 0, len(live)) > 0
            if measure == "share":
                total[at] /= distinct[live]
            weight[pcol[mine]] = 0
        if measure == "share":
            both[:] = True
        flat = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(total, mask=~both))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes[0]))).astype(np.int32)), flat)

    def run(parts: pa.Array, sents: pa.Array) -> pa.Array:
        out, low, held = [], 0, 0
        for i, n in enumerate((_tokens(parts) + _tokens(sents)).tolist()):
            held += n
            if held >= TOKENS or i + 1 == len(parts):
                out.append(some(parts.slice(low, i + 1 - low), sents.slice(low, i + 1 - low)))
                low, held = i + 1, 0
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.list_(pa.float64())))

    return run


def similarities(rows: DataFrame, measure: str = "cosine") -> DataFrame:
    """Documents (doc_id, sentences, part_words, sentence_words: token arrays) to (doc_id, sentences, sims): by part its similarities to the sentences, in Arrow batches.

    ``cosine``: of word counts, null where no word is shared; ``share``: the share of a sentence's distinct words that the part has, 0 without any.
    """
    return _in_batches(rows.select("doc_id", "sentences", "part_words", "sentence_words"), _compared(measure))


def _in_batches(rows: DataFrame, compared) -> DataFrame:
    """Rows (doc_id, sentences, two sides) to (doc_id, sentences, sims: what ``compared`` makes of the sides)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), compared(b.column(2), b.column(3))], ["doc_id", "sentences", "sims"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:2], StructField("sims", ArrayType(ArrayType(DoubleType())))]))


def _vector_products(parts: pa.Array, sents: pa.Array) -> pa.Array:
    def matrices(side: pa.Array) -> list[np.ndarray]:
        flat = side.flatten()
        width = len(flat.flatten()) // max(1, len(flat))
        if flat.null_count or not pc.all(pc.equal(pc.list_value_length(flat), width), min_count=0).as_py():
            raise ValueError("vectors have to be given and of one length")
        values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), width)
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(side).to_numpy(zero_copy_only=False).astype(np.int64))))
        return [values[a:b] for a, b in zip(ends, ends[1:])]

    ends, inner, found = [0], [], []
    for x, y in zip(matrices(parts), matrices(sents)):
        total = np.zeros((len(x), len(y)))
        for k in range(x.shape[1] if total.size else 0):
            total += x[:, k, None] * y[None, :, k]
        ends.append(ends[-1] + len(x))
        inner += [len(y)] * len(x)
        found.append((np.floor(total * 1e12 + 0.5) / 1e12).ravel())
    flat = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(inner))).astype(np.int32)), pa.array(np.concatenate((np.zeros(0), *found))))
    return pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), flat)


def vector_similarities(rows: DataFrame) -> DataFrame:
    """Documents (doc_id, sentences, part_vectors, sentence_vectors: arrays of vectors) to (doc_id, sentences, sims): by part its inner products with the sentences, to twelve decimals, in Arrow batches: summed from the first component on and rounded by floor, so that any engine gives the same doubles and breaks ties alike."""
    return _in_batches(rows.select("doc_id", "sentences", "part_vectors", "sentence_vectors"), _vector_products)


def align(rows: DataFrame, least: float = 0.25, k: int = 3) -> DataFrame:
    """Documents (doc_id, sentences, sims: by chunk the similarity to each sentence, null for none) to (doc_id, chunk_i, target, score): a chunk's k best sentences in text order; chunks whose best is under ``least`` are dropped. Ties go to the earlier sentence. Nothing is shuffled."""
    sims = rows.select("doc_id", "sentences", F.posexplode("sims").alias("chunk_i", "sim"))
    placed = F.filter(F.transform("sim", lambda x, i: F.struct((-x).alias("far"), i.alias("i"))), lambda x: x["far"].isNotNull())
    best = sims.select("doc_id", "chunk_i", "sentences", F.slice(F.array_sort(placed), 1, k).alias("best"))
    best = best.withColumn("top", -F.get("best", F.lit(0))["far"]).where(F.col("top") >= least)
    target = F.array_join(F.transform(F.array_sort(F.transform("best", lambda x: x["i"])), lambda i: F.get("sentences", i)), " ")
    # Rounded as SQL rounds doubles: Spark's own goes by their decimal digits, which takes another side of some halves.
    return best.select("doc_id", "chunk_i", target.alias("target"), (F.floor(F.col("top") * 10000 + 0.5) / 10000).alias("score"))


def second_pass(aligned: DataFrame, key: str = "doc_id", least: int = 2, least_words: int = 0) -> DataFrame:
    """(key, input): the targets of a document's chunks in order, for documents with ``least`` aligned chunks and ``least_words`` words."""
    rows = aligned.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("chunk_i", "target"))).alias("t"))
    rows = rows.where(F.col("n") >= least).select(key, F.array_join(F.transform("t", lambda x: x["target"]), " ").alias("input"))
    return rows.where(F.regexp_count("input", F.lit(r"\S+")) >= least_words)


def alignment_stats(chunks: DataFrame, aligned: DataFrame, passes: DataFrame) -> DataFrame:
    """One row: papers, chunks, aligned, filtered, coverage in percent (one decimal), second-pass pairs."""
    c = chunks.agg(F.count_distinct("doc_id").alias("papers"), F.count(F.lit(1)).alias("chunks"))
    a = aligned.agg(F.count(F.lit(1)).alias("aligned"))
    p = passes.agg(F.count(F.lit(1)).alias("second_pass"))
    one = c.crossJoin(a).crossJoin(p)  # three tables of one row
    return one.select("papers", "chunks", "aligned", (F.col("chunks") - F.col("aligned")).alias("filtered"), F.round(100.0 * F.col("aligned") / F.greatest("chunks", F.lit(1)), 1).alias("coverage"), "second_pass")


def first_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def case_texts(cases: DataFrame, texts: DataFrame) -> DataFrame:
    """Cases (case_id, case_documents: array) with the texts found: (case_id, pos, doc_id, text)."""
    return cases.select("case_id", F.posexplode("case_documents").alias("pos", "doc_id")).join(texts, "doc_id")


def longest_text(found: DataFrame) -> DataFrame:
    """The longest text of each case, the first of equals."""
    w = Window.partitionBy("case_id").orderBy(F.desc(F.length("text")), "pos")
    return found.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def leaked(train: DataFrame, validation: DataFrame, key: str) -> DataFrame:
    """One row: keys in train, in validation, in both, and whether the split is disjoint."""
    t, v = train.select(key).distinct(), validation.select(key).distinct()
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    one = count(t, "n_train").crossJoin(count(v, "n_validation")).crossJoin(count(t.join(v, key, "left_semi"), "n_both"))  # three tables of one row
    return one.withColumn("disjoint", F.col("n_both") == 0)
