"""Ranking passages for queries: TF-IDF, BM25, reciprocal rank fusion. Terms are rows, so a hot term is a skewed join key that AQE can split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..plans.scratch import Scratch

#: A numeric sign that keeps sums alike in any order.
DIGITS = 6
#: Distinct query terms up to which they are broadcast.
FEW_TERMS = 200_000


def term_counts(df: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """Rows (keys, term, tf)."""
    return df.select(*keys, F.explode(tokens).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(passages: DataFrame, queries: DataFrame, passage: list[str], query: str, scope: list[str] | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Scores of (query, passage) pairs that share a term. passages: (passage keys, text); queries: (query, text).

    Numbers of passages, document frequencies and mean lengths are taken within ``scope`` (columns of both
    sides: one document, as a retriever per document does) or over the whole table if it is empty. A term
    that repeats in the query counts each time.
    """
    scope = scope or []
    keys = list(dict.fromkeys([*scope, *passage]))
    q = term_counts(queries, [*scope, query], T.content_words(F.col("text"))).withColumnRenamed("tf", "times")
    tokens = passages.select(*keys, T.content_words(F.col("text")).alias("w"))
    lengths = tokens.groupBy(*keys).agg(F.sum(F.size("w")).alias("len"))
    # Only terms that a query has matter from here on; a small set of them filters the passages before their terms are shuffled.
    asked = q.select(*scope, "term").distinct()
    terms = tokens.select(*keys, F.explode("w").alias("term"))
    if not scope:
        asked = Scratch(passages.sparkSession, "bm25").save(asked, "asked")
        terms = terms.join(F.broadcast(asked) if asked.count() <= FEW_TERMS else asked, "term", "left_semi")
    tf = terms.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    stats = lengths.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_passages"), F.avg("len").alias("mean_len"))
    df = tf.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))
    rows = q.join(df, [*scope, "term"]).join(tf, [*scope, "term"]).join(lengths, keys)
    rows = rows.join(stats, scope) if scope else rows.crossJoin(F.broadcast(stats))  # without a scope, stats is one row
    idf = F.log((F.col("n_passages") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean_len")))
    return rows.groupBy(*scope, query, *[p for p in passage if p not in scope]).agg(F.round(F.sum(F.col("times") * idf * gain), DIGITS).alias("score"))


def _ranked_in_row(k1: float, b: float):
    def some(question: pa.Array, passages: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sides = [question.flatten(), passages.flatten().flatten()]
        coded = pa.concat_arrays(sides).dictionary_encode()
        code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
        count = lambda x: pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        n, size = count(passages), count(passages.flatten())
        doc, at = np.repeat(np.arange(len(n)), n), len(sides[0])
        mean = np.bincount(doc, size, len(n)) / np.maximum(n, 1)
        asked, times = np.unique(np.repeat(np.arange(len(n)), count(question)) * words + code[:at], return_counts=True)
        owner = np.repeat(np.arange(len(size)), size)
        # Only the terms of a document's own question matter from here on.
        key = doc[owner] * words + code[at:]
        place = np.searchsorted(asked, key)
        hit = np.append(asked, -1)[place] == key
        cell, tf = np.unique(owner[hit] * max(1, len(asked)) + place[hit], return_counts=True)
        row, col = cell // max(1, len(asked)), cell % max(1, len(asked))
        df = np.bincount(col, minlength=len(asked))[col]
        idf = np.log((n[doc[row]] - df + 0.5) / (df + 0.5) + 1.0)
        gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[row] / mean[doc[row]]))
        found = np.unique(row)
        return doc[found], found - (np.cumsum(n) - n)[doc[found]], np.bincount(row, times[col] * idf * gain, len(size))[found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            question, passages = (pc.struct_field(batch.column("doc"), f) for f in ("question", "passages"))
            doc, number, score = some(question, passages)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(score)], ["doc_id", "chunk_idx", "score"])

    return run


def bm25_in_rows(docs: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``bm25`` within each document, its passages being in its row: (doc_id, doc: struct of question, an array of tokens, and passages, an array of such arrays) to (doc_id, chunk_idx, score) of passages that share a term with the question. Nothing is shuffled."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "doc").mapInArrow(_ranked_in_row(k1, b), "doc_id long, chunk_idx int, score double")
    return rows.withColumn("score", F.round("score", DIGITS))


def tfidf(df: DataFrame, keys: list[str], tokens: Column, scope: list[str] | None = None, sublinear: bool = True, max_share: float = 1.0) -> DataFrame:
    """Rows (keys, term, w): smoothed idf, L2-normalised by key; terms in over ``max_share`` of a scope's keys are left out."""
    scope = scope or []
    tf = term_counts(df, keys, tokens)
    n = df.select(*keys).distinct().groupBy(*scope).agg(F.count(F.lit(1)).alias("n_keys"))
    seen = tf.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))
    seen = seen.join(n, scope) if scope else seen.crossJoin(F.broadcast(n))  # without a scope, n is one row
    seen = seen.where(F.col("df") <= max_share * F.col("n_keys"))
    idf = F.log((1 + F.col("n_keys")) / (1 + F.col("df"))) + 1
    weight = (1 + F.log("tf") if sublinear else F.col("tf")) * idf
    rows = tf.join(seen, [*scope, "term"]).select(*keys, "term", weight.alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") ** 2).over(Window.partitionBy(*keys)))
    return rows.select(*keys, "term", (F.col("raw") / norm).alias("w"))


def tfidf_model(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """The fitted part of a TF-IDF model as a table to save and load again: (term, df, n_keys, idf)."""
    tf = term_counts(df, [key], tokens)
    n = df.select(F.count_distinct(key).alias("n_keys"))
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).withColumn("idf", F.log((1 + F.col("n_keys")) / (1 + F.col("df"))) + 1)


def cosine(passages: DataFrame, queries: DataFrame, passage: list[str], query: list[str], scope: list[str] | None = None) -> DataFrame:
    """Cosines of term rows (keys, term, w) on both sides, pairs that share a term."""
    scope = scope or []
    both = queries.withColumnRenamed("w", "v").join(passages, [*scope, "term"])
    return both.groupBy(*scope, *query, *[p for p in passage if p not in scope]).agg(F.round(F.sum(F.col("w") * F.col("v")), DIGITS).alias("score"))


def top_k(scores: DataFrame, by: list[str], k: int, ties: list[str]) -> DataFrame:
    """The k best of each group with rank from 1; ties by the given columns. For a small k: Spark cuts each task's rows to k before it shuffles them."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), *ties)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rank_fusion(first: DataFrame, second: DataFrame, by: list[str], item: list[str], most: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two rankings (by, item, rank): the ``most`` largest sums of 1 / (k + rank); ties in the order of the first ranking."""
    part = lambda df, no: df.select(*by, *item, (1.0 / (k + F.col("rank"))).alias("part"), F.when(F.lit(no == 1), F.col("rank")).alias("first_rank"))
    fused = part(first, 1).unionByName(part(second, 2)).groupBy(*by, *item).agg(F.round(F.sum("part"), 9).alias("score"), F.min("first_rank").alias("first_rank"))
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("first_rank"), *item)
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def gold_chunk(chunks: DataFrame, golds: DataFrame) -> DataFrame:
    """(example_id, gold_chunk_idx): the first chunk of an example that contains one of its gold answers, case ignored; -1 if none."""
    hit = chunks.join(golds, "example_id").where(F.lower("text").contains(F.lower("answer")) & (F.col("answer") != ""))
    found = hit.groupBy("example_id").agg(F.min("chunk_idx").alias("gold_chunk_idx"))
    return golds.select("example_id").distinct().join(found, "example_id", "left").select("example_id", F.coalesce("gold_chunk_idx", F.lit(-1)).alias("gold_chunk_idx"))


def recall_report(df: DataFrame, group: str = "source", short: int = 6) -> DataFrame:
    """Recall at 1, 3 and 5 over answerable examples with a known gold chunk: rows (grp, n, recall_1, recall_3, recall_5, miss_1) for all, each group, and short and long questions."""
    known = df.where("is_answerable and gold_chunk_idx >= 0")
    hit = lambda k: F.avg(F.array_contains(F.slice("retrieved", 1, k), F.col("gold_chunk_idx")).cast("double"))
    side = F.when(T.word_count(F.col("question")) <= short, "short question").otherwise("long question")
    rows = known.withColumn("grp", F.explode(F.array(F.lit("all"), F.concat(F.lit("source "), group), side)))
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *[F.round(hit(k), DIGITS).alias(f"recall_{k}") for k in (1, 3, 5)], F.round(1 - hit(1), DIGITS).alias("miss_1"))
