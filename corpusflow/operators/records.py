"""QA records from the shapes of public collections, builders of whole training sets, plug points."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from . import align, chunks

FIELDS = ["question", "context", "answer_text", "answer_start", "is_answerable", "domain"]


def from_answers(df: DataFrame, domain: str | Column = "general") -> DataFrame:
    """Rows (question, context, answers: text[], answer_start[]): the first answer, none if a list is empty."""
    has = (F.size("answers.text") > 0) & (F.size("answers.answer_start") > 0)
    first = lambda c, none: F.when(has, F.get(c, F.lit(0))).otherwise(none)
    rest = [c for c in df.columns if c != "answers"]
    return df.select(*rest, first("answers.text", "").alias("answer_text"), first("answers.answer_start", -1).alias("answer_start"), F.coalesce(has, F.lit(False)).alias("is_answerable"), (F.lit(domain) if isinstance(domain, str) else domain).alias("domain"))


def from_evidence(df: DataFrame, domain: str = "general") -> DataFrame:
    """Rows (question, value, aliases, search_context[], page_context[]): the first search context, else the first page; the value, else the first alias; its first place, -1 if it has none."""
    blank = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(None))
    context = F.coalesce(blank(F.get("search_context", F.lit(0))), F.get("page_context", F.lit(0)), F.lit(""))
    answer = F.coalesce(blank(F.col("value")), F.get("aliases", F.lit(0)), F.lit(""))
    rest = [c for c in df.columns if c not in ("value", "aliases", "search_context", "page_context")]
    rows = df.select(*rest, context.alias("context"), answer.alias("answer_text"))
    at = F.when((F.col("answer_text") != "") & (F.col("context") != ""), F.instr(F.col("context"), F.col("answer_text")) - 1).otherwise(-1)
    return rows.withColumn("answer_start", at).withColumn("is_answerable", at >= 0).withColumn("domain", F.lit(domain))


def from_open_questions(df: DataFrame) -> DataFrame:
    """Rows (question, answer[]) without a context: the first answer is the context; rows that lack either are dropped."""
    rows = df.where("question <> '' and size(answer) > 0")
    rest = [c for c in df.columns if c != "answer"]
    first = F.get("answer", F.lit(0))
    return rows.select(*rest, first.alias("context"), first.alias("answer_text"), F.lit(0).alias("answer_start"), F.lit(True).alias("is_answerable"), F.lit("general").alias("domain"))


def with_defaults(df: DataFrame, source: str, key: str, domain: str = "legal") -> DataFrame:
    """Records of a small collection with defaults for what is missing, and ids made of source and key."""
    name = F.concat(F.lit(f"{source}_"), F.col(key).cast("string"))
    have = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in df.columns else F.lit(d)
    return df.select("question", "context", have("answer_text", "").alias("answer_text"), have("answer_start", -1).alias("answer_start"), have("is_answerable", False).alias("is_answerable"), F.lit(domain).alias("domain"), F.lit(source).alias("source"), name.alias("doc_id"), name.alias("question_id"), F.lit(0).alias("chunk_idx"), F.lit(1).alias("n_chunks"))


def label_names(df: DataFrame, names: DataFrame, label: str = "label") -> DataFrame:
    """``df`` with label_name: the class's name from (label, name), else the number as text."""
    n = names.select(F.col("label").alias("__l"), F.col("name").alias("__n"))
    return df.join(n, F.col(label) == F.col("__l"), "left").withColumn("label_name", F.coalesce("__n", F.col(label).cast("string"))).drop("__l", "__n")


def with_chunks(records: DataFrame, key: str, size: int = 400, overlap: int = 50) -> DataFrame:
    """Records cut into chunks of their context: each with its own text, answer place (-1 where the answer is not whole) and numbers."""
    parts = chunks.offset_chunks(records.select(key, F.col("context").alias("text")), size, overlap, (key,))
    rows = records.drop("context").join(parts, key)
    local = F.col("answer_start") - F.col("char_start")
    inside = F.col("is_answerable") & (local >= 0) & (F.col("answer_start") + F.length("answer_text") <= F.col("char_end"))
    return rows.withColumn("is_answerable", inside).withColumn("answer_start", F.when(inside, local).otherwise(-1)).withColumnRenamed("text", "context").drop("char_start", "char_end", "word_start", "word_end")


def kept_and_dropped(df: DataFrame, reasons: dict[str, Column], by: str) -> DataFrame:
    """Counts by group of what a builder keeps and drops, the first reason that holds counting: (by, reason, n)."""
    reason = F.coalesce(*[F.when(c, F.lit(k)) for k, c in reasons.items()], F.lit("kept"))
    return df.groupBy(by, reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def write_kept(df: DataFrame, reasons: dict[str, Column], by: str, groups: list[str], path: str) -> DataFrame:
    """Write the rows of ``df`` that no reason drops to ``path`` and return (by, reason, n) as ``kept_and_dropped`` gives them, for the named groups: counted in the pass that writes, by observed metrics."""
    reason = F.coalesce(*[F.when(c, F.lit(k)) for k, c in reasons.items()], F.lit("kept"))
    names = [(g, k) for g in groups for k in (*reasons, "kept")]
    counts = Observation("kept and dropped")
    seen = df.withColumn("__reason", reason).observe(counts, *[F.count_if((F.col(by) == g) & (F.col("__reason") == k)).alias(f"n{i}") for i, (g, k) in enumerate(names)])
    seen.where("__reason = 'kept'").drop("__reason").write.parquet(path)
    found = counts.get
    rows = [(g, k, found[f"n{i}"]) for i, (g, k) in enumerate(names) if found[f"n{i}"]]
    return df.sparkSession.createDataFrame(rows, f"`{by}` string, reason string, n long")


def summarisation_set(pairs: DataFrame, sentences: Callable[[Column], Column], similarity: Callable[[DataFrame], DataFrame], size: int = 350, least: float = 0.25, k: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(aligned chunks, second-pass pairs, statistics) of pairs (doc_id, text, summary): documents of 50 words and summaries of 10 or more are cut, aligned by ``similarity`` (doc_id, parts, sentences: arrays of texts) -> (doc_id, sentences, sims: by chunk its similarities to the sentences), filtered and joined again. A document is a row throughout."""
    words = lambda c: F.regexp_count(c, F.lit(r"\S+"))
    fit = pairs.where((words(F.col("text")) >= 50) & (words(F.col("summary")) >= 10))
    rows = fit.select("doc_id", chunks.chunk_texts(F.col("text"), size, 50).alias("parts"), sentences(F.col("summary")).alias("sentences"))
    aligned = align.align(similarity(rows.where("size(sentences) > 0")), least, k)
    passes = align.second_pass(aligned)
    return aligned, passes, align.alignment_stats(chunks.word_chunks(fit, size, 50), aligned, passes)


def rewritten(df: DataFrame, rewrite: Callable[[Column, Column], Column] = lambda question, span: span) -> DataFrame:
    """``df`` (question, extracted_span) with predicted_answer by a plug-in column function; the span itself by default, empty for an empty span."""
    return df.withColumn("predicted_answer", F.when(F.col("extracted_span") != "", rewrite(F.col("question"), F.col("extracted_span"))).otherwise(""))


def _unit_counts(size: int):
    def run(buckets: pa.Array) -> pa.Array:
        texts = buckets.flatten()
        owner = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False))
        n = np.bincount(owner * size + texts.flatten().to_numpy(zero_copy_only=False).astype(np.int64), minlength=len(texts) * size).astype(np.float64).reshape(len(texts), size)
        norm = np.sqrt((n * n).sum(axis=1))  # squares are whole numbers, so their order does not matter
        n /= np.where(norm > 0, norm, 1)[:, None]
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * size, pa.int32()), pa.array(n.ravel()))
        ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(buckets), 0).to_numpy(zero_copy_only=False))))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), vectors)

    return run


def hashed_vectors(texts: Column, size: int = 64) -> Column:
    """A stand-in for an encoder: of an array of texts, each one's counts of words by hash, at length one. Any column function or Arrow UDF that returns an array of vectors can take its place."""
    from ..functions import text as T

    bucket = lambda x: F.pmod(F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"), F.lit(size))
    return F.arrow_udf(_unit_counts(size), "array<array<double>>")(F.transform(texts, lambda t: F.transform(T.content_words(t), bucket)))
