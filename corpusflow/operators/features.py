"""Tokens to vocabularies, ids and model features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Reserved ids.
PAD, START, END, UNKNOWN, DOMAIN = 0, 1, 2, 3, 4


def vocabulary(tokens: DataFrame, size: int = 32000, least: int = 2, reserved: int = 5) -> DataFrame:
    """Rows (token, n, id): the ``size`` commonest tokens of frequency ``least`` and more, ties by token; ids follow the reserved ones."""
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    top = counts.orderBy(F.desc("n"), "token").limit(size)
    return top.withColumn("id", (F.row_number().over(Window.orderBy(F.desc("n"), "token")) + reserved - 1).cast("int"))


def encode(tokens: DataFrame, vocab: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, pos, token) -> (keys, ids): ids in order of pos, unknown tokens as ``UNKNOWN``."""
    ids = tokens.join(vocab.select("token", "id"), "token", "left").select(*keys, "pos", F.coalesce("id", F.lit(UNKNOWN)).alias("id"))
    return ids.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))


def encode_pair(source: Column, target: Column, most_source: int = 400, most_target: int = 128) -> list[Column]:
    """Source ids cut to length, target ids between start and end, and both lengths."""
    src = F.slice(source, 1, most_source)
    tgt = F.concat(F.array(F.lit(START)), F.slice(target, 1, most_target - 2), F.array(F.lit(END)))
    return [src.alias("source_ids"), tgt.alias("target_ids"), F.size(src).alias("source_length"), F.size(tgt).alias("target_length")]


def with_domain_marker(ids: Column, source: Column, marked: list[str], most: int = 400) -> Column:
    """Ids cut to most - 1, the domain marker put before those of marked sources, then cut to most."""
    cut = F.slice(ids, 1, most - 1)
    return F.slice(F.when(source.isin(marked), F.concat(F.array(F.lit(DOMAIN)), cut)).otherwise(cut), 1, most)


def padded(ids: Column, length: Column) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(PAD), F.greatest(length - F.size(ids), F.lit(0))))


def pad_batches(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """``df`` (batch, source_ids, target_ids) with ids padded to the batch's longest and the target shifted: target_in, target_out."""
    w = Window.partitionBy(batch)
    longest = lambda c: F.max(F.size(c)).over(w)
    rows = df.withColumn("source_longest", longest("source_ids")).withColumn("target_longest", longest("target_ids"))
    target = padded(F.col("target_ids"), F.col("target_longest"))
    rows = rows.withColumn("source_ids", padded(F.col("source_ids"), F.col("source_longest")))
    rows = rows.withColumn("target_in", F.slice(target, F.lit(1), F.col("target_longest") - 1)).withColumn("target_out", F.slice(target, F.lit(2), F.col("target_longest") - 1))
    return rows.drop("source_longest", "target_longest", "target_ids")


def qa_features(df: DataFrame, question_most: int = 60, context_most: int = 400, length: int = 462, cls: int = 101, sep: int = 102) -> DataFrame:
    """``df`` (question_ids, context_ids, starts and ends of context tokens in characters, answer_start, answer) to fixed-length features.

    input_ids: cls, question, sep, context, padding; segment 0 up to the separator, then 1, padding included;
    attention 1 on tokens. The answer's token span is that of the tokens its characters touch; kept is false
    if it is cut off. Unanswerable rows (answer_start < 0) point at position 0.
    """
    q, c = F.slice("question_ids", 1, question_most), F.slice("context_ids", 1, context_most)
    head = F.concat(F.array(F.lit(cls)), q, F.array(F.lit(sep)))
    rows = df.withColumn("head", head).withColumn("body", F.concat("head", c))
    end = F.col("answer_start") + F.length("answer")
    touched = F.filter(F.sequence(F.lit(0), F.size("context_ids") - 1), lambda i: (F.get("starts", i) < end) & (F.get("ends", i) > F.col("answer_start")))
    rows = rows.withColumn("touched", F.when(F.col("answer_start") >= 0, touched).otherwise(F.array().cast("array<int>")))
    first, last = F.get("touched", F.lit(0)), F.element_at("touched", -1)
    inside = (F.size("touched") > 0) & (last < context_most)
    place = lambda x: F.when(F.col("answer_start") < 0, 0).when(inside, x + F.size("head"))
    return rows.select(
        "*",
        padded(F.col("body"), F.lit(length)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(0), F.size("head")), F.array_repeat(F.lit(1), length - F.size("head"))).alias("segment_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("body")), F.array_repeat(F.lit(0), length - F.size("body"))).alias("attention_mask"),
        place(F.when(F.size("touched") > 0, first)).alias("answer_start_tok"),
        place(F.when(F.size("touched") > 0, last)).alias("answer_end_tok"),
        ((F.col("answer_start") < 0) | inside).alias("kept"),
    ).drop("head", "body", "touched")


def shuffled_sentences(sentences: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Sentences (doc_id, sent_idx, sentence) with a new order for a seeded share of documents of three sentences and more: adds new_idx."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    gate = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "doc_id")), 1, 6), 16, 10).cast("long") < int(share * 16**6)
    key = F.when((n >= 3) & gate, F.md5(F.concat_ws(":", F.lit(seed), "doc_id", "sent_idx"))).otherwise(F.lpad(F.col("sent_idx").cast("string"), 12, "0"))
    return sentences.withColumn("key", key).withColumn("new_idx", (F.row_number().over(Window.partitionBy("doc_id").orderBy("key")) - 1).cast("int")).drop("key")
