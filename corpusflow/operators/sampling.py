"""Seeded sampling, mixing into batches, negatives. Order is by md5 of seed and key, so it is the same everywhere."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..plans.ranks import with_group_ranks, with_row_numbers
from ..plans.scratch import Scratch


def seeded(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *keys))


def first_n(df: DataFrame, n: int, seed: int, key: str, by: list[str] | None = None) -> DataFrame:
    """n seeded rows, of each group if ``by`` names its columns."""
    if not by:
        return df.orderBy(seeded(seed, key), key).limit(n)
    w = Window.partitionBy(*by).orderBy(seeded(seed, key), key)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def quota_rows(df: DataFrame, quotas: Mapping[str, int], group: str, key: str) -> DataFrame:
    """The first rows by key of each group, as many as its quota; groups without one are left out. Parts of a group are cut to the largest quota first, before and after their shuffle, so that no task holds a group."""
    w, part = Window.partitionBy(group).orderBy(key), Window.partitionBy(group, "__part").orderBy(key)
    df = df.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(64))).withColumn("__n", F.row_number().over(part)).where(F.col("__n") <= max(quotas.values(), default=0)).drop("__part")
    limit = F.create_map(*[x for g, n in quotas.items() for x in (F.lit(g), F.lit(n))])
    return df.where(F.col(group).isin(list(quotas))).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit[F.col(group)]).drop("__n")


def batch_counts(mix: Mapping[str, float], batch_size: int) -> dict[str, int]:
    """Rows of each source in a batch: rounded shares, one at least, what is missing or over going to the largest share (the first of equals)."""
    if abs(sum(mix.values()) - 1) > 1e-6:
        raise ValueError(f"shares sum to {sum(mix.values())}, not 1")
    counts = {k: max(1, round(batch_size * share)) for k, share in mix.items()}
    counts[max(mix, key=lambda k: mix[k])] += batch_size - sum(counts.values())
    return counts


def resolve_mix(mix: Mapping[str, float], sizes: Mapping[str, int]) -> dict[str, float]:
    """Shares of sources that have rows, summing to 1."""
    held = {k: share for k, share in mix.items() if sizes.get(k, 0) > 0}
    return {k: share / sum(held.values()) for k, share in held.items()}


def mixed_batches(df: DataFrame, counts: Mapping[str, int], source: str, key: str, seed: int, n_batches: int | None = None, length: str = "min") -> DataFrame:
    """Rows (batch_id, pos, source, key): each batch holds counts[s] rows of source s.

    The number of batches, if not given: with ``min`` the least over sources of size // count, one at
    least; with ``majority`` the largest source's size // the largest count. A source that runs out starts
    again. An empty source is an error. Places in a pool are numbered per source by range, then copies are made only
    for batches that are asked for.
    """
    sizes = {r[source]: r["n"] for r in df.where(F.col(source).isin(list(counts))).groupBy(source).agg(F.count(F.lit(1)).alias("n")).collect()}
    if missing := [k for k in counts if not sizes.get(k)]:
        raise ValueError(f"no rows of {missing}")
    if n_batches is None:
        n_batches = max(1, min(sizes[k] // max(1, n) for k, n in counts.items())) if length == "min" else max(sizes.values()) // max(counts.values())
    of = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])[F.col(source)]
    rows = df.where(F.col(source).isin(list(counts))).select(F.col(source), F.col(key), seeded(seed, key).alias("__order"))
    rows = with_group_ranks(rows, [source], ["__order", key], "at").withColumn("at", F.col("at") - 1).withColumn("size", of(sizes)).withColumn("count", of(counts))
    wanted = F.col("count") * n_batches
    rows = rows.where(F.col("at") < wanted).withColumn("slot", F.explode(F.sequence(F.col("at"), wanted - 1, F.col("size"))))
    starts = dict(zip(counts, [sum(list(counts.values())[:i]) for i in range(len(counts))], strict=True))
    batch = F.floor(F.col("slot") / F.col("count")).cast("long")
    return rows.select(batch.alias("batch_id"), (F.pmod(F.col("slot"), F.col("count")) + of(starts)).alias("pos"), F.col(source).alias("source"), F.col(key).alias("key"))


def other_document(df: DataFrame, doc: str, seed: int) -> DataFrame:
    """Each document with another: (doc, other_doc). Documents stand in a seeded ring and take the one a seeded number of places on; alone, they have none."""
    docs = df.select(doc).distinct().withColumn("__order", seeded(seed, doc))
    ring = with_row_numbers(docs, ["__order", doc], "at").select(doc, F.col("at").cast("long").alias("at"))
    ring = Scratch(df.sparkSession, "ring").save(ring, "ring")
    ring = ring.crossJoin(F.broadcast(ring.agg(F.count(F.lit(1)).alias("total"))))  # a table of one row
    step = 1 + F.pmod(T.seeded_number(seed, F.lit("step"), doc), F.col("total") - 1)
    picks = ring.where("total > 1").withColumn("to", F.pmod(F.col("at") + step, F.col("total")))
    return picks.select(doc, "to").join(ring.select(F.col("at").alias("to"), F.col(doc).alias("other_doc")), "to").drop("to")


def _first_by(rows: DataFrame, order: str, ties: str, most: int) -> DataFrame:
    """The first ``most`` of saved rows by order, then ties: only the orders are numbered, and of the rows those at the edge, so the others are not moved."""
    edge = with_row_numbers(rows.select(order), [order], "__n").where(F.col("__n") == most).first()
    if edge is None:
        return rows
    sure, tied = rows.where(F.col(order) < edge[order]), rows.where(F.col(order) == edge[order])
    return sure.union(with_row_numbers(tied, [order, ties], "__n").where(F.col("__n") < most - sure.count()).drop("__n"))


def clause_negatives(pool: DataFrame, seed: int = 42, share: float = 45 / 55) -> DataFrame:
    """Positives (doc_id, clause, question, context) and two kinds of negatives, these capped at round(positives * share): rows (question, context, doc_id, clause, neg_kind, is_answerable).

    cross_document: a seeded context of another document; wrong_clause: a seeded context of another clause of the same document.
    """
    pool = pool.select("doc_id", "clause", "question", "context")
    # One place per context and per clause in its document's seeded order: a pick is an equi join on a place, no pairs are made.
    by_doc = Window.partitionBy("doc_id")
    places = pool.withColumn("at", F.row_number().over(by_doc.orderBy(seeded(seed, "doc_id", "clause", "context"))) - 1).withColumn("size", F.count(F.lit(1)).over(by_doc))
    contexts = places.select(F.col("doc_id").alias("other_doc"), F.col("at").alias("to"), F.col("context").alias("neg_context"))
    sizes = places.groupBy(F.col("doc_id").alias("other_doc")).agg(F.count(F.lit(1)).alias("n"))
    cross = pool.join(other_document(pool, "doc_id", seed), "doc_id").join(sizes, "other_doc").withColumn("to", F.pmod(T.seeded_number(seed, "doc_id", "clause"), F.col("n")))
    cross = cross.join(contexts.withColumn("to", F.col("to").cast("long")), ["other_doc", "to"]).withColumn("neg_kind", F.lit("cross_document"))
    clauses = pool.groupBy("doc_id", "clause").agg(F.min_by("context", seeded(seed, "doc_id", "clause", "context")).alias("neg_context"))
    clauses = clauses.withColumn("at", F.row_number().over(by_doc.orderBy(seeded(seed, "doc_id", "clause"), "clause")) - 1).withColumn("n", F.count(F.lit(1)).over(by_doc))
    ring = clauses.where("n > 1").select("doc_id", "clause", F.pmod(F.col("at") + 1, F.col("n")).alias("at"))
    wrong = pool.join(ring, ["doc_id", "clause"]).join(clauses.select("doc_id", F.col("at").cast("long").alias("at"), "neg_context"), ["doc_id", "at"]).withColumn("neg_kind", F.lit("wrong_clause"))
    negatives = cross.select("doc_id", "clause", "question", "neg_context", "neg_kind").union(wrong.select("doc_id", "clause", "question", "neg_context", "neg_kind"))
    most = round(pool.count() * share)
    negatives = negatives.withColumn("__order", seeded(seed, "doc_id", "clause", "neg_kind", "question"))
    negatives = _first_by(Scratch(pool.sparkSession, "negatives").save(negatives, "all"), "__order", "neg_context", most).drop("__order")
    columns = ["doc_id", "clause", "question"]
    return pool.select(*columns, "context", F.lit(None).cast("string").alias("neg_kind"), F.lit(True).alias("is_answerable")).union(negatives.select(*columns, "neg_context", "neg_kind", F.lit(False)))


def chunk_negatives(chunks: DataFrame, positives: DataFrame, n: int = 4, seed: int = 42) -> DataFrame:
    """The positive chunk of each question and up to n seeded other chunks of its document: (question_id, doc_id, chunk_idx, is_positive)."""
    rows = positives.select("question_id", "doc_id", F.col("chunk_idx").alias("positive")).join(chunks.select("doc_id", "chunk_idx"), "doc_id")
    rows = rows.withColumn("is_positive", F.col("chunk_idx") == F.col("positive"))
    w = Window.partitionBy("question_id", "is_positive").orderBy(seeded(seed, "question_id", "chunk_idx"), "chunk_idx")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("is_positive") | (F.col("n") <= n)).select("question_id", "doc_id", "chunk_idx", "is_positive")
