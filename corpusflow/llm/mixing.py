"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ranks import with_group_ranks, with_sums_before
from ..plans.scratch import Scratch
from .quality_rules import n_words

MAX_SOURCES = 100_000
#: Words of a shard of the mix, about, and shards of a small one.
SHARD_WORDS, LEAST_SHARDS = 1 << 24, 64
#: Groups of shards that the driver splits quotas into, at most.
GROUPS = 256


def target_sizes(sizes: list[int], weights: tuple[float, ...], most: float) -> list[float]:
    """Targets of sources in their order: shares of the sum of sizes by repeating weights; none is above ``most`` times its size, what is cut off is shared anew by weight."""
    share = np.array([weights[k % len(weights)] for k in range(len(sizes))], float)
    top = most * np.array(sizes, float)
    out, free, left = np.zeros(len(sizes)), np.ones(len(sizes), bool), float(sum(sizes))
    while free.any() and left > 0:
        want = left * share / share[free].sum()
        above = free & (want > top)
        if not above.any():
            out[free] = want[free]
            break
        out[above] = top[above]
        left -= top[above].sum()
        free &= ~above
    return out.tolist()


def split_quotas(blocks: list[int], shards: int, seed: int) -> list[list[int]]:
    """Blocks of each source that each shard gets: the range of shards is halved again and again, and one half's share of every source is drawn at once."""
    out: list[list[int]] = [[] for _ in range(shards)]

    def split(lo: int, hi: int, counts: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = counts.tolist()
            return
        mid = (lo + hi) // 2
        n = int(counts.sum()) * (mid - lo) // (hi - lo)
        # Only sources with blocks take part, in draws of two kinds at a time, which have no bound on their sum.
        rng, left, part, rest = np.random.default_rng([seed, lo, hi]), n, np.zeros_like(counts), int(counts.sum())
        for k, c in enumerate(counts.tolist()):
            rest -= c
            part[k] = rng.hypergeometric(c, rest, left) if left and c and rest else min(c, left)
            left -= int(part[k])
        split(lo, mid, part)
        split(mid, hi, counts - part)

    split(0, shards, np.array(blocks, np.int64))
    return out


def _split_groups(per_group: int, seed: int):
    """Rows (grp, first, quota: arrays by source) -> (no, shard, first, n): how many of a source's copies each shard of the group gets, from which place on."""

    def run(batches):
        for batch in batches:
            for grp, first, quota in zip(*[batch.column(c).to_pylist() for c in ("grp", "first", "quota")], strict=True):
                parts = np.array(split_quotas(quota, per_group, seed + 1 + grp), np.int64).reshape(per_group, len(quota))
                start = np.array(first, np.int64) + np.cumsum(parts, axis=0) - parts
                shard, no = np.nonzero(parts)
                columns = [no.astype(np.int32), (grp * per_group + shard).astype(np.int32), start[shard, no], parts[shard, no]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["no", "shard", "first", "n"])

    return run


def _places(spark: SparkSession, copies: list[int], shards: int, seed: int) -> DataFrame:
    """(no, at, shard): the shard of each copy of a block, by its place among its source's copies. The upper half of the tree is split here, up to ``GROUPS`` groups of shards, and the rest in tasks."""
    groups = min(GROUPS, shards)
    per_group = -(-shards // groups)
    quotas = np.array(split_quotas(copies, groups, seed), np.int64).reshape(groups, len(copies))
    first = np.cumsum(quotas, axis=0) - quotas
    rows = spark.createDataFrame([(g, first[g].tolist(), quotas[g].tolist()) for g in range(groups)], "grp long, first array<long>, quota array<long>")
    parts = rows.repartition(min(groups, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(_split_groups(per_group, seed), "no int, shard int, first long, n long")
    return parts.select("no", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("at"))


def _filled(work: Scratch, units: DataFrame, rests: list[tuple[int, float]], seed: int) -> DataFrame:
    """What fills the rests of sources: no, block, extra (2: the whole block, 1: only ``got``), got (array of text_key); other blocks are absent.

    Each round goes on behind the block in which the one before ended, with the room left, so every block is settled
    at most once and the rounds end. Only per-source rows reach the driver.
    """
    spark, rounds = work.spark, []
    units = work.save(units, "units")
    order = F.xxhash64(F.lit(seed), F.lit("block"), "no", "block")
    fold = F.expr("aggregate(docs, struct(room as room, cast(array() as array<bigint>) as got), (a, d) -> if(d.size <= a.room, struct(a.room - d.size as room, array_append(a.got, d.text_key) as got), a))")
    state = [(no, rest, -(1 << 63), -1) for no, rest in rests]
    while state or not rounds:
        now = F.broadcast(spark.createDataFrame(state, "no int, room double, last_order long, last_block long"))
        left = units.join(now, "no").withColumn("order", order).where("order > last_order or order = last_order and block > last_block")
        fits = F.col("size") <= F.col("room")
        by = left.groupBy("no", "block", "order", "room").agg(F.sum(F.when(fits, F.col("size"))).alias("words"), F.count_if(fits).alias("n"), F.count(F.lit(1)).alias("n_all"))
        # Blocks of documents without words only come along in the first round, and whole.
        by = by.where(F.col("words") > 0 if rounds else "words > 0 or n = n_all").withColumn("words", F.coalesce("words", F.lit(0)))
        by = with_sums_before(by, ["no"], ["order", "block"], "words")
        by = by.where("before < room or before + words <= room").withColumn("edge", F.col("before") + F.col("words") > F.col("room"))
        by = work.save(by.select("no", "block", "order", (F.col("room") - F.col("before")).alias("free"), "edge", (~F.col("edge") & (F.col("n") == F.col("n_all"))).alias("all")), f"round_{len(rounds)}")
        # ``docs``: what may be taken of a block that is not taken whole, in permuted order.
        part = by.where("not all").select("no", "block", F.col("free").alias("room"))
        part = left.where(fits).drop("room").join(part, ["no", "block"]).groupBy("no", "block", "room").agg(F.sort_array(F.collect_list(F.struct("text_key", "size"))).alias("docs")).select("no", "block", fold.alias("end"))
        part = work.save(by.join(part, ["no", "block"], "left").select("no", "block", "order", "edge", F.when(F.col("all"), 2).otherwise(1).alias("extra"), F.col("end.got").alias("got"), F.col("end.room").alias("room")), f"filled_{len(rounds)}")
        rounds.append(part.where("extra = 2 or size(got) > 0").select("no", "block", "extra", "got"))
        state = [tuple(r) for r in part.where("edge and room > 0").select("no", "room", "order", "block").collect()]
    return functools.reduce(DataFrame.union, rounds)


def plan_mix(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, shards: int | None = None, block_docs: int = 256, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, source, text_key, size, source_size, target, draws (array of epoch, shard), taken.

    Sources in code-point order, null last, have the repeating weights. A source with target t and
    size s is drawn whole floor(t / s) times; the rest of t comes from permuted blocks of its documents:
    documents longer than the room left are set aside, blocks whose others fit are taken, the next one is filled
    document by document, and the room that it leaves goes on to the blocks after it in the same way, until no
    document with words behind it fits. Block copies go to shards by exact quotas
    from ``split_quotas``; unless given, there is a shard for each ``SHARD_WORDS`` words, and ``LEAST_SHARDS`` at least. Documents without words take part with size 0. Documents are told apart by
    doc_id and text: rows equal in both share one fate. Only per-source rows reach the driver,
    ``MAX_SOURCES`` at most (more raise an error).
    """
    work = Scratch(spark, "mixing")
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    sized = work.save(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("text_key")), "sized")
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    targets = target_sizes([r["size"] for r in found], weights, most)
    plan = []
    for no, (r, t) in enumerate(zip(found, targets, strict=True)):
        whole = min(most, int(t // r["size"])) if r["size"] else 0
        plan.append((r["source"], no, int(r["size"]), float(t), whole, float(t - whole * r["size"]), -(-r["n"] // block_docs)))
    schema = T.StructType.fromDDL("source string, no int, source_size long, target double, whole int, rest double, n_blocks long")
    plan_df = F.broadcast(spark.createDataFrame(plan, schema))
    rows = sized.withColumnRenamed("source", "s").join(plan_df, F.col("s").eqNullSafe(F.col("source")))
    rows = rows.select("doc_id", F.col("s").alias("source"), "text_key", "size", "no", "source_size", "target", "whole", "rest", F.expr("pmod(xxhash64(text_key), n_blocks)").alias("block"))
    rows = work.save(rows, "rows")

    rests = [(no, rest) for _, no, _, _, _, rest, _ in plan]
    extras = _filled(work, rows.groupBy("no", "block", "text_key").agg(F.sum("size").alias("size")), rests, seed)
    blocks = rows.groupBy("no", "block").agg(F.first("whole").alias("whole")).join(extras, ["no", "block"], "left")
    blocks = work.save(blocks.withColumn("extra", F.coalesce("extra", F.lit(0))), "blocks")

    drawn = {r["no"]: r["n"] for r in blocks.groupBy("no").agg(F.sum(F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0)).alias("n")).collect()}
    if shards is None:
        shards = max(LEAST_SHARDS, int(sum(t for *_, t, _, _, _ in plan) // SHARD_WORDS) + 1)
    places = _places(spark, [int(drawn.get(no, 0)) for no in range(len(plan))], shards, seed)
    copies = blocks.select("no", "block", F.explode(F.expr("sequence(0, whole)")).alias("epoch"), "whole", "extra").where("epoch < whole or extra > 0")
    copies = copies.select("no", "block", "epoch", F.xxhash64(F.lit(seed), "no", "epoch", "block").alias("order"))
    copies = with_group_ranks(copies, ["no"], ["epoch", "order", "block"], "at").withColumn("at", (F.col("at") - 1).cast("long"))
    copies = copies.join(places, ["no", "at"]).select("no", "block", F.struct("epoch", "shard").alias("draw"))
    draws = copies.groupBy("no", "block").agg(F.sort_array(F.collect_list("draw")).alias("draws"))

    out = rows.join(blocks.select("no", "block", "extra", "got").join(draws, ["no", "block"], "left"), ["no", "block"])
    own = F.expr("filter(coalesce(draws, cast(array() as array<struct<epoch:int,shard:int>>)), d -> d.epoch < whole or extra = 2 or (extra = 1 and array_contains(got, text_key)))")
    out = out.withColumn("draws", own)
    return out.select("doc_id", "source", "text_key", "size", "source_size", "target", "draws", (F.col("size") * F.size("draws")).alias("taken"))


def mixed_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is drawn, by shard and shuffled within it; columns of ``docs`` and shard.

    Documents that are never drawn are absent. Rows with equal doc_id and text are drawn alike.
    """
    seed = options.get("seed", 7)
    own = F.xxhash64(F.lit("id"), F.col("doc_id")).alias("__id")
    plan = plan_mix(spark, docs, **options).where("size(draws) > 0").select(F.col("text_key").alias("__key"), own, F.col("draws").alias("__draws")).dropDuplicates(["__key", "__id"])
    keyed = docs.select("*", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("__key"), own)
    rows = keyed.join(plan, ["__key", "__id"]).withColumn("__draw", F.explode("__draws"))
    shard, order = F.col("__draw.shard").alias("shard"), F.xxhash64(F.lit(seed), F.lit("row"), "__draw.epoch", "__key")
    rows = rows.select(*[F.col(f"`{c}`") for c in docs.columns if c != "shard"], shard, order.alias("__order"))
    return rows.repartition("shard").sortWithinPartitions("shard", "__order").drop("__order")
