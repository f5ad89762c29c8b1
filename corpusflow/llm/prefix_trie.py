"""Conversation prefix trie: nodes by prefix hashes, an Euler tour of enter and exit arcs, distributed list ranking, subtree sums from prefix sums at arc positions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ranks import with_group_ranks, with_row_numbers, with_sums_before
from ..plans.scratch import Scratch
from .periodic_runs import crc32_ctes, crc32_sql

#: A list is contracted until so few elements are left that one task ranks them.
FEW = 1 << 14
#: Conversations come in families of so many; a conversation opens with up to three turns of its family's first.
FAMILY = 20


def list_ranks(spark: SparkSession, links: DataFrame, work: Scratch, few: int = FEW) -> DataFrame:
    """(x, at): the place, from 0, of each element of the list that ``links`` (x, nxt: the next element, null for the last) forms.

    In each round an element of a fair coin's one side takes over its successor if that one shows the other side, so
    about a quarter of the elements leave, none of them neighbours; the distance to the successor is kept. When few are left one
    task ranks them, and rounds are undone in turn: who left stands its distance behind who took it over. Work is in proportion to the
    list; each round is one join and one written table. Coins are hashes, so a lost task tosses them alike.
    """
    alive = work.save(links.select("x", "nxt", F.lit(1).cast("long").alias("step")), "list0")
    k, rounds = 0, []
    while alive.count() > few:
        heads = lambda c, k=k: F.xxhash64(c, F.lit(k)).bitwiseAND(F.lit(1)) == 0
        asks = F.coalesce(heads(F.col("x")) & ~heads(F.col("nxt")) & F.col("nxt").isNotNull(), F.lit(False))
        messages = alive.where(asks).select(F.col("nxt").alias("to"), F.col("x").alias("taker"), F.col("step").alias("off"))
        asked = alive.where(~heads(F.col("x"))).join(messages, F.col("x") == F.col("to"), "left").drop("to")
        rest = alive.where(heads(F.col("x")) & ~asks).withColumns({"taker": F.lit(None).cast("long"), "off": F.lit(None).cast("long")})
        done = work.save(asked.unionByName(rest), f"round{k}")
        rounds.append(done.where("taker is not null").select("x", "taker", "off"))
        alive = done.select(F.coalesce("taker", "x").alias("x"), "nxt", (F.col("step") + F.coalesce("off", F.lit(0))).alias("step"))
        k += 1
    at = work.save(alive.repartition(1).mapInArrow(_ranked, "x long, at long"), "ranked")
    for k in reversed(range(len(rounds))):
        back = rounds[k].join(at.withColumnRenamed("x", "taker"), "taker").select("x", (F.col("at") + F.col("off")).alias("at"))
        at = work.save(at.union(back), f"undone{k}")
    return at


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places in a list of bounded length."""
    after: dict[int, tuple[int | None, int]] = {}
    for b in batches:
        x, nxt, step = (c.to_pylist() for c in b.columns)
        after.update(zip(x, zip(nxt, step)))
    reached = {n for n, _ in after.values()}
    x = next((v for v in after if v not in reached), None)
    xs, places, at = [], [], 0
    while x is not None:
        xs.append(x)
        places.append(at)
        x, step = after[x]
        at += step
    yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(places, pa.int64())], ["x", "at"])


def subtree_sums(spark: SparkSession, nodes: DataFrame, values: list[str], work: Scratch, few: int = FEW) -> DataFrame:
    """(no, *values): sums of each of ``values`` over a node's subtree, the node included, by an Euler tour.

    ``nodes``: no (numbers from 0 in which the children of a node follow each other), parent_no (null for the root),
    first_child, last_child (null without children), last_of_parent, and the values. A node's arcs are enter (2 no) and exit (2 no + 1).
    """
    enter, leave = F.col("no") * 2, F.col("no") * 2 + 1
    down = F.when(F.col("first_child").isNotNull(), F.col("first_child") * 2).otherwise(leave)
    up = F.when(F.col("no") < F.col("last_of_parent"), (F.col("no") + 1) * 2).otherwise(F.col("parent_no") * 2 + 1)
    links = nodes.select(F.explode(F.array(F.struct(enter.alias("x"), down.alias("nxt")), F.struct(leave.alias("x"), up.alias("nxt")))).alias("a")).select("a.*")
    places = list_ranks(spark, links, work, few)
    weights = nodes.select(F.explode(F.array(*[F.struct(a.alias("x"), *[v.alias(n) for v, n in zip(vs, values)]) for a, vs in ((enter, [F.col(v) for v in values]), (leave, [F.lit(0).cast("long")] * len(values)))])).alias("a")).select("a.*")
    tour = with_sums_before(places.join(weights, "x"), [], ["at"], values, [f"{v}_before" for v in values])
    sign = F.when(F.col("x") % 2 == 1, 1).otherwise(-1)
    return tour.groupBy(F.floor(F.col("x") / 2).cast("long").alias("no")).agg(*[F.sum(F.col(f"{v}_before") * sign).alias(v) for v in values])


def rebuilt(turns: DataFrame, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """(c, d, n, a, b, words): each conversation's turns d = 1 to n after its opening is exchanged, a and b being hashes of role and text; and (c, n) of every conversation.

    A conversation c opens with the first h turns of c - c % 20 instead of its own first h, h being crc32 of its number modulo 4.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), "turn", F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(2), text, role).alias("b"), words.alias("words"))
    rows = work.save(with_group_ranks(rows, ["c"], ["turn", "a", "b"], "pos").drop("turn"), "turns")
    sizes = work.save(rows.groupBy("c").agg(F.count(F.lit(1)).alias("own")), "sizes")
    opening = (F.crc32(F.col("c").cast("string").cast("binary")) % 4).cast("int")
    first = sizes.select(F.col("c").alias("first"), F.col("own").alias("lent"))
    plan = sizes.select("c", "own", opening.alias("h"), (F.col("c") - F.col("c") % FAMILY).alias("first")).join(first, "first", "left")
    plan = plan.withColumn("lent", F.least("h", F.coalesce("lent", F.lit(0)))).withColumn("n", F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    plan = work.save(plan, "plan")
    opened = plan.where("lent > 0").join(rows.where("pos <= 3").withColumnRenamed("c", "first"), "first").where("pos <= lent").select("c", F.col("pos").cast("long").alias("d"), "n", "a", "b", "words")
    kept = rows.join(plan, "c").where("pos > h").select("c", (F.col("lent") + F.col("pos") - F.col("h")).alias("d"), "n", "a", "b", "words")
    return work.save(opened.unionByName(kept), "rebuilt"), plan.select("c", "n")


def prefix_trie(spark: SparkSession, turns: DataFrame, few: int = FEW) -> DataFrame:
    """One row per distinct sequence of first turns of the rebuilt conversations of ``turns`` (conv_id, turn, role, text; other columns are left out).

    conv_id: smallest member; depth; parent_conv_id; n_convs: members; n_children; n_leaves: childless nodes of the subtree; saved_tokens:
    the sum, over the subtree, of a node's (n_convs - 1) times the words of its last text; ends_sha256: digest of the ids of
    conversations that end at the node, ascending, joined by commas. Turns are ordered by turn, null first, and by hashes of role and text
    where turns share a number; null roles and texts are empty; rows without a conv_id belong to no conversation; repeated rows are
    turns of their own; an empty table has no node, not even a root. A prefix is known by sums of hashes of its turns and their places
    (two of 64 bits), which are prefix sums over ranges of rows: a conversation of any length, a turn or an end
    that many share, and a node with many children are all dealt over tasks.
    """
    work = Scratch(spark, "trie")
    rows, everyone = rebuilt(turns, work)
    low, high = lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF)), lambda v: F.shiftrightunsigned(v, 32)
    a, b = F.xxhash64("d", "a"), F.xxhash64("d", "b", F.lit(3))
    sums = ["s0", "s1", "s2", "s3"]
    rows = rows.select("c", "d", "n", "words", low(a).alias("s0"), high(a).alias("s1"), low(b).alias("s2"), high(b).alias("s3"))
    rows = with_sums_before(rows, ["c"], ["d"], sums, [f"{s}_before" for s in sums])

    def key(d: Column, parts: list[Column], k: int) -> Column:
        return F.xxhash64(d, *parts, F.lit(k))

    upto = [F.col(s) + F.col(f"{s}_before") for s in sums]
    above = [F.col(f"{s}_before") for s in sums]
    path = rows.select("c", "d", "n", "words", *[key(F.col("d"), upto, k).alias(f"k{k}") for k in (1, 2)], *[key(F.col("d") - 1, above, k).alias(f"p{k}") for k in (1, 2)])
    path = work.save(path, "path")

    root_keys = [key(F.lit(0).cast("long"), [F.lit(0).cast("long")] * 4, k) for k in (1, 2)]
    none = F.lit(None).cast("long")
    root = everyone.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(*[k.alias(f"k{i + 1}") for i, k in enumerate(root_keys)], none.alias("p1"), none.alias("p2"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words"))
    nodes = path.groupBy("k1", "k2").agg(F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("c").alias("conv_id"), F.max("d").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
    nodes = work.save(with_row_numbers(nodes.unionByName(root), ["p1", "p2", "conv_id"], "no"), "nodes")

    # Numbers of a node's children follow each other, so the first and the last tell which has a sibling after it.
    children = nodes.where("p1 is not null").groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n_children"), F.min("no").cast("long").alias("first_child"), F.max("no").cast("long").alias("last_child"))
    own = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("no").cast("long").alias("parent_no"), F.col("conv_id").alias("parent_conv_id"))
    families = work.save(children.join(own, ["p1", "p2"]), "families")
    up = families.select("p1", "p2", "parent_no", "parent_conv_id", F.col("last_child").alias("last_of_parent"))
    down = families.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children", "first_child", "last_child")
    tree = nodes.join(up, ["p1", "p2"], "left").join(down, ["k1", "k2"], "left")
    saved = ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")
    tree = work.save(tree.select("k1", "k2", F.col("no").cast("long").alias("no"), "conv_id", "depth", "n_convs", "parent_no", "parent_conv_id", "last_of_parent", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "first_child", "last_child", F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"), saved), "tree")

    below = work.save(subtree_sums(spark, tree, ["n_leaves", "saved_tokens"], work, few), "below")
    ended = path.where("d = n").select("k1", "k2", "c").union(everyone.where("n = 0").select(*root_keys, "c"))
    ends = work.save(_end_digests(ended), "ends")
    out = tree.drop("n_leaves", "saved_tokens").join(below, "no").join(ends, ["k1", "k2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def _end_digests(ended: DataFrame) -> DataFrame:
    """(k1, k2, sha): the digest of each node's ids in order. Ids are joined where ranges of (node, id) lie, and digests are fed piece by piece, so no task holds a node's ids."""
    n = int(ended.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["k1", "k2"]
    schema = "k1 long, k2 long, first long, ids string"

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            k1, k2 = (np.asarray(b.column(i)) for i in (0, 1))
            ids = b.column(2).to_pylist()
            cut = np.concatenate(([0], np.flatnonzero((np.diff(k1) != 0) | (np.diff(k2) != 0)) + 1, [b.num_rows])).tolist()
            text = [",".join(map(str, ids[i:j])) for i, j in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(k1[cut[:-1]]), pa.array(k2[cut[:-1]]), pa.array([ids[i] for i in cut[:-1]], pa.int64()), pa.array(text, pa.string())], ["k1", "k2", "first", "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, hashlib.sha256()
        row = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "sha"])
        for b in batches:
            done = []
            for x, y, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                if now != (x, y):
                    if now:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (x, y), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield row(done)
        if now:
            yield row([(*now, digest.hexdigest())])

    pieces = ended.repartitionByRange(n, *keys, "c").sortWithinPartitions(*keys, "c").mapInArrow(joined, schema)
    return pieces.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digested, "k1 long, k2 long, sha string")


SQL = rf"""
WITH {crc32_ctes()}, o AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT c, {crc32_sql('CAST(c AS VARCHAR)')} % 4 AS h FROM (SELECT DISTINCT c FROM o), crc_table
), r AS (
  SELECT ids.c, 0 AS side, pos, role, text FROM ids JOIN o ON o.c = ids.c - ids.c % 20 AND pos <= h
  UNION ALL SELECT ids.c, 1, pos, role, text FROM ids JOIN o ON o.c = ids.c AND pos > h
), p AS (
  SELECT c, row_number() OVER w AS d, text, sha256(string_agg(sha256(role) || sha256(text), '' ) OVER w) AS k FROM r WINDOW w AS (PARTITION BY c ORDER BY side, pos)
), path AS (
  SELECT c, d, text, k FROM p UNION ALL SELECT c, 0, '', '' FROM ids
), node AS (
  SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(min(text), '[^\x20\x09-\x0D]+')) AS saved FROM path GROUP BY k, d
), up AS (
  SELECT n.k, n.d, m.k AS pk FROM node n JOIN path m ON m.c = n.conv_id AND m.d = n.d - 1
), kids AS (
  SELECT pk AS k, count(*) AS n_children FROM up GROUP BY pk
), above AS (
  SELECT m.k, n.k AS low, n.saved, CASE WHEN kids.k IS NULL THEN 1 ELSE 0 END AS leaf FROM node n JOIN path m ON m.c = n.conv_id AND m.d <= n.d LEFT JOIN kids ON kids.k = n.k
), below AS (
  SELECT k, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY k
), ends AS (
  SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS sha FROM (SELECT c, k FROM path QUALIFY d = max(d) OVER (PARTITION BY c)) GROUP BY k
)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, par.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM node JOIN below ON below.k = node.k LEFT JOIN up ON up.k = node.k LEFT JOIN node par ON par.k = up.pk LEFT JOIN kids ON kids.k = node.k LEFT JOIN ends ON ends.k = node.k
"""
