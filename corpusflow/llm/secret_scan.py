"""Secret scans: single-pattern spans, and weak parts that count only beside their complements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: Weak parts: a bare secret of 40 characters, an account name, an endpoint.
BARE = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]{0,39}[0-9])(?=[A-Za-z0-9+/]{0,39}[A-Z])(?=[A-Za-z0-9+/]{0,39}[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
ACCOUNT = r"""(?i:\b(?:user(?:name)?|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,}"""
ENDPOINT = r"""\b[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]{4,}"""
#: Kinds in the order in which spans that start together are listed.
KINDS = ["assign", "access", "hex", "bare_secret", "account", "endpoint"]
#: Characters between parts of one credential, at most.
SCOPE = 400


def spans_of(text: Column, pattern: str, kind: str, keep: tuple[int, int] | None = None) -> Column:
    """Leftmost non-overlapping matches as (start, rank, end) in code points; ``keep``: a group and its least length.

    The pieces between matches and the matches themselves, in turn, give the positions as running sums of lengths.
    """
    rank, none = KINDS.index(kind), F.array().cast("array<struct<start:int,rank:int,end:int>>")
    long_enough = F.regexp_extract_all(text, F.lit(pattern), F.lit(keep[0] if keep else 0))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), long_enough.alias("part"))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        counts = x["hit"].isNotNull() & (F.length(x["part"]) >= (keep[1] if keep else 0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(counts, F.array_append(a["out"], span)).otherwise(a["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(parts, start, step, lambda a: a["out"])).otherwise(none)


def _listed(spans: Column) -> Column:
    kind = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["rank"] + 1)
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", kind(x), x["start"], x["end"])), ",")


def _near(weak: DataFrame, parts: DataFrame, scope: int) -> DataFrame:
    """Rows of ``weak`` with a part of the same text at most ``scope`` characters away: an interval join over bins, which makes no pairs."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope)))
    binned = weak.withColumn("bin", bins(F.col("start"), F.col("end")))
    other = parts.select("k", "t", F.col("start").alias("s"), F.col("end").alias("e"), bins(F.col("start") - scope, F.col("end") + scope).alias("bin"))
    return binned.join(other, (binned.k == other.k) & (binned.t == other.t) & (binned.bin == other.bin) & (other.s <= binned.end + scope) & (other.e >= binned.start - scope), "left_semi").drop("bin").distinct()


def secret_scan(spark: SparkSession, docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Base spans: values assigned to a secret's name, access identifiers, long hexadecimal runs. A weak part
    overlaps no base span and counts if its complement lies within ``scope`` characters: for a bare secret
    an identifier (access or account), for an account name a secret (assigned, hexadecimal or bare), for
    an endpoint both. Null and empty texts have no spans; rows equal in doc_id and text get the same spans;
    null ids are kept. Positions are code points of the whole text, end exclusive.
    """
    work = Scratch(spark, "secrets")
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(spans_of(F.col("x"), ASSIGN, "assign", (2, 6)), spans_of(F.col("x"), ACCESS, "access", (0, 20)), spans_of(F.col("x"), HEX, "hex", (0, 24)))
    weak = F.concat(spans_of(F.col("x"), BARE, "bare_secret"), spans_of(F.col("x"), ACCOUNT, "account"), spans_of(F.col("x"), ENDPOINT, "endpoint"))
    keys = [F.xxhash64(F.lit("id"), F.col("doc_id")).alias("k"), F.xxhash64(text).alias("t")]
    each = docs.select("doc_id", *keys, text.alias("x")).select("doc_id", "k", "t", base.alias("base"), weak.alias("weak"))
    free = F.expr("filter(weak, w -> not exists(base, b -> b.start < w.end and b.end > w.start))")
    each = work.save(each.withColumn("weak", F.when(F.size("weak") > 0, free).otherwise(F.col("weak"))), "spans")

    parts = each.where("size(weak) > 0 and size(weak) + size(base) > 1").select("k", "t", F.explode(F.concat("base", "weak")).alias("p")).select("k", "t", "p.*").distinct()
    parts = work.save(parts, "parts")
    of = lambda *kinds: parts.where(F.col("rank").isin([KINDS.index(k) for k in kinds]))
    identifiers, secrets = of("access", "account"), of("assign", "hex", "bare_secret")
    linked = _near(of("bare_secret"), identifiers, scope).union(_near(of("account"), secrets, scope)).union(_near(_near(of("endpoint"), identifiers, scope), secrets, scope))
    linked = linked.groupBy("k", "t").agg(F.collect_set(F.struct("start", "rank", "end")).alias("linked"))

    out = each.select("doc_id", "k", "t", "base").join(linked, ["k", "t"], "left")
    count = lambda kind: F.size(F.filter("base", lambda b: b["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    every = F.concat(F.col("base"), F.coalesce("linked", F.expr("slice(base, 1, 0)")))
    return out.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(every).alias("spans"), F.coalesce(F.when(F.col("linked").isNotNull(), F.size("linked")), F.lit(0)).cast("long").alias("n_linked")
    )
