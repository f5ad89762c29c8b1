"""Document fingerprints: SimHash by weighted votes of term hashes, and a search of all fingerprints within a Hamming radius by permuted block tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scratch import Scratch

BITS = 128
#: Bits in which fingerprints of one neighbourhood may differ, and blocks that a fingerprint is cut into: with r bits changed, at least BLOCKS - r blocks are equal.
RADIUS, BLOCKS, EQUAL = 6, 8, 2
#: Pairs of words with so many characters and more count twice.
LONG_PAIR = 10
#: A term's lowest three bits: which text of a row it is of, and its weight, 0 for the mark that every text has.
_SIDE, _WEIGHT = 4, 3
_HALF = 0xFFFFFFFF
_SPACES = r"[\x20\x09-\x0D]+"


def terms(text: Column, side: int = 0) -> Column:
    """Distinct hashes of each word with the one after it (the last stands alone), and a mark of weight 0; see ``_SIDE`` for their lowest bits."""

    def hashed(a: Column, b: Column) -> Column:
        weight = F.when(F.length(a) + F.coalesce(F.length(b), F.lit(0)) >= LONG_PAIR, 2 + _SIDE * side).otherwise(1 + _SIDE * side)
        return F.shiftleft(F.shiftright(F.xxhash64(a, b), 3), 3).bitwiseOR(weight.cast("long"))

    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACES), "")
    # A variable of one outer step holds the words, else each inner step would cut the text again.
    pairs = F.transform(F.array(words), lambda w: F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), hashed))[0]
    return F.concat(F.array(F.lit(_SIDE * side).cast("long")), F.array_distinct(pairs))


def voted(rows: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """(key, side, *carried, hi, lo): the fingerprints of ``rows`` (key, carried longs, t: terms of one or two texts).

    A bit is set if the terms whose hash has it weigh more than the others; without words none is. Votes for two bits are counted in
    one long, 64 longs in all, by sums that Spark combines before it shuffles them, so texts may have any number of terms.
    """
    each = rows.select(key, *carried, F.explode("t").alias("h"))
    term = F.col("h").bitwiseAND(F.lit(~7))
    each = each.select(key, *carried, F.shiftright("h", 2).bitwiseAND(F.lit(1)).alias("side"), F.xxhash64(term, F.lit(1)).alias("x"), F.xxhash64(term, F.lit(2)).alias("y"), F.col("h").bitwiseAND(F.lit(_WEIGHT)).alias("w"))
    two = F.lit(1 << 32 | 1)
    votes = [F.sum(F.shiftrightunsigned(c, j).bitwiseAND(two) * F.col("w")).alias(f"{c}{j}") for c in "xy" for j in range(32)]
    counted = each.groupBy(key, "side").agg(*[F.max(c).alias(c) for c in carried], F.sum("w").alias("all"), *votes)

    def packed(c: str) -> Column:
        bits = None
        for j in range(32):
            for k, count in ((j, F.col(f"{c}{j}").bitwiseAND(F.lit(_HALF))), (j + 32, F.shiftrightunsigned(f"{c}{j}", 32))):
                bit = F.when(2 * count > F.col("all"), F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long"))
                bits = bit if bits is None else bits.bitwiseOR(bit)
        return bits

    return counted.select(key, "side", *carried, packed("y").alias("hi"), packed("x").alias("lo"))


def fingerprints(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, hi, lo): the fingerprint of each text of ``docs``, whose keys (longs) are distinct. Null is an empty text; equal texts have equal fingerprints."""
    return voted(docs.select(key, terms(F.col(text)).alias("t")), key, []).drop("side")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a["hi"].bitwiseXOR(b["hi"])) + F.bit_count(a["lo"].bitwiseXOR(b["lo"]))


def likeness(a: Column, b: Column) -> Column:
    """The share of bits that two fingerprints have in common."""
    return 1.0 - distance(a, b) / BITS


def as_text(print_: Column) -> Column:
    """32 lower-case hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(print_["hi"]), 16, "0"), F.lpad(F.hex(print_["lo"]), 16, "0")))


def followed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(no, total, doc_id, text, next): documents numbered from 0 by doc_id with the text of the one after, the first after the last. ``docs``: doc_id, text.

    Rows without an id come first, by text hash, then text; rows with one id by text; rows alike in both follow each
    other. Texts are shuffled once, into ranges of ids (of hashes where there is no id) with about as many rows each;
    the first row of a range is added to the end of the one before it. The driver holds a number or two for each range.
    """
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10_000 + 10 * n)).first()[0] or []
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    below = F.lit(0)  # bounds that are at most the id, found by halving
    if bounds:
        table = F.lit(bounds)
        below = F.aggregate(F.lit(steps), F.lit(0), lambda a, s: F.when(F.get(table, a + s - 1) <= F.col("doc_id"), a + s).otherwise(a))
    tie = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    by_hash = F.floor((tie / F.lit(2.0**64) + 0.5) * n).cast("int")
    rows = docs.withColumn("tie", tie).withColumn("part", F.when(F.col("doc_id").isNull(), by_hash).otherwise(n + below))

    sizes = sorted(tuple(r) for r in rows.groupBy("part").agg(F.count(F.lit(1)), F.min("doc_id"), F.min("tie")).collect())
    if not sizes:
        return rows.select(F.lit(0).cast("long").alias("no"), F.lit(0).cast("long").alias("total"), "doc_id", "text", F.col("text").alias("next"))
    before, total = [], 0
    for p, count, first_id, first_tie in sizes:
        before.append((p, total))
        total += count
    after = [(sizes[(k + 1) % len(sizes)][0], sizes[(k + 1) % len(sizes)][2], sizes[(k + 1) % len(sizes)][3], p) for k, (p, *_) in enumerate(sizes)]
    firsts = spark.createDataFrame(after, "part int, first_id long, first_tie long, goes_to int")
    same = (rows.part == firsts.part) & rows.doc_id.eqNullSafe(firsts.first_id) & rows.tie.eqNullSafe(firsts.first_tie)
    lent = rows.join(F.broadcast(firsts), same).groupBy("goes_to").agg(F.min("text").alias("text"))  # a row or a few for each range
    lent = lent.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("tie"), F.col("goes_to").alias("part"), F.lit(True).alias("lent"))
    order = Window.partitionBy("part").orderBy("lent", "doc_id", "tie", "text")
    both = rows.withColumn("lent", F.lit(False)).unionByName(lent)
    both = both.withColumn("next", F.lead("text").over(order)).withColumn("at", F.row_number().over(order)).where("not lent")
    offsets = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    return both.join(offsets, "part").select((F.col("before") + F.col("at") - 1).alias("no"), F.lit(total).cast("long").alias("total"), "doc_id", "text", "next")


def within_radius(spark: SparkSession, prints: DataFrame, work: Scratch, radius: int = RADIUS) -> DataFrame:
    """(hi, lo, class_id, size, n_near): each distinct fingerprint of ``prints`` (doc_id, hi, lo) with its smallest doc_id, its rows, and the number of rows of other fingerprints within ``radius`` bits.

    Two fingerprints that differ in at most six bits agree in two of eight blocks of 16 bits, so each is entered into 28 tables by a
    pair of its blocks, and only entries of one key are compared. Copies are one fingerprint and are not paired; a pair
    counts in the first of the tables that it meets in, hence once. A radius above six is an error.
    """
    if radius > BLOCKS - EQUAL:
        raise ValueError(f"the tables find radii up to {BLOCKS - EQUAL}")
    classes = work.save(prints.groupBy("hi", "lo").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("size")), "classes")
    block = lambda k: F.shiftrightunsigned("hi" if k < 4 else "lo", 48 - 16 * (k % 4)).bitwiseAND(F.lit(0xFFFF))
    keys = [F.struct(F.lit(1 << i | 1 << j).alias("m"), F.shiftleft(block(i), 16).bitwiseOR(block(j)).alias("key")) for i, j in combinations(range(BLOCKS), EQUAL)]
    entries = classes.select("hi", "lo", "size", F.explode(F.array(*keys)).alias("e")).select("hi", "lo", "size", "e.m", "e.key")
    other = entries.select(*[F.col(c).alias(f"{c}2") for c in ("m", "key", "hi", "lo", "size")])
    x, y = F.col("hi").bitwiseXOR(F.col("hi2")), F.col("lo").bitwiseXOR(F.col("lo2"))
    alike = F.lit(0)  # the blocks in which the two agree
    for k in range(BLOCKS):
        alike = alike + F.when(F.shiftrightunsigned(x if k < 4 else y, 48 - 16 * (k % 4)).bitwiseAND(F.lit(0xFFFF)) == 0, 1 << k).otherwise(0)
    least = lambda v: v.bitwiseAND(-v)
    first_two = least(alike).bitwiseOR(least(alike - least(alike)))
    smaller = (F.col("hi") < F.col("hi2")) | ((F.col("hi") == F.col("hi2")) & (F.col("lo") < F.col("lo2")))
    near = smaller & (F.bit_count(x) + F.bit_count(y) <= radius) & (first_two == F.col("m"))
    # Spark sizes 28 entries as one row, so without the hint it would take them for small and broadcast them.
    pairs = entries.join(other.hint("merge"), (F.col("m") == F.col("m2")) & (F.col("key") == F.col("key2")) & near)
    ends = F.explode(F.array(F.struct("hi", "lo", F.col("size2").alias("n")), F.struct(F.col("hi2").alias("hi"), F.col("lo2").alias("lo"), F.col("size").alias("n"))))
    counts = pairs.select(ends.alias("p")).select("p.*").groupBy("hi", "lo").agg(F.sum("n").alias("n_near"))
    return classes.join(counts, ["hi", "lo"], "left").select("hi", "lo", "class_id", "size", F.coalesce("n_near", F.lit(0)).alias("n_near"))


def compared(spark: SparkSession, docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprints of documents and of their edited texts, a row per row of ``docs`` (doc_id, text, any others, which are left out).

    The edited text has its last floor(n_chars / 4) code points replaced by as many first ones of the next document (all, if
    it is shorter). Returned: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, then
    class_id (smallest doc_id with the same fingerprint) and n_near (other rows within ``radius`` bits). Null texts are empty;
    an empty text has the fingerprint without bits; rows equal in doc_id and text are documents of their own, one after
    the other; the only row is followed by itself; an empty table gives none.
    """
    work = Scratch(spark, "simhash")
    edits = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))"), F.substr("next", F.lit(1), edits))
    rows = followed(spark, docs.select("doc_id", "text")).select("no", "total", "doc_id", "text", edited.alias("edited"))
    digest = [F.conv(F.substr(F.sha2("edited", 256), F.lit(16 * k + 1), F.lit(16)), 16, -10).cast("long").alias(f"d{k}") for k in range(4)]
    carried = ["total", "doc_id", "n_chars", "d0", "d1", "d2", "d3"]
    rows = rows.select("no", "total", "doc_id", F.length("text").cast("long").alias("n_chars"), *digest, F.concat(terms(F.col("text")), terms(F.col("edited"), 1)).alias("t"))
    rows = work.save(voted(rows, "no", carried), "sides")
    side = lambda k: F.max(F.when(F.col("side") == k, F.struct("hi", "lo")))
    rows = rows.groupBy("no", *carried).agg(side(0).alias("p"), side(1).alias("e"))
    sha = F.lower(F.concat(*[F.lpad(F.hex(f"d{k}"), 16, "0") for k in range(4)]))
    rows = work.save(rows.select("no", "total", "doc_id", "n_chars", sha.alias("edited_sha256"), "p", "e"), "prints")
    after = rows.select(((F.col("no") - 1 + F.col("total")) % F.col("total")).alias("no"), F.col("p").alias("after"))
    # Copies make these files smaller than their rows: all three joins of whole tables are told not to broadcast.
    found = rows.join(after.hint("merge"), "no").withColumn("near_edited", likeness(F.col("p"), F.col("e"))).withColumn("near_next", likeness(F.col("p"), F.col("after")))
    near = work.save(within_radius(spark, rows.select("doc_id", "p.hi", "p.lo"), work, radius), "near")
    joined = found.join(near.hint("merge"), (F.col("p.hi") == near.hi) & (F.col("p.lo") == near.lo))
    out = joined.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("p")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"), "near_edited", "near_next", "class_id", (F.col("n_near") + F.col("size") - 1).alias("n_near"))
    return out
