"""Quality rules: base counts, and a length-normalised log-likelihood ratio of hashed n-grams."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
#: Labelled rows of good quality that the target model is fitted on, at most.
TARGET_ROWS = 20_000
#: Mean log ratio per n-gram under which a document is rejected.
THRESHOLD = -0.1
SPACE = r"[ \t\n\x0B\f\r]+"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, not once per element of an inner loop."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long"), F.lit(0).cast("long"))


def _repeat_words(hashes: Column) -> Column:
    """Words that lie in 5-word windows found twice or more. ``hashes`` has to be a variable of an outer step."""
    five = F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, 5)]))
    windows = F.slice(five, F.lit(1), F.greatest(F.size(hashes) - 4, F.lit(0)))

    def covered(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, d, i: F.get(s, i + d)["h"].eqNullSafe(x["h"])
            return F.sort_array(F.transform(F.filter(s, lambda x, i: ((i > 0) & same(x, -1, i)) | same(x, 1, i)), lambda x: x["i"]))

        def union(p: Column) -> Column:
            return F.aggregate(p, F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n")), lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(5), x - a["last"])).alias("n")), lambda a: a["n"])

        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_let(_let(placed, twice), union))

    return _let(windows, covered)


def _buckets(hashes: Column) -> Column:
    """Buckets of word unigrams and bigrams. ``hashes`` has to be a variable of an outer step."""
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    two = F.transform(hashes, lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(BUCKETS)).cast("int"))
    return F.concat(one, F.slice(two, F.lit(1), F.greatest(F.size(hashes) - 1, F.lit(0))))


def word_hashes(text: Column) -> Column:
    """One 64-bit value per word, in order; empty for null texts."""
    return F.coalesce(F.transform(words_of(text), lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def fit_ratio(docs: DataFrame, labels: DataFrame) -> list[float]:
    """log(target / raw) of each bucket.

    Raw: all n-grams of all documents. Target: those of documents labelled as good, ``TARGET_ROWS`` at
    most (the smallest by hash, so that reruns agree). The target is smoothed by the raw distribution
    with a weight of one per bucket.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_ROWS).select("doc_id", F.lit(1).alias("good"))
    grams = docs.join(F.broadcast(good), "doc_id", "left").select("good", F.explode(_let(word_hashes(F.col("text")), _buckets)).alias("bucket"))
    raw, target = [1.0] * BUCKETS, [0.0] * BUCKETS
    for r in grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good")).collect():
        raw[r["bucket"]] += r["n"]
        target[r["bucket"]] = float(r["good"] or 0)
    n_raw, n_target = sum(raw), sum(target)
    if not n_target:
        return [0.0] * BUCKETS
    return [math.log((t + BUCKETS * r / n_raw) / (n_target + BUCKETS) / (r / n_raw)) for r, t in zip(raw, target, strict=True)]


def quality_rules(docs: DataFrame, ratio: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    ``score`` is the mean log ratio over a document's n-grams (0 without any); ``kept`` is false if the
    base rules fail, else score >= threshold. Null and empty texts have no words and so fail. Every row
    gets its own row back, repeated rows and null ids too.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    own = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    text = F.coalesce(F.col("text"), F.lit(""))
    table = F.from_json(F.lit(json.dumps(ratio)), "array<double>")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\n\x0b\f\r", "") != "")

    def counted(h: Column) -> Column:
        total = F.aggregate(_buckets(h), F.lit(0.0), lambda a, b: a + F.get(table, b))
        score = F.when(F.size(h) > 0, total / (2 * F.size(h) - 1)).otherwise(0.0)
        return F.struct(F.size(h).cast("long").alias("n_words"), _repeat_words(h).cast("long").alias("n_repeat_words"), score.alias("score"))

    def judged(c: Column) -> Column:
        failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
        return F.struct(*[c[k].alias(k) for k in ("n_words", "n_repeat_words", "score")], failed.alias("base_failed"), (~failed & (c["score"] >= threshold)).alias("kept"))

    # One value holds all that depends on the words: a filter on its verdict, wherever the optimizer puts it, computes it once.
    verdict = _let(_let(word_hashes(F.col("text")), counted), judged)
    return docs.select(
        *own,
        verdict.alias("__v"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select(*own, F.col("__v.n_words"), "word_chars", "n_symbols", "n_dup_lines", *[F.col(f"__v.{k}") for k in ("n_repeat_words", "base_failed", "score", "kept")])
