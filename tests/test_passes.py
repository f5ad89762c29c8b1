"""Medians, key filters and observed counts against plain Python, and what their plans shuffle."""

import random
import statistics

from pyspark.sql import functions as F

from corpusflow.operators import keyfilter as B
from corpusflow.operators import quantiles as Q
from corpusflow.operators import records as R


def test_medians(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([None, rng.random(), float(rng.randrange(5))])) for g in ("a", "b", None) for _ in range(rng.randrange(400, 900))]
    rows += [("one", 2.5), ("two", 1.0), ("two", 2.0), ("none", None), *[("hot", float(i % 7)) for i in range(5_000)]]
    got = {r["g"]: (r["median"], r["n"]) for r in Q.medians(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    groups = {g: [v for h, v in rows if h == g and v is not None] for g in {g for g, _ in rows}}
    assert got == {g: (statistics.median(v), len(v)) for g, v in groups.items() if v}
    (whole,) = Q.medians(spark.range(100_001).withColumn("v", F.col("id") * 3 % 100_001), [], "v").collect()
    assert tuple(whole) == (50_000.0, 100_001)
    assert Q.medians(spark.createDataFrame([], "v double"), [], "v").collect() == []


def test_key_filter_cuts_what_is_shuffled(spark):
    rows = spark.range(50_000).withColumn("x", F.col("id") % 7).union(spark.createDataFrame([(None, 1)], "id long, x long"))
    keys = spark.createDataFrame([(k,) for k in [*range(0, 50_000, 500), *range(0, 50_000, 500), 90_000, None]], "id long")
    assert sorted(r["id"] for r in B.needed_rows(rows, keys, "id").collect()) == list(range(0, 50_000, 500))
    words, bits, share = B.bit_filter(keys, "id")
    passed = rows.where(B.passes(F.col("id"), words, bits)).count()
    assert 100 <= passed <= 100 + 50_000 * max(0.02, 3 * share) and share < 0.05  # of 50,001 rows
    full = B.bit_filter(keys, "id", 64)
    assert full[2] > B.WORTH and sorted(r["id"] for r in B.needed_rows(rows, keys, "id", 64).collect()) == list(range(0, 50_000, 500))
    assert B.needed_rows(rows, keys.where("false"), "id").collect() == []
    names = spark.createDataFrame([("a",), ("b",)], "k string")
    assert [r["k"] for r in B.needed_rows(spark.createDataFrame([("b",), ("c",), (None,)], "k string"), names, "k").collect()] == ["b"]


def test_counts_of_the_pass_that_writes(spark, tmp_path):
    rows = spark.range(1_000).select("id", F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("domain"))
    reasons = {"small": F.col("id") < 100, "tens": F.col("id") % 10 == 0}
    path = str(tmp_path / "kept")
    got = sorted(map(tuple, R.write_kept(rows, reasons, "domain", ["x", "y", "z"], path).collect()))
    assert got == sorted(map(tuple, R.kept_and_dropped(rows, reasons, "domain").collect()))
    assert spark.read.parquet(path).count() == 810 and spark.read.parquet(path).columns == ["id", "domain"]
