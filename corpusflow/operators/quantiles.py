"""Exact medians in two combined passes: a mergeable sketch bounds them, then only the values inside the bounds are put in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranks import with_sums_before
from ..plans.scratch import Scratch

#: The sketch's ranks are off by at most one in ACCURACY; bounds are taken SLACK to either side of the middle, ten times as far.
ACCURACY, SLACK = 1_000, 0.01


def medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median, n): the exact median of each group's values, the mean of the middle two for an even number; nulls are left out, NaN counts as the largest value, null groups are groups.

    No task holds a group's values: the sketch merges, and of the values within its bounds, about one in fifty,
    only distinct ones with their counts are shuffled and summed up over ranges.
    """
    work = Scratch(df.sparkSession, "medians")
    names = [f"__g{i}" for i in range(len(by))]
    rows = work.save(df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col(value).cast("double").alias("__v")), "rows")
    sketch = F.percentile_approx("__v", [0.5 - SLACK, 0.5 + SLACK], ACCURACY)
    bounds = rows.groupBy(*names).agg(sketch.alias("b"), F.count(F.lit(1)).alias("__n"))
    bounds = work.save(bounds.select(*names, F.col("b")[0].alias("__lo"), F.col("b")[1].alias("__hi"), "__n"), "bounds")

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        other = right.select(*[F.col(n).alias(f"{n}r") for n in names], *[c for c in right.columns if c not in names])
        same = F.lit(True)
        for n in names:
            same = same & F.col(n).eqNullSafe(F.col(f"{n}r"))
        return left.join(other, same).drop(*[f"{n}r" for n in names])

    placed = joined(rows, bounds)
    below = placed.groupBy(*names).agg(F.count_if(F.col("__v") < F.col("__lo")).alias("__below"))
    inside = placed.where("__v between __lo and __hi").groupBy(*names, "__v").agg(F.count(F.lit(1)).alias("__c"))
    ranked = joined(joined(with_sums_before(inside, names, ["__v"], "__c", "__before"), below), bounds.select(*names, "__n"))
    first = F.col("__below") + F.col("__before")
    holds = lambda k: (first <= k) & (k < first + F.col("__c"))
    low, high = F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)
    middle = ranked.groupBy(*names).agg(F.max(F.when(holds(low), F.col("__v"))).alias("a"), F.max(F.when(holds(high), F.col("__v"))).alias("b"), F.max("__n").alias("n"))
    return middle.where("n is not null").select(*[F.col(n).alias(c) for c, n in zip(by, names)], ((F.col("a") + F.col("b")) / 2).alias("median"), "n")
