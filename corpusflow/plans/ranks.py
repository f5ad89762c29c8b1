"""Row numbers over a whole table without a single task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch


def with_group_ranks(df: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with ranks from 1 within each group of ``by`` (null is a group of its own), in the given order: numbers over the whole table less the group's first, so that no task holds a group."""
    rows = with_row_numbers(df, [*by, *order], "__no")
    first = rows.groupBy(*[F.col(c).alias(f"__{i}") for i, c in enumerate(by)]).agg(F.min("__no").alias("__first"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__{i}"))
    return rows.join(first, same).withColumn(name, (F.col("__no") - F.col("__first") + 1).cast("int")).drop("__no", "__first", *[f"__{i}" for i in range(len(by))])


def with_sums_before(df: DataFrame, by: list[str], order: list[str], value: str | list[str], name: str | list[str] = "before") -> DataFrame:
    """``df`` with the sums of ``value`` (a column or several) over the rows before it in its group: rows are dealt by range, summed within a partition, and shifted by the group's sums in the partitions before. Null is a group of its own."""
    values, names = ([value], [name]) if isinstance(value, str) else (value, name)
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = Scratch(spark, "ranks").save(df.repartitionByRange(n, *by, *order).withColumn("__p", F.spark_partition_id()), "summed")
    so_far = lambda v, w: F.coalesce(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keys = [f"__by{i}" for i in range(len(by))]
    # At most one row per group and partition.
    sums = parts.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col("__p").alias("__q")).agg(*[F.sum(v).alias(f"__v{i}") for i, v in enumerate(values)])
    before = Window.partitionBy(*keys).orderBy("__q")
    shifts = sums.select(*keys, "__q", *[so_far(f"__v{i}", before).alias(f"__s{i}") for i in range(len(values))])
    within = Window.partitionBy(*by, "__p").orderBy(*order)
    own = parts.withColumns({f"__o{i}": so_far(v, within) for i, v in enumerate(values)})
    same = F.col("__p") == F.col("__q")
    for c, k in zip(by, keys):
        same = same & F.col(c).eqNullSafe(F.col(k))
    found = own.join(shifts, same).withColumns({n: F.col(f"__o{i}") + F.col(f"__s{i}") for i, n in enumerate(names)})
    return found.drop("__p", "__q", *keys, *[f"__o{i}" for i in range(len(values))], *[f"__s{i}" for i in range(len(values))])


def with_row_numbers(df: DataFrame, order: list[str], name: str = "no") -> DataFrame:
    """``df`` with numbers from 0 in the given order: rows are dealt by range, numbered within a partition, and shifted by the sizes of the partitions before."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = Scratch(spark, "ranks").save(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()), "ranged")
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per partition
    offsets = F.broadcast(sizes.select("__p", before.alias("__before")))
    at = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return parts.withColumn(name, at).join(offsets, "__p").withColumn(name, F.col(name) + F.col("__before")).drop("__p", "__before")
