"""Sinks: JSON Lines and Parquet tables, prediction tables with their projections, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the prediction table's projections.
PROJECTIONS = {
    "answers": ["example_id", "predicted_answer"],
    "spans": ["example_id", "extracted_span", "gold_answers"],
    "decisions": ["example_id", "source", "is_answerable", "has_answer_prob", "extracted_span"],
    "retrieval": ["example_id", "retrieved", "gold_chunk_idx"],
    "references": ["example_id", "gold_answers", "is_answerable"],
}


def write_sets(df: DataFrame, path: str, by: list[str] = ("split", "type"), fmt: str = "json") -> None:
    """One folder per value of the partition columns."""
    df.write.partitionBy(*by).format(fmt).save(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """The canonical table; projections are read from it, a columnar file being pruned by itself."""
    df.write.parquet(path)


def projection(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(path).select(*PROJECTIONS[name])


def merged_summary(reports: dict[str, DataFrame]) -> DataFrame:
    """One-row reports as (report, metric, value); counts are left out."""
    from ..operators.metrics import long_report

    rows = None
    for name, report in reports.items():
        part = long_report(report).withColumn("report", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return rows.select("report", "metric", "value")


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.json(path)  # a report has a few rows
