"""Corpus pipeline over ``documents``: quality rules, line dedup, near duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.llm.jaccard_join import jaccard_components
from corpusflow.llm.line_dedup import line_dedup
from corpusflow.llm.mixing import mixed_documents
from corpusflow.llm.packing import pack
from corpusflow.llm.quality_rules import fit_ratio, quality_rules
from corpusflow.plans.ranks import with_row_numbers
from corpusflow.plans.scratch import Scratch, released

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it now is."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _documents(quality_rules(docs.select(*COLUMNS), fit_ratio(docs, labels)).where("kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that lie in repeated three-line windows; one of which nothing is left goes."""
    return _documents(line_dedup(docs.select(*COLUMNS)).where("n_removed = 0 or n_removed < n_lines"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 4-word shingle sets link: the one with the smallest doc_id.

    Rows that share a doc_id are one document, the row with the smallest text hash stands for it. Rows without a
    doc_id are documents of their own that come after all others.
    """
    docs = docs.select(*COLUMNS)
    nameless = with_row_numbers(docs.where("doc_id is null").withColumn("__h", F.xxhash64("text")), ["__h"], "__no")
    named = docs.where("doc_id is not null").withColumn("__id", F.col("doc_id").cast("long"))
    rows = named.unionByName(nameless.withColumn("__id", F.lit(1 << 62) + F.col("__no")).select(*COLUMNS, "__id"))
    groups = jaccard_components(spark, rows.select(F.col("__id").alias("doc_id"), "text"))
    others = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct()
    first = F.row_number().over(Window.partitionBy("__id").orderBy(F.xxhash64("text")))
    return _documents(rows.join(others, "__id", "left_anti").withColumn("__n", first).where("__n = 1"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them."""
    return _documents(mixed_documents(spark, docs.select(*COLUMNS)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all drawn documents in sequences of 2048 tokens."""
    return pack(spark, docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("mixing", mixing), ("packing", packing)]
#: SQL cannot tokenise, and the mix is a seeded draw: the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, and what its stage wrote on the way is deleted."""
    work = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with released():
            docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
