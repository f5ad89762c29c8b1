"""The thin ``opN_<name>`` queries over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, line_dedup, periodic_runs, prefix_trie, simhash, toxicity
from .html_extract import extract
from .jaccard_join import jaccard_components
from .mixing import plan_mix
from .nearest import nearest
from .packing import pack
from .quality_rules import fit_ratio, quality_rules
from .secret_scan import secret_scan


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(0))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", _fold(3) == 1)
    model = toxicity.fit(docs.where("not held_out"), _table(spark, sf_dir, "labels").where(_fold(3) != 1))
    return toxicity.score(docs, model).withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, _table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, fit_ratio(docs, _table(spark, sf_dir, "labels"))).drop("text")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(spark, _table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.col("draws.shard").alias("shards"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark, _table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", _fold(5) == 0)
    model = language_id.fit(docs.where("not held_out"))
    return language_id.predict(docs.drop("lang"), model)


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, _table(spark, sf_dir, "pages"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, _table(spark, sf_dir, "embeddings"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, _table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"), planted=True)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compared(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark, _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


_QUERIES = [op1_line_dedup, op2_toxicity, op3_packing, op4_quality_rules, op5_mixing, op6_secret_scan, op7_language_id, op8_html_extract, op9_nearest, op10_jaccard_join, op11_periodic_runs, op12_simhash, op13_prefix_trie]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op11_periodic_runs": periodic_runs.SQL, "op13_prefix_trie": prefix_trie.SQL}
