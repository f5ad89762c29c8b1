"""Readers of JSON Lines, JSON arrays, keyed JSON maps, and QA and case collections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.lexicon import LABEL_QUESTIONS
from ..plans.ranks import with_row_numbers
from ..plans.scratch import Scratch
from .json_map import index_maps, large_maps

QA_FIELDS = ["question", "context", "answer_text", "answer_start", "is_answerable", "domain"]
QA_TEST = "example_id string, source string, question string, document string, gold_answers array<string>, is_answerable boolean, extras map<string,string>"


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a path or glob names anything, asked of the file system that holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def json_lines(spark: SparkSession, path: str, schema: str, limit: int | None = None, order: str | None = None) -> DataFrame:
    """JSON Lines with blank lines skipped; a missing path gives an empty table; ``limit`` keeps the first rows by ``order``."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).json(path)
    fields = T.StructType.fromDDL(schema).names
    rows = rows.where(F.coalesce(*[F.col(f"`{f}`").cast("string") for f in fields]).isNotNull())
    return rows if limit is None else rows.orderBy(order or fields[0]).limit(limit)


def json_array(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """A JSON array of records; rows without a required field are an error."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in required]))
    return rows.where(F.assert_true(F.size(missing) == 0, F.concat(F.lit("missing: "), F.array_join(missing, ","))).isNull())


def split_files(spark: SparkSession, folder: str, split: str, schema: str, sources: list[str]) -> DataFrame:
    """Files ``<split>*.json`` of a folder (or such folders of part files), with file_name; source from the record, else the first known name that the file name contains; defaults for ids. Nothing found is an error."""
    pattern = f"{folder}/{split}*.json"
    if not exists(spark, pattern):
        raise FileNotFoundError(pattern)
    rows = spark.read.schema(schema).json(pattern).withColumn("file_name", F.regexp_extract(F.input_file_name(), rf"/({re.escape(split)}[^/]*\.json)(?:/[^/]+)?$", 1))
    named = F.coalesce(*[F.when(F.contains("file_name", F.lit(s)), F.lit(s)) for s in sources], F.lit("unknown"))
    defaults = {"source": named, "doc_id": F.lit(""), "question_id": F.lit(""), "chunk_idx": F.lit(0), "n_chunks": F.lit(1)}
    have = set(T.StructType.fromDDL(schema).names)
    return rows.withColumns({c: F.coalesce(F.col(c), d) if c in have else d for c, d in defaults.items()})


def with_anchor(rows: DataFrame, anchor: DataFrame, source: str = "anchor") -> DataFrame:
    """Rows of this stage and those of an earlier one, which count as one source."""
    return rows.unionByName(anchor.withColumn("source", F.lit(source)), allowMissingColumns=True)


def file_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))


def keyed_map(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One JSON object per line, {id: text}, as rows (test_id, name)."""
    parsed = F.from_json("value", "map<string,string>")
    return spark.read.text(path, lineSep="\n").select(F.explode(parsed).alias("test_id", name))


def evaluation_set(generated: DataFrame, references: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows (test_id, generated, reference, source_text); what a side lacks is empty."""
    rows = generated.join(references, "test_id", "left").join(sources, "test_id", "left")
    return rows.select("test_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("generated", "reference", "source_text")])


def map_texts(rows: DataFrame) -> DataFrame:
    """(key, value, is_text) of a keyed map, values a string or {doc_text, text}, as (doc_id, text): the first of the two that is not empty; entries without a text, or with one of spaces alone (of any width), are left out."""
    inner = F.from_json("value", "struct<doc_text:string,text:string>", {"maxStringLen": str(2**31 - 1)})
    text = F.when(~F.col("is_text") & F.col("value").startswith("{"), F.coalesce(F.nullif("s.doc_text", F.lit("")), F.col("s.text"))).otherwise(F.col("value"))
    rows, kept = rows.withColumn("s", inner).withColumn("text", text), [c for c in rows.columns if c not in ("key", "value", "is_text")]
    return rows.where(F.col("text").rlike(r"[^\p{Zs}]")).select(F.col("key").alias("doc_id"), "text", *kept)


def source_map(spark: SparkSession, releases: list[list[str]]) -> DataFrame:
    """Keyed JSON maps of several releases, each a list of files of any size: rows (doc_id, text), the first non-empty text in order of release and place."""
    work, rows = Scratch(spark, "maps"), None
    for no, files in enumerate(releases):
        index = f"{work.root}/index{no}"
        index_maps(spark, files, index)
        part = map_texts(large_maps(spark, index)).withColumn("release", F.lit(no))
        rows = part if rows is None else rows.union(part)
    # A combined aggregate, so an id that many releases have is no single task's work.
    return rows.groupBy("doc_id").agg(F.min_by("text", F.struct("release", "at", "text")).alias("text"))


def cases(parts: list[tuple[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(train, validation) of case tables (case_id, ...) named by split in order of precedence: the first occurrence of a case_id wins, so the two are disjoint."""
    rows = None
    for no, (split, df) in enumerate(parts):
        part = df.withColumn("split", F.lit(split)).withColumn("part_no", F.lit(no))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    order = [F.col("part_no"), *[F.col(c) for c in rows.columns if c in ("line_no", "doc_id")]]
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("case_id").orderBy(*order))).where("n = 1").drop("n", "part_no")
    return first.where("split = 'train'").drop("split"), first.where("split <> 'train'").drop("split")


def test_cases(case_rows: DataFrame, texts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` cases by id, and only the texts that they name."""
    held = case_rows.orderBy("case_id").limit(most)
    needed = held.select(F.explode("case_documents").alias("doc_id"))
    return held, texts.join(needed, "doc_id", "left_semi")


def first_column(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that the table has."""
    for n in names:
        if n in df.columns:
            return F.col(f"`{n}`")
    raise ValueError(f"none of {names} in {df.columns}")


def document_pairs(df: DataFrame, id_prefix: str | None = None, key: str = "doc_id") -> DataFrame:
    """(doc_id, text, summary) of a pair table whose columns bear any of the usual names."""
    text, summary = first_column(df, "article", "text", "document"), first_column(df, "abstract", "summary", "highlights")
    name = F.col(key).cast("string")
    if id_prefix is not None:
        df = with_row_numbers(df, [key], "__no")
        name = F.concat(F.lit(id_prefix), F.col("__no").cast("string"))
    return df.select(name.alias("doc_id"), text.alias("text"), summary.alias("summary"))


def corpus_texts(*tables: tuple[DataFrame, list[str]], least: int = 50) -> DataFrame:
    """All texts of several corpora, one row per named column; only those over ``least`` characters."""
    rows = None
    for df, columns in tables:
        part = df.select(F.explode(F.array(*columns)).alias("text")).where(F.length("text") > least)
        rows = part if rows is None else rows.union(part)
    return rows


def squad_tests(df: DataFrame, source: str) -> DataFrame:
    """SQuAD-shaped rows (id, question, context, answers: text[], answer_start[]) as QA test records: answerable if both lists have entries and the first text is not blank."""
    golds = F.filter("answers.text", lambda x: F.btrim(x) != "")
    answerable = (F.size("answers.text") > 0) & (F.size("answers.answer_start") > 0) & (F.btrim(F.get("answers.text", F.lit(0))) != "")
    return df.select(F.col("id").alias("example_id"), F.lit(source).alias("source"), "question", F.col("context").alias("document"), golds.alias("gold_answers"), F.coalesce(answerable, F.lit(False)).alias("is_answerable"), F.lit(None).cast("map<string,string>").alias("extras"))


def label_questions(spark: SparkSession) -> DataFrame:
    """The fixed table of clause labels and their questions."""
    pairs = [x for kv in LABEL_QUESTIONS.items() for x in map(F.lit, kv)]
    return spark.range(1).select(F.explode(F.create_map(*pairs)).alias("label", "question"))


def label_tests(df: DataFrame, templates: DataFrame, words: int = 200) -> DataFrame:
    """Rows (id, text, label) with a question from a template table (label, question), case and white space of labels ignored; rows without a template are dropped; the gold answer is the first words of the text."""
    from ..functions import text as X

    key = lambda c: F.lower(F.btrim(c))
    t = templates.select(key("label").alias("k"), "question")
    rows = df.withColumn("k", key("label")).join(t, "k")
    return rows.select(F.col("id").alias("example_id"), F.lit("label").alias("source"), "question", F.col("text").alias("document"), F.array(X.truncate_words(F.col("text"), words)).alias("gold_answers"), F.lit(True).alias("is_answerable"), F.create_map(F.lit("label"), "label").alias("extras"))


def optional_tests(spark: SparkSession, path: str) -> DataFrame:
    """QA test records of a file that may be absent."""
    return json_lines(spark, path, QA_TEST)


def all_tests(tables: list[DataFrame], cap: int, seed: int = 42) -> DataFrame:
    """Test records of all sources, ``cap`` of each at most, by a seeded order."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t, allowMissingColumns=True)
    w = Window.partitionBy("source").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "example_id")), "example_id")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap).drop("n")


def summary_counts(rows: DataFrame) -> DataFrame:
    """Totals and answerable shares over all rows and by domain, source and file, from one pass: (grp, n, answerable)."""
    names = F.array_compact(F.array(F.lit("all"), *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c} "), c)) for c in ("domain", "source", "file_name") if c in rows.columns]))
    return rows.withColumn("grp", F.explode(names)).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("is_answerable").cast("double")), 6).alias("answerable"))


def by_question(rows: DataFrame) -> DataFrame:
    """Example ids of each question in order. The list is as long as a question's chunks."""
    return rows.groupBy("question_id").agg(F.sort_array(F.collect_list("example_id")).alias("example_ids"))
