"""Queries of the readers, sinks, record builders and streams, over files and streams that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import qa as Q
from ..sources import json_map as J
from ..sources import readers as R
from ..sources import writers as K
from ..streaming import memory
from .eval_queries import _PRED, _SCORED, _SUM, predictions, summaries
from .registry import query, table
from .scratch import Scratch
from .text_queries import documents


def _folder(spark: SparkSession, name: str) -> str:
    return Scratch(spark, name).root


def _json(text: Column) -> Column:
    """A text as a JSON string; null for none."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1))


@query("s1_json_lines", "SELECT doc_id, source, md5(text) AS text_md5 FROM documents")
def s1(spark, sf_dir):
    path = _folder(spark, "s1")
    documents(spark, sf_dir).write.json(path)
    rows = R.json_lines(spark, path, "doc_id long, source string, text string")
    empty = R.json_lines(spark, path + "-absent", "doc_id long, source string, text string")
    return rows.union(empty).select("doc_id", "source", F.md5("text").alias("text_md5"))


@query("s1_first_lines", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 40")
def s1b(spark, sf_dir):
    path = _folder(spark, "s1b")
    documents(spark, sf_dir).write.json(path)
    return R.json_lines(spark, path, "doc_id long, source string", 40).select("doc_id", "source")


_RECORD = """SELECT doc_id, substring(text, 1, 60) AS question, text AS context, substring(text, 41, 30) AS answer_text, CASE WHEN doc_id % 4 = 0 THEN -1 ELSE 40 END AS answer_start, doc_id % 4 <> 0 AS is_answerable, CASE doc_id % 3 WHEN 0 THEN 'general' WHEN 1 THEN 'legal' ELSE 'scientific' END AS domain, source FROM documents"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_RECORD.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))


@query("s4_split_files", f"WITH r AS ({_RECORD}) SELECT doc_id, question, CASE WHEN doc_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS source, 0 AS chunk_idx, 1 AS n_chunks FROM r")
def s4(spark, sf_dir):
    folder = _folder(spark, "s4")
    rows = _records(spark, sf_dir).select("doc_id", "question")
    for name, wanted in (("train_alpha", "doc_id % 2 = 0"), ("train_beta", "doc_id % 2 = 1"), ("val_alpha", "true")):
        rows.where(wanted).withColumn("source", F.lit(None).cast("string")).write.json(f"{folder}/{name}.json")
    out = R.split_files(spark, folder, "train", "doc_id long, question string, source string", ["alpha", "beta"])
    return out.select("doc_id", "question", "source", "chunk_idx", "n_chunks")


@query("s12_optional_tests", f"WITH r AS ({_RECORD}) SELECT CAST(doc_id AS VARCHAR) AS example_id, 'local' AS source, question, md5(context) AS document_md5, CASE WHEN is_answerable THEN answer_text ELSE '' END AS first_gold, is_answerable FROM r")
def s12(spark, sf_dir):
    """A local file of QA tests that is there, and one that is not."""
    folder = _folder(spark, "s12")
    golds = F.when(F.col("is_answerable"), F.array("answer_text")).otherwise(F.array().cast("array<string>"))
    rows = _records(spark, sf_dir).select(F.col("doc_id").cast("string").alias("example_id"), F.lit("local").alias("source"), "question", F.col("context").alias("document"), golds.alias("gold_answers"), "is_answerable")
    rows.write.json(f"{folder}/tests.json")
    found = R.optional_tests(spark, f"{folder}/tests.json").unionByName(R.optional_tests(spark, f"{folder}/absent.json"))
    return found.select("example_id", "source", "question", F.md5("document").alias("document_md5"), F.coalesce(F.get("gold_answers", F.lit(0)), F.lit("")).alias("first_gold"), "is_answerable")


@query("s5_union_with_anchor", f"WITH r AS ({_RECORD}) SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'anchor' ELSE source END AS source, is_answerable FROM r")
def s5(spark, sf_dir):
    rows = _records(spark, sf_dir).select("doc_id", "source", "is_answerable")
    return R.with_anchor(rows.where("doc_id % 5 <> 0"), rows.where("doc_id % 5 = 0").drop("source"))


@query("s6_source_map", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text_md5 FROM documents WHERE trim(text) <> ''")
def s6(spark, sf_dir):
    folder = _folder(spark, "s6")
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    first = docs.where(F.col("doc_id").cast("long") % 2 == 0).select(F.col("doc_id").alias("key"), _json(F.col("text")).alias("json"))
    both = F.when(F.col("doc_id").cast("long") % 3 == 0, F.struct(F.lit("").alias("doc_text"), F.col("text").alias("text"))).otherwise(F.struct(F.col("text").alias("doc_text"), F.when(F.col("text") != "", "unused").alias("text")))
    releases = [J.write_maps(first, f"{folder}-1"), J.write_maps(docs.select(F.col("doc_id").alias("key"), F.to_json(both).alias("json")), f"{folder}-2")]
    return R.source_map(spark, releases).select("doc_id", F.md5("text").alias("text_md5"))


@query("s7_case_splits", """WITH p AS (SELECT doc_id % 700 AS case_id, doc_id, doc_id // 700 % 4 AS part FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY part, doc_id) AS n FROM p) SELECT case_id, doc_id, CASE WHEN part IN (0, 2) THEN 'train' ELSE 'validation' END AS split FROM f WHERE n = 1""")
def s7(spark, sf_dir):
    rows = documents(spark, sf_dir).select((F.col("doc_id") % 700).alias("case_id"), "doc_id", (F.floor(F.col("doc_id") / 700) % 4).alias("part"))
    parts = [(split, rows.where(F.col("part") == k).drop("part")) for k, split in enumerate(("train", "validation", "train", "validation"))]
    train, validation = R.cases(parts)
    return train.withColumn("split", F.lit("train")).union(validation.withColumn("split", F.lit("validation")))


@query("s8_test_cases", "WITH c AS (SELECT DISTINCT conv_id AS case_id FROM conversations ORDER BY 1 LIMIT 20), n AS (SELECT DISTINCT conv_id * 3 + turn AS doc_id FROM conversations WHERE conv_id IN (SELECT case_id FROM c)) SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM n)")
def s8(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("case_id")).agg(F.collect_list(F.col("conv_id") * 3 + F.col("turn")).alias("case_documents"))
    return R.test_cases(conv, documents(spark, sf_dir).select("doc_id", "source"), 20)[1]


@query("s9_renamed_pairs", "SELECT 'bs_' || CAST(row_number() OVER (ORDER BY item_id) - 1 AS VARCHAR) AS doc_id, text, substring(text, 1, 40) AS summary FROM benchmark")
def s9(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("article"), F.substring("text", 1, 40).alias("highlights"))
    return R.document_pairs(rows, "bs_", "item_id")


@query("s10_squad_tests", f"WITH r AS ({_RECORD}) SELECT CAST(doc_id AS VARCHAR) AS example_id, 'squad' AS source, question, is_answerable AND trim(answer_text) <> '' AS is_answerable, CASE WHEN is_answerable THEN answer_text ELSE '' END AS first_gold FROM r")
def s10(spark, sf_dir):
    answers = F.when(F.col("is_answerable"), F.struct(F.array("answer_text").alias("text"), F.array("answer_start").alias("answer_start"))).otherwise(F.struct(F.array().cast("array<string>").alias("text"), F.array().cast("array<int>").alias("answer_start")))
    rows = _records(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "question", "context", answers.alias("answers"))
    return R.squad_tests(rows, "squad").select("example_id", "source", "question", "is_answerable", F.coalesce(F.get("gold_answers", F.lit(0)), F.lit("")).alias("first_gold"))


@query("s11_label_tests", r"""SELECT CAST(d.doc_id AS VARCHAR) AS example_id, CASE d.doc_id % 3 WHEN 0 THEN 'What are the payment obligations?' ELSE 'Where must disputes be filed?' END AS question,
md5(CASE WHEN len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) <= 200 THEN text ELSE array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')[1:200], ' ') END) AS gold_md5 FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE d.doc_id % 3 < 2""")
def s11(spark, sf_dir):
    label = F.when(F.col("doc_id") % 3 == 0, " Payments ").when(F.col("doc_id") % 3 == 1, "VENUE").otherwise("Something else")
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").cast("string").alias("id"), "text", label.alias("label"))
    return R.label_tests(rows, R.label_questions(spark)).select("example_id", "question", F.md5(F.get("gold_answers", F.lit(0))).alias("gold_md5"))


@query("s14_corpus_texts", "SELECT md5(t) AS text_md5, length(t) AS n_chars FROM (SELECT text AS t FROM documents UNION ALL SELECT substring(text, 1, 200) FROM documents UNION ALL SELECT text FROM benchmark) WHERE length(t) > 50")
def s14(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("summary", F.substring("text", 1, 200))
    rows = R.corpus_texts((docs, ["text", "summary"]), (table(spark, sf_dir, "benchmark"), ["text"]))
    return rows.select(F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@query("s16_evaluation_set", _SUM + " SELECT CAST(test_id AS VARCHAR) AS test_id, generated, CASE WHEN test_id % 3 = 0 THEN '' ELSE reference END AS reference, md5(source_text) AS source_md5 FROM u")
def s16(spark, sf_dir):
    folder, rows = _folder(spark, "s16"), summaries(spark, sf_dir).withColumn("test_id", F.col("test_id").cast("string"))
    for name, df in (("generated", rows), ("reference", rows.where(F.col("test_id").cast("long") % 3 != 0)), ("source_text", rows)):
        df.select(F.to_json(F.create_map("test_id", name)).alias("value")).write.text(f"{folder}-{name}")
    read = lambda name: R.keyed_map(spark, f"{folder}-{name}", name)
    return R.evaluation_set(read("generated"), read("reference"), read("source_text")).select("test_id", "generated", "reference", F.md5("source_text").alias("source_md5"))


@query("k1_partitioned_sets", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, CASE WHEN doc_id % 3 = 0 THEN 'second_pass' ELSE 'chunk' END AS type FROM documents")
def k1(spark, sf_dir):
    path = _folder(spark, "k1")
    rows = documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train").alias("split"), F.when(F.col("doc_id") % 3 == 0, "second_pass").otherwise("chunk").alias("type"))
    K.write_sets(rows, path)
    return spark.read.schema("doc_id long, split string, type string").json(path).select("doc_id", "split", "type")


@query("k2_prediction_projections", _PRED + " SELECT example_id, source, is_answerable, has_answer_prob, extracted_span FROM p")
def k2(spark, sf_dir):
    path = _folder(spark, "k2")
    K.write_predictions(predictions(spark, sf_dir), path)
    return K.projection(spark, path, "decisions")


@query("k3_merged_summary", _SCORED + ", r AS (SELECT count(*) AS n, avg(em) AS em, avg(f1) AS f1 FROM s), l AS (SELECT round(avg(length(generated)), 6) AS mean_chars FROM (SELECT CASE doc_id % 4 WHEN 3 THEN '' ELSE 'x' END AS generated FROM documents)) SELECT 'answers' AS report, 'em' AS metric, round(em, 6) AS value FROM r UNION ALL SELECT 'answers', 'f1', round(f1, 6) FROM r UNION ALL SELECT 'lengths', 'mean_chars', mean_chars FROM l")
def k3(spark, sf_dir):
    from ..operators import metrics as M

    answers = M.em_f1(predictions(spark, sf_dir)).where("grp = 'all'").select("n", "em", "f1")
    lengths = documents(spark, sf_dir).select(F.when(F.col("doc_id") % 4 == 3, "").otherwise("x").alias("g")).agg(F.count(F.lit(1)).alias("n_texts"), F.round(F.avg(F.length("g")), 6).alias("mean_chars"))
    return K.merged_summary({"answers": answers, "lengths": lengths})


@query("v1_contract_violations", f"WITH r AS ({_RECORD}) SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'missing:question' WHEN domain NOT IN ('general', 'legal') THEN 'domain' ELSE '' END AS violations FROM r")
def v1(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumn("question", F.when(F.col("doc_id") % 6 != 0, F.col("question")))
    rows = rows.withColumn("domain", F.when(F.col("doc_id") % 6 == 0, "legal").otherwise(F.col("domain")))
    return Q.contract_violations(rows, ["general", "legal"]).select("doc_id", F.array_join("violations", ",").alias("violations"))


@query("a24_dataset_summary", f"WITH r AS ({_RECORD}) SELECT grp, count(*) AS n, round(avg(CAST(is_answerable AS INTEGER)), 6) AS answerable FROM (SELECT is_answerable, unnest(['all', 'domain ' || domain, 'source ' || source]) AS grp FROM r) GROUP BY grp")
def a24(spark, sf_dir):
    return R.summary_counts(_records(spark, sf_dir))


@query("a25_by_question", "SELECT CAST(doc_id // 5 AS BIGINT) AS question_id, list(doc_id ORDER BY doc_id) AS example_ids FROM documents GROUP BY 1")
def a25(spark, sf_dir):
    return R.by_question(documents(spark, sf_dir).select(F.floor(F.col("doc_id") / 5).alias("question_id"), F.col("doc_id").alias("example_id")))


@query("p13_options", "SELECT item_id, regexp_replace('(B) ' || text, '^\\s*[\\(\\[]?[A-Da-d][\\)\\].:\\-]\\s*', '') AS option, CASE item_id % 3 WHEN 0 THEN 'one' WHEN 1 THEN 'three' ELSE 'four' END AS gold FROM benchmark")
def p13(spark, sf_dir):
    options = F.array(*map(F.lit, ("one", "two", "three", "four")))
    labels = [F.expr("CASE item_id % 3 WHEN 0 THEN '0' WHEN 1 THEN '9' ELSE NULL END"), F.expr("CASE item_id % 3 WHEN 1 THEN 'C' WHEN 2 THEN 'd' ELSE 'B' END")]
    return table(spark, sf_dir, "benchmark").select("item_id", Q.strip_option(F.concat(F.lit("(B) "), "text")).alias("option"), Q.gold_option(options, labels).alias("gold"))


@query("p15_clause_title", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lower(trim(source)) ELSE 'unknown' END AS title FROM documents")
def p15(spark, sf_dir):
    q = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('Find " '), F.upper("source"), F.lit(' " and "other".'))).otherwise("No quotes")
    return documents(spark, sf_dir).select("doc_id", Q.clause_title(q).alias("title"))


@query("p16_flatten_paper", "SELECT doc_id, array_to_string(list_filter([source, substring(text, 1, 50), 'Intro', substring(text, 51, 50), 'Rest', substring(text, 101, 50)], lambda x: trim(x) <> ''), chr(10) || chr(10)) AS text FROM documents")
def p16(spark, sf_dir):
    part = lambda a: F.array(F.substring("text", a, 50))
    return documents(spark, sf_dir).select("doc_id", Q.flatten_paper(F.col("source"), F.substring("text", 1, 50), F.array(F.lit("Intro"), F.lit("Rest")), F.array(part(51), part(101))).alias("text"))


@query("p17_answer_type", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'abstractive' WHEN 1 THEN 'extractive' WHEN 2 THEN 'boolean' ELSE 'abstractive' END AS kind FROM documents")
def p17(spark, sf_dir):
    m = F.col("doc_id") % 4
    spans = F.when(m == 1, F.array(F.substring("text", 1, 9))).otherwise(F.array().cast("array<string>"))
    return documents(spark, sf_dir).select("doc_id", Q.answer_type(m == 0, spans, F.when(m == 2, F.lit(True))).alias("kind"))


@query("m10_qa_records", f"WITH r AS ({_RECORD}) SELECT domain, count(*) AS n_read, count_if(is_answerable AND instr(context, answer_text) <> answer_start + 1) AS n_moved, count_if(length(context) < 200) AS n_short FROM r GROUP BY domain")
def m10(spark, sf_dir):
    rows = _records(spark, sf_dir)
    moved = F.col("is_answerable") & (F.instr(F.col("context"), F.col("answer_text")) != F.col("answer_start") + 1)
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n_read"), F.count_if(moved).alias("n_moved"), F.count_if(F.length("context") < 200).alias("n_short"))


_TURNS = "SELECT conv_id, turn, text AS question, list(text) OVER w AS history FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)"


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))


@query("w9_history_window", f"SELECT conv_id, turn, question, array_to_string(list_concat([question], coalesce(history, [])), ' ') AS query FROM ({_TURNS})")
def w9(spark, sf_dir):
    return memory.with_history(_turns(spark, sf_dir)).select("conv_id", "turn", "question", F.btrim("query").alias("query"))


#: Minutes between turns of a conversation: after some, it has been idle for over an hour. A turn's passage is the text before it; every fifth finds none, every seventh no span.
_GAP = "turn * 7 + CASE WHEN turn >= 4 AND conv_id % 3 = 0 THEN 90 ELSE 0 END"
_PASSAGE = "CASE WHEN (conv_id + turn) % 5 = 0 THEN NULL ELSE substring(text, 20, 200) END"
_SPAN = "CASE WHEN (conv_id + turn) % 7 = 0 THEN '' ELSE substring(text, 30, 25) END"
_ASKED = "CASE WHEN turn % 4 = 2 THEN concat('When: ', substring(text, 1, 60)) ELSE substring(text, 1, 60) END"
_OUTCOMES = f"""t AS (SELECT conv_id, turn, {_GAP} AS mi, {_ASKED} AS question, {_PASSAGE} AS passage, {_SPAN} AS span FROM conversations WHERE role = 'user'),
o AS (SELECT *, coalesce(passage, '') <> '' AND coalesce(span, '') <> '' AS remembered FROM t),
a AS (SELECT *, CASE WHEN NOT remembered OR (CASE WHEN regexp_matches(lower(question), 'price|cost|amount') THEN NOT regexp_matches(lower(passage), '\\$|usd|rs|rupees|price|amount') WHEN contains(lower(question), 'when') THEN NOT regexp_matches(lower(passage), 'year|month|day|202|203') ELSE false END) THEN 'not found' ELSE span END AS answer FROM o),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY mi, turn) AS sitting FROM (SELECT *, CASE WHEN mi - lag(mi) OVER (PARTITION BY conv_id ORDER BY mi, turn) > 60 THEN 1 ELSE 0 END AS fresh FROM a))"""


@query(
    "x1_streamed_memory",
    f"""WITH {_OUTCOMES}, m AS (SELECT x.conv_id, x.turn, list(y.question ORDER BY y.mi DESC, y.turn DESC) AS q, list(y.answer ORDER BY y.mi DESC, y.turn DESC) AS r FROM g x JOIN g y ON x.conv_id = y.conv_id AND x.sitting = y.sitting AND y.remembered AND (y.mi, y.turn) < (x.mi, x.turn) GROUP BY 1, 2)
SELECT g.conv_id, g.turn, g.question, g.answer, array_to_string(list_concat([g.question], list_reverse(coalesce(q[1:2], []))), ' ') AS query, array_to_string(list_reverse(coalesce(q[1:3], [])), '|') AS asked, array_to_string(list_reverse(coalesce(r[1:3], [])), '|') AS answered FROM g LEFT JOIN m ON g.conv_id = m.conv_id AND g.turn = m.turn""",
)
def x1(spark, sf_dir):
    """Each turn's memory as the stream writes it: turns are dealt over three micro-batches out of order, and a tick lets the last ones out."""
    folder = _folder(spark, "x1")
    ts = F.timestamp_seconds(F.expr(_GAP) * 60 + 1_000_000)
    users = table(spark, sf_dir, "conversations").where("role = 'user'")
    turns = memory.with_outcomes(users.select("conv_id", "turn", ts.alias("ts"), F.expr(_ASKED).alias("question"), F.expr(_PASSAGE).alias("passage"), F.expr(_SPAN).alias("span")))
    turns = turns.withColumn("part", F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)))
    tick = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.timestamp_seconds(F.lit(4e9)).alias("ts"), F.lit("").alias("question"), F.lit("").alias("answer"), F.lit(False).alias("remembered"))
    for k in range(3):
        turns.where(F.col("part") == k).drop("part").coalesce(1).write.parquet(f"{folder}-in/part{k}")
    tick.coalesce(1).write.parquet(f"{folder}-in/tick")
    stream = spark.readStream.schema(turns.drop("part").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}-in")
    with memory.state_store(spark):
        memory.stream_with_memory(stream, "1 day", 3_600_000).writeStream.format("parquet").option("path", f"{folder}-out").option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start().awaitTermination()
    joined = lambda f: F.array_join(F.transform("memory", lambda m: m[f]), "|")
    return spark.read.schema(memory.REMEMBERED).parquet(f"{folder}-out").where("conv_id >= 0").select("conv_id", "turn", "question", "answer", "query", joined("question").alias("asked"), joined("answer").alias("answered"))


@query("x2_streamed_documents", "SELECT doc_id, source, md5(text) AS text_md5 FROM documents WHERE doc_id IN (SELECT conv_id FROM conversations)")
def x2(spark, sf_dir):
    """Documents that conversations name, picked out of large maps that a stream reads: it stops halfway and goes on from its offset."""
    folder = _folder(spark, "x2")
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("key"), F.to_json(F.struct("source", "text")).alias("json"))
    files = J.write_maps(docs, f"{folder}-in")
    needed = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("key"))
    ranges = J.count_ranges(files, 1 << 20)
    for first, last in ((0, ranges // 2), (ranges // 2, ranges)):
        if first == last:
            continue
        J.index_maps(spark, files, f"{folder}-index", 1 << 20, first, last)
        wanted = memory.needed_documents(J.large_maps(spark, f"{folder}-index", stream=True), needed, "key")
        query = wanted.writeStream.format("parquet").option("path", f"{folder}-out").option("checkpointLocation", f"{folder}-state").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    found = spark.read.schema(J.SCHEMA).parquet(f"{folder}-out").select("key", F.from_json("value", "source string, text string").alias("v"))
    return found.select(F.col("key").cast("long").alias("doc_id"), "v.source", F.md5("v.text").alias("text_md5"))


@query("a23_dialogue_metrics", f"""WITH u AS ({_TURNS}), r AS (SELECT conv_id, turn, len(coalesce(history, [])) AS lookback, CAST(conv_id * 31 + turn * 17 AS BIGINT) % 10 / 10.0 AS f1_with, CAST(conv_id * 13 + turn * 7 AS BIGINT) % 10 / 10.0 AS f1_without FROM u)
SELECT count(DISTINCT conv_id) AS n_dialogues, count(*) AS n_turns, round(count_if(f1_with > 0.4 AND lookback >= 1) / greatest(count_if(lookback >= 1), 1), 6) AS resolution, round(count_if(f1_with + 1e-6 < f1_without) / count(*), 6) AS drift, round(count_if(f1_with > 0.4 AND lookback >= 2) / greatest(count_if(lookback >= 2), 1), 6) AS depth_accuracy FROM r""")
def a23(spark, sf_dir):
    from ..operators import metrics as M

    rows = memory.with_history(_turns(spark, sf_dir)).select(F.col("conv_id").alias("dialogue_id"), F.size("history").alias("lookback"), ((F.col("conv_id") * 31 + F.col("turn") * 17) % 10 / 10.0).alias("f1_with"), ((F.col("conv_id") * 13 + F.col("turn") * 7) % 10 / 10.0).alias("f1_without"))
    return M.dialogue_report(rows)
