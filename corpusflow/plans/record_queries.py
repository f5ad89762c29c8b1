"""Queries of the record builders, set operations, plug points and remaining joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon
from ..functions import text as T
from ..operators import align as A
from ..operators import chunks as C
from ..operators import features as X
from ..operators import metrics as M
from ..operators import qa as Q
from ..operators import records as R
from ..operators import sampling as S
from ..operators import textrank as K
from ..sources import readers
from .eval_queries import _BOUNDS, _GENERATION, _PRED, _SCORED, _SUM, _TERM, OUTCOMES_SQL, TERMS_SQL, predictions, summaries
from .registry import query, table
from .scratch import Scratch
from .set_queries import OTHER_SQL, QA_SQL, qa_rows
from .text_queries import _CONTENT, _LEGAL_SENTENCES, _OFFSETS, _SECTIONS, _STARTS, _WORDS, _chunk_sql, _sentences_sql, documents, legal


@query("p18_evidence_records", """WITH e AS (SELECT doc_id, substring(text, 1, 40) AS question, CASE WHEN doc_id % 3 = 0 THEN source ELSE substring(text, 61, 20) END AS answer_text, CASE WHEN doc_id % 2 = 0 THEN text ELSE substring(text, 1, 100) END AS context FROM documents)
SELECT *, CASE WHEN answer_text <> '' AND context <> '' THEN instr(context, answer_text) - 1 ELSE -1 END AS answer_start, answer_text <> '' AND context <> '' AND instr(context, answer_text) > 0 AS is_answerable, 'general' AS domain FROM e""")
def p18(spark, sf_dir):
    none = F.array().cast("array<string>")
    even, third = F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0
    rows = documents(spark, sf_dir).select("doc_id", F.substring("text", 1, 40).alias("question"), F.when(third, "").otherwise(F.substring("text", 61, 20)).alias("value"), F.array("source").alias("aliases"), F.when(even, F.array("text")).otherwise(none).alias("search_context"), F.array(F.substring("text", 1, 100)).alias("page_context"))
    rows = rows.withColumn("value", F.when(third | (F.col("value") != ""), F.col("value")).otherwise("~")).withColumn("aliases", F.when(F.col("value") == "~", F.array(F.lit(""))).otherwise(F.col("aliases"))).withColumn("value", F.when(F.col("value") == "~", "").otherwise(F.col("value")))
    return R.from_evidence(rows)


@query("p19_answer_records", "SELECT doc_id, substring(text, 1, 60) AS question, text AS context, CASE WHEN doc_id % 4 = 0 THEN '' ELSE substring(text, 41, 30) END AS answer_text, CASE WHEN doc_id % 4 = 0 THEN -1 ELSE 40 END AS answer_start, doc_id % 4 <> 0 AS is_answerable, 'general' AS domain FROM documents")
def p19(spark, sf_dir):
    has = F.col("doc_id") % 4 != 0
    answers = F.struct(F.when(has, F.array(F.substring("text", 41, 30))).otherwise(F.array().cast("array<string>")).alias("text"), F.when(has, F.array(F.lit(40))).otherwise(F.array().cast("array<int>")).alias("answer_start"))
    return R.from_answers(documents(spark, sf_dir).select("doc_id", F.substring("text", 1, 60).alias("question"), F.col("text").alias("context"), answers.alias("answers")))


@query("p20_open_questions", "SELECT doc_id, substring(text, 1, 60) AS question, source AS context, source AS answer_text, 0 AS answer_start, true AS is_answerable, 'general' AS domain FROM documents WHERE doc_id % 5 <> 0 AND text <> ''")
def p20(spark, sf_dir):
    answers = F.when(F.col("doc_id") % 5 != 0, F.array("source", "text")).otherwise(F.array().cast("array<string>"))
    return R.from_open_questions(documents(spark, sf_dir).select("doc_id", F.substring("text", 1, 60).alias("question"), answers.alias("answer")))


@query("p21_default_records", "SELECT substring(text, 1, 20) AS question, text AS context, '' AS answer_text, -1 AS answer_start, false AS is_answerable, 'legal' AS domain, 'local' AS source, 'local_' || item_id AS doc_id, 'local_' || item_id AS question_id, 0 AS chunk_idx, 1 AS n_chunks FROM benchmark")
def p21(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 20).alias("question"), F.col("text").alias("context"))
    return R.with_defaults(rows, "local", "item_id")


@query("p24_label_names", "SELECT doc_id, CASE quality WHEN 1 THEN 'good' ELSE CAST(quality AS VARCHAR) END AS label_name FROM labels")
def p24(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return R.label_names(rows, spark.sql("SELECT 1 AS label, 'good' AS name")).select("doc_id", "label_name")


@query(
    "m10_chunked_records",
    _OFFSETS
    + """, a AS (SELECT *, doc_id % 4 <> 0 AND 40 >= char_start AND 40 + length(substring(text, 41, 30)) <= char_end AS inside FROM c)
SELECT doc_id, CAST(chunk_idx AS INTEGER) AS chunk_idx, CAST(1 + greatest(0, CAST(ceil((n - 400) / 350.0) AS INTEGER)) AS INTEGER) AS n_chunks, CAST(CASE WHEN inside THEN 40 - char_start ELSE -1 END AS INTEGER) AS answer_start, inside AS is_answerable, md5(substring(text, char_start + 1, char_end - char_start)) AS context_md5 FROM a""",
)
def m10c(spark, sf_dir):
    return R.with_chunks(p19(spark, sf_dir), "doc_id").select("doc_id", "chunk_idx", "n_chunks", "answer_start", "is_answerable", F.md5("context").alias("context_md5"))


@query("m10_drop_reasons", "SELECT domain, reason, count(*) AS n FROM (SELECT CASE doc_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS domain, CASE WHEN length(text) < 200 THEN 'short' WHEN doc_id % 4 = 0 THEN 'unanswerable' ELSE 'kept' END AS reason FROM documents) GROUP BY 1, 2")
def m10d(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("domain", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"))
    reasons = {"short": F.length("text") < 200, "unanswerable": F.col("doc_id") % 4 == 0}
    return R.write_kept(rows, reasons, "domain", ["even", "odd"], f"{Scratch(spark, 'm10').root}/kept")


@query("j4_evaluation_join", "SELECT item_id AS test_id, text AS generated, coalesce(l.quality, -1) AS quality FROM benchmark b LEFT JOIN labels l ON l.doc_id = b.item_id")
def j4(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), "quality")
    return table(spark, sf_dir, "benchmark").join(labels, "item_id", "left").select(F.col("item_id").alias("test_id"), F.col("text").alias("generated"), F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("j13_kept_ratings", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN NULL ELSE l.quality + 1 END AS rating FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY md5('7:' || d.doc_id), d.doc_id LIMIT 30")
def j13(spark, sf_dir):
    sample = S.first_n(documents(spark, sf_dir).select("doc_id"), 30, 7, "doc_id")
    earlier = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 1).alias("rating"))
    return sample.join(earlier, "doc_id", "left")


@query("j8_other_document", f"WITH {OTHER_SQL} SELECT doc_id, other_doc FROM o")
def j8(spark, sf_dir):
    return S.other_document(documents(spark, sf_dir), "doc_id", 42)


@query("w11_final_scores", _PRED + " SELECT example_id, round(CASE WHEN example_id % 11 = 0 THEN 0 ELSE has_answer_prob / (1 + exp(-(CAST(example_id % 13 AS DOUBLE) - 6) / 10)) END, 6) AS final FROM p")
def w11(spark, sf_dir):
    end = F.when(F.col("example_id") % 11 == 0, 0).otherwise(5)
    return predictions(spark, sf_dir).select("example_id", F.round(Q.final_score(F.col("has_answer_prob"), (F.col("example_id") % 13).cast("double") - 6, F.lit(0), end), 6).alias("final"))


@query("w13_source_shares", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY source) AS size FROM documents WHERE source IN ('src0', 'src1')) WHERE n <= CASE source WHEN 'src0' THEN least(size, 8) ELSE 12 END")
def w13(spark, sf_dir):
    return S.quota_rows(documents(spark, sf_dir).select("doc_id", "source"), {"src0": int(20 * 0.4), "src1": 20 - int(20 * 0.4)}, "source", "doc_id")


@query("m5_resolved_mix", "WITH m AS (SELECT unnest(['src0', 'src1', 'absent']) AS source, unnest([0.5, 0.3, 0.2]) AS share), h AS (SELECT * FROM m WHERE source IN (SELECT source FROM documents)) SELECT source, round(share / sum(share) OVER (), 6) AS share FROM h")
def m5(spark, sf_dir):
    sizes = documents(spark, sf_dir).where(F.col("source").isin("src0", "src1", "absent")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    mix = spark.sql("SELECT stack(3, 'src0', 0.5D, 'src1', 0.3D, 'absent', 0.2D) AS (source, share)")
    held = mix.join(sizes, "source").select("source", "share")
    return held.select("source", F.round(F.col("share") / F.sum("share").over(Window.partitionBy(F.lit(1))), 6).alias("share"))


@query("u1_union_all", "SELECT 'documents' AS origin, doc_id AS id, source, md5(text) AS text_md5 FROM documents UNION ALL SELECT 'benchmark', item_id, NULL, md5(text) FROM benchmark")
def u1(spark, sf_dir):
    a = documents(spark, sf_dir).select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "source", F.md5("text").alias("text_md5"))
    b = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"), F.md5("text").alias("text_md5"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u2_shared_ids", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def u2(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


@query("u3_added_terms", _PRED + f" SELECT example_id, len(list_filter({_TERM['time'].format('extracted_span')}, lambda x: NOT list_contains({_TERM['time'].format('gold')}, x))) AS n_added FROM p")
def u3(spark, sf_dir):
    of = lambda c: T.legal_terms(F.col(c))["time"]
    return predictions(spark, sf_dir).select("example_id", F.size(F.array_except(of("extracted_span"), of("gold"))).cast("long").alias("n_added"))


@query("f8_lcs_length")
def f8(spark, sf_dir):
    # A text against an extract of it: every second sentence, from the last to the first.
    every = T.sentences(F.col("text"), [], 0)
    extract = F.reverse(F.filter(every, lambda s, k: k % 2 == 0))
    rows = documents(spark, sf_dir).select("doc_id", T.words(F.col("text")).alias("a"), T.words(F.array_join(extract, " ")).alias("b"))
    return rows.select("doc_id", T.lcs_length(F.col("a"), F.col("b")).alias("n"))


@query("f9_safe_rates", "SELECT source, round(CASE WHEN count_if(doc_id % 20 = 1) = 0 THEN 0 ELSE count_if(doc_id % 40 = 1) / count_if(doc_id % 20 = 1) END, 6) AS rate FROM documents GROUP BY source")
def f9(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("source").agg(F.round(T.safe_divide(F.count_if(F.col("doc_id") % 40 == 1), F.count_if(F.col("doc_id") % 20 == 1)), 6).alias("rate"))


@query("t13_section_sentences", f"WITH {_SECTIONS}, {_STARTS} SELECT DISTINCT doc_id, sent_idx FROM st")
def t13(spark, sf_dir):
    texts = legal(spark, sf_dir).select("doc_id", "text")
    return C.section_starts(texts).where("starts_section").select("doc_id", "sent_idx")


@query(
    "t7_sentence_sections",
    f"""WITH {_SECTIONS}, {_LEGAL_SENTENCES}, p AS (SELECT doc_id, sent_idx, greatest(instr(text, substring(sentence, 1, 60)), instr(text, substring(sentence, 1, 40)), 1) - 1 AS place FROM snt)
SELECT p.doc_id, p.sent_idx, CAST(count(s) - 1 AS INTEGER) AS section FROM p LEFT JOIN sec ON sec.doc_id = p.doc_id AND s <= place GROUP BY p.doc_id, p.sent_idx""",
)
def t7(spark, sf_dir):
    texts = C.sections(legal(spark, sf_dir).select("doc_id", "text"), keep=("text",))
    sentences = T.sentences(F.col("text"), lexicon.LEGAL_ABBREVIATIONS, 0)
    return texts.select("doc_id", F.posexplode(K.sentence_sections(F.col("text"), sentences, F.col("sections"))).alias("sent_idx", "section"))


@query("t24_batch_rows", "SELECT d.doc_id, count(*) AS times, md5(any_value(d.text)) AS text_md5 FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS r, count(*) OVER (PARTITION BY source) AS size FROM documents WHERE source IN ('src0', 'src1')) b JOIN documents d ON d.doc_id = b.doc_id WHERE r <= size // 4 * 4 AND r <= (SELECT min(c) FROM (SELECT count(*) // 4 AS c FROM documents WHERE source IN ('src0', 'src1') GROUP BY source)) * 4 GROUP BY 1")
def t24(spark, sf_dir):
    docs = documents(spark, sf_dir)
    plan = S.mixed_batches(docs, {"src0": 4, "src1": 4}, "source", "doc_id", 42)
    rows = plan.join(docs.select(F.col("doc_id").alias("key"), "text"), "key")
    return rows.groupBy(F.col("key").alias("doc_id")).agg(F.count(F.lit(1)).alias("times"), F.md5(F.first("text")).alias("text_md5"))


@query("t25_decoded_spans", f"""WITH t AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), v AS (SELECT x AS token, count(*) AS n FROM (SELECT unnest(w) AS x FROM t) GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, token LIMIT 5000)
SELECT doc_id, string_agg(coalesce(v.token, '<unk>'), ' ' ORDER BY i) AS span FROM (SELECT doc_id, i, w[i] AS x FROM (SELECT *, unnest(range(4, 10)) AS i FROM t WHERE len(w) >= 9)) s LEFT JOIN v ON v.token = s.x GROUP BY doc_id""")
def t25(spark, sf_dir):
    """Ids of a span of word tokens looked up in their vocabulary again."""
    tokens = documents(spark, sf_dir).select("doc_id", F.posexplode(T.words(F.col("text"))).alias("pos", "token"))
    vocab = X.vocabulary(tokens.select("token"), 5000)
    ids = X.encode(tokens.where("pos between 3 and 8"), vocab, ["doc_id"]).where("size(ids) = 6").select("doc_id", F.posexplode("ids").alias("pos", "id"))
    words = ids.join(vocab.select("id", "token"), "id", "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("token", F.lit("<unk>")).alias("token")))).alias("w"))
    return words.select("doc_id", F.array_join(F.transform("w", lambda x: x["token"]), " ").alias("span"))


@query("p22_domain_marker", f"SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN least(len({_WORDS.format('text')}), 399) + 1 ELSE least(len({_WORDS.format('text')}), 399) END AS n_ids, source IN ('src0', 'src1') AS marked FROM documents")
def p22(spark, sf_dir):
    ids = F.transform(T.words(F.col("text")), lambda w: F.lit(9))
    rows = documents(spark, sf_dir).select("doc_id", X.with_domain_marker(ids, F.col("source"), ["src0", "src1"]).alias("i"))
    return rows.select("doc_id", F.size("i").cast("long").alias("n_ids"), (F.get("i", F.lit(0)) == X.DOMAIN).alias("marked"))


@query("t21_inference_features", QA_SQL + " SELECT doc_id, input_ids, segment_ids, attention_mask FROM f")
def t21(spark, sf_dir):
    """The features of questions whose answers are not known."""
    rows = qa_rows(spark, sf_dir).withColumn("answer_start", F.lit(-1))
    return X.qa_features(rows).select("doc_id", *[F.array_join(c, " ").alias(c) for c in ("input_ids", "segment_ids", "attention_mask")])


@query("a3_legal_validation", _SCORED + """ SELECT count(*) AS n, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1, count_if(l) AS n_legal, round(CASE WHEN count_if(l AND NOT is_answerable) = 0 THEN 0 ELSE count_if(l AND NOT is_answerable AND has_answer_prob > 0.5) / count_if(l AND NOT is_answerable) END, 6) AS legal_fpr,
round(avg(CASE WHEN l THEN w END), 6) AS mean_length_legal, round(avg(CASE WHEN NOT l THEN w END), 6) AS mean_length_general FROM (SELECT *, example_id % 2 = 0 AS l, len(regexp_extract_all(predicted_answer, '\\S+')) AS w FROM s)""")
def a3(spark, sf_dir):
    legal_row, said = F.col("example_id") % 2 == 0, F.col("has_answer_prob") > 0.5
    n = T.word_count(F.col("predicted_answer"))
    r = lambda c, name: F.round(c, 6).alias(name)
    none = legal_row & ~F.col("is_answerable")
    return M.scored(predictions(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"), r(F.avg("em"), "em"), r(F.avg("f1"), "f1"), F.count_if(legal_row).alias("n_legal"), r(T.safe_divide(F.count_if(none & said), F.count_if(none)), "legal_fpr"), r(F.avg(F.when(legal_row, n)), "mean_length_legal"), r(F.avg(F.when(~legal_row, n)), "mean_length_general"))


def _extracts(spark, sf_dir):
    """Documents with a summary that Spark derives: every third sentence of the whole text."""
    every = T.sentences(F.col("text"), lexicon.GENERAL_ABBREVIATIONS, 5)
    return documents(spark, sf_dir).select("doc_id", "text", F.array_join(F.filter(every, lambda s, k: k % 3 == 0), " ").alias("summary"))


_SUMMARY_SENTENCES = lambda text: T.sentences(text, lexicon.GENERAL_ABBREVIATIONS, 5)
_PAIRS = rf"""d AS (SELECT doc_id, text AS body, array_to_string(list_filter(s, lambda x, i: (i - 1) % 3 = 0), ' ') AS text FROM (SELECT doc_id, text, {_sentences_sql(lexicon.GENERAL_ABBREVIATIONS, 5)} AS s FROM documents)),
fit AS (SELECT * FROM d WHERE len(regexp_extract_all(body, '\S+')) >= 50 AND len(regexp_extract_all(text, '\S+')) >= 10),
k AS (SELECT doc_id, chunk_idx AS chunk_i, chunk FROM ({_chunk_sql(1_000_000).replace('FROM documents', 'FROM (SELECT doc_id, body AS text FROM fit)')})),
s AS (SELECT doc_id, i - 1 AS sent_idx, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_sentences_sql(lexicon.GENERAL_ABBREVIATIONS, 5)} AS s FROM fit)))"""
_BEST = ", rk AS (SELECT sims.*, sentence, row_number() OVER (PARTITION BY sims.doc_id, chunk_i ORDER BY sim DESC, sims.sent_idx) AS n FROM sims JOIN s ON s.doc_id = sims.doc_id AND s.sent_idx = sims.sent_idx), al AS (SELECT doc_id, chunk_i, string_agg(sentence, ' ' ORDER BY sent_idx) AS target, round(max(sim), 4) AS score FROM rk WHERE n <= 3 GROUP BY 1, 2 HAVING max(sim) >= 0.25)"
#: Vectors of 64 buckets, at length one; a chunk meets all of its document's sentences, also those that share no bucket with it.
_HASHED = "(SELECT {0}, list_transform(n, lambda c: CASE WHEN list_sum(n) > 0 THEN c / sqrt(list_sum(list_transform(n, lambda e: e * e))) ELSE 0 END) AS x FROM (SELECT {0}, list_transform(range(0, 64), lambda k: CAST(len(list_filter(b, lambda e: e = k)) AS DOUBLE)) AS n FROM (SELECT {0}, list_transform({1}, lambda w: CAST('0x' || substring(md5(w), 1, 8) AS BIGINT) % 64) AS b FROM {2})))"


@query(
    "r8_vector_alignment",
    f"WITH {_PAIRS}, va AS {_HASHED.format('doc_id, chunk_i', _CONTENT.format('chunk'), 'k')}, vb AS {_HASHED.format('doc_id, sent_idx', _CONTENT.format('sentence'), 's')}, sims AS (SELECT va.doc_id, chunk_i, sent_idx, floor(list_sum(list_transform(range(1, 65), lambda k: va.x[k] * vb.x[k])) * 1e12 + 0.5) / 1e12 AS sim FROM va JOIN vb ON va.doc_id = vb.doc_id){_BEST} SELECT * FROM al",
)
def r8(spark, sf_dir):
    """Chunks and sentences aligned by plug-in vectors."""
    return R.summarisation_set(_extracts(spark, sf_dir), _SUMMARY_SENTENCES, lambda rows: A.vector_similarities(rows.select("doc_id", "sentences", *[R.hashed_vectors(F.col(c)).alias(f"{c[:-1]}_vectors") for c in ("parts", "sentences")])))[0]


@query(
    "m11_summarisation_stats",
    f"""WITH {_PAIRS}, ca AS (SELECT doc_id, chunk_i, list_distinct({_CONTENT.format('chunk')}) AS x FROM k), cb AS (SELECT doc_id, sent_idx, list_distinct({_CONTENT.format('sentence')}) AS y FROM s),
sims AS (SELECT ca.doc_id, chunk_i, sent_idx, CASE WHEN len(y) > 0 THEN len(list_intersect(x, y)) / len(y) ELSE 0.0 END AS sim FROM ca JOIN cb ON ca.doc_id = cb.doc_id){_BEST}
SELECT (SELECT count(DISTINCT doc_id) FROM k) AS papers, (SELECT count(*) FROM k) AS chunks, count(*) AS aligned, (SELECT count(*) FROM k) - count(*) AS filtered, round(100.0 * count(*) / greatest((SELECT count(*) FROM k), 1), 1) AS coverage, (SELECT count(*) FROM (SELECT doc_id FROM al GROUP BY 1 HAVING count(*) >= 2)) AS second_pass FROM al""",
)
def m11(spark, sf_dir):
    words = lambda c: F.transform(c, lambda x: T.content_words(x)).alias(f"{c[:-1]}_words")
    return R.summarisation_set(_extracts(spark, sf_dir), _SUMMARY_SENTENCES, lambda rows: A.similarities(rows.select("doc_id", "sentences", words("parts"), words("sentences")), "share"))[2]


@query("g1_rewritten_answers", _PRED + " SELECT example_id, CASE WHEN extracted_span = '' THEN '' ELSE 'In short: ' || extracted_span END AS predicted_answer FROM p")
def g1(spark, sf_dir):
    return R.rewritten(predictions(spark, sf_dir), lambda q, s: F.concat(F.lit("In short: "), s)).select("example_id", "predicted_answer")


_LONG = "SELECT '{0}' AS report, unnest([{1}]) AS metric, CAST(unnest([{2}]) AS DOUBLE) AS value FROM ({3})"


def _long(report: str, metrics: str, sql: str) -> str:
    names = metrics.split()
    return _LONG.format(report, ", ".join(f"'{m}'" for m in names), ", ".join(f'"{m}"' for m in names), sql)


_ALL_ANSWERS = _long("answers", "em f1", _SCORED + " SELECT round(avg(em), 6) AS em, round(avg(f1), 6) AS f1 FROM s")


@query(
    "g4_metric_registry",
    "SELECT report, metric, value, NULL AS error FROM ("
    + " UNION ALL ".join([_ALL_ANSWERS, _long("terms", "overall defined monetary time party", TERMS_SQL), _long("outcomes", "preservation inversion", OUTCOMES_SQL), _long("generation", "faithfulness simplification plain_grade span_grade information_preservation", _GENERATION)])
    + ") UNION ALL SELECT 'broken', NULL, NULL, 'AnalysisException'",
)
def g4(spark, sf_dir):
    """Reports of a metric registry as one long table; a metric that fails leaves its message."""
    pred, made = predictions(spark, sf_dir), summaries(spark, sf_dir)
    done, failed = M.run_metrics({
        "answers": lambda: M.em_f1(pred).where("grp = 'all'").drop("grp"), "terms": lambda: M.term_preservation(pred), "outcomes": lambda: M.outcome_report(made), "generation": lambda: M.generation_report(pred),
        "broken": lambda: made.select("no_such_column"), "skipped": lambda: made,
    }, skip=["skipped"])
    from ..sources.writers import merged_summary

    out = merged_summary(done).withColumn("error", F.lit(None).cast("string"))
    errors = [F.struct(F.lit(k).alias("report"), F.lit(v.split(":")[0]).alias("error")) for k, v in failed.items()]
    faults = spark.range(1).select(F.explode(F.array(*errors)).alias("e")).select("e.*")
    return out.unionByName(faults, allowMissingColumns=True)


@query("k4_report_files", _ALL_ANSWERS + " UNION ALL " + _long("boundaries", "full partial start_errors end_errors", _BOUNDS + """ SELECT avg(CASE WHEN s AND e THEN 1.0 ELSE 0.0 END) AS "full", avg(CASE WHEN s OR e THEN 1.0 ELSE 0.0 END) AS partial, count_if(NOT s) AS start_errors, count_if(NOT e) AS end_errors FROM b"""))
def k4(spark, sf_dir):
    from ..sources.writers import merged_summary, write_report

    pred = predictions(spark, sf_dir)
    root = Scratch(spark, "k4").root
    reports = {"answers": M.em_f1(pred).where("grp = 'all'").drop("grp"), "boundaries": M.boundary_report(pred).where("grp = 'all'").drop("grp")}
    for name, report in reports.items():
        write_report(report, f"{root}/{name}")
    return merged_summary({name: spark.read.json(f"{root}/{name}") for name in reports})


@query("s2_json_array", "SELECT item_id, md5(text) AS text_md5 FROM benchmark")
def s2(spark, sf_dir):
    root = Scratch(spark, "s2").root
    rows = table(spark, sf_dir, "benchmark").withColumn("bucket", F.floor(F.col("item_id") / 20))
    rows.groupBy("bucket").agg(F.to_json(F.collect_list(F.struct("item_id", "text"))).alias("value")).write.partitionBy("bucket").text(root)  # one array per file
    return readers.json_array(spark, root, "item_id long, text string", ["item_id", "text"]).select("item_id", F.md5("text").alias("text_md5"))


@query("s3_file_counts", "SELECT 'train' AS split, count(*) AS n FROM documents WHERE doc_id % 5 <> 0")
def s3(spark, sf_dir):
    root = Scratch(spark, "s3").root
    documents(spark, sf_dir).where("doc_id % 5 <> 0").select("doc_id", "source").coalesce(2).write.json(f"{root}/train.json")
    rows = readers.split_files(spark, root, "train", "doc_id long, source string", ["src0"])
    return readers.file_counts(rows).agg(F.sum("n").alias("n")).select(F.lit("train").alias("split"), "n")


@query("s15_column_resolution", "SELECT CAST(item_id AS VARCHAR) AS doc_id, text, substring(text, 5, 50) AS summary FROM benchmark")
def s15(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("document"), F.substring("text", 5, 50).alias("abstract"))
    return readers.document_pairs(rows, key="item_id")


