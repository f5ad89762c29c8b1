"""Queries of the evaluation operators over predictions derived from ``documents``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as T
from ..operators import align as A
from ..operators import metrics as M
from ..operators import phrases as H
from ..operators import qa as Q
from ..operators import spans as S
from .registry import query, table, view
from .text_queries import _CONTENT, _NORM, _PLAIN, _SYL, _WORDS, LEGAL, _sentences_sql, pattern_places_sql

#: Predictions whose spans are exact, shifted, empty, elsewhere or shortened; read alike by both engines.
PREDICTIONS = f"""
SELECT doc_id AS example_id, source, doc_id % 3 <> 0 AS is_answerable, CAST((doc_id * 37) % 101 AS DOUBLE) / 100 AS has_answer_prob, text AS document, substring(text, 1, 40 + CAST(doc_id % 30 AS INTEGER)) AS question,
  substring(text, length(text) - 330, 120) AS gold,
  CASE doc_id % 5 WHEN 0 THEN substring(text, length(text) - 330, 120) WHEN 1 THEN substring(text, length(text) - 320, 120) WHEN 2 THEN '' WHEN 3 THEN substring(text, length(text) - 160, 60) ELSE substring(text, length(text) - 330, 90) END AS extracted_span,
  CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'entirely other words stand here' ELSE substring(text, length(text) - 325, 110) END AS predicted_answer,
  CAST(doc_id % 5 AS INTEGER) - 1 AS gold_chunk_idx, CAST(doc_id % 4 AS INTEGER) AS best_chunk
FROM ({LEGAL}) AS legal
"""
#: In SQL place 0 lies before a text, so a substring from there is one character shorter than asked for; Spark begins at the first place instead.
_FROM_END = re.compile(r"substring\(text, length\(text\) - (\d+), (\d+)\)")
_PRED = f"WITH p AS ({PREDICTIONS.format(documents='documents')})"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, _FROM_END.sub(r"substring(text, length(text) - \1, \2 - CAST(length(text) = \1 AS INTEGER))", PREDICTIONS), "documents")
    return rows.withColumn("gold_answers", F.array("gold")).withColumn("retrieved", F.array("best_chunk", (F.col("best_chunk") + 1) % 4, (F.col("best_chunk") + 2) % 4))


_BAG = "coalesce(list_sum(list_transform(list_distinct({0}), lambda v: least(len(list_filter({0}, lambda x: x = v)), len(list_filter({1}, lambda x: x = v))))), 0)"
_F1 = f"CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) + len(b) = 0 THEN 0.0 ELSE 2.0 * {_BAG.format('a', 'b')} / (len(a) + len(b)) END"
_TOK = "list_filter(string_split({0}, ' '), lambda w: w <> '')"
_SCORED = _PRED + f""", n AS (SELECT *, {_NORM.format('predicted_answer')} AS np, {_NORM.format('gold')} AS ng, {_NORM.format('extracted_span')} AS ns FROM p),
t AS (SELECT *, {_TOK.format('np')} AS a, {_TOK.format('ng')} AS b FROM n), s AS (SELECT *, CASE WHEN np = ng THEN 1.0 ELSE 0.0 END AS em, {_F1} AS f1 FROM t)"""


@query("a1_em_f1", _SCORED + """ SELECT grp, count(*) AS n, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1 FROM (SELECT unnest(['all', 'source ' || source, 'answerable ' || CAST(is_answerable AS VARCHAR)]) AS grp, em, f1 FROM s) GROUP BY grp""")
def a1(spark, sf_dir):
    return M.em_f1(predictions(spark, sf_dir))


@query(
    "a2_validation",
    _SCORED + """ SELECT grp, count(*) AS n, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1, round(avg(CASE WHEN (has_answer_prob > 0.5) = is_answerable THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count_if(has_answer_prob > 0.5 AND NOT is_answerable) AS fp, count_if(has_answer_prob <= 0.5 AND is_answerable) AS fn, round(avg(len(a)), 6) AS mean_length FROM (SELECT unnest(['all', 'domain ' || CASE WHEN doc % 2 = 0 THEN 'legal' ELSE 'general' END]) AS grp, * FROM (SELECT *, example_id AS doc FROM s)) GROUP BY grp""",
)
def a2(spark, sf_dir):
    rows = M.scored(predictions(spark, sf_dir))
    said = F.col("has_answer_prob") > 0.5
    domain = F.when(F.col("example_id") % 2 == 0, "legal").otherwise("general")
    length = F.size(T.words(T.normalise_answer(F.col("predicted_answer"))))
    return M.breakdown(rows, {"domain": domain}, em=F.avg("em"), f1=F.avg("f1"), accuracy=F.avg((said == F.col("is_answerable")).cast("double")), fp=F.count_if(said & ~F.col("is_answerable")), fn=F.count_if(~said & F.col("is_answerable")), mean_length=F.avg(length))


_CELLS = """count_if(g AND d) AS tp, count_if(NOT g AND NOT d) AS tn, count_if(NOT g AND d) AS fp, count_if(g AND NOT d) AS fn"""
_RATES = """*, round(CASE WHEN tp + tn + fp + fn = 0 THEN 0 ELSE (tp + tn) / (tp + tn + fp + fn) END, 6) AS accuracy, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS tpr, round(CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END, 6) AS tnr,
round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END, 6) AS fpr, round(CASE WHEN fn + tp = 0 THEN 0 ELSE fn / (fn + tp) END, 6) AS fnr"""


@query("a4_confusion", _PRED + f" SELECT {_RATES} FROM (SELECT source, {_CELLS} FROM (SELECT source, is_answerable AS g, has_answer_prob >= 0.5 AND trim(extracted_span) <> '' AS d FROM p) GROUP BY source)")
def a4(spark, sf_dir):
    decided = (F.col("has_answer_prob") >= 0.5) & (F.btrim("extracted_span") != "")
    return M.confusion(predictions(spark, sf_dir), ["source"], decided)


_LEGAL_SOURCES = ["src0", "src1", "src2", "src3"]
_SWEEP = _PRED + f""", th AS (SELECT unnest({M.THRESHOLDS}) AS threshold), sw AS (SELECT {_RATES} FROM (SELECT grp, threshold, {_CELLS} FROM (SELECT grp, CAST(threshold AS DOUBLE) AS threshold, is_answerable AS g, has_answer_prob >= CAST(threshold AS DOUBLE) AND trim(extracted_span) <> '' AS d
FROM (SELECT *, unnest(CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN ['overall', 'legal'] WHEN source = 'src4' THEN ['overall', 'general'] ELSE ['overall'] END) AS grp FROM p), th) GROUP BY grp, threshold))"""


def _swept(spark, sf_dir):
    return M.sweep(predictions(spark, sf_dir), {"legal": _LEGAL_SOURCES, "general": ["src4"]})


@query("a5_calibration_sweep", _SWEEP + " SELECT * FROM sw")
def a5(spark, sf_dir):
    return _swept(spark, sf_dir)


@query("a6_recommended_threshold", _SWEEP + " SELECT coalesce(min(CASE WHEN fpr < 0.08 AND tpr > 0.75 THEN threshold END), arg_min(threshold, CASE WHEN tpr > 0.60 THEN fpr + threshold / 1e9 END)) AS threshold FROM sw WHERE grp = 'legal'")
def a6(spark, sf_dir):
    return M.recommended_threshold(_swept(spark, sf_dir))


_HEAD = r"regexp_matches(head, '(?i)^\s*(\([a-zA-Z0-9]+\)|\d+[\.\)]|Article\s+\w+|Section\s+\w+|§)')"


_BOUNDS = (
    _PRED + f""", f AS (SELECT source, document AS t, extracted_span AS x, instr(document, extracted_span) - 1 AS loc FROM p WHERE is_answerable AND extracted_span <> ''), h AS (SELECT *, list_last(string_split(substring(t, 1, loc), chr(10))) || substring(t, loc + 1, 1) AS head, substring(t, loc, 1) AS before, substring(t, loc + length(x), 1) AS last, substring(t, loc + length(x) + 1, 1) AS after FROM f WHERE loc >= 0),
b AS (SELECT source, loc <= 0 OR before IN ('.', ';', ':', chr(10)) OR {_HEAD} AS s, loc + length(x) >= length(t) OR last IN ('.', ';', ':', chr(10)) OR after IN ('.', ';', ':', chr(10)) AS e FROM h)"""
)


@query(
    "a9_clause_boundaries",
    _BOUNDS + """ SELECT grp, count(*) AS n, round(avg(CASE WHEN s AND e THEN 1.0 ELSE 0.0 END), 6) AS "full", round(avg(CASE WHEN s OR e THEN 1.0 ELSE 0.0 END), 6) AS partial, count_if(NOT s) AS start_errors, count_if(NOT e) AS end_errors FROM (SELECT unnest(['all', 'source ' || source]) AS grp, s, e FROM b) GROUP BY grp""",
)
def a9(spark, sf_dir):
    return M.boundary_report(predictions(spark, sf_dir))


_TERM = {
    "defined": r"list_distinct(regexp_extract_all({0}, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b'))",
    "monetary": r"list_distinct(list_transform(regexp_extract_all({0}, '(?i)\$[0-9][\d,]*(?:\.\d+)?|\b\d[\d,]*\s*(?:dollars?|USD|cents?)\b'), lambda x: lower(x)))",
    "time": r"list_distinct(list_transform(regexp_extract_all({0}, '(?i)\b\d+\s*(?:days?|weeks?|months?|years?|hours?|minutes?)\b'), lambda x: lower(x)))",
    "party": r"list_distinct(list_filter(regexp_extract_all(lower({0}), '\b\w+\b'), lambda w: list_contains([" + ", ".join(f"'{w}'" for w in lexicon.PARTY_WORDS) + "], w)))",
}
_KEPT = ", ".join(f"CASE WHEN len({t.format('gold')}) > 0 THEN len(list_intersect({t.format('gold')}, {t.format('extracted_span')})) / len({t.format('gold')}) END AS {'c_' + k}" for k, t in _TERM.items())


TERMS_SQL = (
    _PRED + f""", k AS (SELECT {_KEPT} FROM p WHERE is_answerable AND extracted_span <> ''), o AS (SELECT *, list_avg(list_filter([c_defined, c_monetary, c_time, c_party], lambda x: x IS NOT NULL)) AS o FROM k)
SELECT count(o) AS n, round(coalesce(avg(o), 0), 6) AS overall, round(coalesce(avg(c_defined), 0), 6) AS defined, round(coalesce(avg(c_monetary), 0), 6) AS monetary, round(coalesce(avg(c_time), 0), 6) AS "time", round(coalesce(avg(c_party), 0), 6) AS party,
count(c_defined) AS n_defined, count(c_monetary) AS n_monetary, count(c_time) AS n_time, count(c_party) AS n_party FROM o"""
)


@query("a10_term_preservation", TERMS_SQL)
def a10(spark, sf_dir):
    return M.term_preservation(predictions(spark, sf_dir))


_BOW = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}_]+'))"


@query("f6_word_overlap", _PRED + f" SELECT example_id, round(CASE WHEN len({_BOW.format('predicted_answer')}) = 0 THEN 1 ELSE len(list_intersect({_BOW.format('predicted_answer')}, {_BOW.format('extracted_span')})) / len({_BOW.format('predicted_answer')}) END, 6) AS overlap FROM p")
def f6(spark, sf_dir):
    return predictions(spark, sf_dir).select("example_id", F.round(T.word_overlap(F.col("extracted_span"), F.col("predicted_answer")), 6).alias("overlap"))


def _ease_parts(text: str, name: str) -> str:
    """Words, their syllables and sentences of a text, as three columns."""
    w = f"list_transform(list_filter(regexp_extract_all({text}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: regexp_matches(x, '^[a-zA-Z]+$')), lambda x: lower(x))"
    return f"len({w}) AS {name}_k, coalesce(list_sum(list_transform({w}, lambda w: {_SYL})), 0) AS {name}_y, len(list_filter(string_split_regex({text}, '[.!?]+'), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13)) <> '')) AS {name}_n"


def _ease(name: str) -> str:
    return f"CASE WHEN {name}_k = 0 OR {name}_n = 0 THEN 0 ELSE 206.835 - 1.015 * ({name}_k / {name}_n) - 84.6 * ({name}_y / {name}_k) END AS {name}_ease"


_FACTS = r"list_distinct(list_concat(list_concat(regexp_extract_all({0}, '\b\d[\d,]*(?:\.\d+)?\b'), regexp_extract_all({0}, '\b\d{{4}}\b|\b\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\b')), regexp_extract_all({0}, '\b(?:Licensor|Licensee|Buyer|Seller|Lessor|Lessee|Company|Customer|Supplier|Party|Parties)\b')))"
_GENERATION = (
    _PRED
    + f""", g AS (SELECT {_ease_parts('extracted_span', 's')}, {_ease_parts('predicted_answer', 'p')}, {_BOW.format('predicted_answer')} AS bp, {_BOW.format('extracted_span')} AS bs, {_FACTS.format('predicted_answer')} AS fp, {_FACTS.format('extracted_span')} AS fs FROM p WHERE extracted_span <> '' AND predicted_answer <> ''),
h AS (SELECT {_ease('s')}, {_ease('p')}, CASE WHEN len(bp) = 0 THEN 1 ELSE len(list_intersect(bp, bs)) / len(bp) END AS faith, CASE WHEN len(fs) = 0 THEN 1 ELSE len(list_intersect(fs, fp)) / len(fs) END AS facts FROM g)
SELECT count(*) AS n, round(avg(faith), 6) AS faithfulness, round(avg(p_ease - s_ease), 6) AS simplification, round(avg(greatest(1.0, 20.0 - p_ease / 5.0)), 6) AS plain_grade, round(avg(greatest(1.0, 20.0 - s_ease / 5.0)), 6) AS span_grade, round(avg(facts), 6) AS information_preservation FROM h"""
)


@query("a11_generation_quality", _GENERATION)
def a11(spark, sf_dir):
    return M.generation_report(predictions(spark, sf_dir))


_FAIL = _SCORED + f""", sp AS (SELECT * EXCLUDE (a, f1, em), {_TOK.format('ns')} AS a, CASE WHEN ns = ng THEN 1.0 ELSE 0.0 END AS em FROM s), sf AS (SELECT *, {_F1} AS f1, list_distinct({_WORDS.format('lower(extracted_span)')}) AS bs, list_distinct({_WORDS.format('lower(predicted_answer)')}) AS bp FROM sp),
c AS (SELECT example_id, CASE WHEN NOT is_answerable AND trim(extracted_span) <> '' THEN 'has_answer_false_positive' WHEN NOT is_answerable THEN 'ok' WHEN gold_chunk_idx >= 0 AND NOT list_contains([best_chunk, (best_chunk + 1) % 4, (best_chunk + 2) % 4], gold_chunk_idx) THEN 'retrieval_failure'
WHEN trim(extracted_span) = '' THEN 'missed_answer' WHEN f1 > 0.65 AND em < 0.5 THEN 'span_boundary_error' WHEN f1 < 0.40 AND ({' OR '.join(f"len(list_filter({_TERM[k].format('extracted_span')}, lambda x: NOT list_contains({_TERM[k].format('gold')}, x))) > 0" for k in ('defined', 'monetary', 'time'))}) THEN 'legal_term_hallucination'
WHEN predicted_answer <> '' AND trim(predicted_answer) <> trim(extracted_span) AND len(bp) > 0 AND len(list_intersect(bs, bp)) / len(bp) < 0.35 THEN 'generation_unfaithful' WHEN f1 < 0.20 THEN 'low_quality_span' ELSE 'ok' END AS category FROM sf)"""


@query("a12_failure_category", _FAIL + " SELECT example_id, category FROM c")
def a12(spark, sf_dir):
    return M.failure_category(predictions(spark, sf_dir)).select("example_id", "category")


@query("a13_failure_report", _FAIL + " SELECT category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM c GROUP BY category")
def a13(spark, sf_dir):
    return M.failure_report(predictions(spark, sf_dir))


@query(
    "a7_retrieval_recall",
    _PRED + r""", k AS (SELECT *, list_contains([best_chunk], gold_chunk_idx) AS h1, list_contains([best_chunk, (best_chunk + 1) % 4, (best_chunk + 2) % 4], gold_chunk_idx) AS h3 FROM p WHERE is_answerable AND gold_chunk_idx >= 0)
SELECT grp, count(*) AS n, round(avg(CAST(h1 AS INTEGER)), 6) AS recall_1, round(avg(CAST(h3 AS INTEGER)), 6) AS recall_3, round(avg(CAST(h3 AS INTEGER)), 6) AS recall_5, round(1 - avg(CAST(h1 AS INTEGER)), 6) AS miss_1 FROM (SELECT *, unnest(['all', 'source ' || source, CASE WHEN len(regexp_extract_all(question, '\S+')) <= 6 THEN 'short question' ELSE 'long question' END]) AS grp FROM k) GROUP BY grp""",
)
def a7(spark, sf_dir):
    from ..operators.retrieval import recall_report

    return recall_report(predictions(spark, sf_dir))


#: Summaries derived from documents: the start or the end of the decorated text.
_SUMMARIES = f"SELECT doc_id AS test_id, source, text AS source_text, substring(text, 1, 300) AS reference, CASE doc_id % 4 WHEN 0 THEN substring(text, length(text) - 300, 250) WHEN 1 THEN substring(text, 1, 200) WHEN 2 THEN substring(text, 20, 280) ELSE '' END || CASE doc_id % 5 WHEN 0 THEN ' The claim was denied.' WHEN 1 THEN ' Relief was granted.' ELSE '' END AS generated FROM ({LEGAL}) AS legal"
_SUM = f"WITH u AS ({_SUMMARIES.format(documents='documents')})"


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, _SUMMARIES, "documents")


def _outcome(t: str) -> str:
    has = lambda words: "len(list_filter([" + ", ".join(f"'{w}'" for w in words) + f"], lambda w: contains(lower({t}), w))) > 0"
    return f"CASE WHEN {has(M.MIXED)} THEN 'mixed' WHEN {has(M.PLAINTIFF)} THEN 'plaintiff' WHEN {has(M.DEFENDANT)} THEN 'defendant' ELSE 'unknown' END"


_LAST = "substring(source_text, CAST(floor(length(source_text) * CAST(0.8 AS DOUBLE)) AS INTEGER) + 1)"


@query("a16_outcome", _SUM + f" SELECT test_id, {_outcome('generated')} AS generated_outcome, {_outcome(_LAST)} AS source_outcome FROM u")
def a16(spark, sf_dir):
    return summaries(spark, sf_dir).select("test_id", M.outcome(F.col("generated")).alias("generated_outcome"), M.outcome(T.tail(F.col("source_text"))).alias("source_outcome"))


_INV = "((s = 'plaintiff' AND g = 'defendant') OR (s = 'defendant' AND g = 'plaintiff'))"


OUTCOMES_SQL = _SUM + f""", o AS (SELECT {_outcome('generated')} AS g, {_outcome(_LAST)} AS s FROM u WHERE generated <> '' AND source_text <> ''), n AS (SELECT count(*) AS n_total, count_if(s <> 'unknown' AND g <> 'unknown') AS n_known, count_if(s <> 'unknown' AND s = g) AS n_correct, count_if{_INV} AS n_inverted FROM o)
SELECT *, round(n_correct / greatest(n_known, 1), 6) AS preservation, round(n_inverted / greatest(n_known, 1), 6) AS inversion FROM n"""


@query("a17_outcome_report", OUTCOMES_SQL)
def a17(spark, sf_dir):
    return M.outcome_report(summaries(spark, sf_dir))


def _sent_count(t: str) -> str:
    return rf"len(list_filter(string_split(regexp_replace({t}, '([.!?])\s+([A-Z])', '\1' || chr(30) || '\2', 'g'), chr(30)), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13)) <> ''))"


@query("a18_length_report", _SUM + rf""", w AS (SELECT len(regexp_extract_all(generated, '\S+')) AS w, {_sent_count('generated')} AS s, len(regexp_extract_all(source_text, '\S+')) AS sw FROM u WHERE generated <> '')
SELECT count(*) AS n, round(avg(w), 6) AS mean_words, round(stddev_pop(w), 6) AS std_words, round(quantile_cont(w, 0.5), 6) AS median_words, CAST(min(w) AS INTEGER) AS min_words, CAST(max(w) AS INTEGER) AS max_words, round(avg(s), 6) AS mean_sentences, round(avg(CASE WHEN sw > 0 THEN w / sw END), 6) AS compression FROM w""")
def a18(spark, sf_dir):
    return M.length_report(summaries(spark, sf_dir), lambda t: T.sentences(t, [], 0))


@query("v8_flagged", _SUM + rf""", i AS (SELECT test_id, len(regexp_extract_all(generated, '\S+')) AS w, trim(generated) AS t, source_text, {_outcome('generated')} AS g, {_outcome(_LAST)} AS s FROM u),
j AS (SELECT test_id, array_to_string(list_filter([CASE WHEN t = '' THEN 'empty_summary' WHEN w < 30 THEN 'too_short:' || w || 'w' WHEN w > 500 THEN 'too_long:' || w || 'w' END, CASE WHEN source_text <> '' AND {_INV} THEN 'outcome_inverted:' || s || '->' || g END], lambda x: x IS NOT NULL), ',') AS issues FROM i) SELECT * FROM j WHERE issues <> '' ORDER BY test_id LIMIT 50""")
def v8(spark, sf_dir):
    return M.flagged(summaries(spark, sf_dir))


_ROUGE = _SUM + f""", t AS (SELECT {_PLAIN.format('generated')} AS g, {_PLAIN.format('reference')} AS r FROM u), b AS (SELECT list_transform(range(1, len(g)), lambda i: g[i] || ' ' || g[i + 1]) AS g2, list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1]) AS r2, g, r FROM t),
h AS (SELECT {_BAG.format('g', 'r')} AS m1, len(g) AS a1, len(r) AS b1, {_BAG.format('g2', 'r2')} AS m2, len(g2) AS a2, len(r2) AS b2 FROM b),
q AS (SELECT CASE WHEN a1 = 0 THEN 0 ELSE m1 / a1 END AS p1, CASE WHEN b1 = 0 THEN 0 ELSE m1 / b1 END AS q1, CASE WHEN a2 = 0 THEN 0 ELSE m2 / a2 END AS p2, CASE WHEN b2 = 0 THEN 0 ELSE m2 / b2 END AS q2 FROM h)
SELECT round(avg(p1), 6) AS rouge1_precision, round(avg(q1), 6) AS rouge1_recall, round(avg(CASE WHEN p1 + q1 = 0 THEN 0 ELSE 2 * p1 * q1 / (p1 + q1) END), 6) AS rouge1_f1, round(avg(p2), 6) AS rouge2_precision, round(avg(q2), 6) AS rouge2_recall, round(avg(CASE WHEN p2 + q2 = 0 THEN 0 ELSE 2 * p2 * q2 / (p2 + q2) END), 6) AS rouge2_f1 FROM q"""


@query("a14_rouge", _ROUGE)
def a14(spark, sf_dir):
    return M.rouge(summaries(spark, sf_dir), lcs=False, stemmed=False)


@query("a14_rouge_stemmed")
def a14s(spark, sf_dir):
    return M.rouge(summaries(spark, sf_dir))


@query("a14_rouge_lcs")
def a14l(spark, sf_dir):
    return M.rouge(summaries(spark, sf_dir), longest=1, stemmed=False).select("rougeL_precision", "rougeL_recall", "rougeL_f1")


@query("a15_extract_quality")
def a15(spark, sf_dir):
    rows = summaries(spark, sf_dir).select("test_id", F.col("generated").alias("summary"), F.col("source_text").alias("document"))
    return M.extract_quality(rows).drop("summary", "document")


@query(
    "v7_target_check",
    f"""WITH m AS (SELECT unnest(['rouge1_f1', 'rouge2_f1']) AS metric, unnest([rouge1_f1, rouge2_f1]) AS value FROM ({_ROUGE}) UNION ALL SELECT unnest(['outcome_preservation_rate', 'outcome_inversion_rate']), unnest([preservation, inversion]) FROM ({OUTCOMES_SQL})),
t (metric, least, most, kind) AS (VALUES {', '.join(f"('{m}', {lo}, {hi}, '{k}')" for m, lo, hi, k in M.TARGETS)})
SELECT m.metric, value, CASE WHEN (kind = '>' AND value >= least) OR (kind = '<' AND value <= most) OR (kind = 'range' AND value BETWEEN least AND most) THEN 'PASS' ELSE 'FAIL' END AS status FROM m JOIN t ON t.metric = m.metric""",
)
def v7(spark, sf_dir):
    rows = summaries(spark, sf_dir)
    r = M.rouge(rows, lcs=False, stemmed=False).select("rouge1_f1", "rouge2_f1")
    o = M.outcome_report(rows).select(F.col("preservation").alias("outcome_preservation_rate"), F.col("inversion").alias("outcome_inversion_rate"))
    return M.target_check(M.long_report(r).union(M.long_report(o)))


@query(
    "a20_sentence_faithfulness",
    _SUM
    + f""", s AS (SELECT test_id, source_text, unnest({_sentences_sql(lexicon.LEGAL_ABBREVIATIONS, 0)}) AS s FROM (SELECT test_id, source_text, generated AS text FROM u)), o AS (SELECT test_id, CASE WHEN len({_BOW.format('s')}) = 0 THEN 1 ELSE len(list_intersect({_BOW.format('s')}, {_BOW.format('source_text')})) / len({_BOW.format('s')}) END AS e FROM s),
b AS (SELECT test_id, avg(CASE WHEN e >= 0.5 THEN 1.0 ELSE 0.0 END) AS faith, max(CASE WHEN 1 - e >= CAST(0.7 AS DOUBLE) THEN 1 ELSE 0 END) AS bad, count_if(1 - e >= CAST(0.7 AS DOUBLE)) AS n_bad, count(*) AS n FROM o GROUP BY 1)
SELECT round(avg(faith), 6) AS mean_faithfulness, round(quantile_cont(faith, 0.5), 6) AS median_faithfulness, round(avg(bad), 6) AS hallucination_rate, round(sum(n_bad) / sum(n), 6) AS contradicted, CAST(sum(n) AS BIGINT) AS n_sentences FROM b""",
)
def a20(spark, sf_dir):
    rows = summaries(spark, sf_dir).select("test_id", "source_text", F.explode(T.sentences(F.col("generated"), lexicon.LEGAL_ABBREVIATIONS, 0)).alias("s"))
    overlap = T.word_overlap(F.col("source_text"), F.col("s"))
    return M.sentence_faithfulness(rows.select("test_id", overlap.alias("entail"), (1 - overlap).alias("contradict")))


_ASCII_WORDS = r"regexp_replace({0}, '[a-zA-Z0-9_]*[^\x00-\x7F][^\s.,;:!?()]*', '~', 'g')"  # a word end beside a letter with an accent is none
_SIDES = " UNION ALL ".join(
    f"SELECT test_id, '{side}' AS side, '{label}' AS label, unnest({sql.format(_ASCII_WORDS.format(column) if label == 'defined' else column)}) AS v FROM u" for side, column in (("source", "source_text"), ("generated", "generated")) for label, sql in _TERM.items()
)


@query(
    "a19_entity_coverage",
    _SUM
    + f""", e AS (SELECT DISTINCT test_id, side, label, lower(v) AS v FROM ({_SIDES})), f AS (SELECT a.test_id, unnest([a.label, 'overall']) AS label, CASE WHEN b.v IS NULL THEN 0 ELSE 1 END AS hit FROM (SELECT * FROM e WHERE side = 'source') a LEFT JOIN (SELECT * FROM e WHERE side = 'generated') b ON b.test_id = a.test_id AND b.label = a.label AND b.v = a.v),
h AS (SELECT test_id, label, avg(hit) AS c FROM f GROUP BY 1, 2) SELECT label, round(avg(c), 6) AS coverage, count(*) AS n FROM h GROUP BY 1""",
)
def a19(spark, sf_dir):
    rows = summaries(spark, sf_dir)
    side = lambda name, c: rows.select("test_id", F.lit(name).alias("side"), F.explode(F.array(*[F.struct(F.lit(k).alias("label"), v.alias("found")) for k, v in T.legal_terms(F.col(c)).items()])).alias("x")).select("test_id", "side", "x.label", F.explode("x.found").alias("text"))
    return M.entity_coverage(side("source", "source_text").union(side("generated", "generated")))


@query("a21_vector_match", """WITH a AS (SELECT vec_id // 10 AS pair_id, vec_id AS i, embedding AS x FROM embeddings WHERE vec_id % 10 < 4), b AS (SELECT vec_id // 10 AS pair_id, vec_id AS j, embedding AS y FROM embeddings WHERE vec_id % 10 >= 4),
s AS (SELECT a.pair_id, i, j, list_sum(list_transform(range(1, 65), lambda k: CAST(x[k] AS DOUBLE) * CAST(y[k] AS DOUBLE))) AS s FROM a JOIN b ON a.pair_id = b.pair_id),
p AS (SELECT pair_id, avg(m) AS p FROM (SELECT pair_id, i, max(s) AS m FROM s GROUP BY 1, 2) GROUP BY 1), r AS (SELECT pair_id, avg(m) AS r FROM (SELECT pair_id, j, max(s) AS m FROM s GROUP BY 1, 2) GROUP BY 1)
SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END), 6) AS f1 FROM p JOIN r ON p.pair_id = r.pair_id""")
def a21(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("pair_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))
    return M.vector_match(v.where("pos % 10 < 4"), v.where("pos % 10 >= 4"))


@query("a22_ratings", "WITH r AS (SELECT CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 5 + 1 END AS correctness, CASE WHEN doc_id % 4 = 0 OR doc_id % 3 = 0 THEN NULL ELSE doc_id % 7 % 5 + 1 END AS clarity FROM documents) SELECT round(avg(correctness), 6) AS correctness, round(avg(clarity), 6) AS clarity, count_if(coalesce(correctness, clarity) IS NOT NULL) AS n_rated FROM r")
def a22(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.expr("CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 5 + 1 END AS correctness"), F.expr("CASE WHEN doc_id % 4 = 0 OR doc_id % 3 = 0 THEN NULL ELSE doc_id % 7 % 5 + 1 END AS clarity"))
    return M.ratings(rows, ["correctness", "clarity"])


@query("a28_substring_accuracy", _PRED + " SELECT source, round(avg(CASE WHEN contains(lower(predicted_answer), lower(substring(gold, 20, 30))) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY source")
def a28(spark, sf_dir):
    return M.substring_accuracy(predictions(spark, sf_dir).select("source", F.col("predicted_answer").alias("pred"), F.substring("gold", 20, 30).alias("gold")), "source")


@query("v5_plausible_answer", r"""WITH q AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'What is the price?' WHEN 1 THEN 'When was it?' ELSE 'Who?' END AS q, CASE WHEN item_id % 2 = 0 THEN text || ' It cost $5 in the year.' ELSE text END AS c FROM benchmark)
SELECT item_id, CASE WHEN contains(lower(q), 'price') THEN regexp_matches(lower(c), '\$|usd|rs|rupees|price|amount') WHEN contains(lower(q), 'when') THEN regexp_matches(lower(c), 'year|month|day|202|203') ELSE true END AS plausible, regexp_matches(lower(c), 'not found|no answer|does not contain|not present') AS no_answer FROM q""")
def v5(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select("item_id", F.expr("CASE item_id % 3 WHEN 0 THEN 'What is the price?' WHEN 1 THEN 'When was it?' ELSE 'Who?' END AS q"), F.expr("CASE WHEN item_id % 2 = 0 THEN text || ' It cost $5 in the year.' ELSE text END AS c"))
    return q.select("item_id", Q.plausible(F.col("q"), F.col("c")).alias("plausible"), Q.is_no_answer(F.col("c")).alias("no_answer"))


@query("w10_best_chunk", _PRED + """, c AS (SELECT source AS k, CAST(example_id AS INTEGER) AS chunk_idx, has_answer_prob AS prob, CASE WHEN example_id % 11 = 0 THEN 0.0 ELSE has_answer_prob / (1 + exp(-(CAST(example_id % 13 AS DOUBLE) - 6) / 10.0)) END AS final, extracted_span AS span FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY prob >= 0.3 DESC, final DESC, chunk_idx) AS n FROM c WHERE span <> '') SELECT s.k, chunk_idx, CASE WHEN prob >= 0.35 THEN span ELSE 'Answer not found in document.' END AS answer FROM (SELECT DISTINCT k FROM c) s LEFT JOIN r ON s.k = r.k AND n = 1""")
def w10(spark, sf_dir):
    start = F.when(F.col("example_id") % 11 == 0, 0).otherwise(1)
    rows = predictions(spark, sf_dir).select(F.col("source").alias("k"), F.col("example_id").cast("int").alias("chunk_idx"), F.col("has_answer_prob").alias("prob"), Q.final_score(F.col("has_answer_prob"), (F.col("example_id") % 13).cast("double") - 6, start, start).alias("final"), F.col("extracted_span").alias("span"))
    return Q.best_chunk(rows, "k")


@query("w12_longest_span", _PRED + " SELECT source, example_id, extracted_span AS span FROM p WHERE extracted_span <> '' QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(extracted_span) DESC, example_id) = 1")
def w12(spark, sf_dir):
    rows = predictions(spark, sf_dir).select("source", "example_id", F.col("extracted_span").alias("span"), F.col("example_id").alias("rank"))
    return Q.longest_span(rows, "source").drop("rank")


@query("j14_best_span", """WITH s AS (SELECT vec_id, embedding AS a, list_reverse(embedding) AS b, unnest(range(1, 65)) AS i FROM embeddings), p AS (SELECT vec_id, i, unnest(range(i, least(i + 30, 65))) AS j, a, b FROM s), c AS (SELECT vec_id, i, j, CAST(a[i] AS DOUBLE) + CAST(b[j] AS DOUBLE) + CAST(0.01 AS DOUBLE) * (j - i) AS score FROM p)
SELECT vec_id, CAST(i - 1 AS INTEGER) AS start_tok, CAST(j - 1 AS INTEGER) AS end_tok, score AS span_score FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, i, j) = 1""")
def j14(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("starts"), F.reverse("embedding").alias("ends"))
    return S.best_span(rows, "vec_id", 30, 0.01)


_ENTITIES = " UNION ALL ".join(pattern_places_sql(p, "legal") for p in S.ENTITIES)


@query(
    "w8_j12_extended_spans",
    f"""WITH legal AS ({LEGAL.format(documents='documents')}), x AS ({_ENTITIES}),
i AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x)),
m AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM i GROUP BY doc_id, g), p AS (SELECT doc_id, length(text) - 320 AS a, length(text) - 290 AS b FROM legal)
SELECT p.doc_id, CAST(a AS INTEGER) AS span_start, CAST(b AS INTEGER) AS span_end, CAST(least(a, min(s)) AS INTEGER) AS new_start, CAST(greatest(b, max(e)) AS INTEGER) AS new_end FROM p LEFT JOIN m ON m.doc_id = p.doc_id AND s < b AND e > a GROUP BY p.doc_id, a, b""",
)
def w8(spark, sf_dir):
    rows = view(spark, sf_dir, LEGAL, "documents").select("doc_id", "text")
    spans = rows.select("doc_id", (F.length("text") - 320).alias("span_start"), (F.length("text") - 290).alias("span_end"))
    return S.extend_spans(spans, S.entity_spans(rows))


_SMALL = "abcdefghijklmnopqrstuvwxyz"


def _located(answer: str) -> str:
    w = _CONTENT.format(answer)
    phrases = f"list_concat(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i + 2], ' ')), list_transform(range(1, greatest(len(w), 1)), lambda i: array_to_string(w[i:i + 1], ' ')))"
    first = "list_filter(ph, lambda x, i: list_position(ph, x) = i)[1:6]"
    return f"SELECT doc_id, CASE WHEN instr(lower(text), lower(a)) > 0 THEN instr(lower(text), lower(a)) ELSE coalesce(list_filter(list_transform({first}, lambda x: instr(lower(text), x)), lambda x: x > 0)[1], 0) END AS at FROM (SELECT *, {phrases} AS ph FROM (SELECT doc_id, text, {answer} AS a, {w} AS w FROM documents))"


@query("j15_locate_answer", f"""SELECT a.doc_id, a.at, b.at AS near FROM ({_located(f"substring(translate(text, '{_SMALL}', '{_SMALL.upper()}'), 30, 40)")}) a JOIN ({_located("substring(text, 60, 60) || ' zzz'")}) b ON a.doc_id = b.doc_id""")
def j15(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", Q.locate_answer(F.col("text"), F.substring(F.translate("text", _SMALL, _SMALL.upper()), 30, 40)).alias("at"), Q.locate_answer(F.col("text"), F.concat(F.substring("text", 60, 60), F.lit(" zzz"))).alias("near"))


@query("v4_split_leak", "WITH t AS (SELECT doc_id, doc_id % 10 < 8 AS train, doc_id % 10 >= 7 AS val FROM documents) SELECT count_if(train) AS n_train, count_if(val) AS n_validation, count_if(train AND val) AS n_both, count_if(train AND val) = 0 AS disjoint FROM t")
def v4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return A.leaked(docs.where("doc_id % 10 < 8"), docs.where("doc_id % 10 >= 7"), "doc_id")


@query("a8_ranking_accuracy", _PRED + """, q AS (SELECT 'q' || CAST(example_id // 4 AS VARCHAR) AS question_id, CAST(example_id % 4 AS INTEGER) AS chunk_idx, has_answer_prob AS score, is_answerable AS pos FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_idx) AS rk FROM q),
b AS (SELECT question_id, min(CASE WHEN pos THEN rk END) AS best, count(*) AS n FROM r GROUP BY 1) SELECT grp, count(*) AS n, round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0 END), 6) AS top_1, round(avg(CASE WHEN best <= 3 THEN 1.0 ELSE 0 END), 6) AS top_3 FROM (SELECT *, unnest(['all', 'source one']) AS grp FROM b WHERE best IS NOT NULL AND n >= 2) GROUP BY grp""")
def a8(spark, sf_dir):
    rows = predictions(spark, sf_dir).select(F.concat(F.lit("q"), F.floor(F.col("example_id") / 4).cast("string")).alias("question_id"), F.lit("one").alias("source"), (F.col("example_id") % 4).cast("int").alias("chunk_idx"), F.col("has_answer_prob").alias("score"), F.col("is_answerable").alias("is_positive"))
    return M.ranking_accuracy(rows)


#: Every eight consecutive words of a benchmark text.
_PHRASES = "SELECT DISTINCT item_id, array_to_string({0}(w, i, i + 7), ' ') AS phrase FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT item_id, regexp_extract_all(text, '\\S+') AS w FROM benchmark))"


@query(
    "f4_phrases_in_documents",
    f"""WITH p AS ({_PHRASES.format('list_slice')}) SELECT doc_id, item_id, count(*) AS n_phrases, min(instr(text, phrase) - 1) AS first FROM documents JOIN p ON contains(text, phrase) GROUP BY doc_id, item_id""",
)
def f4_phrases(spark, sf_dir):
    """Documents that hold runs of eight words of a benchmark text: how many distinct ones, and where the first begins."""
    w = table(spark, sf_dir, "benchmark").select("item_id", T.words(F.col("text")).alias("w")).where("size(w) >= 8")
    phrases = w.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.array_join(F.slice("w", i, F.lit(8)), " "))).alias("phrase")).distinct()
    found = H.phrase_places(table(spark, sf_dir, "documents").select("doc_id", "text"), phrases, ["doc_id"])
    each = found.groupBy("doc_id", "item_id", "phrase").agg(F.min("start").alias("start"))
    return each.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_phrases"), F.min("start").alias("first"))
