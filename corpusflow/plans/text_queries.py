"""Queries of the text operators over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as T
from ..operators import chunks as C
from .registry import query, table, view

#: Documents with the legal wording that the operators look for; read alike by both engines.
LEGAL = """
SELECT doc_id, source, concat(text, ' The fee is $', doc_id, ' due within ', doc_id % 30, ' days by Licensee of Green River Company. Motion ',
  CASE doc_id % 3 WHEN 0 THEN 'granted' WHEN 1 THEN 'denied' ELSE 'remanded' END, '. [***] EXECUTION COPY for the DRAFT.', chr(10), 'Page ', doc_id % 9, ' of 9', chr(10),
  'Exhibit A-', doc_id, ' holds. Source: filing of 2019 text', chr(10), '***', chr(10), 'ANNEX B', chr(10), 'ok', chr(10), 'SHORT CAPS LINE', chr(10), 'ARTICLE 1 DEFINITIONS', chr(10), 'The terms of ', source, ' follow here in full. ',
  CASE WHEN doc_id % 2 = 0 THEN 'IN WITNESS WHEREOF signed by all' ELSE 'Nothing more is said' END) AS text FROM {documents}
"""
LEGAL_SQL = f"WITH legal AS ({LEGAL.format(documents='documents')})"
_WORDS = "list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')"
_DOT = "chr(2)"


def legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, LEGAL, "documents")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


@query(
    "p1_normalise_raw",
    r"""SELECT doc_id, trim(translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '-\n', '', 'g'), '([^\n])\n([^\n])', '\1 \2', 'g'), '([^\n])\n([^\n])', '\1 \2', 'g'), ' +', ' ', 'g'), chr(160) || chr(12), ' ' || chr(10)), ' ' || chr(10) || chr(9) || chr(13) || chr(11) || chr(12)) AS text FROM documents""",
)
def p1(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.normalise_raw(F.col("text")).alias("text"))


@query("p2_cut_signature", LEGAL_SQL + r" SELECT doc_id, regexp_replace(text, '(?is)IN WITNESS WHEREOF.*', '') AS text FROM legal")
def p2(spark, sf_dir):
    return legal(spark, sf_dir).select("doc_id", T.cut_signature(F.col("text")).alias("text"))


_STAMPS = "text"
for _p in lexicon.STAMPS:
    _STAMPS = f"regexp_replace({_STAMPS}, '{_p}', '', 'g')"
_FOOTERS = "text"
for _p in lexicon.FOOTERS:
    _FOOTERS = f"regexp_replace({_FOOTERS}, '{_p}', '', 'g')"
_LINES = r"""array_to_string(list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: length(x) >= 3
  AND NOT regexp_matches(x, '^-?\s*\d+\s*-?$') AND NOT regexp_matches(x, '^[Pp]age\s+\d+(\s+of\s+\d+)?$') AND NOT regexp_matches(x, '(?i)^(Schedule|Annex|Appendix)\s+[\w.]+\s*$')
  AND NOT (regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}') AND len(regexp_extract_all(x, '\S+')) <= 5) AND regexp_matches(x, '[\p{{L}}\p{{N}}]')), chr(10))"""


@query("p3_strip_stamps", LEGAL_SQL + f" SELECT doc_id, {_STAMPS} AS text FROM legal")
def p3(spark, sf_dir):
    return legal(spark, sf_dir).select("doc_id", T.strip_patterns(F.col("text"), lexicon.STAMPS).alias("text"))


@query("p4_strip_footers", LEGAL_SQL + f" SELECT doc_id, {_FOOTERS} AS text FROM legal")
def p4(spark, sf_dir):
    return legal(spark, sf_dir).select("doc_id", T.strip_patterns(F.col("text"), lexicon.FOOTERS).alias("text"))


@query("p5_clean_lines", LEGAL_SQL + f" SELECT doc_id, {_LINES.format('text')} AS text FROM legal")
def p5(spark, sf_dir):
    return legal(spark, sf_dir).select("doc_id", T.clean_lines(F.col("text")).alias("text"))


_SQUEEZE = r"trim(regexp_replace(regexp_replace({0}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' +', ' ', 'g'), ' ' || chr(10) || chr(9) || chr(13))"


@query("p6_squeeze", f"SELECT doc_id, {_SQUEEZE.format('text')} AS text FROM documents")
def p6(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.squeeze(F.col("text")).alias("text"))


@query(
    "p7_clean_text",
    LEGAL_SQL
    + r", cut AS (SELECT doc_id, regexp_replace(text, '(?is)IN WITNESS WHEREOF.*', '') AS text FROM legal), stamped AS (SELECT doc_id, "
    + _STAMPS
    + " AS text FROM cut), footed AS (SELECT doc_id, "
    + _FOOTERS
    + f" AS text FROM stamped), lined AS (SELECT doc_id, {_LINES.format('text')} AS text FROM footed) SELECT doc_id, {_SQUEEZE.format('text')} AS text FROM lined",
)
def p7(spark, sf_dir):
    return legal(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query("p8_truncate_words", f"SELECT doc_id, CASE WHEN len({_WORDS.format('text')}) <= 50 THEN text ELSE array_to_string({_WORDS.format('text')}[1:50], ' ') END AS text FROM documents")
def p8(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.truncate_words(F.col("text"), 50).alias("text"))


@query("p9_preview", "SELECT doc_id, CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '...' ELSE text END AS preview FROM documents")
def p9(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.preview(F.col("text"), 80).alias("preview"))


@query("p10_tail", "SELECT doc_id, substring(text, CAST(floor(length(text) * CAST(0.8 AS DOUBLE)) AS INTEGER) + 1) AS tail FROM documents")
def p10(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.tail(F.col("text")).alias("tail"))


_SENT = r"string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30))"
_UNIQ = r"""array_to_string(list_transform(list_filter(range(1, len(p) + 1), lambda i: k[i] <> '' AND list_position(k, k[i]) = i), lambda i: p[i]), ' ')"""
_REPEAT = "SELECT doc_id, " + _UNIQ + " AS text FROM (SELECT doc_id, p, list_transform(p, lambda x: lower(trim(x, ' ' || chr(10) || chr(9) || chr(13)))) AS k FROM (SELECT doc_id, {0} AS p FROM {1}))"


@query("p12_drop_repeated", _REPEAT.format(_SENT.format("text"), "documents"))
def p12(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.drop_repeated(F.col("text")).alias("text"))


@query("p11_post_process", _REPEAT.format(_SENT.format("text"), r"(SELECT doc_id, trim(regexp_replace(regexp_replace('<s> ' || text || ' </s><pad>', '</?s>|<pad>|<unk>|<legal>|\[(?:CLS|SEP|PAD)\]', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM documents)"))
def p11(spark, sf_dir):
    marked = F.concat(F.lit("<s> "), "text", F.lit(" </s><pad>"))
    return documents(spark, sf_dir).select("doc_id", T.post_process(marked).alias("text"))


def _abbr(text: str, names: list[str]) -> str:
    for a in names:
        text = f"replace({text}, '{a}', '{a.replace('.', chr(2))}')"
    return text


def _sentences_sql(names: list[str], least: int) -> str:
    return rf"""list_filter(list_transform(string_split(regexp_replace({_abbr('text', names)}, '([.!?])\s+([A-Z])', '\1' || chr(30) || '\2', 'g'), chr(30)), lambda x: trim(replace(x, chr(2), '.'), ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> '' AND len(regexp_extract_all(x, '\S+')) >= {least})"""


def _sentence_query(name: str, names: list[str], least: int) -> None:
    sql = f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS sent_idx, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_sentences_sql(names, least)} AS s FROM documents))"
    query(name, sql)(lambda spark, sf_dir: C.sentence_rows(documents(spark, sf_dir), names, least))


_sentence_query("t1_sentences_general", lexicon.GENERAL_ABBREVIATIONS, 5)
_sentence_query("t2_sentences_legal", lexicon.LEGAL_ABBREVIATIONS, 5)
_sentence_query("t3_sentences_all", lexicon.LEGAL_ABBREVIATIONS[:16], 0)


@query(
    "t4_fit_sentences",
    f"SELECT doc_id, count(*) AS n_sentences, sum(length(s)) AS n_chars FROM (SELECT doc_id, unnest({_sentences_sql(lexicon.GENERAL_ABBREVIATIONS, 0)}) AS s FROM documents) WHERE length(s) >= 10 AND regexp_matches(s, '[\\p{{L}}_]') GROUP BY doc_id",
)
def t4(spark, sf_dir):
    rows = C.sentence_rows(documents(spark, sf_dir), lexicon.GENERAL_ABBREVIATIONS, 0).where(T.fit_sentence(F.col("sentence")))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"))


def _chunk_sql(most: int) -> str:
    return f"""WITH w AS (SELECT doc_id, text, {_WORDS.format('text')} AS w FROM documents),
r AS (SELECT *, unnest(range(0, least({most}, 1 + greatest(0, CAST(ceil((len(w) - 350) / 300.0) AS INTEGER))))) AS chunk_idx FROM w)
SELECT doc_id, CAST(chunk_idx AS INTEGER) AS chunk_idx, CASE WHEN len(w) <= 350 THEN text ELSE array_to_string(w[chunk_idx * 300 + 1:chunk_idx * 300 + 350], ' ') END AS chunk FROM r"""


@query("t8_word_chunks", _chunk_sql(1_000_000))
def t8(spark, sf_dir):
    return C.word_chunks(documents(spark, sf_dir))


@query("t9_first_chunks", _chunk_sql(6))
def t9(spark, sf_dir):
    return C.word_chunks(documents(spark, sf_dir), max_chunks=6)


_OFFSETS = r"""WITH w AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '(\s*)(\S+)', 1), lambda x: length(x)) AS g, list_transform(regexp_extract_all(text, '(\s*)(\S+)', 2), lambda x: length(x)) AS l FROM documents),
r AS (SELECT *, len(l) AS n, unnest(range(0, 1 + greatest(0, CAST(ceil((len(l) - 400) / 350.0) AS INTEGER)))) AS chunk_idx FROM w WHERE len(l) > 0),
o AS (SELECT *, chunk_idx * 350 AS word_start, least(chunk_idx * 350 + 400, n) AS word_end FROM r),
c AS (SELECT *, CAST(list_sum(g[1:word_start + 1]) + coalesce(list_sum(l[1:word_start]), 0) AS INTEGER) AS char_start, CAST(list_sum(g[1:word_end]) + list_sum(l[1:word_end]) AS INTEGER) AS char_end FROM o)"""


@query("t10_offset_chunks", _OFFSETS + " SELECT doc_id, substring(text, char_start + 1, char_end - char_start) AS text, char_start, char_end, CAST(word_start AS INTEGER) AS word_start, CAST(word_end AS INTEGER) AS word_end, CAST(chunk_idx AS INTEGER) AS chunk_idx, CAST(1 + greatest(0, CAST(ceil((n - 400) / 350.0) AS INTEGER)) AS INTEGER) AS n_chunks FROM c")
def t10(spark, sf_dir):
    return C.offset_chunks(documents(spark, sf_dir))


@query(
    "t11_answer_in_chunk",
    _OFFSETS
    + """, a AS (SELECT doc_id AS d, substring(text, 101, 30) AS answer, 100 AS answer_start FROM documents WHERE length(text) > 200)
SELECT doc_id, CAST(chunk_idx AS INTEGER) AS chunk_idx, answer, CAST(CASE WHEN 100 >= char_start AND 100 + length(answer) <= char_end AND substring(substring(text, char_start + 1, char_end - char_start), 100 - char_start + 1, length(answer)) = answer THEN 100 - char_start ELSE -1 END AS INTEGER) AS local_start FROM c JOIN a ON c.doc_id = a.d""",
)
def t11(spark, sf_dir):
    docs = documents(spark, sf_dir)
    answers = docs.where("length(text) > 200").select("doc_id", F.substring("text", 101, 30).alias("answer"), F.lit(100).alias("answer_start"))
    return C.answer_offsets(C.offset_chunks(docs), answers).select("doc_id", "chunk_idx", "answer", "local_start")


def pattern_places_sql(pattern: str, table: str, name: bool = False) -> str:
    """(doc_id, s, e) of a pattern's matches: texts between matches and matches, in turn, as running sums of lengths; ``name``: also the match with single spaces."""
    cut = f"SELECT doc_id, unnest(range(1, len(g) + 1)) AS i, g, h FROM (SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}') AS h FROM {table})"
    sums = f"SELECT doc_id, h[i] AS hit, length(h[i]) AS n, sum(length(g[i]) + coalesce(length(h[i]), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM ({cut})"
    return f"SELECT doc_id, CAST(e - n AS INTEGER) AS s, CAST(e AS INTEGER) AS e{', trim(regexp_replace(hit, $p$\\s+$p$, $p$ $p$, $p$g$p$)) AS name' if name else ''} FROM ({sums}) WHERE n > 0"


#: No look-behind there: before a word character it is a word's edge.
_HEADERS = " UNION ALL ".join(pattern_places_sql("(?m)" + p.replace(r"(?<!\w)", r"\b"), "legal", True) for p in lexicon.SECTION_PATTERNS)
_SECTIONS = f"""RECURSIVE legal AS ({LEGAL.format(documents='documents')}), f AS ({_HEADERS}),
r AS (SELECT DISTINCT doc_id, -1 AS last FROM f UNION ALL SELECT r.doc_id, min(f.s) FROM r JOIN f ON f.doc_id = r.doc_id AND f.s > r.last + 10 GROUP BY r.doc_id),
sec AS (SELECT doc_id, s, e, name FROM f SEMI JOIN r ON r.doc_id = f.doc_id AND r.last = f.s QUALIFY row_number() OVER (PARTITION BY doc_id, s ORDER BY e, name) = 1)"""
_LEGAL_SENTENCES = f"snt AS (SELECT doc_id, text, CAST(i - 1 AS INTEGER) AS sent_idx, s[i] AS sentence FROM (SELECT doc_id, text, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, text, {_sentences_sql(lexicon.LEGAL_ABBREVIATIONS, 0)} AS s FROM legal)))"
_STARTS = f"{_LEGAL_SENTENCES}, st AS (SELECT snt.doc_id, s, min(sent_idx) AS sent_idx FROM snt JOIN sec ON sec.doc_id = snt.doc_id AND contains(substring(text, s + 1, 200), sentence) GROUP BY 1, 2)"


@query("t6_sections", f"WITH {_SECTIONS} SELECT legal.doc_id, CAST(count(s) AS INTEGER) AS n_sections, coalesce(string_agg(s || ':' || e || ':' || name, '|' ORDER BY s), '') AS found FROM legal LEFT JOIN sec ON sec.doc_id = legal.doc_id GROUP BY legal.doc_id")
def t6(spark, sf_dir):
    return C.sections(legal(spark, sf_dir)).select("doc_id", F.size("sections").alias("n_sections"), F.array_join(F.transform("sections", lambda s: F.concat_ws(":", s["start"], s["end"], s["name"])), "|").alias("found"))


#: A document's sentences, their words summed up from 0, and which of them start a section, as lists. A chunk is the sentences from a to before z; the next one may take up the last of them again, from b.
_PACKED = rf"""{_SECTIONS}, {_STARTS}, n AS (SELECT doc_id, sent_idx, sentence, len(regexp_extract_all(sentence, '\S+')) AS n, (doc_id, sent_idx) IN (SELECT (doc_id, sent_idx) FROM st) AS head FROM snt),
d AS (SELECT doc_id, list(sentence ORDER BY sent_idx) AS t, list_prepend(0, list(upto ORDER BY sent_idx)) AS p, list(head ORDER BY sent_idx) AS h, count(*) AS n FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY sent_idx) AS BIGINT) AS upto FROM n) GROUP BY doc_id),
c AS (
  SELECT doc_id, CAST(-1 AS BIGINT) AS k, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS z, CAST(0 AS BIGINT) AS b FROM d
  UNION ALL
  SELECT doc_id, k, a, z, greatest(a, len(list_filter(p, lambda x: p[z + 1] - x > 50))) FROM (
    SELECT *, CASE WHEN y >= n THEN n ELSE y + CASE WHEN y + 1 < n AND h[y + 2] THEN 1 WHEN y + 2 < n AND h[y + 3] THEN 2 WHEN y + 3 < n AND h[y + 4] THEN 3 ELSE 0 END END AS z FROM (
      SELECT *, least(n, greatest(len(list_filter(p, lambda x: x - p[a + 1] <= 200)) - 1, a + 1)) AS y FROM (
        SELECT c.doc_id, c.k + 1 AS k, d.p, d.h, d.n, CASE WHEN c.b < c.z AND d.p[c.z + 2] - d.p[c.b + 1] > 200 THEN c.z ELSE c.b END AS a FROM c JOIN d ON d.doc_id = c.doc_id AND c.z < d.n)))
)"""


@query("t12_section_chunks", f"WITH {_PACKED} SELECT c.doc_id, CAST(k AS INTEGER) AS chunk_index, array_to_string(t[a + 1:z], ' ') AS text, CAST(p[z + 1] - p[a + 1] AS INTEGER) AS token_count, CAST(z - a AS INTEGER) AS sentence_count FROM c JOIN d ON d.doc_id = c.doc_id WHERE k >= 0")
def t12(spark, sf_dir):
    texts = legal(spark, sf_dir).select("doc_id", "text")
    return C.section_chunks(C.section_starts(texts), size=200, overlap=50)


_STOP = "[" + ", ".join(f"'{w}'" for w in lexicon.STOP_WORDS) + "]"
_CONTENT = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: NOT list_contains(" + _STOP + ", w))"


@query("t14_content_words", f"SELECT doc_id, w AS token, count(*) AS n FROM (SELECT doc_id, unnest({_CONTENT.format('text')}) AS w FROM documents) GROUP BY doc_id, w")
def t14(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.explode(T.content_words(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "t15_key_phrases",
    f"""WITH w AS (SELECT doc_id, {_CONTENT.format('text')} AS w FROM documents), p AS (SELECT doc_id, list_concat(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i + 2], ' ')), list_transform(range(1, greatest(len(w), 1)), lambda i: array_to_string(w[i:i + 1], ' '))) AS p FROM w),
u AS (SELECT doc_id, p[i] AS x, i FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM p)), f AS (SELECT doc_id, x, min(i) AS i FROM u GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) <= 6)
SELECT p.doc_id, coalesce(string_agg(x, '|' ORDER BY i), '') AS phrases FROM p LEFT JOIN f ON f.doc_id = p.doc_id GROUP BY 1""",
)
def t15(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.array_join(T.key_phrases(F.col("text")), "|").alias("phrases"))


_NORM = r"array_to_string(list_filter(string_split_regex(regexp_replace(lower({0}), '[[:punct:]]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


@query("t16_normalise_answer", f"SELECT item_id, {_NORM.format('text')} AS answer FROM benchmark")
def t16(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.normalise_answer(F.col("text")).alias("answer"))


_PLAIN = r"list_filter(list_transform(string_split_regex(lower({0}), '\s+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: w <> '')"


@query("t17_plain_tokens", f"SELECT doc_id, len({_PLAIN.format('text')}) AS n_tokens, len(list_distinct({_PLAIN.format('text')})) AS n_distinct FROM documents")
def t17(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.size(T.plain_tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(F.array_distinct(T.plain_tokens(F.col("text")))).cast("long").alias("n_distinct"))


_SYL = """CASE WHEN w = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN w LIKE '%e' AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 AND w NOT LIKE '%le' THEN 1 ELSE 0 END) END"""


@query("f1_syllables", f"SELECT item_id, sum({_SYL}) AS n_syllables FROM (SELECT item_id, regexp_replace(lower(unnest({_WORDS.format('text')})), '[^a-z]', '', 'g') AS w FROM benchmark) GROUP BY item_id")
def f1(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.words(F.col("text"))).alias("w"))
    return rows.groupBy("item_id").agg(F.sum(T.syllables(F.col("w"))).alias("n_syllables"))


@query(
    "f2_reading_ease",
    f"""WITH s AS (SELECT item_id, len(list_filter(string_split_regex(text, '[.!?]+'), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13)) <> '')) AS n FROM benchmark),
w AS (SELECT item_id, count(*) AS k, sum({_SYL}) AS syl FROM (SELECT item_id, lower(w0) AS w FROM (SELECT item_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS w0 FROM benchmark) WHERE regexp_matches(w0, '^[a-zA-Z]+$')) GROUP BY item_id)
SELECT item_id, round(CASE WHEN coalesce(k, 0) = 0 OR n = 0 THEN 0 ELSE 206.835 - 1.015 * (k / n) - 84.6 * (syl / k) END, 6) AS ease, round(greatest(1.0, 20.0 - CASE WHEN coalesce(k, 0) = 0 OR n = 0 THEN 0 ELSE 206.835 - 1.015 * (k / n) - 84.6 * (syl / k) END / 5.0), 6) AS grade FROM s LEFT JOIN w USING (item_id)""",
)
def f2(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", T.reading_ease(F.col("text")).alias("e"))
    return rows.select("item_id", F.round("e", 6).alias("ease"), F.round(T.grade_level(F.col("e")), 6).alias("grade"))


@query(
    "f3_key_facts",
    LEGAL_SQL
    + r""" SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(t, '\b\d[\d,]*(?:\.\d+)?\b'), regexp_extract_all(t, '\b\d{4}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b')), regexp_extract_all(t, '\b(?:Licensor|Licensee|Buyer|Seller|Lessor|Lessee|Company|Customer|Supplier|Party|Parties)\b')))), '|') AS facts FROM (SELECT doc_id, text AS t FROM legal)""",
)
def f3(spark, sf_dir):
    return legal(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(T.key_facts(F.col("text"))), "|").alias("facts"))


@query(
    "f4_legal_terms",
    LEGAL_SQL
    + r""" SELECT doc_id, len(list_distinct(regexp_extract_all(regexp_replace(text, '[a-zA-Z0-9_]*[^\x00-\x7F][^\s.,;:!?()]*', '~', 'g'), '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b'))) AS n_defined, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)\$[0-9][\d,]*(?:\.\d+)?|\b\d[\d,]*\s*(?:dollars?|USD|cents?)\b'), lambda x: lower(x)))), '|') AS monetary,
array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)\b\d+\s*(?:days?|weeks?|months?|years?|hours?|minutes?)\b'), lambda x: lower(x)))), '|') AS spans, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '\b\w+\b'), lambda w: list_contains(["""
    + ", ".join(f"'{w}'" for w in lexicon.PARTY_WORDS)
    + """], w)))), '|') AS parties FROM legal""",
)
def f4(spark, sf_dir):
    terms = T.legal_terms(F.col("text"))
    joined = lambda k: F.array_join(F.array_sort(terms[k]), "|")
    return legal(spark, sf_dir).select("doc_id", F.size(terms["defined"]).cast("long").alias("n_defined"), joined("monetary").alias("monetary"), joined("time").alias("spans"), joined("party").alias("parties"))


@query("v2_least_sizes", r"SELECT doc_id, source FROM documents WHERE len(regexp_extract_all(text, '\S+')) >= 50 AND length(text) > 200")
def v2(spark, sf_dir):
    return documents(spark, sf_dir).where((T.word_count(F.col("text")) >= 50) & (F.length("text") > 200)).select("doc_id", "source")


@query("t18_vocabulary", f"SELECT w AS token, n, CAST(4 + row_number() OVER (ORDER BY n DESC, w) AS INTEGER) AS id FROM (SELECT w, count(*) AS n FROM (SELECT unnest({_CONTENT.format('text')}) AS w FROM documents) GROUP BY w HAVING count(*) >= 2) QUALIFY id < 1005")
def t18(spark, sf_dir):
    from ..operators.features import vocabulary

    return vocabulary(documents(spark, sf_dir).select(F.explode(T.content_words(F.col("text"))).alias("token")), size=1000)
