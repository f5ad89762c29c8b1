"""Faults found on larger or odd tables."""

import collections

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusflow.functions import lexicon
from corpusflow.functions import text as T
from corpusflow.operators import sampling
from corpusflow.plans import catalogue

from .test_oracles import rows as plain

SF = "/root/testdata/sf0.001"


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_alignment_shuffles_no_terms(spark):
    """The pairs of a document's chunks and sentences stay in its row."""
    assert exchanges(catalogue.queries()["w1_chunk_alignment"](spark, SF)) == 0


def test_section_starts_are_found_in_the_row(spark):
    """No sentence meets headers by a join."""
    assert exchanges(catalogue.queries()["t13_section_sentences"](spark, SF)) == 0


def folder(tmp_path, spark, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    return str(tmp_path), con


@pytest.mark.parametrize("name", ["k2_prediction_projections", "g1_rewritten_answers", "a9_clause_boundaries", "f6_word_overlap"])
def test_spans_of_texts_that_begin_where_they_do(spark, tmp_path, name):
    """Sources and texts of many lengths: some decorated texts have just the characters that a span goes back."""
    rows = [(5 * (60 * n + k) + 4 * (k % 2), "x" * k, "en", "s" * n, 1) for n in range(1, 15) for k in range(1, 60)]
    sf, con = folder(tmp_path, spark, rows)
    ours, theirs = catalogue.queries()[name](spark, sf).toPandas(), con.execute(catalogue.oracle_sql()[name]).df()
    assert plain(ours) == plain(theirs)


def test_vector_alignment_of_a_sentence_without_content_words(spark, tmp_path):
    """A sentence that shares no bucket with a chunk is still among its three best of three."""
    text = "Alpha beta gamma delta epsilon words. " + "Other words here go on and on. " * 2 + "It was not for you or if. " + "Other words here go on and on again and again. " * 2
    text += "More of them follow after that one" + " and more" * 10 + "."
    sf, con = folder(tmp_path, spark, [(1, text, "en", "src0", 1)])
    ours = catalogue.queries()["r8_vector_alignment"](spark, sf).select("doc_id", "chunk_i", "target", "score").collect()
    theirs = con.execute(f"SELECT doc_id, chunk_i, target, score FROM ({catalogue.oracle_sql()['r8_vector_alignment']})").fetchall()
    assert [tuple(r) for r in ours] == theirs and len(ours) == 1


@pytest.mark.parametrize("name", ["r5_sentence_graph", "r6_pagerank", "w7_position_bias", "r7_extractive_summary", "w5_section_summary", "t7_sentence_sections", "r9_hierarchical_summary"])
def test_sentences_are_ranked_in_their_document_row(spark, name):
    """No terms are rows that are shuffled; r5 deals out its totals, r9 the summaries of chunks once."""
    assert exchanges(catalogue.queries()[name](spark, SF)) == (name in ("r5_sentence_graph", "r9_hierarchical_summary"))


def test_cuts_look_back_at_abbreviations(spark):
    """Sentences are those of a text whose dots were protected one abbreviation after the other."""
    pieces = ["i.e.", "e.g.", "i.e.g.", "U.S.", "xv.", "No.", "no.", "et al.", "End.", "Why?", "\u0002", "Word", "low", "\n", "é.", "a.b.", "b."]
    texts = [" ".join(pieces[(k * m + m) % len(pieces)] for k in range(40)) for m in range(1, 60)] + [None, "", "A."]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for names in (lexicon.LEGAL_ABBREVIATIONS, lexicon.GENERAL_ABBREVIATIONS, ["b.", "a.b."], ["a.b.", "b.e."], ["End. W"], []):
        text = F.col("text")
        for a in names:
            text = F.replace(text, F.lit(a), F.lit(a.replace(".", "\u0002")))
        old = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])"), lambda x: F.btrim(F.translate(x, "\u0002", "."), F.lit(" \n\t\r"))), lambda x: x != "")
        got = df.select(T.sentences(F.col("text"), names, 0).alias("a"), old.alias("b")).collect()
        assert [r["a"] for r in got] == [r["b"] for r in got]
    assert T._guard([a for a in lexicon.LEGAL_ABBREVIATIONS if "." in a])


def test_shared_grams_take_linear_work(spark):
    """Texts of 20,000 distinct words are counted at once; short ones as by comparing all grams."""
    words = [f"w{k}" for k in range(20000)]
    many = [(["a", "b", "a", "b"], ["b", "a", "b", "b"]), ([], ["a"]), (["a"], ["a"]), (None, ["a"]), (["a", "b"], ["c"]), (words, words[::-1] + words[:3])]
    got = spark.createDataFrame(many, "a array<string>, b array<string>").select(*[T.shared_grams(F.col("a"), F.col("b"), n).alias(f"n{n}") for n in (1, 2, 3)]).collect()
    grams = lambda w, n: collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    assert [tuple(r) for r in got] == [tuple(None if a is None else (grams(a, n) & grams(b, n)).total() for n in (1, 2, 3)) for a, b in many]


def test_plain_tokens_of_odd_texts(spark):
    """One pattern over the text gives what each word reduced by itself gives."""
    texts = ["Don't   stop it-now", "é à\u0085b A.B.C. 12,5", "", None, " \x0b\x1c a\tb\n"]
    each = F.filter(F.transform(T.words(F.lower("text")), lambda w: F.regexp_replace(w, "[^a-z0-9]", "")), lambda w: w != "")
    assert all(r["a"] == r["b"] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(T.plain_tokens(F.col("text")).alias("a"), each.alias("b")).collect())


def test_passages_of_a_document_are_ranked_in_its_row(spark, tmp_path):
    """No term is shuffled; null, empty and one-word texts and a question without content words give what SQL gives."""
    assert exchanges(catalogue.queries()["r4_bm25_in_document"](spark, SF)) == 0
    long = " ".join(f"w{k % 97} term{k % 11}" for k in range(900))
    sf, con = folder(tmp_path, spark, [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "Word", "en", "a", 4), (4, "the of and " * 300, "en", "a", 1), (5, long, "en", "a", 1), (6, "the of and " * 10 + long, "en", "a", 1)])
    ours, theirs = catalogue.queries()["r4_bm25_in_document"](spark, sf).toPandas(), con.execute(catalogue.oracle_sql()["r4_bm25_in_document"]).df()
    assert plain(ours) == plain(theirs) and len(ours) > 4


def test_negatives_are_capped_without_moving_their_texts(spark, monkeypatch):
    """What is kept is the first by order, then context, with many of one order; texts are numbered at the edge only."""
    pool = spark.createDataFrame([(d, f"c{c % 2}", "q", f"text {d} {c}") for d in range(4) for c in range(9)], "doc_id long, clause string, question string, context string")
    every = [tuple(r) for r in sampling.clause_negatives(pool, share=9.0).where("not is_answerable").select(F.md5(F.concat_ws(":", F.lit(42), "doc_id", "clause", "neg_kind", "question")), "context").collect()]
    moved, number = [], sampling.with_row_numbers
    monkeypatch.setattr(sampling, "with_row_numbers", lambda df, *a: (moved.append(df.count() if "neg_context" in df.columns else 0), number(df, *a))[1])
    for share in (0.4,):
        got = sampling.clause_negatives(pool, share=share).where("not is_answerable").select(F.md5(F.concat_ws(":", F.lit(42), "doc_id", "clause", "neg_kind", "question")), "context").collect()
        assert sorted(map(tuple, got)) == sorted(every)[: round(36 * share)]
    assert max(moved) < len(every) // 4


@pytest.mark.parametrize("name", ["w1_chunk_alignment", "a26_second_pass", "k5_alignment_stats", "r8_vector_alignment", "m11_summarisation_stats"])
def test_alignment_reads_texts_to_their_end(spark, tmp_path, name):
    """Texts of some 14 and 11 chunks beside short ones: chunks beyond the eighth are aligned and counted."""
    long = " ".join(f"Sentence{i} names topic{i // 15} and topic{i // 15} again with item{i} near place{i % 7} for once." for i in range(350))
    sf, con = folder(tmp_path, spark, [(1, "One. Two.", "en", "a", 1), (2, long, "en", "a", 1), (4, long[:9000], "en", "a", 1), (5, "", "en", "a", 1), (6, long[5000:], "en", "a", 1)])
    ours, theirs = catalogue.queries()[name](spark, sf).toPandas(), con.execute(catalogue.oracle_sql()[name]).df()
    assert plain(ours) == plain(theirs)
    if name in ("w1_chunk_alignment", "r8_vector_alignment"):
        assert ours.groupby("doc_id")["chunk_i"].max()[[2, 6]].min() > 10
    elif name == "a26_second_pass":
        assert all("topic20 " in t for t in ours.set_index("doc_id")["input"][[2, 6]])
    else:
        every = {r["doc_id"] for r in catalogue.queries()["t8_word_chunks"](spark, sf).collect()} if name == "k5_alignment_stats" else {2, 4, 6}
        counted = catalogue.queries()["t8_word_chunks"](spark, sf).where(F.col("doc_id").isin(every)).count()
        assert ours["chunks"].tolist() == [counted] and ours["aligned"][0] > 16 + 8
