"""Phrases by automaton against find in plain Python; sections of a text with very many headers."""

import random
import time

import pytest

from corpusflow.operators import chunks as C
from corpusflow.operators import phrases as H


@pytest.mark.parametrize("most", [H.AUTOMATON_CHARS, 40])
def test_phrase_places(spark, monkeypatch, most):
    monkeypatch.setattr(H, "AUTOMATON_CHARS", most)
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ab é𝒳") for _ in range(n))
    texts = [(i, word(rng.randrange(200))) for i in range(40)] + [(90, None), (91, ""), (92, "aaaa"), (92, "aaaa")]
    phrases = [(i, word(rng.randrange(1, 5))) for i in range(25)] + [(50, "aa"), (51, "aa"), (52, None), (53, ""), (54, "zz")]
    got = H.phrase_places(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(phrases, "no int, phrase string"), ["doc_id"])
    want = [(d, n, p, k) for d, t in texts for n, p in phrases if t and p for k in range(len(t)) if t.startswith(p, k)]
    assert sorted((r["doc_id"], r["no"], r["phrase"], r["start"]) for r in got.collect()) == sorted(want)
    none = H.phrase_places(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([], "no int, phrase string"), ["doc_id"])
    assert none.collect() == []


def test_a_text_of_very_many_headers(spark):
    n = 200_000
    text = "intro text here\n" + "".join(f"SECTION {k}. TITLE\nsome words\n" for k in range(n))
    began = time.perf_counter()
    (row,) = C.sections(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).where("doc_id = 1").selectExpr("size(sections) AS n", "sections[1].start AS second").collect()
    assert row["n"] == n and row["second"] == text.index("SECTION 1.")
    assert time.perf_counter() - began < 60
    assert {r["doc_id"]: r["sections"] for r in C.sections(spark.createDataFrame([(2, None), (3, "")], "doc_id long, text string")).collect()}[3] == []
