"""Operators without an oracle, and edge cases, on literal rows."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import lexicon
from corpusflow.functions import text as T
from corpusflow.operators import chunks as C
from corpusflow.operators import metrics as M
from corpusflow.operators import spans as N
from corpusflow.operators import sampling as S
from corpusflow.operators import textrank as K
from corpusflow.plans import catalogue
from corpusflow.plans.eval_queries import summaries
from corpusflow.plans.ranks import with_group_ranks, with_sums_before
from corpusflow.plans.scratch import Scratch, released
from corpusflow.sources import readers


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_clean_text(spark):
    raw = "Terms [***] hold.\n- 12 -\nPage 3 of 9\nSHORT CAPS\n***\nThe CONFIDENTIAL sum is due.\nAnnex B\nok\nIN WITNESS WHEREOF we sign"
    assert one(spark, T.clean_text(F.col("t")), t=raw) == "Terms hold.\nThe sum is due."


def test_chunk_edges(spark):
    rows = [(n, " ".join(["w"] * n)) for n in (0, 349, 350, 351, 650, 651)]
    out = collections.Counter(r["doc_id"] for r in C.word_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert dict(out) == {0: 1, 349: 1, 350: 1, 351: 2, 650: 2, 651: 3}
    text = "  a\n\nbb   ccc d  "
    got = [tuple(r) for r in C.offset_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), 2, 1).select("text", "char_start", "char_end").collect()]
    assert got == [(text[s:e], s, e) for _, s, e in got] and len(got) == 3
    with pytest.raises(ValueError):
        C.word_chunks(spark.createDataFrame(rows, "doc_id long, text string"), 5, 5)


def test_sections(spark):
    text = "ARTICLE 1 TERM\nSome words go here.\nWHEREAS, it is so.\n2.1 FEES AND COSTS\nSECTION 4. NOTICES\nDEFINITIONS\nIN WITNESS WHEREOF"
    found = C.sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["sections"]
    want, last = [], -1
    hits = sorted((m.start(), m.end(), re.sub(r"\s+", " ", m[0]).strip()) for p in lexicon.SECTION_PATTERNS for m in re.finditer(p, text, re.M))
    for h in hits:
        if h[0] > last + 10:
            want.append(h)
            last = h[0]
    assert [tuple(s) for s in found] == want and len(want) >= 4


def test_section_chunks_move_on(spark):
    rows = [(1, k, " ".join([f"s{k}"] * n), k == 4) for k, n in enumerate([30, 30, 40, 20, 30, 180, 20])]
    out = C.section_chunks(spark.createDataFrame(rows, "doc_id long, sent_idx int, sentence string, starts_section boolean"), 100, 40).orderBy("chunk_index").collect()
    assert [r["token_count"] for r in out][0] == 120  # three sentences, and the one before the section start
    assert out[-1]["text"].endswith("s6") and len(out) == len({r["text"] for r in out})
    assert {w for r in out for w in r["text"].split()} == {f"s{k}" for k in range(7)}


def test_best_span_ties(spark):
    rows = [(1, [1.0, 1.0, 0.0], [0.0, 1.0, 1.0]), (2, [0.0, 5.0], [9.0, 0.0])]
    got = {r["k"]: tuple(r)[1:] for r in N.best_span(spark.createDataFrame(rows, "k long, starts array<double>, ends array<double>"), "k", 2).collect()}
    assert got == {1: (0, 1, 2.0), 2: (0, 0, 9.0)}


def test_entities_merge_and_extend(spark):
    text = "Pay $1,000 to Green River Company within 30 days now"
    e = N.entity_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert [text[r["s"] : r["e"]] for r in e.orderBy("s").collect()] == ["$1,000", "Green River Company", "30 days"]
    out = N.extend_spans(spark.createDataFrame([(1, 6, 20), (1, 0, 2)], "doc_id long, span_start int, span_end int"), e).orderBy("span_start").collect()
    assert [(r["new_start"], r["new_end"]) for r in out] == [(0, 2), (4, text.index("Company") + 7)]


def test_failure_rules(spark):
    row = lambda **x: {"is_answerable": True, "extracted_span": "the fee", "predicted_answer": "the fee", "gold_answers": ["the fee"], "gold_chunk_idx": 0, "retrieved": [0]} | x
    cases = [
        ("has_answer_false_positive", row(is_answerable=False)), ("ok", row(is_answerable=False, extracted_span="")), ("retrieval_failure", row(gold_chunk_idx=2)), ("missed_answer", row(extracted_span="")),
        ("span_boundary_error", row(extracted_span="fee of one hundred", gold_answers=["fee of one hundred more"])), ("legal_term_hallucination", row(extracted_span="30 days of rest", gold_answers=["something else"])),
        ("generation_unfaithful", row(predicted_answer="quite other words")), ("low_quality_span", row(extracted_span="nothing alike", predicted_answer="nothing alike")), ("ok", row()),
    ]
    schema = "is_answerable boolean, extracted_span string, predicted_answer string, gold_answers array<string>, gold_chunk_idx int, retrieved array<int>"
    out = M.failure_category(spark.createDataFrame([tuple(r.values()) for _, r in cases], schema).coalesce(1)).collect()
    assert [r["category"] for r in out] == [c for c, _ in cases]


def test_threshold_rule(spark):
    rows = [("legal", 0.3, 0.2, 0.9), ("legal", 0.5, 0.07, 0.8), ("legal", 0.7, 0.0, 0.5)]
    df = spark.createDataFrame(rows, "grp string, threshold double, fpr double, tpr double")
    assert M.recommended_threshold(df).first()[0] == 0.5
    assert M.recommended_threshold(df.where("threshold <> 0.5")).first()[0] == 0.3
    assert M.recommended_threshold(df.where("threshold = 0.7")).first()[0] is None


def test_batch_counts():
    assert S.batch_counts({"a": 0.5, "b": 0.3, "c": 0.2}, 16) == {"a": 8, "b": 5, "c": 3}
    assert S.batch_counts({"a": 0.98, "b": 0.02}, 10) == {"a": 9, "b": 1}
    assert S.resolve_mix({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 3, "c": 1}) == pytest.approx({"a": 5 / 7, "c": 2 / 7})
    with pytest.raises(ValueError):
        S.batch_counts({"a": 0.5}, 4)


def test_mixed_batches_recycle(spark):
    rows = [(k, "a") for k in range(20)] + [(100 + k, "b") for k in range(3)]
    df = spark.createDataFrame(rows, "id long, s string")
    out = S.mixed_batches(df, {"a": 4, "b": 2}, "s", "id", 1, length="majority").collect()
    assert collections.Counter(r["batch_id"] for r in out) == {k: 6 for k in range(5)}
    assert sorted(collections.Counter(r["key"] for r in out if r["source"] == "b").values()) == [3, 3, 4]
    with pytest.raises(ValueError):
        S.mixed_batches(df, {"a": 1, "c": 1}, "s", "id", 1)


def test_negatives(spark):
    rows = [(d, f"c{c}", "q", f"text {d} {c}") for d in range(3) for c in range(3)]
    pool = spark.createDataFrame(rows, "doc_id long, clause string, question string, context string")
    out = S.clause_negatives(pool).collect()
    negatives = [r for r in out if not r["is_answerable"]]
    assert len(out) - len(negatives) == 9 and len(negatives) == round(9 * 45 / 55)
    for r in negatives:
        d, c = r["context"].split()[1:]
        assert (int(d) != r["doc_id"]) if r["neg_kind"] == "cross_document" else (int(d) == r["doc_id"] and f"c{c}" != r["clause"])
    alone = S.clause_negatives(pool.where("doc_id = 0 and clause = 'c0'")).collect()
    assert len(alone) == 1


def test_greedy_choice_skips_alike(spark):
    scores = spark.createDataFrame([(1, k, 1.0 - k / 10) for k in range(4)], "doc_id long, sent_idx int, score double")
    terms = spark.createDataFrame([(1, 0, "a", 1.0), (1, 1, "a", 0.9), (1, 2, "b", 1.0), (1, 3, "c", 1.0)], "doc_id long, sent_idx int, term string, w double")
    assert sorted(r["sent_idx"] for r in K.choose_sentences(scores, terms, 3).collect()) == [0, 2, 3]


def test_lcs_and_f1(spark):
    assert one(spark, T.lcs_length(F.col("a"), F.col("b")), a=list("abcbdab"), b=list("bdcaba")) == 4
    assert one(spark, T.token_f1(F.col("a"), F.col("b")), a="The fee, fee of one", b="a fee of two") == pytest.approx(2 * 2 / 7)
    assert one(spark, T.token_f1(F.col("a"), F.col("b")), a="the", b="") == 1.0


def lcs_by_hand(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(row[j], prev[j + 1]))
        prev = row
    return prev[-1]


def test_lcs_of_whole_texts(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice("abcdefgé") for _ in range(rng.randrange(0, n))], [rng.choice("abcdefgé") for _ in range(rng.randrange(0, n))]) for k, n in enumerate([1, 5, 40, 150, 400] * 4)]
    df = spark.createDataFrame(rows + [(98, None, ["a"]), (99, [None, "a"], [None, "a"])], "k long, a array<string>, b array<string>")
    got = {r["k"]: r["n"] for r in df.repartition(3).select("k", T.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {k: lcs_by_hand(a, b) for k, a, b in rows} | {98: None, 99: 1}


def test_lcs_query_reads_whole_texts(spark, tmp_path):
    parts = [[f"S{d}{k} " + " ".join(f"{d}w{j % (k + 3)}" for j in range(30)) + "." for k in range(12)] for d in range(3)]
    text = [" ".join(p) for p in parts]
    spark.createDataFrame([(d, t, "a") for d, t in enumerate(text)], "doc_id long, text string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n"] for r in catalogue.queries()["f8_lcs_length"](spark, f"file://{tmp_path}").collect()}
    assert got == {d: lcs_by_hand(text[d].split(), " ".join(p[::2][::-1]).split()) for d, p in enumerate(parts)}


@pytest.fixture(scope="module")
def end_only(spark, tmp_path_factory):
    """Texts whose summary is their end, far behind the first 300 characters."""
    folder = f"file://{tmp_path_factory.mktemp('end')}"
    rows = [(d, " ".join(f"word{k}" for k in range(200)) + f" Green River Company pays within {d} days " + " ".join(f"last{k}" for k in range(20)), "src0") for d in (4, 8, 24)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_extract_quality_reads_whole_documents(spark, end_only):
    plain = lambda t: [w for w in (re.sub("[^a-z0-9]", "", x) for x in t.lower().split()) if w]
    texts = {r["test_id"]: (plain(r["generated"]), plain(r["source_text"])) for r in summaries(spark, end_only).collect()}
    got = {r["test_id"]: tuple(r)[1:] for r in catalogue.queries()["a15_extract_quality"](spark, end_only).select("test_id", "precision", "coverage", "rougeL_precision").collect()}
    want = {k: (sum(w in d for w in s) / len(s), len({*s} & {*d}) / len({*d}), lcs_by_hand(s, d) / len(s)) for k, (s, d) in texts.items()}
    assert got == {k: pytest.approx(v, abs=6e-5) for k, v in want.items()} and len(got) == 3 and min(v[0] for v in got.values()) > 0.8


def test_entity_coverage_reads_whole_sources(spark, end_only):
    rows = summaries(spark, end_only).collect()
    found = lambda t: {*re.findall(r"\b\d+ days", t)}
    want = [len(found(r["source_text"]) & found(r["generated"])) / len(found(r["source_text"])) for r in rows]
    got = {r["label"]: r for r in catalogue.queries()["a19_entity_coverage"](spark, end_only).collect()}
    assert got["time"]["n"] == 3 and got["time"]["coverage"] == pytest.approx(sum(want) / 3, abs=1e-6)


def test_outcomes(spark):
    texts = {"Motion granted.": "plaintiff", "Claim denied": "defendant", "Affirmed in part": "mixed", "It rained": "unknown", "affirmed dismissal": "plaintiff"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", M.outcome(F.col("t")).alias("o")).collect()
    assert {r["t"]: r["o"] for r in rows} == texts


def test_released_tables_are_deleted(spark):
    with released():
        inner = Scratch(spark, "inner")
        assert inner.save(spark.range(3), "t").count() == 3
    assert not readers.exists(spark, f"{inner.root}/t")
    outer = Scratch(spark, "outer")
    outer.save(spark.range(3), "a")
    outer.save(spark.range(3), "b")
    outer.drop("a")
    assert not readers.exists(spark, f"{outer.root}/a") and readers.exists(spark, f"{outer.root}/b")


def test_numbers_over_ranges(spark):
    rows = [(k % 3, (k * 37) % 50, k % 5) for k in range(200)]
    df = spark.createDataFrame(rows, "g int, o int, v int").withColumn("id", F.monotonically_increasing_id())
    ranked = collections.defaultdict(list)
    for r in with_group_ranks(df, ["g"], ["o", "id"]).collect():
        ranked[r["g"]].append((r["o"], r["id"], r["rank"]))
    assert all([x[2] for x in sorted(own)] == list(range(1, len(own) + 1)) for own in ranked.values())
    sums = collections.defaultdict(list)
    for r in with_sums_before(df, ["g"], ["o", "id"], "v").collect():
        sums[r["g"]].append((r["o"], r["id"], r["v"], r["before"]))
    for own in sums.values():
        total = 0
        for _, _, v, before in sorted(own):
            assert before == total
            total += v


def test_absent_files(spark, tmp_path):
    assert readers.json_lines(spark, f"file://{tmp_path}/none.json", "a long").count() == 0
    assert readers.optional_tests(spark, f"file://{tmp_path}/none.json").count() == 0
    with pytest.raises(FileNotFoundError):
        readers.split_files(spark, f"file://{tmp_path}", "train", "a long", [])
    (tmp_path / "x.json").write_text('{"a": 1, "b": "x"}\n\n{"a": 2, "b": "y"}\n')
    assert readers.json_lines(spark, f"file://{tmp_path}/x.json", "a long, b string").count() == 2


def test_metrics_keep_running(spark):
    done, failed = M.run_metrics({"good": lambda: spark.range(1), "bad": lambda: spark.range(1).select("nope")})
    assert list(done) == ["good"] and "bad" in failed


def test_sweep_and_window_against_all_pairs(spark):
    rng = random.Random(3)
    spans = [(d, a, a + rng.randrange(0, 9)) for d in (1, 2, None) for a in (rng.randrange(60) for _ in range(40))]
    entities = [(d, s, s + rng.randrange(1, 7)) for d in (1, 2, None) for s in (rng.randrange(60) for _ in range(25))]
    hit = lambda d, a, b: [(s, e) for x, s, e in entities if d is not None and x == d and s < b and e > a]
    want = {(d, a, b, min([a, *(s for s, _ in hit(d, a, b))]), max([b, *(e for _, e in hit(d, a, b))])) for d, a, b in spans}
    got = N.extend_spans(spark.createDataFrame(spans, "doc_id long, span_start int, span_end int"), spark.createDataFrame(entities, "doc_id long, s int, e int"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    many = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), (F.col("id") * 10).cast("int").alias("span_start"), (F.col("id") * 10 + 4).cast("int").alias("span_end"))
    wide = N.extend_spans(many, spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), (F.col("id") * 10 + 3).cast("int").alias("s"), (F.col("id") * 10 + 9).cast("int").alias("e")))
    assert wide.where("new_end = span_start + 9 and new_start = span_start").count() == 100_000

    rows = [(k, [rng.choice([0.5, 1.25, rng.random()]) for _ in range(n)], [rng.choice([0.5, rng.random()]) for _ in range(n)]) for k, n in enumerate([0, 1, 5, 30, 31, 64, 200, 200, 200])]
    rows += [(90, [None, 1.0], [float("nan"), 2.0]), (91, None, [1.0]), (92, [1.0, 9.0, 1.0], [3.0])]
    for longest, penalty in ((1, 0.0), (7, 0.0), (30, 0.01), (30, -0.3)):
        want = {}
        for k, s, e in rows[:9]:
            pairs = [(s[i] + e[j] + penalty * (j - i), -i, -j) for i in range(len(s)) for j in range(i, min(i + longest, len(e)))]
            if pairs:
                score, i, j = max(pairs)
                want[k] = (-i, -j, score)
        got = {r[0]: tuple(r)[1:] for r in N.best_span(spark.createDataFrame(rows, "k long, starts array<double>, ends array<double>"), "k", longest, penalty).collect()}
        assert {k: v for k, v in got.items() if k < 90} == want
        assert got[90] == (1, 1, 3.0) and 91 not in got and got[92] == (0, 0, 4.0)
