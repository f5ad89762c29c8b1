"""Queries that SQL cannot express, against plain Python over all documents of the smallest scale."""

import collections
import math
import os
import re

import pytest

from corpusflow.functions import lexicon
from corpusflow.functions.stem import stem
from corpusflow.operators import metrics as M
from corpusflow.operators import spans as N
from corpusflow.plans import catalogue
from corpusflow.plans.eval_queries import summaries
from corpusflow.plans.text_queries import legal

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def run(spark, name):
    return catalogue.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def legal_texts(spark):
    return {r["doc_id"]: r["text"] for r in legal(spark, SF).collect()}


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def sentences(text, names, least=0):
    for a in names:
        text = text.replace(a, a.replace(".", "\x02"))
    parts = [x.replace("\x02", ".").strip(" \n\t\r") for x in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+(?=[A-Z])", text)]
    return [x for x in parts if x and len(re.findall(r"[^ \t\n\x0b\f\r]+", x)) >= least]


def sections(text):
    hits = sorted((m.start(), m.end(), re.sub(r"[ \t\n\x0b\f\r]+", " ", m[0]).strip(" ")) for p in lexicon.SECTION_PATTERNS for m in re.finditer(p, text, re.M | re.A))
    out = []
    for h in hits:
        if h[0] > (out[-1][0] if out else -1) + 10:
            out.append(h)
    return out


def heads(text):
    """Sentences of a text and which of them are the first within 200 characters from a section's start."""
    s = sentences(text, lexicon.LEGAL_ABBREVIATIONS)
    starts = [next((k for k, x in enumerate(s) if x in text[b : b + 200]), None) for b, _, _ in sections(text)]
    return s, {k for k in starts if k is not None}


def test_sections(spark, legal_texts):
    got = {r["doc_id"]: (r["n_sections"], r["found"]) for r in run(spark, "t6_sections")}
    want = {d: sections(t) for d, t in legal_texts.items()}
    assert got == {d: (len(x), "|".join(f"{a}:{b}:{n}" for a, b, n in x)) for d, x in want.items()} and any(want.values())


def test_section_sentences(spark, legal_texts):
    got = collections.defaultdict(set)
    for r in run(spark, "t13_section_sentences"):
        got[r["doc_id"]].add(r["sent_idx"])
    assert got == {d: h for d, t in legal_texts.items() if (h := heads(t)[1])}


def test_sentence_sections(spark, legal_texts):
    got = {(r["doc_id"], r["sent_idx"]): r["section"] for r in run(spark, "t7_sentence_sections")}
    want = {}
    for d, t in legal_texts.items():
        found = sections(t)
        for k, s in enumerate(sentences(t, lexicon.LEGAL_ABBREVIATIONS)):
            at = max(t.find(s[:60]), t.find(s[:40]), 0)
            want[d, k] = sum(b <= at for b, _, _ in found) - 1
    assert got == want


def test_section_chunks(spark, legal_texts):
    got = collections.defaultdict(list)
    for r in sorted(run(spark, "t12_section_chunks"), key=lambda r: r["chunk_index"]):
        got[r["doc_id"]].append((r["text"], r["token_count"], r["sentence_count"]))
    count = lambda x: len(re.findall(r"[^ \t\n\x0b\f\r]+", x))
    for d, t in legal_texts.items():
        s, starts = heads(t)
        want, held, new, k = [], [], False, 0
        while k < len(s) or (held and new):
            if k < len(s) and (not held or sum(count(s[i]) for i in held) + count(s[k]) <= 200):
                held, new, k = [*held, k], True, k + 1
                continue
            if not new:
                held = []
                continue
            if k < len(s):
                for ahead in (1, 2, 3):
                    if k + ahead < len(s) and k + ahead in starts:
                        held, k = [*held, *range(k, k + ahead)], k + ahead
                        break
            want.append((" ".join(s[i] for i in held), sum(count(s[i]) for i in held), len(held)))
            tail = []
            while held and sum(count(s[i]) for i in tail) + count(s[held[-1]]) <= 50:
                tail = [held.pop(), *tail]
            held, new = tail, False
            if k >= len(s):
                break
        if held and k >= len(s) and want and not want[-1][0].endswith(" ".join(s[i] for i in held)):
            want.append((" ".join(s[i] for i in held), sum(count(s[i]) for i in held), len(held)))
        covered = [x[0] for x in got[d]]
        assert covered[: len(want) - 1] == [x[0] for x in want][:-1]
        assert [x[1] for x in got[d]] == [count(x) for x in covered]
        assert all(any(x in c for c in covered) for x in s)


def content(text):
    return [w for w in re.findall(r"\w+", text.lower()) if w not in set(lexicon.STOP_WORDS)]


def summary(text, wanted, found=None, limit=0.35):
    """A document's summary by dense matrices in plain Python."""
    every = list(enumerate(sentences(text, lexicon.LEGAL_ABBREVIATIONS)))
    count = {k: len(x.split()) for k, x in every}
    band = [(k, x) for k, x in every if 12 <= count[k] <= 80]
    if len(band) < max(2, wanted):
        wide = [(k, x) for k, x in every if 12 <= count[k] <= 999]
        band = wide if len(wide) >= 2 else every
    n, bags = len(band), []
    for _, x in band:
        w = [t for t in content(x) if len(t) > 1]
        bags.append(collections.Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]))
    seen = collections.Counter(t for b in bags for t in b)
    rows = []
    for b in bags:
        v = {t: (1 + math.log(c)) * (math.log((1 + n) / (1 + seen[t])) + 1) for t, c in b.items() if seen[t] <= 0.85 * n}
        norm = math.sqrt(sum(x * x for x in v.values()))
        rows.append({t: x / norm for t, x in v.items()})
    like = [[0.0 if i == j else sum(x * b[t] for t, x in a.items() if t in b) for j, b in enumerate(rows)] for i, a in enumerate(rows)]
    total = [sum(r) for r in like]
    score = [1 / n] * n
    for _ in range(100):
        new = [0.15 / n + 0.85 * sum(score[i] * like[i][j] / total[i] for i in range(n) if total[i]) for j in range(n)]
        change, score = sum(abs(a - b) for a, b in zip(new, score, strict=True)), new
        if change < 1e-6:
            break
    score = [0.95 * x + 0.05 * (n - i) / n for i, x in enumerate(score)]
    order = sorted(range(n), key=lambda i: (-score[i], -i))
    place = {i: sum(b <= max(text.find(band[i][1][:60]), text.find(band[i][1][:40]), 0) for b, _, _ in found) - 1 for i in range(n)} if found is not None else None
    taken = []
    fresh = lambda i: len(taken) < wanted and i not in taken and all(like[i][j] < limit for j in taken)
    if place:
        for i in order:
            if fresh(i) and place[i] not in {place[j] for j in taken}:
                taken.append(i)
    for i in order:
        if fresh(i):
            taken.append(i)
    return " ".join(band[i][1] for i in sorted(taken))


def short(texts, most=6000):
    """Plain Python is cubic: documents over ``most`` characters are left to the oracles of the steps."""
    return {d: t for d, t in texts.items() if len(t) <= most}


def test_extractive_summary(spark, texts):
    got = {r["doc_id"]: r["summary"] for r in run(spark, "r7_extractive_summary")}
    assert got.keys() == texts.keys()
    assert {d: got[d] for d in short(texts)} == {d: summary(t, 5) for d, t in short(texts).items()}


def test_section_summary(spark, legal_texts):
    got = {r["doc_id"]: r["summary"] for r in run(spark, "w5_section_summary")}
    assert got.keys() == legal_texts.keys()
    assert {d: got[d] for d in short(legal_texts)} == {d: summary(t, 5, sections(t)) for d, t in short(legal_texts).items()}


def test_hierarchical_summary(spark, texts):
    got = {r["doc_id"]: r["summary"] for r in run(spark, "r9_hierarchical_summary")}
    some = dict(list(short(texts, 12000).items())[:80])
    want = {}
    for d, t in some.items():
        w = re.findall(r"[^ \t\n\x0b\f\r]+", t)
        parts = [t] if len(w) <= 350 else [" ".join(w[k : k + 350]) for k in range(0, 300 * math.ceil((len(w) - 350) / 300) + 1, 300)]
        want[d] = summary(" ".join(summary(p, 4) for p in parts), 5)
    assert {d: got[d] for d in some} == want and got.keys() == texts.keys()


def test_extended_spans(spark, legal_texts):
    got = {r["doc_id"]: (r["new_start"], r["new_end"]) for r in run(spark, "w8_j12_extended_spans")}
    want = {}
    for d, t in legal_texts.items():
        a, b = len(t) - 320, len(t) - 290
        merged = []
        for s, e in sorted(m.span() for p in N.ENTITIES for m in re.finditer(re.sub(r"^\(\?i\)", "", p), t, re.A | (re.I if p.startswith("(?i)") else 0))):
            if merged and s <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        hit = [(s, e) for s, e in merged if s < b and e > a]
        want[d] = (min([a, *(s for s, _ in hit)]), max([b, *(e for _, e in hit)]))
    same = sum(got[d] == want[d] for d in want)
    assert got.keys() == want.keys() and same == len(want)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain(text):
    return [w for w in (re.sub("[^a-z0-9]", "", x) for x in re.split(r"[ \t\n\x0b\f\r]+", text.lower())) if w]


def test_common_subsequences(spark, texts):
    got = {r["doc_id"]: r["n"] for r in run(spark, "f8_lcs_length")}
    for d, t in short(texts, 3000).items():
        s = sentences(t, [])
        assert got[d] == lcs(t.split(), " ".join(s[::2][::-1]).split())
    assert got.keys() == texts.keys()


def test_rouge_lcs(spark):
    rows = [(plain(r["generated"]), plain(r["reference"])) for r in summaries(spark, SF).collect()]
    p, q, f = [], [], []
    for g, r in rows:
        n = lcs(g, r)
        p.append(n / len(g) if g else 0.0)
        q.append(n / len(r) if r else 0.0)
        f.append(2 * p[-1] * q[-1] / (p[-1] + q[-1]) if n else 0.0)
    got = run(spark, "a14_rouge_lcs")[0]
    assert tuple(got) == pytest.approx([sum(x) / len(rows) for x in (p, q, f)], abs=1e-6)


def test_stems():
    """Examples of the algorithm's paper."""
    words = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner adjustable defensible irritant replacement adjustment dependent adoption communism activate homologous effective bowdlerize probate rate cease controll roll"
    stems = "caress poni ti caress cat feed agre plaster bled motor sing conflat troubl size hop tan fall hiss fizz fail file happi sky relat condit ration valenc digit oper feudal decis hope callous formal sensit sensibl triplic form formal electr electr hope good reviv allow infer airlin adjust defens irrit replac adjust depend adopt commun activ homolog effect bowdler probat rate ceas control roll"
    assert [stem(w) for w in words.split()] == stems.split()


def test_extended_stems():
    words = "enjoy enjoyed caresses flies dies mules denied died agreed owned humbled sized meeting stating siezing itemization sensational traditional reference colonizer plotted skies sky ties news proceed dying spied happily fly by boy biology generally hopefully possibly using as"
    stems = "enjoy enjoy caress fli die mule deni die agre own humbl size meet state siez item sensat tradit refer colon plot sky sky tie news proceed die spi happili fli by boy biolog gener hope possibl use as"
    assert [stem(w, True) for w in words.split()] == stems.split()


def test_rouge_stemmed(spark):
    pairs = [tuple([stem(w, True) if len(w) > 3 else w for w in plain(r[c])] for c in ("generated", "reference")) for r in summaries(spark, SF).collect()]
    grams = lambda w, n: collections.Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    want = []
    for kind in (1, 2, "L"):
        p, q, f = [], [], []
        for g, r in pairs:
            a, b = (len(g), len(r)) if kind == "L" else (sum(grams(g, kind).values()), sum(grams(r, kind).values()))
            n = lcs(g, r) if kind == "L" else sum((grams(g, kind) & grams(r, kind)).values())
            p.append(n / a if a else 0.0)
            q.append(n / b if b else 0.0)
            f.append(2 * p[-1] * q[-1] / (p[-1] + q[-1]) if n else 0.0)
        want += [sum(x) / len(pairs) for x in (p, q, f)]
    assert tuple(run(spark, "a14_rouge_stemmed")[0]) == pytest.approx(want, abs=1e-6)


def test_extract_quality(spark):
    rows = {r["test_id"]: (plain(r["generated"]), plain(r["source_text"])) for r in summaries(spark, SF).collect()}
    got = {r["test_id"]: (r["precision"], r["coverage"], r["rougeL_precision"]) for r in run(spark, "a15_extract_quality")}
    for k, (s, d) in rows.items():
        if len(d) <= 600:
            want = (sum(w in set(d) for w in s) / len(s), len({*s} & {*d}) / len({*d}), lcs(s, d) / len(s)) if s and d else (0, 0, 0)
            assert got[k] == pytest.approx(want, abs=6e-5)
    assert got.keys() == rows.keys()
