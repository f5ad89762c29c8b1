"""Searches over the term index against scores of all pairs in plain Python."""

import math
import random
from collections import Counter

import pytest

from corpusflow.operators import search as N


def corpus(rng: random.Random, n: int) -> list[tuple[int, int, str | None]]:
    words = [f"term{i}" for i in range(25)]
    rows = [(d, c, " ".join(rng.choice(words[: rng.choice([4, 25])]) for _ in range(rng.randrange(1, 30)))) for d in range(n) for c in (0, 1)]
    return [*rows, (n, 0, None), (n + 1, 0, ""), (n + 2, 0, rows[0][2]), (n + 3, 0, rows[0][2])]


def rankings(passages, queries) -> list[dict]:
    """By query, passages with (score) in order, for TF-IDF and BM25."""
    docs = {(d, c): Counter((t or "").split()) for d, c, t in passages}
    n, mean = len(docs), sum(sum(x.values()) for x in docs.values()) / len(docs)
    df = Counter(t for x in docs.values() for t in x)
    idf = {t: math.log((1 + n) / (1 + f)) + 1 for t, f in df.items()}
    out = [{}, {}]
    for q, text in queries:
        times = Counter(t for t in text.split() if t in df)
        qn = math.sqrt(sum((m * idf[t]) ** 2 for t, m in times.items()))
        for kind in (0, 1):
            scores = {}
            for key, x in docs.items():
                shared = [t for t in times if t in x]
                if not shared:
                    continue
                if kind == 0:
                    norm = math.sqrt(sum((m * idf[t]) ** 2 for t, m in x.items()))
                    s = sum(x[t] * times[t] * idf[t] ** 2 for t in shared) / norm / qn
                else:
                    s = sum(times[t] * math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * x[t] * 2.5 / (x[t] + 1.5 * (0.25 + 0.75 * sum(x.values()) / mean)) for t in shared)
                scores[key] = round(s, 6)
            out[kind][q] = sorted(scores.items(), key=lambda r: (-r[1], r[0]))
    return out


@pytest.mark.parametrize("query_rows, cells", [(N.QUERY_ROWS, N.CELLS), (7, 40)])
def test_searches_and_fusion(spark, monkeypatch, query_rows, cells):
    monkeypatch.setattr(N, "QUERY_ROWS", query_rows)
    monkeypatch.setattr(N, "CELLS", cells)
    rng = random.Random(6)
    passages = corpus(rng, 40)
    queries = [(q, " ".join(f"term{rng.randrange(27)}" for _ in range(rng.randrange(1, 6)))) for q in range(6)] + [(6, "unheard words")]
    keys = ["doc_id", "chunk_idx"]
    index = N.Index.of(spark.createDataFrame(passages, "doc_id long, chunk_idx int, text string").repartition(3), keys)
    asked = spark.createDataFrame(queries, "item_id long, text string")
    parts = (N.tfidf_parts(index, asked, "item_id"), N.bm25_parts(index, asked, "item_id"))
    want = rankings(passages, queries)
    for kind in (0, 1):
        got = {}
        for r in N.best_passages(parts[kind], keys, "item_id", 4).orderBy("item_id", "rank").collect():
            got.setdefault(r["item_id"], []).append(((r["doc_id"], r["chunk_idx"]), r["score"]))
        assert got == {q: rows[:4] for q, rows in want[kind].items() if rows}
    places = [{q: {key: i + 1 for i, (key, _) in enumerate(rows)} for q, rows in side.items()} for side in want]
    some = spark.createDataFrame([(q, d, c) for q in range(7) for d, c, _ in passages[::5]], "item_id long, doc_id long, chunk_idx int")
    got = {(r["item_id"], r["doc_id"], r["chunk_idx"]): r["rank"] for r in N.ranks_of(parts[1], keys, "item_id", some).collect()}
    assert got == {(q, d, c): places[1][q][d, c] for q in range(7) for d, c, _ in passages[::5] if (d, c) in places[1][q]}
    for most, k in ((5, 60), (2, 1), (3, 0)):
        got = [tuple(r) for r in N.fused(*parts, keys, "item_id", most, k).orderBy("item_id", "rank").collect()]
        expected = []
        for q, _ in queries:
            sums = {}
            for key in places[0][q].keys() | places[1][q].keys():
                r0, r1 = places[0][q].get(key), places[1][q].get(key)
                sums[key] = (-round(sum(1 / (k + r) for r in (r0, r1) if r), 9), r0 or math.inf, key)
            for i, (s, _, key) in enumerate(sorted(sums.values())[:most]):
                expected.append((q, *key, -s, i + 1))
        assert got == expected


def test_searches_of_nothing(spark):
    keys = ["doc_id"]
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "term1")], "item_id long, text string")
    index = N.Index.of(none, keys)
    assert N.fused(N.tfidf_parts(index, asked, "item_id"), N.bm25_parts(index, asked, "item_id"), keys, "item_id", 5).collect() == []
    some = N.Index.of(spark.createDataFrame([(1, "term1")], "doc_id long, text string"), keys)
    assert N.best_passages(N.bm25_parts(some, asked.where("false"), "item_id"), keys, "item_id", 3).collect() == []


def test_common_terms_stay_with_their_passage(spark, monkeypatch):
    """Norms of common terms need no shuffle, and any split into common and rare terms gives the same rows."""
    rng = random.Random(8)
    passages, asked = corpus(rng, 30), [(q, " ".join(f"term{rng.randrange(25)}" for _ in range(4))) for q in range(5)]
    rows, queries = spark.createDataFrame(passages, "doc_id long, chunk_idx int, text string").repartition(3), spark.createDataFrame(asked, "item_id long, text string")
    want, keys, saved, save = rankings(passages, asked)[0], ["doc_id", "chunk_idx"], [], N.Scratch.save

    def noted(self, df, name):
        if "x" in df.columns:
            saved.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return save(self, df, name)

    monkeypatch.setattr(N.Scratch, "save", noted)
    for most in (1 << 19, 6, 0):
        monkeypatch.setattr(N, "COMMON_TERMS", most, raising=False)
        got = {}
        for r in N.best_passages(N.tfidf_parts(N.Index.of(rows, keys), queries, "item_id"), keys, "item_id", 4).orderBy("item_id", "rank").collect():
            got.setdefault(r["item_id"], []).append(((r["doc_id"], r["chunk_idx"]), r["score"]))
        assert got == {q: found[:4] for q, found in want.items() if found}
    assert saved[0] == 0 < saved[1]


def test_terms_of_an_index_are_content_words(spark):
    """Stop words that leave after the split are those that the pattern leaves out."""
    texts = ["The theme of it, THE_of the-of 12 the1", "été thé ́the l'été ﬁn İs", "of", "", None, "not‍the the‍ and or if"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["len"], dict(zip(r["terms"], r["tf"]))) for r in N.Index.of(df, ["doc_id"]).rows.collect()}
    words = {r["doc_id"]: r["w"] or [] for r in df.select("doc_id", N.T.content_words(N.F.col("text")).alias("w")).collect()}
    assert got == {d: (len(w), dict(Counter(w))) for d, w in words.items()}
