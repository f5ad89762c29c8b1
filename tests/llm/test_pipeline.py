"""The pipeline's stages against their operators' brute-force versions, each on its own input."""

import collections

import pytest

import corpus_pipeline as P
from corpusflow.llm.quality_rules import THRESHOLD

from .test_operators import SF, WORD, base_by_hand, components_by_hand, dedup_by_hand


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in P.STAGES:
        path = f"file://{folder}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns(stages):
    for name, _ in P.STAGES[:-1]:
        assert stages[name][1].columns == P.COLUMNS


def test_quality(stages):
    before, after = stages["quality_rules"]
    kept = dict(pairs(after))
    for doc, text in pairs(before):
        n = base_by_hand(text)
        assert doc not in kept or not (n[0] < 10 or 100 * n[4] > 20 * n[0])
    assert THRESHOLD < 0 and 0.5 * before.count() < after.count() < before.count()


def test_lines(stages):
    before, after = stages["line_dedup"]
    want = dedup_by_hand(pairs(before))
    assert dict(pairs(after)) == {k: t for k, (n, gone, t) in want.items() if not gone or gone < n}


def test_near_duplicates(stages):
    before, after = stages["jaccard_join"]
    want = components_by_hand(pairs(before))
    assert sorted(d for d, _ in pairs(after)) == sorted(k for k, (_, c) in want.items() if k == c)


def test_mixing(stages):
    before, after = stages["mixing"]
    texts = dict(pairs(before))
    times = collections.Counter(d for d, _ in pairs(after))
    assert max(times.values()) <= 3 and all(texts[d] == t for d, t in pairs(after))
    size = lambda rows: sum(len(WORD.findall(t or "")) for _, t in rows)
    assert size(pairs(after)) == pytest.approx(size(pairs(before)), rel=0.1)


def test_packing(stages):
    before, after = stages["packing"]
    wanted = collections.Counter(d for d, _ in pairs(before))
    rows = after.collect()
    assert collections.Counter(r["doc_id"] for r in rows if r["start"] == 0) == wanted
    fill = collections.Counter()
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and sum(fill.values()) > 0.9 * 2048 * len(fill)


def test_run(spark, stages):
    assert P.run(spark, SF).count() == stages["packing"][1].count()


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and empty texts, null ids, repeated rows and an empty table go through every stage."""
    from pyspark.sql import functions as F

    long = " ".join(f"w{k % 97}x{k % 89}" for k in range(60))
    near = long.replace("w5x5", "zz")
    rows = [(1, long), (1, long), (2, near), (3, None), (4, ""), (None, long), (None, near), (None, " ".join(f"own{k}" for k in range(40))), (None, " ".join(f"own{k}" for k in range(40))), (5, " ".join(f"other{k}" for k in range(40)))]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    kept = sorted((repr(r["doc_id"]), (r["text"] or "")[:4]) for r in P.near_duplicates(spark, docs, "").collect())
    assert kept == [("1", "w0x0"), ("3", ""), ("4", ""), ("5", "othe"), ("None", "own0")]
    for df in (docs, docs.where(F.lit(False))):
        for name, stage in P.STAGES:
            out = stage(spark, df, f"file://{tmp_path}")
            n = out.count()
            assert n <= 3 * df.count() and (name == "packing" or out.columns == P.COLUMNS)
            assert name != "line_dedup" or n == df.count()
