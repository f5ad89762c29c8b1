"""Large JSON maps by byte ranges: every cut of a file gives the same entries; a stream goes on where it stopped."""

import json
import os
import random
import tracemalloc

import duckdb
import pyarrow as pa
import pytest

from corpusflow.plans import catalogue
from corpusflow.sources import json_map as J


def nasty(rng: random.Random) -> str:
    return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "a", " ", "\n", "é", "𝒳", '\\"', '","k":"']) for _ in range(rng.randrange(30)))


def entries(rng: random.Random, n: int) -> list[tuple]:
    made = []
    for i in range(n):
        value = rng.choice([nasty(rng), nasty(rng), {"doc_text": nasty(rng), "text": nasty(rng)}, None, 3.5, [1, {"x": nasty(rng)}], {}, True])
        made.append((f"{i}{nasty(rng)}", value))
    return made


def as_value(v):
    return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)


@pytest.mark.parametrize("indent", [None, 2])
def test_any_cut_gives_the_same_entries(tmp_path, indent):
    rng = random.Random(9)
    for n in (0, 1, 30):
        made = entries(rng, n)
        path = str(tmp_path / f"m{n}.json")
        with open(path, "w", encoding="utf-8") as f:
            f.write(" \n" + json.dumps(dict(made), ensure_ascii=rng.random() < 0.5, indent=indent) + "\n")
        data = open(path, "rb").read()
        for width in (1, 2, 7, 50, len(data)):
            found, in_string, depth, escaped = [], False, 0, False
            for start in range(0, len(data), width):
                end = min(start + width, len(data))
                found += J.records(path, start, end, in_string, depth)
                for byte in data[start:end]:
                    if in_string:
                        if not escaped and byte == 34:
                            in_string = False
                        escaped = byte == 92 and not escaped
                    elif byte == 34:
                        in_string = True
                    else:
                        depth += (byte in b"{[") - (byte in b"}]")
            assert [(k, v) for k, v, _ in found] == [(k, as_value(v)) for k, v in made]


def test_index_and_stream(spark, tmp_path):
    rng = random.Random(3)
    sides = [entries(rng, 200), [], entries(rng, 150)]
    files = []
    for i, made in enumerate(sides):
        files.append(str(tmp_path / f"m{i}.json"))
        with open(files[-1], "w", encoding="utf-8") as f:
            f.write(json.dumps(dict(made), ensure_ascii=False))
    want = sorted(((k, as_value(v)) for made in sides for k, v in made), key=repr)
    index = str(tmp_path / "index")
    rows = J.index_maps(spark, files, index, 500).collect()
    assert len(rows) > 20
    got = J.large_maps(spark, index)
    assert got.rdd.getNumPartitions() == len(rows)
    assert sorted(((r["key"], r["value"]) for r in got.collect()), key=repr) == want

    grown, out, state = str(tmp_path / "grown"), str(tmp_path / "out"), str(tmp_path / "state")

    def run() -> int:
        query = J.large_maps(spark, grown, stream=True).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return spark.read.parquet(out).count()

    J.index_maps(spark, files, grown, 500, 0, 7)
    first = run()
    assert 0 < first < len(want) and run() == first
    J.index_maps(spark, files, grown, 500, 7)
    assert run() == len(want)
    assert sorted(((r["key"], r["value"]) for r in spark.read.parquet(out).collect()), key=repr) == want


def test_written_maps(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), json.dumps(f'a "{i}"\n')) for i in range(50)], "key string, json string").repartition(3)
    files = J.write_maps(rows, f"file://{tmp_path}/maps")
    assert len(files) == 3
    assert {k: v for f in files for k, v in json.load(open(f.removeprefix("file://"))).items()} == {str(i): f'a "{i}"\n' for i in range(50)}
    assert all(os.path.getsize(f.removeprefix("file://")) for f in files)


def test_ranges_are_read_once(spark, tmp_path, monkeypatch):
    """A later part of an index reads no file that ended before it; ranges are counted before they are dealt out; x2 indexes each range once."""
    files = [str(tmp_path / f"m{i}.json") for i in range(3)]
    for i, f in enumerate(files):
        with open(f, "w", encoding="utf-8") as out:
            json.dump({f"{i}-{k}": "x" * 90 for k in range(30)}, out)
    whole = [tuple(r) for r in J.index_maps(spark, files, str(tmp_path / "whole"), 500).orderBy("no").collect()]
    counted, sums = [], J.with_sums_before

    def noted(df, *given):
        counted.append((df.count(), "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()))
        return sums(df, *given)

    monkeypatch.setattr(J, "with_sums_before", noted)
    cuts = [0, 3, next(r[1] for r in whole if r[0] == files[1]), len(whole) - 2, len(whole)]
    for first, last in zip(cuts, cuts[1:]):
        parts = J.index_maps(spark, files, str(tmp_path / "parts"), 500, first, last)
    assert [tuple(r) for r in parts.orderBy("no").collect()] == whole
    assert not any(again for _, again in counted)
    third = len(whole) - 2 - next(r[1] for r in whole if r[0] == files[2])
    assert counted[-1][0] == third + 2 and counted[4][0] == cuts[3] - cuts[2]

    made, index_maps = [], J.index_maps
    monkeypatch.setattr(J, "index_maps", lambda spark, files, index, width, first=0, last=None: (made.append((first, last)), index_maps(spark, files, index, width, first, last))[1])
    catalogue.queries()["x2_streamed_documents"](spark, "/root/testdata/sf0.01")
    assert len(made) == 2 and made[0][0] == 0 and made[0][1] == made[1][0]


def test_long_entries_are_handed_on_some_at_a_time(tmp_path):
    """Neither writing nor reading holds copies of a batch: what is made at a time has a fixed size, whatever the entries' lengths."""
    text = json.dumps("y" * 200_000)
    given = pa.RecordBatch.from_arrays([pa.array([f"k{i}" for i in range(300)]), pa.array([text] * 299 + [None])], ["key", "json"])
    tracemalloc.start()
    made = list(J._as_map(iter([given.slice(0, 0), given])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10_000_000 and max(b.nbytes for b in made) < J.BATCH_SIZE + 300_000
    path = str(tmp_path / "long.json")
    with open(path, "w") as f:
        f.write("\n".join(v for b in made for v in b.column(0).to_pylist()))
    assert json.load(open(path)) == {f"k{i}": "y" * 200_000 if i < 299 else None for i in range(300)}
    read = list(J._batches({"file": path, "start": 0, "end": os.path.getsize(path), "in_string": False, "depth": 0}))
    assert sum(b.num_rows for b in read) == 300 and max(b.nbytes for b in read) < J.BATCH_SIZE + 300_000
    assert [b.column(0).to_pylist() for b in J._as_map(iter([]))] == [["{}"]]


def test_source_map_of_odd_texts(spark, tmp_path):
    """Null, empty and blank texts have no row, a text that looks like JSON stays as it is, and one over Jackson's limit of 20 million characters is whole."""
    odd = [None, "", " ", "\t", "\n", "\u00a0", " \u3000\u2003 ", " \u200b", '{"doc_text": "other"}', '{"text": "x"', "{}", "null", '"', "\\", "a\u0000b", "[1]", '{"doc_text": "", "text": ""}', "\ufeffx", "a\r\nb\r"]
    rows = [(6 * i + k, t) for i, t in enumerate(odd) for k in range(6)] + [(6 * len(odd) + k, "long, " * 3_400_000) for k in (1, 3)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'src0' AS source", "length(text) AS n_chars").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalogue.oracle_sql()["s6_source_map"]).fetchall()
    assert sorted(map(tuple, catalogue.queries()["s6_source_map"](spark, str(tmp_path)).collect())) == sorted(want) and len(want) == 6 * 14 + 2
