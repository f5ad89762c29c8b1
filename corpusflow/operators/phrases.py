"""Many phrases in whole texts: one automaton over all phrases, one pass over a text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

#: Characters of the phrases of one automaton, at most, about; more phrases are searched in several passes over the texts.
AUTOMATON_CHARS = 20_000_000


def _places(phrases: list[tuple[int, str]], carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not phrases:
            return
        automaton = ahocorasick.Automaton()
        for no, phrase in phrases:
            automaton.add_word(phrase, (no, len(phrase)))
        automaton.make_automaton()
        for b in batches:
            rows, found, starts = [], [], []
            for i, text in enumerate(b.column(carried).to_pylist()):
                for end, (no, n) in automaton.iter(text or ""):
                    rows.append(i)
                    found.append(no)
                    starts.append(end - n + 1)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns[:carried]], pa.array(found, pa.int64()), pa.array(starts, pa.int64())], [*b.schema.names[:carried], "__no", "start"])

    return run


def phrase_places(texts: DataFrame, phrases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, *columns of phrases, start): every place, from 0 in characters, of every phrase of ``phrases`` (phrase, any others) in ``texts`` (keys, text), overlapping ones too.

    Equal phrases are searched once and come back with each of their rows. Null and empty phrases are nowhere, as are any in
    null texts. An automaton holds up to about ``AUTOMATON_CHARS`` characters and is the only thing that the driver and all tasks hold
    whole; beyond that the texts are passed over once for each part of the phrases, so results are the same at any size.
    """
    spark = texts.sparkSession
    work = Scratch(spark, "phrases")
    distinct = phrases.where("phrase is not null and phrase <> ''").select("phrase").distinct()
    part = F.pmod(F.xxhash64("phrase"), F.lit(1 << 20))
    distinct = work.save(distinct.select("phrase", F.xxhash64("phrase").alias("no"), part.alias("part")), "distinct")
    size = distinct.agg(F.coalesce(F.sum(F.length("phrase")), F.lit(0))).first()[0]
    passes = max(1, -(-size // AUTOMATON_CHARS))
    given = texts.select(*keys, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[: len(keys)])
    found = None
    for k in range(passes):
        own = [(r["no"], r["phrase"]) for r in distinct.where(F.col("part") % passes == k).select("no", "phrase").collect()]
        rows = given.mapInArrow(_places(own, len(keys)), f"{schema}, __no long, start long")
        found = rows if found is None else found.unionByName(rows)
    named = phrases.withColumn("__no", F.xxhash64("phrase"))
    return found.join(named, "__no").select(*keys, *phrases.columns, "start")
