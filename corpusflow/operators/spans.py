"""Spans over whole texts: the best pair of start and end, merged entities, and widening by an interval sweep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Spans that must not be cut.
ENTITIES = [r"\b(?:[A-Z][a-z]+)(?:\s+[A-Z][a-z]+)+\b", r"\$[0-9][\d,]*(?:\.\d+)?", r"(?i)\b\d[\d,]*\s*(?:dollars?|USD|cents?)\b", r"(?i)\b\d+\s*(?:days?|weeks?|months?|years?|hours?|minutes?)\b"]
#: Relative error within which a start counts as a candidate for the best, before pairs are scored as they are defined.
_SLACK = 1e-9


def _window_max(x: np.ndarray, width: int) -> np.ndarray:
    """Largest of x[i : i + width] for every i of ``x``, in two passes over blocks of ``width``."""
    padded = np.concatenate((x, np.full(width - 1 + -(len(x) + width - 1) % width, -np.inf))).reshape(-1, width)
    ahead = np.maximum.accumulate(padded, axis=1).ravel()
    behind = np.maximum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.maximum(behind[: len(x)], ahead[width - 1 : width - 1 + len(x)])


def _best_pair(s: np.ndarray, e: np.ndarray, longest: int, penalty: float) -> tuple[int, int, float] | None:
    """The first best pair of one row: window maxima bound what a start can reach, and only starts that reach the best are scored pair by pair."""
    n = min(len(s), len(e))
    if not n:
        return None
    at = np.arange(len(e))
    bound = s[:n] + _window_max(e + penalty * at, longest)[:n] - penalty * at[:n]
    top = bound.max()
    if top == -np.inf:
        return None
    best = None
    for i in np.flatnonzero(bound >= top - _SLACK * max(1.0, abs(top), np.abs(penalty) * len(e))).tolist():
        own = s[i] + e[i : i + longest] + penalty * np.arange(len(e[i : i + longest]))
        j = int(own.argmax())
        if own[j] > -np.inf and (best is None or own[j] > best[2]):
            best = (i, i + j, float(own[j]))
    return best


def best_span(df: DataFrame, key: str, longest: int = 30, penalty: float = 0.0) -> DataFrame:
    """(key, start_tok, end_tok, span_score): the pair i <= j < i + longest with the largest start[i] + end[j] + penalty * (j - i); the first pair of equals. df: (key, starts, ends arrays).

    Work is in proportion to the arrays, by sliding maxima within Arrow batches; no pairs are made. Null and NaN parts belong to no pair; a row without a pair is left out.
    """
    kind = df.schema[key].dataType.simpleString()

    def parts(column: pa.ListArray) -> list[np.ndarray]:
        values = np.asarray(column.values.to_numpy(zero_copy_only=False), float)
        values = np.where(np.isnan(values), -np.inf, values)
        offsets, missing = column.offsets.to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
        return [values[a:b] if not gone else values[:0] for a, b, gone in zip(offsets, offsets[1:], missing)]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [_best_pair(s, e, longest, penalty) for s, e in zip(parts(b.column(1)), parts(b.column(2)))]
            rows = [p for p in pairs if p]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array([p is not None for p in pairs], pa.bool_())), *columns], [key, "start_tok", "end_tok", "span_score"])

    rows = df.select(key, F.col("starts").cast("array<double>").alias("starts"), F.col("ends").cast("array<double>").alias("ends"))
    return rows.mapInArrow(found, f"`{key}` {kind}, start_tok int, end_tok int, span_score double")


def entity_spans(df: DataFrame, patterns: list[str] = ENTITIES) -> DataFrame:
    """(doc_id, s, e) of all pattern matches in characters, overlapping and touching ones merged."""
    rows = None
    for p in patterns:
        gap, hit = F.split("text", p, -1), F.regexp_extract_all("text", F.lit(p), F.lit(0))
        part = df.where(F.col("text").rlike(p)).select("doc_id", F.posexplode(F.arrays_zip(gap.alias("g"), hit.alias("h"))).alias("pos", "x"))
        part = part.select("doc_id", "pos", F.length("x.g").alias("g"), F.coalesce(F.length("x.h"), F.lit(0)).alias("h"))
        w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        part = part.withColumn("e", F.sum(F.col("g") + F.col("h")).over(w)).where("h > 0").select("doc_id", (F.col("e") - F.col("h")).alias("s"), "e")
        rows = part if rows is None else rows.union(part)
    return merge_spans(rows)


def merge_spans(spans: DataFrame) -> DataFrame:
    """Spans (doc_id, s, e) with overlapping and touching ones merged: a new island starts where none before reaches."""
    w = Window.partitionBy("doc_id").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("new", F.when(F.col("s") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def extend_spans(spans: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct spans (doc_id, span_start, span_end) widened over every entity (doc_id, s, e) that they overlap.

    A sweep over a document's ends in order, without pairs: among entities that begin before a span's end, the largest end
    reaches into the span if any does; from the other side, among those that end after its start, so does the smallest start. Entities
    may overlap each other. Entities without a doc_id widen nothing; a span without one is kept as it is; so is one with a null end.
    """
    none = F.lit(None).cast("long")
    asked = spans.select("doc_id", F.col("span_start").alias("a"), F.col("span_end").alias("b"), none.alias("s"), none.alias("e")).distinct()
    given = entities.where("doc_id is not null and e > s").select("doc_id", none.alias("a"), none.alias("b"), "s", "e")
    both = asked.unionByName(given)
    # At equal places a span's end comes before what begins there, and its start before what ends there: touching is not overlapping.
    forward = Window.partitionBy("doc_id").orderBy(F.coalesce("b", "s"), F.col("s").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    backward = Window.partitionBy("doc_id").orderBy(F.desc(F.coalesce("a", "e")), F.col("s").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("reach", F.max("e").over(forward)).withColumn("back", F.min("s").over(backward)).where("s is null")
    inside = lambda c: F.col("a").isNotNull() & F.col("b").isNotNull() & c
    start = F.when(inside(F.col("back") < F.col("b")), F.least("a", "back")).otherwise(F.col("a"))
    end = F.when(inside(F.col("reach") > F.col("a")), F.greatest("b", "reach")).otherwise(F.col("b"))
    kinds = {f.name: f.dataType for f in spans.schema.fields}
    wide = lambda c, like: c.cast(kinds[like])
    return swept.select("doc_id", wide(F.col("a"), "span_start").alias("span_start"), wide(F.col("b"), "span_end").alias("span_end"), wide(start, "span_start").alias("new_start"), wide(end, "span_end").alias("new_end"))

