"""Line dedup: overlapping three-line windows, repeated windows found globally, later occurrences removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def text_lines(text: Column) -> Column:
    """The lines of a text, trimmed of spaces, tabs and carriage returns; lines left empty don't count."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    return F.filter(trimmed, lambda x: x != "")


def _windows(lines: Column) -> Column:
    """(w1, w2) of each window of three line hashes."""
    hashes = F.transform(lines, lambda x: F.xxhash64(x))

    def of(h: Column) -> Column:
        starts = F.when(F.size(h) >= WINDOW, F.sequence(F.lit(0), F.size(h) - WINDOW)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.xxhash64(h[i], h[i + 1], h[i + 2]).alias("w1"), F.xxhash64(h[i + 2], F.lit(1), h[i], h[i + 1]).alias("w2")))

    # A variable of one outer step holds the hashes, else each inner step would compute all of them again.
    return F.flatten(F.transform(F.array(hashes), of))


def line_dedup(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, any others) with ``text`` deduplicated, then n_lines and n_removed.

    A window is three consecutive non-blank lines of one text. Of equal windows the first by
    (doc_id, text hash, position) stays; lines that any later one covers go, so each removed line has
    an equal line that stays. All other lines of a text stay as they are, blank ones and indents too, as do
    texts that lose none, null ones and those under three lines. Null ids sort first.
    Rows equal in doc_id and text count as one occurrence and come back alike.
    """
    keyed = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != "text"],
        F.col("text"),
        F.xxhash64(F.lit("id"), F.col("doc_id")).alias("__k"),
        F.xxhash64(F.col("text")).alias("__t"),
        F.coalesce(F.size(text_lines(F.col("text"))), F.lit(0)).cast("long").alias("__n"),
    )
    windows = keyed.select("doc_id", "__k", "__t", F.posexplode(_windows(text_lines(F.col("text")))).alias("pos", "w"))
    windows = windows.select("doc_id", "__k", "__t", "pos", "w.w1", "w.w2")
    place = F.struct("doc_id", "__t", "pos")
    repeated = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # The third key keeps the join from reusing the aggregate's layout, so AQE may split windows with very many rows.
    third = F.col("w1").bitwiseXOR(F.col("w2")).alias("w3")
    later = windows.select("*", third).join(repeated.select("w1", "w2", third, "first"), ["w1", "w2", "w3"]).where(~place.eqNullSafe(F.col("first")))
    covered = later.groupBy("__k", "__t").agg(F.collect_set("pos").alias("__at"))
    covered = covered.select("__k", "__t", F.expr("array_distinct(flatten(transform(__at, p -> array(p, p + 1, p + 2))))").alias("__gone"))
    joined = keyed.join(covered, ["__k", "__t"], "left")
    return joined.select(
        *[F.when(F.col("__gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("__gone"))).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.col("__n").alias("n_lines"),
        F.coalesce(F.when(F.col("__gone").isNotNull(), F.size("__gone")), F.lit(0)).cast("long").alias("n_removed"),
    )


def _without(text: Column, gone: Column) -> Column:
    """A text without the non-blank lines of these numbers."""

    def kept(lines: Column) -> Column:
        places = F.filter(F.transform(lines, lambda x, i: F.when(F.btrim(x, F.lit(" \t\r")) != "", i)), lambda i: i.isNotNull())
        # Numbers of non-blank lines to places of lines, then what is left of all places; variables of outer steps again.
        removed = lambda at: F.transform(gone, lambda k: F.get(at, k))
        left = _let(places, lambda at: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed(at)))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    return _let(F.split(text, "\n"), kept)


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


SQL = """
WITH l AS (
  SELECT *, list_transform(held, lambda i: trim(raw[i], chr(32) || chr(9) || chr(13))) AS lines
  FROM (SELECT *, list_filter(range(1, len(raw) + 1), lambda i: trim(raw[i], chr(32) || chr(9) || chr(13)) <> '') AS held
    FROM (SELECT doc_id, text, string_split(text, chr(10)) AS raw FROM documents))
), w AS (
  SELECT doc_id, p, lines[p] || chr(10) || lines[p + 1] || chr(10) || lines[p + 2] AS w
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS p FROM l WHERE len(lines) >= 3)
), r AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS n FROM w
), gone AS (
  SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS i FROM r WHERE n > 1
), g AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
)
SELECT l.doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(len(gone), 0) AS n_removed,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(raw) + 1), lambda i: NOT list_contains(list_transform(gone, lambda k: held[k]), i)), lambda i: raw[i]), chr(10)) END AS text
FROM l LEFT JOIN g ON l.doc_id = g.doc_id
"""
