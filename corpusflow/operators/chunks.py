"""Documents to sentences, sections and chunks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as T


def _windows(n: Column, size: int, overlap: int) -> Column:
    """Window numbers that cover n words; none for n = 0."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int"))
    return F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def word_chunks(df: DataFrame, size: int = 350, overlap: int = 50, max_chunks: int | None = None) -> DataFrame:
    """Rows (doc_id, chunk_idx, chunk): windows of ``size`` words; a text of up to ``size`` words stays as it is. ``max_chunks`` keeps the first ones."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    w = df.select("doc_id", "text", T.words(F.col("text")).alias("w")).where(F.col("text").isNotNull())
    starts = F.when(F.size("w") == 0, F.array(F.lit(0))).otherwise(_windows(F.size("w"), size, overlap))
    if max_chunks is not None:
        starts = F.slice(starts, 1, max_chunks)
    rows = w.select("doc_id", "text", "w", F.explode(starts).alias("chunk_idx"))
    part = F.array_join(F.slice("w", F.col("chunk_idx") * step + 1, F.lit(size)), " ")
    return rows.select("doc_id", "chunk_idx", F.when(F.size("w") <= size, F.col("text")).otherwise(part).alias("chunk"))


def chunk_texts(text: Column, size: int = 350, overlap: int = 50) -> Column:
    """The chunks that ``word_chunks`` makes of a text, as one array; none for a null text."""
    step = size - overlap

    def cut(w: Column) -> Column:
        starts = F.when(F.size(w) == 0, F.array(F.lit(0))).otherwise(_windows(F.size(w), size, overlap))
        return F.transform(starts, lambda i: F.when(F.size(w) <= size, text).otherwise(F.array_join(F.slice(w, i * step + 1, F.lit(size)), " ")))

    return F.when(text.isNotNull(), T.let(T.words(text), cut)).otherwise(F.array().cast("array<string>"))


def offset_chunks(df: DataFrame, size: int = 400, overlap: int = 50, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (keys, text, char_start, char_end, word_start, word_end, chunk_idx, n_chunks): windows as slices of the original text. Texts without words have none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    gap = F.regexp_extract_all("text", F.lit(r"(\s*)(\S+)"), F.lit(1))
    word = F.regexp_extract_all("text", F.lit(r"(\s*)(\S+)"), F.lit(2))
    base = df.select(*keys, F.col("text").alias("whole"), F.transform(gap, F.length).alias("gap"), F.transform(word, F.length).alias("word"))
    rows = base.select("*", F.size("word").alias("n"), F.explode(_windows(F.size("word"), size, overlap)).alias("chunk_idx"))
    total = lambda a, upto: F.aggregate(F.slice(a, F.lit(1), upto), F.lit(0), lambda s, x: s + x)
    rows = rows.withColumn("word_start", F.col("chunk_idx") * step).withColumn("word_end", F.least(F.col("word_start") + size, F.col("n")))
    rows = rows.withColumn("char_start", total("gap", F.col("word_start") + 1) + total("word", F.col("word_start"))).withColumn("char_end", total("gap", F.col("word_end")) + total("word", F.col("word_end")))
    chunks = F.size(_windows(F.col("n"), size, overlap))
    return rows.select(*keys, F.substr("whole", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")).alias("text"), "char_start", "char_end", "word_start", "word_end", "chunk_idx", chunks.alias("n_chunks"))


def answer_offsets(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Chunks joined with (doc_id, answer, answer_start): local_start within a chunk that holds the whole answer, else -1."""
    rows = chunks.join(answers, "doc_id")
    local = F.col("answer_start") - F.col("char_start")
    inside = (F.col("answer_start") >= F.col("char_start")) & (F.col("answer_start") + F.length("answer") <= F.col("char_end"))
    equal = F.substr("text", local + 1, F.length("answer")) == F.col("answer")
    return rows.withColumn("local_start", F.when(inside & equal, local).otherwise(-1))


def sentence_rows(df: DataFrame, abbreviations: list[str], least_words: int = 5) -> DataFrame:
    """Rows (doc_id, sent_idx, sentence) in text order."""
    return df.select("doc_id", F.posexplode(T.sentences(F.col("text"), abbreviations, least_words)).alias("sent_idx", "sentence"))


def _spaced(min_gap: int):
    def run(starts: pa.Array) -> pa.Array:
        values, offsets = starts.values.to_pylist(), starts.offsets.to_pylist()
        out = []
        for a, b in zip(offsets, offsets[1:]):
            last, kept = -1, []
            for i in range(a, b):
                if values[i] > last + min_gap:
                    last = values[i]
                    kept.append(i - a)
            out.append(kept)
        return pa.array(out, pa.list_(pa.int32()))

    return run


def pattern_places(df: DataFrame, patterns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ``keep``, all): the matches of all patterns in a text as structs (start, end, name), in characters and in order; the name is the match with single spaces.

    Positions are running sums of the pieces between matches and the matches, in Arrow batches; a null text has none.
    """
    parts = {}
    for i, p in enumerate(patterns):
        cut = F.arrays_zip(F.split("text", p, -1).alias("gap"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("hit"))
        parts[f"p{i}"] = F.when(F.col("text").rlike(p), cut).otherwise(F.array().cast("array<struct<gap:string,hit:string>>"))
    rows = df.select("doc_id", *keep, *[c.alias(n) for n, c in parts.items()])
    rows = rows.withColumns({f"e{i}": T.running_sums(F.transform(p, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0)))) for i, p in enumerate(parts)})
    found = []
    for i, p in enumerate(parts):
        both = F.filter(F.arrays_zip(F.col(p).alias("p"), F.col(f"e{i}").alias("end")), lambda x: x["p"]["hit"].isNotNull())
        found.append(F.transform(both, lambda x: F.struct((x["end"] - F.length(x["p"]["hit"])).alias("start"), x["end"].alias("end"), F.btrim(F.regexp_replace(x["p"]["hit"], r"\s+", " ")).alias("name"))))
    return rows.select("doc_id", *keep, F.sort_array(F.concat(*found)).alias("all"))


def sections(df: DataFrame, min_gap: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, ``keep``, sections: array of start, end, name): header matches by position, each more than ``min_gap`` after the last one kept (which at first is -1, so a header at the very start is dropped).

    Work is in proportion to the text and its headers. A null text has no sections.
    """
    rows = pattern_places(df, [f"(?m){p}" for p in lexicon.SECTION_PATTERNS], keep)
    kept = F.arrow_udf(_spaced(min_gap), "array<int>")(F.transform("all", lambda x: x["start"]))
    # A variable holds the matches, else each step would put them in order again.
    return rows.withColumn("kept", kept).select("doc_id", *keep, T.let(F.col("all"), lambda a: F.transform("kept", lambda i: F.get(a, i))).alias("sections"))


def _pack(size: int, overlap: int):
    def run(doc: pa.Table) -> pa.Table:
        doc = doc.sort_by("sent_idx")
        texts, counts, heads = (doc[c].to_pylist() for c in ("sentence", "n_words", "starts_section"))
        out, held, fresh, at, total = [], [], 0, 0, 0  # held: sentence numbers; fresh: those not yet in a chunk; total: words held

        def emit() -> None:
            out.append((len(out), " ".join(texts[k] for k in held), total, len(held)))

        while at < len(texts):
            if not held or total + counts[at] <= size:
                held.append(at)
                total += counts[at]
                fresh, at = fresh + 1, at + 1
                continue
            if not fresh:  # only what the last chunk ended with: it gives way, so that each turn moves on
                held, total = [], 0
                continue
            ahead = next((d for d in (1, 2, 3) if at + d < len(texts) and heads[at + d]), 0)
            held += range(at, at + ahead)
            total += sum(counts[at : at + ahead])
            at += ahead
            emit()
            kept, room = [], overlap
            for k in reversed(held):
                if counts[k] > room:
                    break
                kept.append(k)
                room -= counts[k]
            held, fresh, total = kept[::-1], 0, overlap - room
        if held:
            emit()
        columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.string(), pa.int32(), pa.int32()))]
        return pa.table([pa.repeat(doc["doc_id"][0], len(out)), *columns], ["doc_id", "chunk_index", "text", "token_count", "sentence_count"])

    return run


def section_chunks(sentences: DataFrame, size: int = 800, overlap: int = 50) -> DataFrame:
    """Sentences (doc_id, sent_idx, sentence, starts_section) packed up to ``size`` words; a chunk that is full first takes in up to three sentences before a section start; up to ``overlap`` words of trailing sentences open the next chunk. One document is one group; an overlap that leaves no room for the next sentence is given up."""
    rows = sentences.withColumn("n_words", T.word_count(F.col("sentence"))).select(F.col("doc_id").cast("long").alias("doc_id"), "sent_idx", "sentence", "n_words", F.coalesce("starts_section", F.lit(False)).alias("starts_section"))
    return rows.groupBy("doc_id").applyInArrow(_pack(size, overlap), "doc_id long, chunk_index int, text string, token_count int, sentence_count int")


def section_starts(texts: DataFrame, abbreviations: list[str] = lexicon.LEGAL_ABBREVIATIONS, reach: int = 200) -> DataFrame:
    """Texts (doc_id, text) to their sentences (doc_id, sent_idx, sentence, starts_section): the first sentence contained in the ``reach`` characters from a section's start starts it. A text stays one row until its sentences are told apart, nothing is shuffled."""
    found = F.coalesce("sections", F.array().cast("array<struct<start:int,end:int,name:string>>"))
    whole = F.struct("text", found.alias("sections"), T.sentences(F.col("text"), abbreviations, 0).alias("sentences"))

    def started(d: Column) -> Column:
        short = F.filter(F.transform(d["sentences"], lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda x: F.length(x["s"]) <= reach)
        head = lambda s: F.array(F.substr(d["text"], s["start"] + 1, F.lit(reach)))
        first = lambda ss, h: F.get(F.filter(ss, lambda x: F.contains(h, x["s"])), F.lit(0))["i"]
        return T.let(short, lambda ss: F.struct(d["sentences"].alias("sentences"), F.array_distinct(F.transform(d["sections"], lambda s: F.transform(head(s), lambda h: first(ss, h))[0])).alias("starts")))

    rows = sections(texts, keep=("text",)).select("doc_id", T.let(whole, started).alias("d")).select("doc_id", "d.starts", "d.sentences")
    parts = rows.select("doc_id", "starts", F.posexplode("sentences").alias("sent_idx", "sentence"))
    return parts.select("doc_id", "sent_idx", "sentence", F.coalesce(F.array_contains("starts", F.col("sent_idx")), F.lit(False)).alias("starts_section"))
