"""Chunk decisions, answer checks and QA records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

# Phrases that mean no answer.
NO_ANSWER = ["not found", "no answer", "does not contain", "not present"]
NOT_FOUND = "Answer not found in document."


def final_score(prob: Column, span_score: Column, start: Column, end: Column) -> Column:
    """Probability times the squashed span score; 0 for the empty span at position 0."""
    return F.when((start == 0) & (end == 0), 0.0).otherwise(prob * T.sigmoid(span_score / 10.0))


def best_chunk(df: DataFrame, key: str, keep: float = 0.3, answer: float = 0.35) -> DataFrame:
    """df (key, chunk_idx, prob, final, span) -> (key, chunk_idx, answer): the best final score among chunks with prob >= keep and a span, else among those with a span; the answer is given if its prob >= answer."""
    usable = df.where("span <> ''").withColumn("kept", F.col("prob") >= keep)
    w = Window.partitionBy(key).orderBy(F.desc("kept"), F.desc("final"), "chunk_idx")
    best = usable.withColumn("n", F.row_number().over(w)).where("n = 1")
    rows = df.select(key).distinct().join(best.select(key, "chunk_idx", "prob", "span"), key, "left")
    return rows.select(key, "chunk_idx", F.when(F.col("prob") >= answer, F.col("span")).otherwise(NOT_FOUND).alias("answer"))


def longest_span(df: DataFrame, key: str) -> DataFrame:
    """The longest span of each key, ties to the better retrieval rank."""
    w = Window.partitionBy(key).orderBy(F.desc(F.length("span")), "rank")
    return df.where("span <> ''").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def plausible(question: Column, context: Column) -> Column:
    """Whether a context can answer: price questions need a money word, "when" questions a date word."""
    q, c = F.lower(question), F.lower(context)
    money = _any(c, ["$", "usd", "rs", "rupees", "price", "amount"])
    date = _any(c, ["year", "month", "day", "202", "203"])
    return F.when(_any(q, ["price", "cost", "amount"]), money).when(q.contains("when"), date).otherwise(True)


def _any(text: Column, parts: list[str]) -> Column:
    out = text.contains(parts[0])
    for p in parts[1:]:
        out = out | text.contains(p)
    return out


def is_no_answer(text: Column) -> Column:
    return _any(F.lower(text), NO_ANSWER)


def locate_answer(article: Column, answer: Column) -> Column:
    """1-based position of the answer, case ignored, else of its first key phrase that occurs; 0 if none does."""
    low = F.lower(article)
    phrases = F.filter(F.transform(T.key_phrases(answer), lambda p: F.instr(low, p)), lambda x: x > 0)
    return F.when(F.instr(low, F.lower(answer)) > 0, F.instr(low, F.lower(answer))).otherwise(F.coalesce(F.get(phrases, F.lit(0)), F.lit(0)))


def strip_option(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s*[\(\[]?[A-Da-d][\)\].:\-]\s*", "")


def gold_option(options: Column, labels: list[Column]) -> Column:
    """The option that the first usable label names: an index in range, or a letter A to D."""
    usable = []
    for c in labels:
        letter = F.ascii(F.upper(c)) - F.ascii(F.lit("A"))
        index = F.when(c.rlike("^[A-Da-d]$"), letter).when(c.rlike("^[0-9]+$"), c.try_cast("int"))
        usable.append(F.when((index >= 0) & (index < F.size(options)), F.get(options, index)))
    return F.coalesce(*usable)


def clause_title(question: Column) -> Column:
    """The first quoted text in lower case, "unknown" without."""
    found = F.lower(F.btrim(F.regexp_extract(question, "\"([^\"]+)\"", 1)))
    return F.when(found == "", "unknown").otherwise(F.coalesce(found, F.lit("unknown")))


def contract_violations(df: DataFrame, domains: list[str]) -> DataFrame:
    """``df`` with violations: what is wrong with each QA record (missing fields, unknown domain, an answerable one without an answer)."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in ("question", "context", "answer_text", "answer_start", "is_answerable", "domain")]
    checks.append(F.when(~F.col("domain").isin(domains), F.lit("domain")))
    checks.append(F.when(F.col("is_answerable") & (F.col("answer_start") < 0), F.lit("answer_start")))
    return df.withColumn("violations", F.array_compact(F.array(*checks)))


def flatten_paper(title: Column, abstract: Column, names: Column, paragraphs: Column) -> Column:
    """Title, abstract, then each section's name and paragraphs, joined by blank lines, empty parts dropped."""
    body = F.flatten(F.transform(F.arrays_zip(names.alias("n"), paragraphs.alias("p")), lambda x: F.concat(F.array(x["n"]), F.coalesce(x["p"], F.array().cast("array<string>")))))
    parts = F.concat(F.array(title, abstract), body)
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (F.btrim(x) != "")), "\n\n")


def answer_type(unanswerable: Column, spans: Column, yes_no: Column) -> Column:
    return F.when(unanswerable, "abstractive").when(F.size(spans) > 0, "extractive").when(yes_no.isNotNull(), "boolean").otherwise("abstractive")
