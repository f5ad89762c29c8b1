"""Evaluation: answers, calibration, boundaries, terms, summaries, failures, reports. Predictions are rows; breakdowns are grouping sets."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.scratch import Scratch
from .quantiles import medians
from ..functions.stem import stems

# Outcome words, in the order in which kinds are tried.
MIXED = ["partially granted", "partially denied", "remanded", "affirmed in part", "reversed in part", "vacated in part", "settled", "consent decree"]
PLAINTIFF = ["granted", "affirmed", "awarded", "judgment for plaintiff", "judgment for the plaintiff", "reversed in favor", "in favor of plaintiff", "in favor of the plaintiff", "court found for", "ruled for plaintiff", "settled in favor", "prevailed"]
DEFENDANT = ["denied", "dismissed", "judgment for defendant", "judgment for the defendant", "affirmed dismissal", "in favor of defendant", "in favor of the defendant", "court found for the defendant", "ruled for defendant", "no liability"]
# Metric, least, most, direction.
TARGETS = [
    ("rouge1_f1", 0.30, 0.45, ">"), ("rouge2_f1", 0.10, 0.20, ">"), ("rougeL_f1", 0.25, 0.40, ">"), ("bertscore_f1", 0.80, 1.0, ">"), ("mean_faithfulness", 0.75, 1.0, ">"), ("hallucination_rate", 0.0, 0.15, "<"),
    ("overall_entity_coverage", 0.60, 1.0, ">"), ("person_coverage", 0.70, 1.0, ">"), ("outcome_preservation_rate", 0.70, 1.0, ">"), ("outcome_inversion_rate", 0.0, 0.05, "<"), ("mean_summary_words", 100.0, 300.0, "range"),
]
# Thresholds of the calibration sweep.
THRESHOLDS = [0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90]
DIGITS = 6


def best_over(golds: Column, pred: Column, score: Callable[[Column, Column], Column]) -> Column:
    """The best score over gold answers; without any, 1 for a blank prediction, else 0."""
    blank = F.when(F.btrim(pred) == "", 1.0).otherwise(0.0)
    return F.when(F.size(golds) > 0, F.array_max(F.transform(golds, lambda g: score(pred, g)))).otherwise(blank)


def scored(df: DataFrame) -> DataFrame:
    """Predictions (predicted_answer, gold_answers) with em and f1."""
    pred, golds = F.coalesce("predicted_answer", F.lit("")), F.coalesce("gold_answers", F.array().cast("array<string>"))
    return df.withColumn("em", best_over(golds, pred, T.exact_match)).withColumn("f1", best_over(golds, pred, T.token_f1))


def breakdown(df: DataFrame, groups: Mapping[str, Column], **measures: Column) -> DataFrame:
    """Measures over all rows and over each value of each named group: rows (grp, n, measures). Each row is counted in each of its groups by one aggregate."""
    names = [F.lit("all"), *[F.concat(F.lit(f"{k} "), c.cast("string")) for k, c in groups.items()]]
    rows = df.withColumn("grp", F.explode(F.array_compact(F.array(*names))))
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *[F.round(m, DIGITS).alias(k) for k, m in measures.items()])


def em_f1(df: DataFrame) -> DataFrame:
    return breakdown(scored(df), {"source": F.col("source"), "answerable": F.col("is_answerable")}, em=F.avg("em"), f1=F.avg("f1"))


def confusion(df: DataFrame, by: list[str], decided: Column) -> DataFrame:
    """Confusion cells and rates by group; rates of empty denominators are 0."""
    gold = F.col("is_answerable")
    cell = lambda c: F.count_if(c)
    rows = df.groupBy(*by).agg(cell(gold & decided).alias("tp"), cell(~gold & ~decided).alias("tn"), cell(~gold & decided).alias("fp"), cell(gold & ~decided).alias("fn"))
    rate = lambda a, b: F.round(T.safe_divide(a, b), DIGITS)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return rows.select("*", rate(tp + tn, tp + tn + fp + fn).alias("accuracy"), rate(tp, tp + fn).alias("tpr"), rate(tn, tn + fp).alias("tnr"), rate(fp, fp + tn).alias("fpr"), rate(fn, fn + tp).alias("fnr"))


def sweep(df: DataFrame, groups: Mapping[str, list[str]], thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Confusion for each threshold and group of sources ("overall" is all): pred = prob >= threshold and a span that isn't blank."""
    names = F.array_compact(F.array(F.lit("overall"), *[F.when(F.col("source").isin(s), F.lit(g)) for g, s in groups.items()]))
    rows = df.select("is_answerable", "has_answer_prob", "extracted_span", F.explode(names).alias("grp"))
    rows = rows.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    decided = (F.coalesce("has_answer_prob", F.lit(0.0)) >= F.col("threshold")) & (F.btrim(F.coalesce("extracted_span", F.lit(""))) != "")
    return confusion(rows, ["grp", "threshold"], decided)


def recommended_threshold(swept: DataFrame, group: str = "legal") -> DataFrame:
    """One row: the least threshold with fpr < .08 and tpr > .75, else the one of least fpr with tpr > .6 (the lowest of equals), else null."""
    rows = swept.where(F.col("grp") == group)
    good = F.min(F.when((F.col("fpr") < 0.08) & (F.col("tpr") > 0.75), F.col("threshold")))
    fallback = F.min(F.when(F.col("tpr") > 0.60, F.struct("fpr", "threshold")))
    return rows.agg(good.alias("good"), fallback.alias("fallback")).select(F.coalesce("good", "fallback.threshold").alias("threshold"))


def boundaries(df: DataFrame) -> DataFrame:
    """Answerable rows whose span occurs in the document: starts_ok, ends_ok."""
    rows = df.where("is_answerable and extracted_span <> ''").withColumn("at", F.instr(F.col("document"), F.col("extracted_span")) - 1).where("at >= 0")
    return rows.withColumn("starts_ok", T.starts_at_boundary(F.col("document"), F.col("at"))).withColumn("ends_ok", T.ends_at_boundary(F.col("document"), F.col("at") + F.length("extracted_span")))


def boundary_report(df: DataFrame) -> DataFrame:
    both, either = F.avg((F.col("starts_ok") & F.col("ends_ok")).cast("double")), F.avg((F.col("starts_ok") | F.col("ends_ok")).cast("double"))
    return breakdown(boundaries(df), {"source": F.col("source")}, full=both, partial=either, start_errors=F.count_if(~F.col("starts_ok")), end_errors=F.count_if(~F.col("ends_ok")))


def term_preservation(df: DataFrame) -> DataFrame:
    """One row: mean preservation of each kind of term (the best over gold answers) and overall (the mean of a record's kinds), with the numbers of records."""
    rows = df.where("is_answerable and extracted_span <> '' and size(gold_answers) > 0")
    kinds = ("defined", "monetary", "time", "party")
    kept = lambda k: lambda g: T.share_kept(T.legal_terms(F.col("extracted_span"))[k], T.legal_terms(g)[k])
    best = {k: F.array_max(F.transform("gold_answers", kept(k))) for k in kinds}
    rows = rows.select(*[c.alias(k) for k, c in best.items()])
    held = F.array_compact(F.array(*kinds))
    rows = rows.withColumn("overall", F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.size(held)))
    return rows.agg(F.count("overall").alias("n"), *[F.round(F.coalesce(F.avg(k), F.lit(0.0)), DIGITS).alias(k) for k in ("overall", *kinds)], *[F.count(k).alias(f"n_{k}") for k in kinds])


def generation_report(df: DataFrame, rewrite: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row of means over rows with a span and an answer: faithfulness (word overlap), simplification, grades, facts preserved."""
    rows = df.where("extracted_span <> '' and predicted_answer <> ''")
    if rewrite is not None:
        rows = rows.withColumn("predicted_answer", rewrite(F.col("predicted_answer")))
    span, plain = F.col("extracted_span"), F.col("predicted_answer")
    rows = rows.select(T.word_overlap(span, plain).alias("faith"), T.reading_ease(span).alias("span_ease"), T.reading_ease(plain).alias("plain_ease"), F.coalesce(T.share_kept(T.key_facts(plain), T.key_facts(span)), F.lit(1.0)).alias("facts"))
    mean = lambda c, name: F.round(F.coalesce(F.avg(c), F.lit(0.0)), DIGITS).alias(name)
    return rows.agg(F.count(F.lit(1)).alias("n"), mean("faith", "faithfulness"), mean(F.col("plain_ease") - F.col("span_ease"), "simplification"), mean(T.grade_level(F.col("plain_ease")), "plain_grade"), mean(T.grade_level(F.col("span_ease")), "span_grade"), mean("facts", "information_preservation"))


def failure_category(df: DataFrame) -> DataFrame:
    """``df`` with category: the first rule that holds, false positives before retrieval before span faults."""
    span, plain, golds = F.coalesce("extracted_span", F.lit("")), F.coalesce("predicted_answer", F.lit("")), F.col("gold_answers")
    best = lambda f: F.coalesce(F.array_max(F.transform(golds, lambda g: f(span, g))), F.lit(0.0))
    rows = df.withColumn("__f1", best(T.token_f1)).withColumn("__em", best(T.exact_match))
    extra = F.lit(False)
    of = lambda k: lambda g: T.legal_terms(g)[k]
    for k in ("defined", "monetary", "time"):
        gold_terms = F.flatten(F.transform(golds, of(k)))
        extra = extra | (F.size(F.array_except(T.legal_terms(span)[k], gold_terms)) > 0)
    bag = lambda c: F.array_distinct(T.words(F.lower(c)))
    loose = (F.btrim(plain) != F.btrim(span)) & (F.size(bag(plain)) > 0) & (F.size(F.array_intersect(bag(span), bag(plain))) / F.size(bag(plain)) < 0.35)
    category = (
        F.when(~F.col("is_answerable") & (F.btrim(span) != ""), "has_answer_false_positive")
        .when(~F.col("is_answerable"), "ok")
        .when((F.col("gold_chunk_idx") >= 0) & ~F.array_contains("retrieved", F.col("gold_chunk_idx")), "retrieval_failure")
        .when(F.btrim(span) == "", "missed_answer")
        .when((F.col("__f1") > 0.65) & (F.col("__em") < 0.5), "span_boundary_error")
        .when(extra & (F.col("__f1") < 0.40), "legal_term_hallucination")
        .when((plain != "") & loose, "generation_unfaithful")
        .when(F.col("__f1") < 0.20, "low_quality_span")
        .otherwise("ok")
    )
    return rows.withColumn("category", category).drop("__f1", "__em")


def failure_report(df: DataFrame) -> DataFrame:
    """Counts and shares (four decimals) by category."""
    counts = failure_category(df).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(total).select("category", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))  # a table of one row


def outcome(text: Column) -> Column:
    """mixed, plaintiff, defendant or unknown: kinds are tried in this order by plain containment."""

    def of(low: Column) -> Column:
        has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
        return F.when(has(MIXED), "mixed").when(has(PLAINTIFF), "plaintiff").when(has(DEFENDANT), "defendant").otherwise("unknown")

    return T.let(F.lower(text), of)


def inverted(a: Column, b: Column) -> Column:
    return ((a == "plaintiff") & (b == "defendant")) | ((a == "defendant") & (b == "plaintiff"))


def outcome_report(df: DataFrame) -> DataFrame:
    """One row over (generated, source_text) pairs: shares of pairs with known outcomes that agree or are inverted; the source's outcome is that of its last fifth."""
    rows = df.where("generated <> '' and source_text <> ''").select(outcome(T.tail(F.col("source_text"))).alias("s"), outcome(F.col("generated")).alias("g"))
    known = (F.col("s") != "unknown") & (F.col("g") != "unknown")
    n = rows.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(known).alias("n_known"), F.count_if(known & (F.col("s") == F.col("g"))).alias("n_correct"), F.count_if(inverted(F.col("s"), F.col("g"))).alias("n_inverted"))
    least = F.greatest("n_known", F.lit(1))
    return n.select("*", F.round(F.col("n_correct") / least, DIGITS).alias("preservation"), F.round(F.col("n_inverted") / least, DIGITS).alias("inversion"))


def substring_accuracy(df: DataFrame, by: str) -> DataFrame:
    """(by, accuracy): the share of rows (pred, gold) whose prediction holds the gold text, case ignored; a null side holds nothing."""
    hit = F.coalesce(F.contains(F.lower("pred"), F.lower("gold")), F.lit(False))
    return df.groupBy(by).agg(F.round(F.avg(hit.cast("double")), DIGITS).alias("accuracy"))


def length_report(df: DataFrame, sentences: Callable[[Column], Column]) -> DataFrame:
    """One row over (generated, source_text): words (mean, population deviation, median, least, most), sentences, compression."""
    words = T.word_count(F.col("generated"))
    rows = df.where("generated <> ''").select(words.alias("w"), F.size(sentences(F.col("generated"))).alias("s"), T.word_count(F.col("source_text")).alias("sw"))
    r = lambda c, name: F.round(c, DIGITS).alias(name)
    ratio = F.avg(F.when(F.col("sw") > 0, F.col("w") / F.col("sw")))
    rows = Scratch(df.sparkSession, "lengths").save(rows, "rows")
    one = rows.agg(F.count(F.lit(1)).alias("n"), r(F.avg("w"), "mean_words"), r(F.stddev_pop("w"), "std_words"), F.min("w").alias("min_words"), F.max("w").alias("max_words"), r(F.avg("s"), "mean_sentences"), r(ratio, "compression"))
    return one.join(_median(rows, "w", "median_words"), F.lit(True), "left")  # a row each


def rouge(df: DataFrame, longest: int = 2, lcs: bool = True, stemmed: bool = True) -> DataFrame:
    """One row of mean precision, recall and F1 of n-grams up to ``longest`` and of the longest common subsequence of stems (or words), over (generated, reference)."""
    tokens = lambda c: stems(T.plain_tokens(F.col(c))) if stemmed else T.plain_tokens(F.col(c))
    rows = df.select(tokens("generated").alias("g"), tokens("reference").alias("r"))
    hits = {str(n): (T.shared_grams(F.col("g"), F.col("r"), n), F.greatest(F.size("g") - (n - 1), F.lit(0)), F.greatest(F.size("r") - (n - 1), F.lit(0))) for n in range(1, longest + 1)}
    if lcs:
        hits["L"] = (T.lcs_length(F.col("g"), F.col("r")), F.size("g"), F.size("r"))
    flat = rows.select(*[x.alias(f"{k}_{i}") for k, t in hits.items() for i, x in enumerate(t)])
    out = []
    for k in hits:
        same, a, b = (F.col(f"{k}_{i}") for i in range(3))
        p, q = T.safe_divide(same, a), T.safe_divide(same, b)
        out += [F.round(F.avg(p), DIGITS).alias(f"rouge{k}_precision"), F.round(F.avg(q), DIGITS).alias(f"rouge{k}_recall"), F.round(F.avg(T.safe_divide(2 * p * q, p + q)), DIGITS).alias(f"rouge{k}_f1")]
    return flat.agg(*out)


def extract_quality(df: DataFrame) -> DataFrame:
    """``df`` (summary, document) with precision, coverage and rougeL_precision of an extract against its document, four decimals, 0 for empty sides."""
    rows = df.withColumn("__s", T.plain_tokens(F.col("summary"))).withColumn("__d", T.plain_tokens(F.col("document")))
    empty = (F.size("__s") == 0) | (F.size("__d") == 0)
    inside = F.size(F.filter("__s", lambda w: F.array_contains("__d", w))) / F.size("__s")
    cover = F.size(F.array_intersect("__s", "__d")) / F.size(F.array_distinct("__d"))
    common = T.lcs_length(F.col("__s"), F.col("__d")) / F.size("__s")
    return rows.select(*df.columns, *[F.when(empty, 0.0).otherwise(F.round(c, 4)).alias(k) for k, c in (("precision", inside), ("coverage", cover), ("rougeL_precision", common))])


def sentence_faithfulness(df: DataFrame) -> DataFrame:
    """One row from sentences (test_id, entail, contradict): mean and median share of entailed sentences by text, contradiction rates by text and sentence."""
    by = df.groupBy("test_id").agg(F.avg((F.col("entail") >= 0.5).cast("double")).alias("faith"), F.max((F.col("contradict") >= 0.7).cast("int")).alias("bad"), F.count_if(F.col("contradict") >= 0.7).alias("n_bad"), F.count(F.lit(1)).alias("n"))
    by = Scratch(df.sparkSession, "faith").save(by, "by")
    one = by.agg(F.round(F.avg("faith"), DIGITS).alias("mean_faithfulness"), F.round(F.avg("bad"), DIGITS).alias("hallucination_rate"), F.round(F.sum("n_bad") / F.sum("n"), DIGITS).alias("contradicted"), F.sum("n").alias("n_sentences"))
    return one.join(_median(by, "faith", "median_faithfulness"), F.lit(True), "left")  # a row each


def _median(rows: DataFrame, value: str, name: str) -> DataFrame:
    return medians(rows, [], value).select(F.round("median", DIGITS).alias(name))


def entity_coverage(entities: DataFrame) -> DataFrame:
    """Entities (test_id, side: source or generated, label, text) to mean coverage by label and overall: the share of a source's distinct entities that the generated text has; sources without any are skipped."""
    e = entities.select("test_id", "side", "label", F.lower("text").alias("text")).distinct()
    source = e.where("side = 'source'").drop("side")
    made = e.where("side = 'generated'").select("test_id", "label", "text", F.lit(1).alias("hit"))
    found = source.join(made, ["test_id", "label", "text"], "left").withColumn("label", F.explode(F.array("label", F.lit("overall"))))
    by = found.groupBy("test_id", "label").agg((F.count("hit") / F.count(F.lit(1))).alias("coverage"))
    return by.groupBy("label").agg(F.round(F.avg("coverage"), DIGITS).alias("coverage"), F.count(F.lit(1)).alias("n"))


def vector_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: mean precision, recall and F1 of greedy matching of token vectors (pair_id, vec) of both sides by largest inner product."""
    from .align import dot

    pairs = a.select("pair_id", F.col("pos").alias("i"), F.col("vec").alias("x")).join(b.select("pair_id", F.col("pos").alias("j"), F.col("vec").alias("y")), "pair_id").select("pair_id", "i", "j", dot(F.col("x"), F.col("y")).alias("s"))
    side = lambda k, name: pairs.groupBy("pair_id", k).agg(F.max("s").alias("m")).groupBy("pair_id").agg(F.avg("m").alias(name))
    both = side("i", "p").join(side("j", "r"), "pair_id")
    return both.agg(F.round(F.avg("p"), DIGITS).alias("precision"), F.round(F.avg("r"), DIGITS).alias("recall"), F.round(F.avg(T.safe_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))), DIGITS).alias("f1"))


def ratings(df: DataFrame, axes: list[str]) -> DataFrame:
    """One row: the mean of each axis over rated rows, and how many rows have any rating."""
    return df.agg(*[F.round(F.avg(a), DIGITS).alias(a) for a in axes], F.count_if(F.coalesce(*axes).isNotNull()).alias("n_rated"))


def dialogue_report(turns: DataFrame) -> DataFrame:
    """One row from turns (dialogue_id, lookback, f1_with, f1_without): follow-ups resolved, drift, depth."""
    good = F.col("f1_with") > 0.4
    share = lambda hit, among: F.round(T.safe_divide(F.count_if(hit & among), F.count_if(among)), DIGITS)
    return turns.agg(F.count_distinct("dialogue_id").alias("n_dialogues"), F.count(F.lit(1)).alias("n_turns"), share(good, F.col("lookback") >= 1).alias("resolution"), share(F.col("f1_with") + 1e-6 < F.col("f1_without"), F.lit(True)).alias("drift"), share(good, F.col("lookback") >= 2).alias("depth_accuracy"))


def ranking_accuracy(df: DataFrame) -> DataFrame:
    """Chunks (question_id, source, chunk_idx, score, is_positive) to top-1 and top-3 accuracy of the best positive, over questions with a positive and two chunks."""
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_idx"))
    by = df.withColumn("rank", rank).groupBy("question_id", "source").agg(F.min(F.when(F.col("is_positive"), F.col("rank"))).alias("best"), F.count(F.lit(1)).alias("n")).where("best is not null and n >= 2")
    return breakdown(by.drop("n"), {"source": F.col("source")}, top_1=F.avg((F.col("best") <= 1).cast("double")), top_3=F.avg((F.col("best") <= 3).cast("double")))


def flagged(df: DataFrame, most: int = 50) -> DataFrame:
    """(test_id, issues) of the first ``most`` texts with an issue: empty, under 30 words, over 500 words, outcome inverted."""
    n = T.word_count(F.col("generated"))
    s, g = outcome(T.tail(F.col("source_text"))), outcome(F.col("generated"))
    issues = F.array_compact(F.array(
        F.when(F.btrim("generated") == "", "empty_summary").when(n < 30, F.concat(F.lit("too_short:"), n.cast("string"), F.lit("w"))).when(n > 500, F.concat(F.lit("too_long:"), n.cast("string"), F.lit("w"))),
        F.when((F.col("source_text") != "") & inverted(s, g), F.concat(F.lit("outcome_inverted:"), s, F.lit("->"), g)),
    ))
    return df.select("test_id", F.array_join(issues, ",").alias("issues")).where("issues <> ''").orderBy("test_id").limit(most)


def target_check(metrics: DataFrame) -> DataFrame:
    """Metrics (metric, value) that have a target, with PASS or FAIL."""
    rows = " UNION ALL ".join(f"SELECT '{m}' AS metric, {lo}D AS least, {hi}D AS most, '{k}' AS kind" for m, lo, hi, k in TARGETS)
    t = F.broadcast(metrics.sparkSession.sql(rows))  # a fixed number of rows
    ok = F.when(F.col("kind") == ">", F.col("value") >= F.col("least")).when(F.col("kind") == "<", F.col("value") <= F.col("most")).otherwise(F.col("value").between(F.col("least"), F.col("most")))
    return metrics.join(t, "metric").select("metric", "value", F.when(ok, "PASS").otherwise("FAIL").alias("status"))


def long_report(one_row: DataFrame, prefix: str = "") -> DataFrame:
    """A one-row report as (metric, value) rows; counts (n, n_...) are left out."""
    names = [c for c in one_row.columns if c != "n" and not c.startswith("n_")]
    return one_row.select(F.explode(F.array(*[F.struct(F.lit(prefix + c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("m")).select("m.*")


def run_metrics(metrics: Mapping[str, Callable[[], DataFrame]], only: list[str] | None = None, skip: list[str] = ()) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Reports by name, and the message of each metric that failed instead of stopping the others."""
    done, failed = {}, {}
    for name, make in metrics.items():
        if (only is None or name in only) and name not in skip:
            try:
                done[name] = make()
            except Exception as e:  # noqa: BLE001 - one metric's fault is reported, not raised
                failed[name] = f"{type(e).__name__}: {e}"
    return done, failed
