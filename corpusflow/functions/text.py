"""Column functions on text: cleaning, splitting, normalising, counting."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon

_DOT = "\u0002"


def let(value: Column, body) -> Column:
    """``body(value)``, the value being computed once although inner loops use it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def normalise_raw(text: Column) -> Column:
    """Hyphenated line ends joined, single line ends and no-break spaces to spaces, form feeds to line ends, trimmed."""
    for pattern, new in (("-\n", ""), ("(?<!\n)\n(?!\n)", " "), (" +", " ")):
        text = F.regexp_replace(text, pattern, new)
    return F.btrim(F.translate(text, " \f", " \n"), F.lit(" \n\t\r\x0b\f"))


def cut_signature(text: Column) -> Column:
    """The text before the first signature pattern that occurs, patterns being tried in order."""
    out = text
    for p in reversed(lexicon.SIGNATURES):
        out = F.when(text.rlike(f"(?i){p}"), F.regexp_replace(text, f"(?is){p}.*", "")).otherwise(out)
    return out


def strip_patterns(text: Column, patterns: list[str]) -> Column:
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, "")
    return text


def keep_line(line: Column) -> Column:
    """False for empty, very short, page-number, schedule, short capital and symbol-only lines."""
    capitals = line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}") & (word_count(line) <= 5)
    drop = line.rlike(r"^-?\s*\d+\s*-?$") | line.rlike(r"^[Pp]age\s+\d+(\s+of\s+\d+)?$") | line.rlike(r"(?i)^(Schedule|Annex|Appendix)\s+[\w.]+\s*$")
    return (F.length(line) >= 3) & ~drop & ~capitals & line.rlike(r"[\p{L}\p{N}]")


def clean_lines(text: Column) -> Column:
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\f")))
    return F.array_join(F.filter(trimmed, keep_line), "\n")


def squeeze(text: Column) -> Column:
    """Three or more line ends to two, runs of spaces to one, trimmed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), " +", " "), F.lit(" \n\t\r"))


def clean_text(text: Column) -> Column:
    """Signature cut, stamps and footers out, lines filtered, white space squeezed, in this order."""
    return squeeze(clean_lines(strip_patterns(cut_signature(text), lexicon.STAMPS + lexicon.FOOTERS)))


def truncate_words(text: Column, n: int) -> Column:
    """First n words joined by spaces; a text of n words or fewer as it is."""
    return let(words(text), lambda w: F.when(F.size(w) <= n, text).otherwise(F.array_join(F.slice(w, 1, n), " ")))


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def tail(text: Column, share: float = 0.8) -> Column:
    """What follows the first ``share`` of a text."""
    return F.substr(text, F.floor(F.length(text) * share).cast("int") + 1)


def _guard(abbreviations: list[str]) -> str | None:
    """A look-behind that fails where one of these ends, as if the dots of each had been protected in this order; None for lists that need more than it."""
    out, bound = [], set()
    for k, b in enumerate(abbreviations):
        inner = [i for i, c in enumerate(b[:-1]) if c == "."]
        if not b.endswith(".") or not all(b[i + 1].isalpha() for i in inner):
            return None
        part = re.escape(b)
        for head in (b[: i + 1] for i in inner):
            for a in abbreviations[:k]:
                if a != b and a.endswith(head[-len(a) :]):  # an earlier one takes the inner dot, as i.e. does in i.e.g.
                    if len(a) <= len(head) or a in bound:
                        return None
                    part = f"(?<!{re.escape(a[: -len(head)])}){part}"
                    bound.add(b)
        out.append(part)
    return f"(?<!{'|'.join(out)})" if out else ""


def sentences(text: Column, abbreviations: list[str], least_words: int = 5) -> Column:
    """Sentences: cut after . ! or ? before white space and a capital, dots of abbreviations protected, trimmed."""
    dotted = [a for a in abbreviations if "." in a]
    guard = _guard(dotted)  # the cut looks back, so that the text is not written anew for each
    if guard is None:
        for a in dotted:
            text = F.replace(text, F.lit(a), F.lit(a.replace(".", _DOT)))
    parts = F.transform(F.split(text, rf"(?<=[.!?]){guard or ''}\s+(?=[A-Z])"), lambda x: F.btrim(F.translate(x, _DOT, "."), F.lit(" \n\t\r")))
    # Any sentence that is left after trimming counts, if it may be without words.
    return F.filter(parts, lambda x: (x != "") & (word_count(x) >= least_words) if least_words > 0 else x != "")


def fit_sentence(x: Column) -> Column:
    """Ten characters or more, and not only digits and symbols."""
    return (F.length(x) >= 10) & x.rlike(r"[\p{L}_]")


def drop_repeated(text: Column) -> Column:
    """Sentences whose lower-cased trimmed form occurred before are left out."""
    parts = F.split(text, r"(?<=[.!?])\s+")

    def first(p: Column) -> Column:
        return let(F.transform(p, lambda x: F.lower(F.btrim(x, F.lit(" \n\t\r")))), lambda k: F.array_join(F.filter(p, lambda x, i: (F.array_position(k, F.get(k, i)) == i + 1) & (F.get(k, i) != "")), " "))

    return let(parts, first)


def post_process(text: Column) -> Column:
    """Special tokens out, white space squeezed, repeated sentences dropped."""
    plain = F.regexp_replace(F.regexp_replace(text, r"</?s>|<pad>|<unk>|<legal>|\[(?:CLS|SEP|PAD)\]", " "), r"\s+", " ")
    return drop_repeated(F.btrim(plain))


def any_of(words: list[str]) -> str:
    """A pattern of these words and no others, by their first two letters, so that a text's letter rules out most of them at once."""
    heads: dict[str, dict[str, list[str]]] = {}
    for w in sorted(set(words)):
        heads.setdefault(re.escape(w[:1]), {}).setdefault(re.escape(w[1:2]), []).append(re.escape(w[2:]))
    return "|".join(f"{a}(?:{'|'.join(f'{b}(?:{'|'.join(rest)})' for b, rest in more.items())})" for a, more in heads.items())


def content_words(text: Column, stop: list[str] = lexicon.STOP_WORDS) -> Column:
    """Lower-cased word tokens that are not stop words: one pattern leaves these out, since a filter looks each word up in an interpreted expression."""
    no = rf"(?!(?:{any_of(stop)})\b)" if stop else ""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)\b{no}\w++"), F.lit(0))


def key_phrases(text: Column, most: int = 6, stop: list[str] = lexicon.STOP_WORDS) -> Column:
    """Distinct phrases of three content words, then of two, in order; ``most`` at most."""

    def phrases(w: Column) -> Column:
        of = lambda n: F.filter(F.transform(w, lambda x, i: F.when(i + n <= F.size(w), F.array_join(F.slice(w, i + 1, n), " "))), lambda p: p.isNotNull())
        return F.slice(F.array_distinct(F.concat(of(3), of(2))), 1, most)

    return let(content_words(text, stop), phrases)


def normalise_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    bare = F.regexp_replace(F.lower(text), r"[\p{Punct}]", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"\s+", " "))


def plain_tokens(text: Column) -> Column:
    """Words reduced to ASCII letters and digits, lower case, empty ones dropped."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]++", ""), F.lit("[a-z0-9]++"), F.lit(0))


def bag_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    return F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda n, v: n + F.least(count(a, v), count(b, v)))


def token_f1(pred: Column, gold: Column) -> Column:
    """Token F1 of two normalised texts; 1 if both are empty."""

    def of(t: Column) -> Column:
        p, g = t["p"], t["g"]
        same = bag_overlap(p, g).cast("double")
        return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when((F.size(p) == 0) | (F.size(g) == 0) | (same == 0), 0.0).otherwise(2 * same / (F.size(p) + F.size(g)))

    return let(F.struct(words(normalise_answer(pred)).alias("p"), words(normalise_answer(gold)).alias("g")), of)


def exact_match(pred: Column, gold: Column) -> Column:
    return (normalise_answer(pred) == normalise_answer(gold)).cast("double")


def syllables(word: Column) -> Column:
    """Vowel groups, less a silent final e; one at least for a word with letters."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    n = F.regexp_count(w, F.lit("[aeiouy]+"))
    silent = w.endswith("e") & (n > 1) & ~w.endswith("le")
    return F.when(w == "", 0).otherwise(F.greatest(F.lit(1), n - silent.cast("int")))


def reading_ease(text: Column) -> Column:
    """Flesch reading ease; 0 without words."""
    n_sentences = F.size(F.filter(F.split(text, "[.!?]+"), lambda s: F.btrim(s, F.lit(" \n\t\r")) != ""))
    found = F.regexp_extract_all(text, F.lit(r"(?U)\b[a-zA-Z]+\b"), F.lit(0))

    def of(w: Column) -> Column:
        total = F.aggregate(w, F.lit(0), lambda n, x: n + syllables(x))
        score = 206.835 - 1.015 * (F.size(w) / n_sentences) - 84.6 * (total / F.size(w))
        return F.when((F.size(w) == 0) | (n_sentences == 0), 0.0).otherwise(score)

    return let(found, of)


def grade_level(ease: Column) -> Column:
    return F.greatest(F.lit(1.0), 20.0 - ease / 5.0)


def matches(text: Column, pattern: str, lower: bool = False) -> Column:
    """Distinct matches of a pattern in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower) if lower else found)


def key_facts(text: Column) -> Column:
    """Numbers, dates and party names of a text."""
    return F.array_union(F.array_union(matches(text, lexicon.NUMBER), matches(text, lexicon.DATE)), matches(text, lexicon.PARTY_NAME))


def legal_terms(text: Column) -> dict[str, Column]:
    """Distinct defined, monetary, time and party terms of a text."""
    party = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"\b\w+\b"), F.lit(0)), lambda w: w.isin(lexicon.PARTY_WORDS)))
    return {"defined": matches(text, lexicon.DEFINED_TERM), "monetary": matches(text, lexicon.MONEY, True), "time": matches(text, lexicon.TIME_SPAN, True), "party": party}


def share_kept(kept: Column, given: Column) -> Column:
    """Share of ``given`` (an array of distinct values) found in ``kept``; null if nothing is given."""
    return F.when(F.size(given) > 0, F.size(F.array_intersect(given, kept)) / F.size(given))


def word_overlap(premise: Column, hypothesis: Column) -> Column:
    """Share of the hypothesis' distinct words that the premise has; 1 without words."""
    w = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"(?U)\w+"), F.lit(0)))
    return let(F.struct(w(premise).alias("p"), w(hypothesis).alias("h")), lambda t: F.coalesce(share_kept(t["p"], t["h"]), F.lit(1.0)))


def _codes(*sides: pa.Array) -> list[list]:
    """Arrays of string arrays as lists of numbers, alike for equal strings; None for a null array."""
    flat = [side.flatten() for side in sides]
    codes = pa.concat_arrays(flat).dictionary_encode().indices
    codes = codes.fill_null(-1).to_numpy(zero_copy_only=False)
    out, at = [], 0
    for side in sides:
        rows = []
        for n in pc.list_value_length(side).to_pylist():
            rows.append(None if n is None else codes[at : at + n].tolist())
            at += n or 0
        out.append(rows)
    return out


def _lcs(a: list[int], b: list[int]) -> int:
    """The table of the recurrence row by row, a row as the bits of one integer: 0 where the length grows by one."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    places: dict[int, int] = {}
    for k, v in enumerate(a):
        if v >= 0:  # a null equals nothing
            places[v] = places.get(v, 0) | 1 << k
    every = (1 << len(a)) - 1
    row = every
    for v in b:
        if v in places:
            hit = row & places[v]
            row = ((row + hit) | (row - hit)) & every
    return len(a) - row.bit_count()


def _lcs_lengths(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else _lcs(x, y) for x, y in zip(*_codes(a, b), strict=True)], pa.int32())


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of strings, whole texts included: exact, in Arrow batches."""
    return F.arrow_udf(_lcs_lengths, "int")(a, b)


def _shared_grams(n: int):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        sides = [x.flatten() for x in (a, b)]
        code = pa.concat_arrays(sides).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        size = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b)]
        row = np.concatenate([np.repeat(np.arange(len(a)), s) for s in size])
        second = np.repeat((False, True), [len(x) for x in sides])
        # A gram's number is that of its row and the gram before its last word, together with that word's.
        gram, at = row, np.arange(len(row))
        for k in range(n):
            inside = at + k < len(row)
            at, gram = at[inside], gram[inside]
            inside = (row[at + k] == row[at]) & (second[at + k] == second[at])
            at, gram = at[inside], gram[inside]
            gram = np.unique(gram * (int(code.max(initial=0)) + 1) + code[at + k], return_inverse=True)[1]
        most = int(gram.max(initial=0)) + 1
        left, right = (np.bincount(gram[second[at] == s], minlength=most) for s in (False, True))
        owner = np.zeros(most, np.int64)
        owner[gram] = row[at]
        shared = np.bincount(owner, np.minimum(left, right), len(a)).astype(np.int32)
        return pa.array(shared, mask=pc.or_(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False))

    return run


def shared_grams(a: Column, b: Column, n: int) -> Column:
    """Size of the multiset intersection of the runs of n in two arrays of strings without nulls, in Arrow batches, in work that grows with the arrays."""
    return F.arrow_udf(_shared_grams(n), "int")(a, b)


def _running(a: pa.Array) -> pa.Array:
    length = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(a.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
    ends = np.cumsum(length)
    before = np.concatenate(([0], total))[ends - length]
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array((total - np.repeat(before, length)).astype(np.int32)))


def running_sums(a: Column) -> Column:
    """Sums of an array's numbers up to each place, itself included, in Arrow batches; an empty array for a null one."""
    return F.arrow_udf(_running, "array<int>")(a)


def seeded_number(seed: int, *keys: str) -> Column:
    """A number under 16^8 from the md5 of seed and keys, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *keys)), 1, 8), 16, 10).cast("long")


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def starts_at_boundary(text: Column, start: Column) -> Column:
    """Whether a span may start at this position: text start, after a boundary character, or on a line that a section marker heads."""
    before = F.substr(text, F.lit(1), start)
    head = F.concat(F.substring_index(before, "\n", -1), F.substr(text, start + 1, F.lit(1)))
    return (start <= 0) | F.substr(text, start, F.lit(1)).isin(*lexicon.BOUNDARY) | head.rlike(lexicon.SECTION_MARKER)


def ends_at_boundary(text: Column, end: Column) -> Column:
    marks = [*lexicon.BOUNDARY]
    return (end >= F.length(text)) | F.substr(text, end, F.lit(1)).isin(marks) | F.substr(text, end + 1, F.lit(1)).isin(marks)
