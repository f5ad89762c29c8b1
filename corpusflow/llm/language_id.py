"""Language ID: unigram piece models per language, summed over all segmentations of each word."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scratch import Scratch
from .textstream import mix

#: Training documents of one language, at most (the smallest by hash of their id).
DOCS_PER_LANGUAGE = 400
#: Languages that a model can hold (more raise an error): its table has a row a piece and a column a language.
MAX_LANGUAGES = 500
#: Longest piece in characters that the forward pass looks up.
LONGEST = 12
#: Letters of the words whose scores a Python worker keeps, and their number.
CACHED_LETTERS, CACHED_WORDS = 32, 400_000
#: Letters after which the forward pass brings its values back to 1.
RESCALE = 24
_LETTERS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """Lower-cased runs of letters (marks that follow a letter composed with it)."""
    return _LETTERS.findall(unicodedata.normalize("NFC", text).lower())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _next_hash(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Hash of a string from that of all but its last character and the code of that."""
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + code + np.uint64(1))


class PieceModel:
    """log P(word | language) over a fixed vocabulary of pieces, by a forward pass over all segmentations."""

    def __init__(self, languages: list[str], pieces: list[str], probability: np.ndarray, unknown: np.ndarray):
        """``probability``: pieces x languages; ``unknown``: that of a character that no piece covers, by language."""
        self.languages, self.unknown = languages, unknown
        self.row = {p: k for k, p in enumerate(pieces)}
        # Hashes of pieces and of their starts, ascending, with the piece's row, or -1 for a start that is none itself.
        starts = dict.fromkeys((p[:k] for p in pieces for k in range(1, len(p))), -1) | self.row
        hashes = np.zeros(len(starts), np.uint64)
        by_size: dict[int, list[int]] = {}
        for k, x in enumerate(starts):
            by_size.setdefault(len(x), []).append(k)
        names = list(starts)
        for size, own in by_size.items():
            codes = _codes("".join(names[k] for k in own)).reshape(-1, size)
            for c in range(size):
                hashes[own] = _next_hash(hashes[own], codes[:, c])
        order = np.argsort(hashes)
        self.hashes, self.rows = np.append(hashes[order], ~np.uint64(0)), np.append(np.fromiter(starts.values(), np.int64, len(starts))[order], -1)
        self.p = probability
        self.cache: dict[str, int] = {}
        self.scores = np.zeros((1024, len(languages)))

    def by_end(self, words: list[str], strip: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(words, starts, pieces) of all pieces of "▁word" that end at place 1, 2, ... of the longest word; found strip by strip."""
        size = np.array([len(w) + 1 for w in words])
        codes, offset = _codes("▁" + "▁".join(words)), np.cumsum(size) - size
        held = tuple(np.zeros(0, np.int64) for _ in range(4))
        for first in range(0, int(size.max()), strip):
            n = np.clip(size - first, 0, strip)
            word = np.repeat(np.arange(len(words)), n)
            start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first
            parts, h = [held], np.zeros(len(word), np.uint64)
            for k in range(1, LONGEST + 1):
                go = start + k <= size[word]
                word, start, h = word[go], start[go], h[go]
                h = _next_hash(h, codes[offset[word] + start + k - 1])
                at = np.searchsorted(self.hashes, h)
                go = self.hashes[at] == h
                word, start, h, piece = word[go], start[go], h[go], self.rows[at[go]]
                whole = piece >= 0
                parts.append((start[whole] + k, word[whole], start[whole], piece[whole]))
            end, word, start, piece = (np.concatenate([x[c] for x in parts]) for c in range(4))
            order = np.lexsort((word, end))
            held = tuple(x[order] for x in (end, word, start, piece))
            last = min(first + strip, int(size.max()))
            cuts = np.searchsorted(held[0], np.arange(first + 1, last + 2))
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield tuple(x[a:b] for x in held[1:])
            held = tuple(x[cuts[-1] :] for x in held)

    def forward(self, words: list[str], strip: int = 4096) -> np.ndarray:
        """log of the sum over all ways to cut "▁word" into pieces, for many words and all languages at once, whatever their length.

        Only the last ``LONGEST`` places are held; values are brought back to 1 now and then and their logarithms kept.
        """
        length = np.array([len(w) + 1 for w in words])
        ring, wide = LONGEST + 1, int(length.max())
        a = np.zeros((ring, len(words), len(self.languages)))
        a[0] = 1.0
        scale, out = np.zeros(a.shape[1:]), np.zeros(a.shape[1:])
        done = np.bincount(length, minlength=wide + 1)
        for j, (w, i, piece) in enumerate(self.by_end(words, strip), 1):
            now = a[j % ring]
            np.multiply(a[(j - 1) % ring], self.unknown, out=now)
            if len(w):
                first = np.flatnonzero(np.diff(w, prepend=-1))
                now[w[first]] += np.add.reduceat(a[i % ring, w] * self.p[piece], first, axis=0)
            if done[j]:
                at = np.flatnonzero(length == j)
                out[at] = np.log(now[at]) + scale[at]
            if j % RESCALE == 0:
                by = np.where(now > 0, now, 1.0)
                scale += np.log(by)
                a /= by
        return out

    def learn(self, words: list[str]) -> None:
        """Score words that the table lacks."""
        for part in by_length(words):
            self._add(part, self.forward(part))

    def _add(self, words: list[str], scores: np.ndarray) -> None:
        first = len(self.cache)
        while first + len(words) > len(self.scores):
            self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
        self.scores[first : first + len(words)] = scores
        self.cache.update(zip(words, range(first, first + len(words)), strict=True))

    def score(self, text: str) -> tuple[np.ndarray, int]:
        """(log likelihood by language, letters) of all letter runs of the text, each as a whole."""
        return next(self.scored([text]))

    def scored(self, texts: list[str]) -> Iterator[tuple[np.ndarray, int]]:
        """``score`` of each text; words that are new are scored together."""
        runs = [letter_runs(t) for t in texts]
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        new = set().union(*runs).difference(self.cache)
        self.learn(sorted(w for w in new if len(w) <= CACHED_LETTERS))
        for words in runs:
            letters, total = sum(map(len, words)), np.zeros(len(self.languages))
            if letters > CACHED_LETTERS and (long := [w for w in words if len(w) > CACHED_LETTERS]):
                words = [w for w in words if len(w) <= CACHED_LETTERS]
                for part in by_length(long):
                    total += self.forward(part).sum(axis=0)
            rows = np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))
            yield total + self.scores[rows].sum(axis=0), letters


def by_length(words: list[str], most: int = 4096, letters: int = 1 << 17) -> Iterator[list[str]]:
    """Words in runs of like length, each of so many words and letters at most (a longer word is a run of its own)."""
    held, size = [], 0
    for w in sorted(words, key=len):
        if held and (len(held) >= most or size + len(w) > letters):
            yield held
            held, size = [], 0
        held.append(w)
        size += len(w)
    if held:
        yield held


def vocabulary(path: str | None) -> list[str]:
    """Letter pieces of a public sentencepiece vocabulary."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {unicodedata.normalize("NFC", model.id_to_piece(k)).lower() for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))}
    return sorted(p for p in pieces if len(p) <= LONGEST and (p == "▁" or p.removeprefix("▁").isalpha()))


def fit(docs: DataFrame, vocabulary_path: str | None = None, rounds: int = 2, docs_per_language: int = DOCS_PER_LANGUAGE) -> PieceModel:
    """Piece probabilities by language from ``docs`` (doc_id, text, lang), by expectation-maximisation over all segmentations.

    The sample: of each language the ``docs_per_language`` documents with the smallest hashes of
    (doc_id, text), all words of their whole texts. Every piece starts equal in all languages. Expected counts
    are summed in tasks; the driver holds the table of pieces by language only. More than ``MAX_LANGUAGES``
    languages raise an error. Languages are in order of their documents' number, then of their name.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "language")
    langs = [r["lang"] for r in docs.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    ranked = docs.where("lang is not null and text is not null").select("lang", "doc_id", F.xxhash64("doc_id", "text").alias("h"))
    # First rows of parts of a language before those of the language: no task gathers a whole language.
    few = ranked.withColumn("part", F.pmod("h", F.lit(8))).withColumn("n", F.row_number().over(Window.partitionBy("lang", "part").orderBy("h", "doc_id"))).where(F.col("n") <= docs_per_language)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("n") <= docs_per_language)
    chosen = F.broadcast(few.select("doc_id", "h").distinct().limit(docs_per_language * max(1, len(langs))))
    sample = docs.withColumn("h", F.xxhash64("doc_id", "text")).join(chosen, ["doc_id", "h"], "left_semi").where("lang is not null")
    words = sample.select("lang", "text").mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = work.save(words, "words")
    pieces = vocabulary(vocabulary_path)
    model = PieceModel(langs, pieces, np.full((len(pieces), len(langs)), 1.0 / max(1, len(pieces))), np.full(len(langs), 0.1 / max(1, len(pieces))))
    for _ in range(rounds if langs else 0):
        counts = np.full((len(pieces), len(langs)), 0.05)
        for r in words.mapInArrow(_expected(langs, pieces, model.p, model.unknown), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r["piece"], r["lang"]] += r["n"]
        model.p = counts / counts.sum(axis=0)
    return model


def _word_counts(batches):
    for batch in batches:
        found: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            found.update((lang, w) for w in letter_runs(text.as_py() or ""))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())], ["lang", "word", "n"])


def expected_counts(model: PieceModel, lang: int, words: list[str], times: np.ndarray) -> np.ndarray:
    """How often each piece is used in words of a language, over all segmentations by their probability: a forward and a backward pass in logarithms."""
    length = np.array([len(w) + 1 for w in words])
    wide, every = int(length.max()), np.arange(len(words))
    p, skip = model.p[:, lang], model.unknown[lang]
    spans = {j: x for j, x in enumerate(model.by_end(words), 1) if len(x[0])}
    forward, backward = np.zeros((wide + 1, len(words))), np.full((wide + 1, len(words)), -np.inf)
    for j in range(1, wide + 1):
        before = forward[j - 1]
        got = np.full(len(words), skip)
        if j in spans:
            w, i, piece = spans[j]
            np.add.at(got, w, p[piece] * np.exp(forward[i, w] - before[w]))
        forward[j] = before + np.log(got)
    backward[length, every] = 0.0
    out = np.zeros(len(p))
    total = forward[length, every]
    for j in range(wide, 0, -1):
        # Nothing else reaches place j from behind once its own pieces are settled, as pieces are given in order of their ends.
        backward[j - 1] = np.logaddexp(backward[j - 1], backward[j] + np.log(skip))
        if j in spans:
            w, i, piece = spans[j]
            gain = np.log(p[piece]) + backward[j, w]
            np.logaddexp.at(backward, (i, w), gain)
            np.add.at(out, piece, times[w] * np.exp(forward[i, w] + gain - total[w]))
    return out


def _expected(languages: list[str], pieces: list[str], p: np.ndarray, unknown: np.ndarray):
    def run(batches):
        model, place, found = PieceModel(languages, pieces, p, unknown), {x: k for k, x in enumerate(languages)}, {}
        for batch in batches:
            held: dict[str, dict[str, int]] = {}
            for lang, word, n in zip(*[batch.column(c).to_pylist() for c in ("lang", "word", "n")], strict=True):
                held.setdefault(lang, {})[word] = n
            for lang, words in held.items():
                if lang not in found:
                    found[lang] = np.zeros(len(pieces))
                for part in by_length(list(words)):
                    found[lang] += expected_counts(model, place[lang], part, np.array([words[w] for w in part], float))
        for lang, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), place[lang], np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "piece", "n"])

    return run


def _in_groups(model: PieceModel, texts: list[str], letters: int = 1 << 20) -> Iterator[tuple[np.ndarray, int]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size > letters:
            yield from model.scored(group)
            group, size = [], 0
    yield from model.scored(group)


def _predicted(held):
    def run(batches):
        languages = held.value[0]
        model = PieceModel(*held.value)
        for batch in batches:
            found, scores = [], []
            for likelihood, n in _in_groups(model, [t or "" for t in batch.column("text").to_pylist()]):
                if not n or not languages:
                    found.append("und")
                    scores.append(0.0)
                    continue
                best = int(np.argmax(likelihood))
                found.append(languages[best])
                # per character, so that a long text's score does not saturate at once
                scores.append(float(1 / np.exp((likelihood - likelihood[best]) / np.sqrt(n)).sum()))
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: PieceModel) -> DataFrame:
    """doc_id (any other columns but text, too), lang_pred and score (0 to 1) of every row's whole text.

    Texts that are null or have no letter are ``und`` with score 0; so are all texts if no language was learned.
    Equal likelihoods go to the language that is commonest in training.
    """
    pieces = sorted(model.row, key=model.row.get)
    keep = [f for f in docs.schema.fields if f.name not in ("text", "lang_pred", "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", lang_pred string, score double"
    return docs.select(*[F.col(f"`{f.name}`") for f in keep], "text").mapInArrow(_predicted(docs.sparkSession.sparkContext.broadcast((model.languages, pieces, model.p, model.unknown))), schema)
